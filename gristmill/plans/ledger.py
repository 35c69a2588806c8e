"""Queries of state that changes: streams played into keyed buckets, staged changes, typed input, cache look-ups with their journal, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gristmill.operators import changes, forms, state
from gristmill.plans.registry import query as _query
from gristmill.session import place, table
from gristmill.streaming.keyed import KeyedStore

_AS_OF = "1998-06-01 00:00:00"


def _now():  # noqa: ANN202
    return F.to_timestamp(F.lit(_AS_OF))


# --- streams

@_query("""SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max_by(value, (ts, event_id)) AS value, max(ts) AS ts, min(ts) AS first_ts, count(*) AS changes FROM events GROUP BY user_id""")
def played_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as a stream of six batches out of order, stopped halfway and taken up again: each user's newest event, first time and number of events."""
    events, feed, at = table(spark, sf_dir, "events"), place(spark, "feed"), place(spark, "users")
    parts = events.withColumn("batch", F.pmod(F.xxhash64("event_id"), F.lit(6)))
    rows = events.select("user_id", F.struct("ts", "event_id").alias("seen"), "event_type", "value")
    store = KeyedStore(spark, at, rows.schema, ["user_id"], "seen", buckets=16)
    for half in (0, 1):
        new = parts.where(F.pmod("batch", F.lit(2)) == half).repartition(3, "batch").drop("batch")
        new.write.mode("append").parquet(feed)
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(feed).select("user_id", F.struct("ts", "event_id").alias("seen"), "event_type", "value")
        store.follow(stream, f"{at}-checkpoint").awaitTermination()
    return store.read().select("user_id", "event_type", "value", F.col("seen.ts").alias("ts"), F.col("first_seen.ts").alias("first_ts"), "changes")


# --- staged changes

_OWN = "(SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE 'u' || (o_custkey % 400) END AS url, CASE o_orderstatus WHEN 'F' THEN 'batch ' || o_orderpriority WHEN 'P' THEN '' END AS batch, o_totalprice AS price, o_orderstatus <> 'O' AS candidate FROM orders)"
_MASTER = "(SELECT c_custkey + 10000000 AS id, 'u' || (c_custkey % 150) AS url, 'old' AS batch, c_acctbal AS price FROM customer WHERE c_custkey % 400 < 150)"


@_query(f"""WITH o AS (SELECT * FROM {_OWN}), m AS (SELECT * FROM {_MASTER}), g AS (SELECT * FROM o WHERE candidate AND batch <> ''), n AS (SELECT * FROM g WHERE url = '' OR url NOT IN (SELECT url FROM m))
SELECT 'master' AS side, id, url, batch, price FROM m UNION ALL SELECT 'master', id, url, batch, price FROM n
UNION ALL SELECT 'own', id, url, batch, price FROM o WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'refused', id, url, batch, price FROM o WHERE candidate AND batch = ''""")
def staged_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a batch go over to the master table: both tables' changes are planned, verified and applied, and rows without a batch name refused. A change that fails a check has left no trace."""
    k = F.col("o_custkey")
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("u"), (k % 400).cast("string"))).alias("url"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("batch "), "o_orderpriority")).when(F.col("o_orderstatus") == "P", "").alias("batch"), F.col("o_totalprice").alias("price"))
    c = F.col("c_custkey")
    master = table(spark, sf_dir, "customer").where("c_custkey % 400 < 150").select((c + 10000000).alias("id"), F.concat(F.lit("u"), (c % 150).cast("string")).alias("url"), F.lit("old").alias("batch"), F.col("c_acctbal").alias("price"))
    tables = {"own": changes.StagedTable(spark, place(spark, "own"), ["id"]), "master": changes.StagedTable(spark, place(spark, "master"), ["id"])}
    tables["own"].create(own)
    tables["master"].create(master)
    own, master = tables["own"].read(), tables["master"].read()
    gained, lost, refused = changes.moved_rows(own, master, F.col("batch").isNotNull(), F.col("batch") != "", "url")
    rest = F.struct("url", "batch", "price")
    none = F.lit(None).cast(master.select(rest.alias("x")).schema["x"].dataType)
    insert = gained.select("id", F.lit("insert").alias("action"), none.alias("before"), rest.alias("after"))
    delete = lost.select("id", F.lit("delete").alias("action"), rest.alias("before"), none.alias("after"))
    try:
        tables["own"].apply(delete, {"nobody is left": F.col("id") < 0})
    except changes.FailedCheck:
        pass
    tables["master"].apply(insert, {"named": F.col("batch") != ""})
    tables["own"].apply(delete, {"none of a batch": F.coalesce(F.col("batch") == "", F.lit(True))})
    out = [df.select(F.lit(side).alias("side"), "id", "url", "batch", "price") for side, df in (("master", tables["master"].read()), ("own", tables["own"].read()), ("refused", refused))]
    return out[0].unionByName(out[1]).unionByName(out[2])


@_query("""SELECT action, count(*) AS n, sum(coalesce(a, 0) - coalesce(b, 0))::BIGINT AS shift FROM (SELECT CASE WHEN o.k IS NULL THEN 'insert' WHEN n.k IS NULL THEN 'delete' WHEN o.v IS DISTINCT FROM n.v THEN 'update' END AS action, o.v AS b, n.v AS a
FROM (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS v FROM part WHERE p_partkey % 3 <> 0) o FULL JOIN (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 WHEN p_partkey % 7 <> 0 THEN p_size END AS v FROM part WHERE p_partkey % 4 <> 0) n ON o.k = n.k) WHERE action IS NOT NULL GROUP BY action""")
def dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would change between two states of a table, by action."""
    p, k, size = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    old = p.where("p_partkey % 3 <> 0").select(k.alias("k"), F.when(k % 7 != 0, size).alias("v"))
    new = p.where("p_partkey % 4 <> 0").select(k.alias("k"), F.when(k % 5 == 0, size + 1).when(k % 7 != 0, size).alias("v"))
    shift = F.coalesce(F.col("after.v"), F.lit(0)) - F.coalesce(F.col("before.v"), F.lit(0))
    return changes.planned(old, new, ["k"]).groupBy("action").agg(F.count("*").alias("n"), F.sum(shift).alias("shift"))


# --- typed input

_FORM = StructType([forms.field("status", "select", options=("O", "F", "P"), required=True), forms.field("price", "number"), forms.field("urgent", "bool", default="yes"), forms.field("note", "textarea", "Note"), forms.field("owner", "number", editable=False)])


@_query(r"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 < 3 THEN o_orderstatus END AS status, CASE o_orderkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN floor(o_totalprice)::BIGINT WHEN 3 THEN -1200 END AS price,
o_orderpriority = '1-URGENT' OR o_orderkey % 4 = 0 AS urgent, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END AS note, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS owner,
array_to_string(list_filter([CASE o_orderkey % 5 WHEN 3 THEN 'status=X: not one of O, F, P' WHEN 4 THEN 'status= : required' END, CASE o_orderkey % 6 WHEN 4 THEN 'price=12.5: not a whole number' WHEN 5 THEN 'price=' || o_orderpriority || ': not a whole number' END], lambda x: x IS NOT NULL), '; ') AS errors FROM orders""")
def coerced_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as a form sends them, as the types of its fields, with values of each kind that can't be taken."""
    k, text = F.col("o_orderkey"), lambda c: F.col(c).cast("string")
    sent = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 5 < 3, F.col("o_orderstatus")).when(k % 5 == 3, "X").otherwise(" ").alias("status"),
        F.when(k % 6 == 0, "").when(k % 6 == 2, F.floor("o_totalprice").cast("string")).when(k % 6 == 3, " -1_200 ").when(k % 6 == 4, "12.5").when(k % 6 == 5, F.col("o_orderpriority")).alias("price"),
        F.when(k % 4 == 0, F.element_at(F.array(*[F.lit(x) for x in (" Yes", "1", "on ", "TRUE")]), (k % 4 + 1).cast("int"))).when(F.col("o_orderpriority") == "1-URGENT", "true").when(k % 2 == 0, "no").alias("urgent"),
        F.when(k % 2 == 0, F.col("o_orderpriority")).alias("note"), F.when(k % 3 == 0, "none").otherwise(text("o_custkey")).alias("owner"))
    held = forms.coerced(sent, _FORM)
    told = F.array_join(F.transform("errors", lambda e: F.concat(e["field"], F.lit("="), e["value"], F.lit(": "), e["reason"])), "; ")
    return held.withColumn("errors", told)


@_query("""SELECT * FROM (VALUES (0, 'o_orderkey', 'number'), (1, 'o_custkey', 'number'), (2, 'o_orderstatus', 'text'), (3, 'o_totalprice', 'number'), (4, 'o_orderdate', 'number'), (5, 'o_orderpriority', 'text')) t(ord, name, kind), (SELECT count(*) AS n FROM orders)
UNION ALL SELECT * FROM (VALUES (10, 'status', 'select'), (11, 'price', 'number'), (12, 'urgent', 'bool'), (13, 'note', 'textarea'), (14, 'owner', 'number')) t(ord, name, kind), (SELECT count(*) AS n FROM orders)""")
def described_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of a table and of a form, beside the rows that the table has."""
    o = table(spark, sf_dir, "orders")
    both = forms.described(spark, o.schema).unionByName(forms.described(spark, _FORM).withColumn("ord", F.col("ord") + 10))
    return both.select("ord", "name", "kind").crossJoin(F.broadcast(o.agg(F.count("*").alias("n"))))


# --- the cache

_URL = "CASE WHEN page_id % 9 = 0 THEN '' WHEN page_id % 9 = 1 THEN 'https://www.own.example/r/' || page_id ELSE url END"
_STATUS = "CASE WHEN page_id % 9 < 2 THEN 'skip' WHEN page_id % 4 = 0 THEN 'miss' WHEN page_id % 4 = 1 THEN 'stale' ELSE 'hit' END"


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Look-ups of pages: some without a URL, some of our own host, and of the others some that are not there, old, or of another model."""
    i = F.col("page_id")
    p = table(spark, sf_dir, "pages")
    url = F.when(i % 9 == 0, "").when(i % 9 == 1, F.concat(F.lit("https://www.own.example/r/"), i.cast("string"))).otherwise(F.concat(F.col("url"), F.lit("#"), i.cast("string")))
    asked = p.select("page_id", url.alias("url_normalized"))
    held = p.select(F.concat(F.col("url"), F.lit("#"), i.cast("string")).alias("url_normalized"), F.when(i % 4 == 0, "other").otherwise("m1").alias("model"), F.lit("v1").alias("version"), F.sha2("html", 256).alias("value"), F.when(i % 8 != 5, F.concat(F.lit("f"), i.cast("string"))).alias("fingerprint"), F.when(i % 4 == 1, F.to_timestamp(F.lit("1998-04-01"))).otherwise(F.to_timestamp(F.lit("1998-05-20"))).alias("created_at"))
    return asked, held


@_query(f"SELECT page_id, {_STATUS} AS status, CASE WHEN {_STATUS} = 'hit' THEN sha256(html) END AS value, CASE WHEN {_STATUS} IN ('hit', 'stale') AND page_id % 8 <> 5 THEN 'f' || page_id ELSE '' END AS prior_fingerprint FROM pages")
def cache_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers of look-ups: skipped, missing, stale and served."""
    asked, held = _asked(spark, sf_dir)
    return state.cache_answers(asked, held, 30, _now(), "m1", "v1", ["own.example"])[0].select("page_id", "status", "value", "prior_fingerprint")


@_query(f"SELECT page_id, 'cache_hit_markdown_to_recipe' AS operation, 'm1' AS model, 0::BIGINT AS input_tokens, 0::BIGINT AS output_tokens, '{{\"cached_at\":\"1998-05-20 00:00:00\"}}' AS meta FROM pages WHERE {_STATUS} = 'hit'")
def cache_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal entries of the same look-ups: one of no tokens for each that was served."""
    asked, held = _asked(spark, sf_dir)
    return state.cache_answers(asked, held, 30, _now(), "m1", "v1", ["own.example"])[1].select("page_id", "operation", "model", "input_tokens", "output_tokens", "meta")


@_query("""SELECT url_normalized, status, drift, coalesce(value, '') AS value FROM (SELECT CASE WHEN doc_id % 6 = 0 THEN 'https://own.example/' || doc_id ELSE 'u' || doc_id END AS url_normalized, CASE WHEN doc_id % 6 < 2 THEN 'skip' ELSE 'written' END AS status, doc_id % 6 >= 2 AND doc_id % 4 IN (1, 2) AS drift,
CASE WHEN doc_id % 6 >= 2 THEN '{"name":' || to_json(source) || ',"recipeIngredient":["a","b","c"],"recipeInstructions":["x","y",' || to_json(lang) || ']}' END AS value FROM documents)""")
def cache_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracts that are written to the cache, with what is stored of them, and those that aren't; drift where a stale row's fingerprint was another."""
    i, lit = F.col("doc_id"), F.lit
    steps = F.when(i % 6 == 1, F.array(lit("x"))).otherwise(F.array(lit("x"), lit("y"), "lang"))
    data = F.to_variant_object(F.struct(F.col("source").alias("name"), F.array(*map(lit, "abc")).alias("recipeIngredient"), steps.alias("recipeInstructions"), i.alias("user_id")))
    from gristmill.functions.text import fingerprint

    same = fingerprint(F.col("source"), F.array(*map(lit, "abc")), steps)
    d = table(spark, sf_dir, "documents").select(F.when(i % 6 == 0, F.concat(lit("https://own.example/"), i.cast("string"))).otherwise(F.concat(lit("u"), i.cast("string"))).alias("url_normalized"), data.alias("data"), F.when(i % 4 == 0, "").when(i % 4 == 3, same).otherwise("other").alias("prior_fingerprint"))
    old = d.where("url_normalized like '%7'").select("url_normalized", lit("m1").alias("model"), lit("v1").alias("version"), lit("old").alias("value"), lit("other").alias("fingerprint"), _now().alias("created_at"))
    cache, told = state.cache_written(old, d, "m1", "v1", ["own.example"], _now())
    return told.join(cache.where("value <> 'old'").select("url_normalized", "value"), "url_normalized", "left").select("url_normalized", "status", "drift", F.coalesce("value", lit("")).alias("value"))


@_query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'error' ELSE 'queued' END AS status, CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '1998-06-01' END AS finished_at FROM customer")
def interrupted_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was running when the process ended is an error from now on."""
    k = F.col("c_custkey")
    jobs = table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 3 == 0, "running").otherwise("queued").alias("status"), F.lit(None).cast("timestamp").alias("finished_at"))
    return state.reset_interrupted(jobs, _now()).select("id", "status", "finished_at")


@_query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 2 = 1 THEN c_acctbal END AS balance FROM customer")
def patched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New values where a condition holds; an empty one is null."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    return state.patched(c, {"segment": "x", "balance": ""}, ["segment", "balance"], F.col("id") % 2 == 0)


