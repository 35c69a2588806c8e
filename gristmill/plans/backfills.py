"""Queries of languages, grades and scores given after the fact, and of stored chapters, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import pages as P
from gristmill.functions import text as T
from gristmill.operators import backfill, chapters, languages
from gristmill.operators.cohorts import fit_groups
from gristmill.plans.registry import query as _query
from gristmill.session import dealt, place, table

_AS_OF = "1998-06-01 00:00:00"


def _now():  # noqa: ANN202
    return F.to_timestamp(F.lit(_AS_OF))


# --- languages

_WORDS = r"(SELECT {key}, w, count(*) AS c FROM (SELECT {key}, unnest(string_split(regexp_replace(lower({text}), '[^\p{{L}}]+', ' ', 'g'), ' ')) AS w FROM {table}) WHERE w <> '' GROUP BY {key}, w)"
_GRAMS = "(SELECT {key}, gram, sum(c) AS c FROM (SELECT {key}, c, unnest(list_transform(range(1, length(w) + 1), lambda i: substr(' ' || w || ' ', i, 3))) AS gram FROM {words}) GROUP BY {key}, gram)"


def _grams_sql(rows: str, key: str, text: str) -> str:
    return _GRAMS.format(key=key, words=_WORDS.format(key=key, text=text, table=rows))


def _told_sql(rows: str, key: str, text: str) -> str:
    """key, lang: the answer of the model of all labelled documents."""
    return f"""(WITH g AS (SELECT lang, gram, c FROM {_grams_sql("(SELECT lang, text FROM documents WHERE lang IS NOT NULL)", "lang", "text")}), v AS (SELECT 0.5 * count(DISTINCT gram) AS v FROM g), t AS (SELECT lang, sum(c) + v AS total FROM g, v GROUP BY lang, v),
a AS (SELECT {key}, gram, c FROM {_grams_sql(f"(SELECT * FROM {rows} WHERE length(trim({text})) >= 50)", key, text)}), n AS (SELECT {key}, sum(c) AS n FROM a GROUP BY {key}),
w AS (SELECT a.{key}, g.lang, sum(a.c * ln((g.c + 0.5) / 0.5)) AS w FROM a JOIN g USING (gram) GROUP BY a.{key}, g.lang)
SELECT {key}, arg_min(lang, (-score, lang)) AS lang FROM (SELECT n.{key}, t.lang, round(coalesce(w, 0) + n * ln(0.5 / total), 9) AS score FROM n CROSS JOIN t LEFT JOIN w ON w.{key} = n.{key} AND w.lang = t.lang) GROUP BY {key})"""


@_query(f"SELECT doc_id, m.lang AS told, m.lang IS NOT DISTINCT FROM d.lang AS right_ FROM documents d JOIN {_told_sql('documents', 'doc_id', 'text')} m USING (doc_id)")
def lang_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text by trigrams, beside the one it is said to have."""
    d = table(spark, sf_dir, "documents")
    told = languages.told(d, languages.profiles(d), "doc_id", "text").select("doc_id", F.col("lang").alias("told"))
    return d.select("doc_id", "lang").join(told, "doc_id").select("doc_id", "told", F.col("told").eqNullSafe(F.col("lang")).alias("right_"))


_VISIBLE = "(SELECT page_id, trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<title>.*?</title>|<script>.*?</script>|<style>.*?</style>|<!--.*?-->|<[^>]*>', ' ', 'gs'), '&amp;?', '&', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', chr(34)), '\\s+', ' ', 'g')) AS visible FROM pages WHERE page_id % 4 > 1)"


@_query(f"""SELECT p.page_id, CASE p.page_id % 4 WHEN 0 THEN lower(regexp_extract(html, '<html[^>]*\\slang="([A-Za-z-]+)', 1))[1:2] WHEN 1 THEN 'de' ELSE coalesce(m.lang, 'en') END AS lang FROM pages p LEFT JOIN {_told_sql(_VISIBLE, 'page_id', 'visible')} m USING (page_id)""")
def lang_from_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tier on some pages: the attribute, a header, and the visible text of pages that have neither."""
    i = F.col("page_id") % 4
    html = F.when(i == 0, F.col("html")).otherwise(F.regexp_replace("html", r'<html[^>]*\slang="[A-Za-z-]+"', '<html class="x"'))
    p = P.spread(table(spark, sf_dir, "pages")).withColumn("html", html)
    visible = p.where("page_id % 4 > 1").select("page_id", P.parsed_page("html")["visible"].alias("visible"))
    told = languages.told(visible, languages.profiles(table(spark, sf_dir, "documents")), "page_id", "visible").select("page_id", F.col("lang").alias("_told"))
    return p.join(told, "page_id", "left").select("page_id", T.language_of(F.col("html"), F.when(i == 1, " DE-at, en"), F.col("_told")).alias("lang"))


# --- grades

_FITS = "(SELECT l_suppkey * 5 AS dish, count(*) AS n, regr_slope(l_extendedprice / 1000, l_quantity) AS m, regr_intercept(l_extendedprice / 1000, l_quantity) AS b, greatest(sqrt(greatest(regr_syy(l_extendedprice / 1000, l_quantity) - pow(regr_sxy(l_extendedprice / 1000, l_quantity), 2) / regr_sxx(l_extendedprice / 1000, l_quantity), 0) / count(*)), 0.5) AS s FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY l_suppkey HAVING count(*) >= 25)"
_SCORE = "((CASE WHEN vec_id % 13 <> 0 THEN 20 + vec_id % 60 END) - (m * (CASE WHEN vec_id % 7 <> 0 THEN vec_id % 50 END) + b)) / s * 10 + 75"


@_query(f"""WITH d AS (SELECT vec_id AS dish, label AS chapter, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id % 5 = 0), r AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id % 5 <> 0), f AS (SELECT * FROM {_FITS}),
c AS (SELECT vec_id, dish, label = chapter AS narrow, list_distance(r.e, d.e) AS distance FROM r CROSS JOIN d),
b AS (SELECT vec_id, arg_min(dish, (distance, dish)) FILTER (narrow) AS nm, 1 - pow(min(distance) FILTER (narrow), 2) / 2 AS ns, arg_min(dish, (distance, dish)) AS wm, 1 - pow(min(distance), 2) / 2 AS ws FROM c GROUP BY vec_id),
x AS (SELECT r.vec_id, vec_id % 11 = 0 AS graded, vec_id % 7 = 0 OR vec_id % 13 = 0 AS bare, CASE WHEN vec_id % 4 = 1 THEN vec_id - vec_id % 5 END AS own, CASE WHEN ns >= 0.25 THEN nm WHEN ws >= 0.25 THEN wm END AS near, CASE WHEN ns >= 0.25 THEN 'narrow' WHEN ws >= 0.25 THEN 'wide' END AS scope FROM r JOIN b USING (vec_id)),
y AS (SELECT x.*, o.dish IS NOT NULL AS has_own, n.dish IS NOT NULL AS has_near, coalesce(o.m, n.m) AS m, coalesce(o.b, n.b) AS b, coalesce(o.s, n.s) AS s FROM x LEFT JOIN f o ON o.dish = own LEFT JOIN f n ON n.dish = near),
z AS (SELECT *, CASE WHEN graded THEN 'already' WHEN bare THEN 'skipped-no-da-pa' WHEN has_own THEN 'graded-explicit' WHEN has_near THEN 'graded-embed' ELSE 'no-match' END AS status FROM y)
SELECT vec_id AS id, status, CASE WHEN status LIKE 'graded%' THEN round({_SCORE}, 2) END AS score, CASE status WHEN 'graded-explicit' THEN own WHEN 'graded-embed' THEN near END AS matched_dish, CASE status WHEN 'graded-explicit' THEN 'explicit' WHEN 'graded-embed' THEN 'embedding-match-' || scope END AS match_method FROM z""")
def graded_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth vector is a dish, some of them with a fit; all others are rows that look for one. All five statuses occur."""
    v, k = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    points = table(spark, sf_dir, "lineitem").where("l_suppkey % 3 <> 0").select((F.col("l_suppkey") * 5).alias("dish"), F.col("l_quantity").alias("da"), (F.col("l_extendedprice") / 1000).alias("pa"))
    fits = fit_groups(points, ["dish"], models=("linear",)).where("used").select("dish", F.struct("model", "coefficients", "sigma_effective", "sigma_observed", "n").alias("fit"))
    dishes = v.where("vec_id % 5 = 0").select(k.alias("dish"), F.col("label").alias("chapter"), "embedding")
    rows = v.where("vec_id % 5 <> 0").select(k.alias("id"), (k % 11 == 0).alias("graded"), F.when(k % 7 != 0, (k % 50).cast("double")).alias("da"), F.when(k % 13 != 0, (20 + k % 60).cast("double")).alias("pa"), F.when(k % 4 == 1, k - k % 5).alias("dish"), F.col("label").alias("chapter"), "embedding")
    return backfill.graded_rows(rows, fits, dishes, least=0.25).select("id", "status", "grade.score", "matched_dish", "match_method")


# --- scores of URL groups

@_query("""WITH d AS (SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN NULL ELSE 'p' || (doc_id % 97) END AS page FROM documents), s AS (SELECT 'p' || i AS page, i FROM range(97) t(i) WHERE i % 4 <> 0)
SELECT doc_id AS id, CASE WHEN i IS NULL THEN CASE WHEN doc_id % 2 = 0 THEN 10.0 END ELSE i END AS pa, CASE WHEN i IS NOT NULL THEN i / 2 END AS da, CASE WHEN doc_id % 3 = 0 THEN 'kept' WHEN i IS NOT NULL AND i % 5 <> 0 THEN 'new ' || i END AS raw_title, CASE WHEN doc_id % 2 = 0 THEN 'a.example' END AS root, 'x' || doc_id AS name,
CASE WHEN page IS NULL THEN NULL ELSE (SELECT count(*) FROM d e WHERE e.page = d.page) END AS page_rows, CASE WHEN page IS NULL THEN NULL ELSE (SELECT count(*) FROM d e WHERE e.page = d.page AND i IS NOT NULL AND (e.doc_id % 2 <> 0 OR i <> 10)) END AS moved FROM d LEFT JOIN s USING (page)""")
def rescored_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of pages that one to many share, scored anew: every patched field and what stays, and how many rows of each page moved."""
    i, lit = F.col("doc_id"), F.lit
    page = (i % 97).cast("string")
    url = F.when(i % 10 == 0, F.when(i % 20 == 0, "").otherwise("our own")).otherwise(F.concat(F.when(i % 2 == 0, "http://www.a.example:80/p").otherwise("http://A.example/p"), page, F.when(i % 3 == 0, "/").otherwise("?utm_source=x")))
    scoring = F.struct(F.when(i % 2 == 0, lit(10.0)).alias("pageAuthority"), F.when(i % 3 == 0, "kept").when(i % 3 == 1, "").alias("rawTitle"), F.when(i % 2 == 0, "a.example").alias("rootDomain"))
    data = F.to_variant_object(F.struct(F.concat(lit("x"), i.cast("string")).alias("name"), F.struct(url.alias("originalUrl")).alias("_source"), F.when(i % 6 != 5, scoring).alias("_scoring")))
    rows = dealt(table(spark, sf_dir, "documents").select(i)).select(i.alias("id"), data.alias("data"))
    n = F.col("id")
    scores = spark.range(97).where("id % 4 <> 0").select(F.concat(lit("http://a.example/p"), n.cast("string")).alias("url_key"), n.cast("double").alias("pa"), (n / 2).alias("da"), (n / 3).alias("ou"), F.when(n % 5 != 0, F.concat(lit("new "), n.cast("string"))).otherwise("").alias("raw_title"))
    out, at = backfill.with_group_changes(backfill.rescored(rows, scores)), lambda path, t="string": F.try_variant_get("data", path, t)
    return out.select("id", at("$._scoring.pageAuthority", "double").alias("pa"), at("$._scoring.domainAuthority", "double").alias("da"), F.nullif(at("$._scoring.rawTitle"), lit("")).alias("raw_title"), at("$._scoring.rootDomain").alias("root"), at("$.name").alias("name"), F.col("rows").alias("page_rows"), "moved")


# --- stored chapters

@_query(f"""WITH p AS (SELECT p_brand AS chapter, l_quantity AS da, l_extendedprice / 1000 AS pa, l_orderkey * 10 + l_linenumber AS id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand NOT LIKE '%1' AND (p_brand NOT LIKE '%2' OR l_orderkey % 2000 = 1)),
f AS (SELECT chapter, count(*) AS n, regr_r2(pa, da) AS r2 FROM p GROUP BY chapter), r AS (SELECT chapter, id, pa, row_number() OVER (PARTITION BY chapter ORDER BY pa DESC, id) AS i FROM p), t AS (SELECT chapter, string_agg(id::VARCHAR, ',' ORDER BY i) AS ids FROM r WHERE i <= 10 GROUP BY chapter)
SELECT name, CASE WHEN name LIKE '%3' THEN 'never' WHEN n >= 25 THEN 'graded' WHEN n IS NOT NULL THEN 'below_min_n' ELSE 'never' END AS fit_status, CASE WHEN name LIKE '%4' THEN '' ELSE coalesce(ids, '') END AS top, n AS fit_recipe_count, CASE WHEN n >= 25 AND name NOT LIKE '%3' THEN round(r2, 6) END AS r2, CASE WHEN name LIKE '%5' OR name LIKE '%1' THEN 'note ' || name WHEN name LIKE '%2' THEN 'old' END AS notes, live AS current_recipe_count, n IS NOT NULL OR name LIKE '%1' OR name LIKE '%2' OR name LIKE '%5' AS known
FROM (SELECT p_brand AS name, count(*) AS live FROM part GROUP BY 1) LEFT JOIN f ON chapter = name LEFT JOIN t ON t.chapter = name""")
def chapter_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters are fitted and stored with notes, stored again over a refit, damaged, and read: malformed parts as missing, notes as they were, counts as they are now."""
    part = table(spark, sf_dir, "part")
    points = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("name"), F.col("l_quantity").alias("da"), (F.col("l_extendedprice") / 1000).alias("pa"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("o"))
    points = points.where("name not like '%1' and (name not like '%2' or o % 2000 = 1)")
    names = part.select(F.col("p_brand").alias("name")).distinct()
    stored = spark.createDataFrame([], "name string, last_ou_fit string, fit_recipe_count long, fit_updated_at timestamp, top_recipes string, notes string")
    notes = names.where("name like '%5' or name like '%1'").select("name", F.concat(F.lit("note "), "name").alias("notes")).unionByName(names.where("name like '%2'").select("name", F.lit("old").alias("notes")))
    stored = chapters.with_notes(stored, notes, _now())
    best = points.select("name", "id", F.lit("t").alias("title"), F.col("pa").alias("ou"))
    for used in (points.where("o % 2 = 0"), points):  # a first fit of a part, then the whole
        at = place(spark, "chapters")
        fits = fit_groups(used, ["name"], models=("linear",))
        chapters.refreshed(stored, fits, best, _now()).write.parquet(at)
        stored = spark.read.parquet(at)
    damaged = stored.withColumn("last_ou_fit", F.when(F.col("name").like("%3"), F.left("last_ou_fit", F.lit(12))).otherwise(F.col("last_ou_fit"))).withColumn("top_recipes", F.when(F.col("name").like("%4"), "{broken").otherwise(F.col("top_recipes")))
    told = chapters.details(names, damaged, part.select(F.col("p_brand").alias("chapter")))
    ids = F.array_join(F.transform("top", lambda t: t["id"].cast("string")), ",")
    return told.select("name", "fit_status", ids.alias("top"), "fit_recipe_count", F.round("fit.r2", 6).alias("r2"), "notes", "current_recipe_count", "known")


