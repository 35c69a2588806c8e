"""Keyed state as functions from tables to tables. Time is an argument, never the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.documents import quality_gate, static_fields, text_at
from gristmill.functions.text import fingerprint
from gristmill.functions.urls import is_self_host
from gristmill.session import staged


def merged_by_key(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """old with new's rows in place of those of the same key; columns in `keep` hold their old values where there are any. Each side has a key once."""
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    there = F.col("n._new").isNotNull()
    n = new.withColumn("_new", F.lit(1)).alias("n")
    joined = o.join(n, on, "full_outer")
    pick = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in keys or c in keep else F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return joined.select(*[pick(c).alias(c) for c in old.columns])


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys that new has are replaced by new's."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def inserted_absent(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """old with those rows of new whose key it hasn't; of rows that repeat a key the first by `order` (a column of new, of old too if it is kept) comes in. Null keys are keys."""
    rest = [c for c in old.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_x")).select(*keys, "_x.*").alias("n")
    held = old.select(*keys).distinct().alias("o")
    return old.unionByName(first.join(held, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "left_anti").select(*old.columns))


def by_priority(keys: list[str], *sources: DataFrame) -> DataFrame:
    """The union of the sources with one row for each key, from the last source that has it. Each source has a key once; of rows that repeat one any may stay."""
    union = None
    for i, s in enumerate(sources):
        s = s.withColumn("_p", F.lit(i))
        union = s if union is None else union.unionByName(s)
    rest = [c for c in union.columns if c not in (*keys, "_p")]
    return union.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_p").alias("_x")).select(*keys, "_x.*")


def merged_rejects(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("dish_name", "url"), own: tuple[str, ...] = ("status", "notes", "marked_at", "created_at"), ran: DataFrame | None = None) -> DataFrame:
    """Rejects after another run: its dishes' untouched ones (`new`) go, marked ones stay with their notes and take new scores, all others come in as `new`.

    ran: the dishes that ran (the first of the keys), which may have no rejects; those of new if it isn't given. Rejects of other dishes stay as they are.
    old and new have the same columns but that new need not have those in `own`. A URL that a run names twice counts once, the last by rank.
    """
    scores = [c for c in old.columns if c not in (*keys, *own)]
    fresh = new.groupBy(*keys).agg(F.max_by(F.struct(*scores), "rank").alias("_n"), F.first("created_at").alias("_at") if "created_at" in new.columns else F.lit(None).alias("_at"))
    dishes = (new if ran is None else ran).select(keys[0]).distinct().withColumn("_ran", F.lit(True))
    stay = old.join(dishes, keys[0], "left").where(F.col("_ran").isNull() | ~F.col("status").eqNullSafe(F.lit("new")))
    j = stay.select(*keys, F.struct(*scores).alias("_o"), F.struct(*own).alias("_own")).join(fresh, list(keys), "full_outer")
    types = dict(old.dtypes)
    first = {"status": F.lit("new"), "created_at": F.col("_at")}
    return j.select(*keys, *[F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}")).alias(c) for c in scores], *[F.when(F.col("_own").isNotNull(), F.col(f"_own.{c}")).otherwise(first.get(c, F.lit(None)).cast(types[c])).alias(c) for c in own]).select(*old.columns)


def cache_status(requests: DataFrame, cache: DataFrame, keys: list[str], days: float, as_of: Column, at: str = "created_at") -> DataFrame:
    """requests with status: miss, fresh or stale (older than `days`), and the cached row's columns."""
    j = requests.join(cache, keys, "left")
    return j.withColumn("status", F.when(F.col(at).isNull(), "miss").when(is_stale(F.col(at), days, as_of), "stale").otherwise("fresh"))


def cache_answers(requests: DataFrame, cache: DataFrame, days: float, as_of: Column, model: str, version: str, hosts: list[str], url: str = "url_normalized") -> tuple[DataFrame, DataFrame]:
    """Both outputs of one look-up, from one pass over the requests that is written once: answers and journal entries.

    Answers: the requests with status (skip: no URL, or one of our own hosts; miss; stale; hit), value (of a hit) and prior_fingerprint (of a hit or a stale row).
    Journal: for each hit an entry of no tokens, so that what was saved can be counted. cache: url, model, version, value, fingerprint, created_at, a key once.
    """
    own = cache.where((F.col("model") == model) & (F.col("version") == version)).select(url, F.col("value").alias("_v"), F.col("fingerprint").alias("_f"), F.col("created_at").alias("_at"), F.lit(True).alias("_there"))
    skip = (F.coalesce(F.col(url), F.lit("")) == "") | is_self_host(F.col(url), hosts)
    # requests that ask nothing get keys that match nothing and differ, else all of them would meet in one task
    asked = requests.withColumn("_k", F.when(~skip, F.col(url)).otherwise(F.concat(F.lit("\0"), F.xxhash64(*requests.columns).cast("string"))))
    j = asked.join(own.withColumnRenamed(url, "_k"), "_k", "left")
    status = F.when(skip, "skip").when(F.col("_there").isNull(), "miss").when(is_stale(F.col("_at"), days, as_of), "stale").otherwise("hit")
    j = j.withColumn("status", status)
    meta = F.to_json(F.struct(F.col("_at").cast("string").alias("cached_at")))
    entry = F.struct(F.lit("cache_hit_markdown_to_recipe").alias("operation"), F.lit(model).alias("model"), F.lit(0).cast("long").alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"), meta.alias("meta"))
    hit = F.col("status") == "hit"
    out = staged(j.select(*[F.col(c) for c in requests.columns], "status", F.when(hit, F.col("_v")).alias("value"), F.when(F.col("status").isin("hit", "stale"), F.coalesce("_f", F.lit(""))).otherwise("").alias("prior_fingerprint"), F.when(hit, entry).alias("_entry")), "answers")
    return out.drop("_entry"), out.where("_entry is not null").select(*requests.columns, "_entry.*")


def cache_written(cache: DataFrame, extracts: DataFrame, model: str, version: str, hosts: list[str], as_of: Column, url: str = "url_normalized") -> tuple[DataFrame, DataFrame]:
    """The cache with new extracts, and what became of each: status (written, or skip: no URL, our own host, or a record that fails the gate) and drift (it is another one than before).

    extracts: url, data (VARIANT), prior_fingerprint, each URL once. What is kept of a record is what belongs to no owner.
    """
    at = lambda path: F.try_variant_get(F.col("data"), path, "array<string>")
    name, parts, steps = text_at(F.col("data"), "$.name"), at("$.recipeIngredient"), at("$.recipeInstructions")
    good = (F.coalesce(F.col(url), F.lit("")) != "") & ~is_self_host(F.col(url), hosts) & quality_gate(name, parts, steps)["ok"]
    told = extracts.withColumn("_good", F.coalesce(good, F.lit(False))).withColumn("fingerprint", F.when(F.col("_good"), fingerprint(name, parts, steps)))
    told = staged(told.withColumn("value", F.when(F.col("_good"), F.to_json(F.to_variant_object(static_fields(F.col("data")))))).drop("data"), "extracts")
    new = told.where("_good").select(url, F.lit(model).alias("model"), F.lit(version).alias("version"), "value", "fingerprint", as_of.alias("created_at"))
    keys = [url, "model", "version"]
    out = cache.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*cache.columns))
    return out, told.select(url, F.when(F.col("_good"), "written").otherwise("skip").alias("status"), F.coalesce(F.col("_good") & drifted(F.col("prior_fingerprint"), F.col("fingerprint")), F.lit(False)).alias("drift"))


def is_stale(at: Column, days: float, as_of: Column) -> Column:
    """Strictly older than `days`; null is stale."""
    return F.coalesce(at < as_of - F.make_dt_interval(secs=F.lit(days * 86400)), F.lit(True))


def is_due(last: Column, ttl_days: Column, as_of: Column) -> Column:
    """Never without a ttl; at once if never run; else when its age reaches the ttl."""
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(last.cast("timestamp"))) / F.lit(86400e6)
    return F.when(ttl_days.isNull(), F.lit(False)).when(last.isNull(), F.lit(True)).otherwise(age >= ttl_days)


def drifted(old_fingerprint: Column, new_fingerprint: Column) -> Column:
    """A fingerprint there was, and it is another one now."""
    return (F.coalesce(old_fingerprint, F.lit("")) != "") & ~old_fingerprint.eqNullSafe(new_fingerprint)


def stamped(rows: DataFrame, changed: DataFrame, key: str, as_of: Column, column: str = "source_changed_at") -> DataFrame:
    """rows whose key changed get the time where they have none yet."""
    c = changed.select(key).distinct().withColumn("_c", F.lit(True))
    return rows.join(c, key, "left").withColumn(column, F.when(F.col("_c"), F.coalesce(F.col(column), as_of)).otherwise(F.col(column))).drop("_c")


def next_ready(jobs: DataFrame, as_of: Column) -> DataFrame:
    """The oldest queued job that isn't scheduled for later."""
    return jobs.where((F.col("status") == "queued") & (F.col("scheduled_at").isNull() | (F.col("scheduled_at") <= as_of))).orderBy(F.col("created_at").asc_nulls_first(), "id").limit(1)


def in_flight(jobs: DataFrame, key: str = "entity_ref") -> DataFrame:
    """Each entity's newest job that is queued or running."""
    return jobs.where(F.col("status").isin("queued", "running")).groupBy(key).agg(F.max_by(F.struct("id", "status", "created_at"), F.struct("created_at", "id")).alias("_x")).select(key, "_x.*")


def reset_interrupted(jobs: DataFrame, as_of: Column) -> DataFrame:
    """What was running when the process ended is an error."""
    run = F.col("status") == "running"
    return jobs.withColumn("finished_at", F.when(run, as_of).otherwise(F.col("finished_at"))).withColumn("status", F.when(run, "error").otherwise(F.col("status")))


def adopted(rows: DataFrame, existing: DataFrame, id: str = "id", keys: tuple[str, ...] = ("url_normalized", "user_id")) -> DataFrame:  # noqa: A002
    """rows take the id of the record of the same URL and user, if there is one; an empty URL matches none."""
    e = existing.where(F.col(keys[0]) != "").groupBy(*keys).agg(F.min(id).alias("_e"))
    return rows.join(e, list(keys), "left").withColumn("adopted", F.col("_e").isNotNull()).withColumn(id, F.coalesce("_e", F.col(id))).drop("_e")


def orphans(rows: DataFrame, referenced: DataFrame, key: str) -> DataFrame:
    """Rows that nothing refers to; null keys are orphans."""
    return rows.join(referenced.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")


def claimed(source: DataFrame, own: DataFrame, user: int, as_of: Column) -> DataFrame:
    """Copies of records for a user who hasn't one of the same source yet: id, user_id, data, url_normalized (empty, so that no later change of the page reaches the copy), created_at, updated_at.

    source: id, user_id (0: the master collection), data (VARIANT); own: user_id, data. data keeps the fields that belong to no owner and is stamped with where it comes from.
    """
    have = own.where(F.col("user_id") == user).select(text_at(F.col("data"), "$._source.claimedFromRecipeId").alias("_id")).where("_id is not null").distinct()
    new = source.join(have, source["id"].cast("string") == have["_id"], "left_anti")
    where = F.when(F.col("user_id") == 0, F.lit("master")).otherwise(F.concat(F.lit("user:"), F.col("user_id").cast("string")))
    key = F.sha2(F.concat_ws(":", F.lit(str(user)), F.col("id").cast("string")), 256)
    fields = static_fields(F.col("data"), stamped={"claimedFrom": where, "claimedAt": as_of.cast("string"), "claimedFromRecipeId": F.col("id").cast("string")})
    fields = F.map_concat(fields, F.create_map(F.lit("id"), key.cast("variant")))
    return new.select(key.alias("id"), F.lit(user).cast("long").alias("user_id"), F.to_variant_object(fields).alias("data"), F.lit("").alias("url_normalized"), as_of.alias("created_at"), as_of.alias("updated_at"))


def patched(rows: DataFrame, values: dict[str, object], allowed: list[str], where: Column) -> DataFrame:
    """rows with new values where the condition holds; '' is null, and a field that isn't allowed is an error."""
    if unknown := sorted(set(values) - set(allowed)):
        raise ValueError(f"unknown fields: {', '.join(unknown)}")
    return rows.withColumns({c: F.when(where, F.lit(None if v == "" else v).cast(dict(rows.dtypes)[c])).otherwise(F.col(c)) for c, v in values.items()})


def latest(rows: DataFrame, keys: list[str], order: str, *ties: str) -> DataFrame:
    """Each key's last row by `order`, of equals the first by `ties`."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order), *ties)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
