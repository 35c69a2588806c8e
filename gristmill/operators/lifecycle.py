"""Changes of stored rows as functions from tables to tables: jobs, rejects, dishes, URL metadata, vectors, enrichment. Time is an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.documents import text_at
from gristmill.functions.urls import normalize_url, root_domain
from gristmill.operators.state import is_stale

STATUSES = ["new", "recovered", "skipped", "unreachable"]


def overlaid(rows: DataFrame, changes: DataFrame, keys: list[str], **values: Column) -> DataFrame:
    """rows with these values where changes has a row of their keys (its columns as `c.<name>`); other rows as they are. changes has a key once."""
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    j = rows.alias("r").join(changes.withColumn("_there", F.lit(True)).alias("c"), on, "left")
    there = F.col("c._there")
    return j.select(*[F.when(there, values[c]).otherwise(F.col(f"r.{c}")).alias(c) if c in values else F.col(f"r.{c}") for c in rows.columns])


def marked(rejects: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """Rejects that a user decided on: changes (id, status, notes) with one of STATUSES, an error otherwise; blank notes are null."""
    status = F.when(F.col("c.status").isin(STATUSES), F.col("c.status")).otherwise(F.raise_error(F.concat(F.lit("no such status: "), F.coalesce(F.col("c.status"), F.lit("null")))).cast("string"))
    return overlaid(rejects, changes, ["id"], status=status, notes=F.nullif(F.col("c.notes"), F.lit("")), marked_at=as_of)


def enqueued(jobs: DataFrame, new: DataFrame, as_of: Column) -> DataFrame:
    """jobs and the new ones (id, type, params, entity_ref, scheduled_at) as queued, made now."""
    types = dict(jobs.dtypes)
    held = new.withColumn("status", F.lit("queued")).withColumn("created_at", as_of)
    return jobs.unionByName(held.select(*[(F.col(c) if c in held.columns else F.lit(None)).cast(types[c]).alias(c) for c in jobs.columns]))


def started(jobs: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    """The given jobs (id, log_filename) run from now on."""
    return overlaid(jobs, ids, ["id"], status=F.lit("running"), started_at=as_of, log_filename=F.col("c.log_filename"))


def finished(jobs: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """The given jobs (id, status, result, error_detail) are over."""
    return overlaid(jobs, results, ["id"], status=F.col("c.status"), finished_at=as_of, result=F.col("c.result"), error_detail=F.col("c.error_detail"))


def drained(jobs: DataFrame, ids: list[object]) -> DataFrame:
    """Of the asked jobs those that are still queued, oldest first."""
    return jobs.where(F.col("id").isin(ids) & (F.col("status") == "queued")).orderBy("created_at", "id")


def checked_dish(name: Column, queries: Column, top_n: Column, ttl_days: Column, notes: Column) -> Column:
    """A payload for a new dish: error (null if it is good) and its trimmed fields. A null ttl means by hand only, other numbers must be positive."""
    clean = F.filter(F.transform(queries, lambda q: F.trim(q)), lambda q: q.isNotNull() & (q != ""))
    error = F.when(F.trim(F.coalesce(name, F.lit(""))) == "", "name is required").when(F.coalesce(F.size(clean), F.lit(0)) <= 0, "queries must hold a text").when(top_n <= 0, "top_n must be positive").when(ttl_days <= 0, "refresh_ttl_days must be positive or null")
    return F.struct(error.alias("error"), F.trim(name).alias("name"), clean.alias("queries"), F.coalesce(top_n, F.lit(10)).alias("top_n"), ttl_days.alias("refresh_ttl_days"), F.nullif(F.trim(notes), F.lit("")).alias("notes"))


def created_dishes(dishes: DataFrame, new: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """dishes with the new ones (name, queries, top_n, refresh_ttl_days, notes, seq), and those that were refused with their error.

    A name that is taken, whatever its case, or that an earlier row (by seq) brings is refused.
    """
    c = new.withColumn("_x", checked_dish(F.col("name"), F.col("queries"), F.col("top_n"), F.col("refresh_ttl_days"), F.col("notes"))).withColumn("_k", F.lower("_x.name"))
    first = c.where("_x.error is null").groupBy("_k").agg(F.min("seq").alias("_first"))
    taken = dishes.select(F.lower("name").alias("_k"), F.lit(True).alias("_taken")).distinct()
    c = c.join(taken, "_k", "left").join(first, "_k", "left").withColumn("error", F.coalesce("_x.error", F.when(F.coalesce("_taken", F.lit(False)) | (F.col("seq") > F.col("_first")), F.lit("name is taken"))))
    types = dict(dishes.dtypes)
    good = c.where("error is null").select("_x.*").withColumn("created_at", as_of).withColumn("updated_at", as_of)
    return dishes.unionByName(good.select(*[(F.col(x) if x in good.columns else F.lit(None)).cast(types[x]).alias(x) for x in dishes.columns])), c.where("error is not null").select("seq", "error")


def deleted_dishes(dishes: DataFrame, rejects: DataFrame, vectors: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """dishes, their rejects and their vectors without the given names; dishes and vectors are told apart without regard to case."""
    gone = names.where("name is not null").select(F.lower("name").alias("_k")).distinct()
    without = lambda df, c: df.join(gone, F.lower(df[c]) == F.col("_k"), "left_anti")
    return without(dishes, "name"), without(rejects, "dish_name"), without(vectors, "name")


def run_stamped(dishes: DataFrame, runs: DataFrame, as_of: Column) -> DataFrame:
    """The outcome of each dish's last run (name, status, count, ou_fit, bottom_ou, log_filename): nulls overwrite what an earlier run left, but for the log."""
    return overlaid(dishes, runs, ["name"], last_refreshed=as_of, last_run_status=F.col("c.status"), last_run_count=F.col("c.count"), last_ou_fit=F.col("c.ou_fit"), last_run_bottom_ou=F.col("c.bottom_ou"), last_run_log=F.coalesce("c.log_filename", "r.last_run_log"), updated_at=as_of)


def without_kind(rows: DataFrame, dishes: DataFrame, kind: str, doc: str = "doc") -> DataFrame:
    """rows less those whose document (VARIANT) says that they are this kind of one of the dishes; all other rows, those that say nothing included, stay."""
    d, k = text_at(F.col(doc), "$._master.dish"), text_at(F.col(doc), "$._master.kind")
    return rows.join(dishes.select(F.col("dish").alias("_d")).distinct(), (d == F.col("_d")) & (k == kind), "left_anti")


def url_metadata(store: DataFrame, asked: DataFrame, scores: DataFrame, as_of: Column, days: float = 30) -> DataFrame:
    """The metadata table after some URLs were asked for: url, root_domain, title, pa, da, scored_at, first_seen, last_accessed.

    asked: url, title, seq. A new URL comes in with its first title; one that is there keeps its rows and is marked as accessed. New ones and those that were scored
    longer than `days` ago (never, if days is 0) take the scores (url, pa, da, title) if there are any; else the old ones stay, and so does the title for a blank one. A URL that normalises to nothing is left out.
    """
    a = asked.withColumn("url", normalize_url(F.col("url"))).where("url <> ''").groupBy("url").agg(F.min_by("title", "seq").alias("_title")).withColumn("_asked", F.lit(True))
    s = scores.select(normalize_url(F.col("url")).alias("url"), F.struct("pa", "da", "title").alias("_s"))
    j = store.withColumn("_old", F.lit(True)).join(a, "url", "full_outer").join(s, "url", "left")
    asked_now, old = F.col("_asked").isNotNull(), F.col("_old").isNotNull()
    wanted = asked_now & F.col("_s").isNotNull() & (~old | (is_stale(F.col("scored_at"), days, as_of) if days > 0 else F.lit(False)))
    title = F.when(old, F.col("title")).otherwise(F.coalesce("_title", F.lit("")))
    return j.select(
        "url",
        F.coalesce("root_domain", root_domain(F.col("url"))).alias("root_domain"),
        F.when(wanted & (F.coalesce("_s.title", F.lit("")) != ""), F.col("_s.title")).otherwise(title).alias("title"),
        *[F.when(wanted, F.col(f"_s.{c}")).otherwise(F.col(c)).alias(c) for c in ("pa", "da")],
        F.when(wanted, as_of).otherwise(F.col("scored_at")).alias("scored_at"),
        F.coalesce("first_seen", as_of).alias("first_seen"),
        F.when(asked_now, as_of).otherwise(F.col("last_accessed")).alias("last_accessed"),
    )


def fitting(vectors: DataFrame, dim: int, embedding: str = "embedding", strict: bool = False) -> DataFrame:
    """Vectors of `dim` components; others, and null ones, are left out, or an error if strict."""
    good = F.coalesce(F.size(embedding) == dim, F.lit(False))
    return vectors.where(F.when(good, F.lit(True)).otherwise(F.raise_error(F.lit(f"a vector has not {dim} components")).cast("boolean"))) if strict else vectors.where(good)


def upserted_vectors(index: DataFrame, new: DataFrame, dim: int, key: str = "id") -> DataFrame:
    """The index with new's vectors in place of those of the same key."""
    new = fitting(new, dim, strict=True)
    return index.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*index.columns))


def rebuilt_vectors(base: DataFrame, dim: int, doc: str = "doc") -> DataFrame:
    """The index from its base table (id, embedding, a VARIANT document): id, embedding, chapter, dish; rows without a fitting vector are not in it."""
    return fitting(base, dim).select("id", "embedding", text_at(F.col(doc), "$.classification.chapter").alias("chapter"), text_at(F.col(doc), "$._master.dish").alias("dish"))


def cascaded(index: DataFrame, base: DataFrame, key: str = "id") -> DataFrame:
    """The index without vectors whose row is no longer there, which is what a delete has to bring about."""
    return index.join(base.select(key).distinct(), key, "left_semi")


def with_defaults(entries: DataFrame, batch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each entry's own value, or its batch's."""
    b = batch.select(key, *[F.col(c).alias(f"_b_{c}") for c in columns])
    return entries.join(b, key, "left").withColumns({c: F.coalesce(c, f"_b_{c}") for c in columns}).drop(*[f"_b_{c}" for c in columns])


def merged_fields(block: Column, overlay: Column, fields: list[str]) -> Column:
    """A struct with the overlay's fields where they are there, else its own: keys are merged, the block isn't replaced."""
    return F.struct(*[F.coalesce(overlay[f], block[f]).alias(f) for f in fields])


def kept_if_empty(old: Column, new: Column) -> Column:
    """new, or old where new is null or empty."""
    return F.when(F.coalesce(new, F.lit("")) != "", new).otherwise(old)


def stamp_text(at: Column) -> Column:
    """A time in UTC as text, to the millisecond."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def reconciled(stored: DataFrame, wanted: DataFrame, renames: dict[str, str], key: str = "name") -> DataFrame:
    """name, new_name, action: what a registry has to do to become the wanted one: rename, drop, add or keep. A rename whose target isn't wanted is a drop."""
    to = F.create_map(*[F.lit(x) for kv in renames.items() for x in kv]) if renames else F.create_map().cast("map<string,string>")
    old = stored.select(F.col(key).alias("name")).distinct().withColumn("new_name", F.coalesce(F.try_element_at(to, F.col("name")), F.col("name")))
    new = wanted.select(F.col(key).alias("new_name")).distinct().withColumn("_w", F.lit(True))
    j = old.join(new, "new_name", "full_outer")
    action = F.when(F.col("name").isNull(), "add").when(F.col("_w").isNull(), "drop").when(F.col("name") != F.col("new_name"), "rename").otherwise("keep")
    return j.select("name", F.when(F.col("_w").isNotNull(), F.col("new_name")).alias("new_name"), action.alias("action"))


def promoted(own: DataFrame, master: DataFrame, ids: DataFrame, as_of: Column, static: list[str]) -> DataFrame:
    """The master rows that the given personal records (id) add: static fields alone, with where they come from; a record that was promoted before adds none."""
    new = own.join(ids.select("id").distinct(), "id", "left_semi").join(master.select(F.col("source_id").alias("id")), "id", "left_anti")
    return new.select(F.sha2(F.concat_ws(":", F.lit("master"), F.col("id").cast("string")), 256).alias("id"), F.lit(0).cast("long").alias("user_id"), F.col("id").alias("source_id"), F.col("user_id").alias("source_user_id"), as_of.alias("promoted_at"), *static)
