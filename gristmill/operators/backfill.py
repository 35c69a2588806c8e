"""Rows that are graded, scored or classified after the fact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.documents import text_at
from gristmill.functions.scores import exceptionalism
from gristmill.functions.stamps import patched_block
from gristmill.functions.urls import normalize_url
from gristmill.operators.vectors import best_match
from gristmill.session import staged


def graded_rows(rows: DataFrame, fits: DataFrame, dishes: DataFrame, least: float = 0.55, force: bool = False) -> DataFrame:
    """rows with status, grade, matched_dish and match_method, down a ladder: a grade that is there stays (already); without da or pa there is none (skipped-no-da-pa); the fit of the
    dish that the row names (graded-explicit); the fit of the nearest dish, first of its own chapter, then of all (graded-embed); else no-match.

    rows: id, graded, da, pa, dish, chapter, embedding; fits: dish, fit (struct of model, coefficients, sigma_effective, sigma_observed, n), used ones alone; dishes: dish, chapter, embedding.
    Only rows that the steps before left over look for a dish.
    """
    graded = F.lit(False) if force else F.coalesce(F.col("graded"), F.lit(False))
    own = staged(rows.join(fits.select("dish", F.col("fit").alias("_own")), "dish", "left").withColumn("_todo", ~graded & F.col("da").isNotNull() & F.col("pa").isNotNull()), "rows")
    asked = own.where("_todo and _own is null and embedding is not null").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"), F.col("chapter").alias("_chapter"))
    near = best_match(dishes, asked, ("chapter", "_chapter"), least=least, key="dish").where("match is not null").select(F.col("query_id").alias("id"), "match", "scope", "similarity")
    near = near.join(fits.select(F.col("dish").alias("match"), F.col("fit").alias("_near")), "match")
    j = own.join(near, "id", "left")
    fit = F.coalesce("_own", "_near")
    grade = F.when(F.col("_todo"), exceptionalism(F.col("pa"), F.col("da"), fit))
    status = F.when(graded, "already").when(~F.col("_todo"), "skipped-no-da-pa").when(grade.isNull(), "no-match").when(F.col("_own").isNotNull(), "graded-explicit").otherwise("graded-embed")
    method = F.when(F.col("_own").isNotNull(), F.lit("explicit")).otherwise(F.concat(F.lit("embedding-match-"), "scope"))
    got = status.startswith("graded")
    return j.withColumn("status", status).select(*rows.columns, "status", F.when(got, grade).alias("grade"), F.when(got, F.when(F.col("_own").isNotNull(), F.col("dish")).otherwise(F.col("match"))).alias("matched_dish"), F.when(got, method).alias("match_method"), F.when(got & F.col("_own").isNull(), F.col("similarity")).alias("confidence"))


def _keyed(rows: DataFrame) -> DataFrame:
    """rows with _k, their page to join by: rows without an address get keys that match nothing and differ."""
    return rows.withColumn("_k", F.coalesce("url_key", F.concat(F.lit("\0"), F.xxhash64("id").cast("string"))))


def rescored(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """rows (id, data) with url_key, old_pa, new_pa and, where their page was scored anew, data with the scores in `_scoring`; a raw title is only filled in where there is none.

    All rows of one page, by its normalised URL, take the same scores; rows without a web address, and pages without scores, stay as they are. scores: url_key, pa, da, ou, raw_title, a page once.
    """
    url = text_at(F.col("data"), "$._source.originalUrl")
    key = F.when(url.rlike("^https?://"), F.nullif(normalize_url(url), F.lit("")))
    held = _keyed(rows.withColumn("url_key", key))
    new = scores.select(F.col("url_key").alias("_k"), F.col("pa").alias("_pa"), F.col("da").alias("_da"), F.col("ou").alias("_ou"), F.col("raw_title").alias("_title"), F.lit(True).alias("_scored"))
    j = held.join(new, "_k", "left")
    title = F.when(F.coalesce(text_at(F.col("data"), "$._scoring.rawTitle"), F.lit("")) == "", F.nullif(F.col("_title"), F.lit("")))
    data = patched_block(F.col("data"), "_scoring", {"pageAuthority": F.col("_pa"), "domainAuthority": F.col("_da"), "ouScore": F.col("_ou"), "rawTitle": title})
    old = F.try_variant_get(F.col("data"), "$._scoring.pageAuthority", "double")
    return j.select("id", F.when(F.col("_scored"), data).otherwise(F.col("data")).alias("data"), "url_key", old.alias("old_pa"), F.when(F.col("_scored"), F.col("_pa")).otherwise(old).alias("new_pa"))


def group_changes(changed: DataFrame) -> DataFrame:
    """url_key, rows, moved: of each page that has an address, its rows and how many of them got another pa."""
    return changed.where("url_key is not null").groupBy("url_key").agg(F.count("*").alias("rows"), F.count_if(~F.col("old_pa").eqNullSafe(F.col("new_pa"))).alias("moved"))


def with_group_changes(changed: DataFrame) -> DataFrame:
    """changed with rows and moved of each row's page, null where it has none. Rows are worked out once, for their pages and for themselves; of pages the size is known before the join, so that rows of few pages stay where they are."""
    held = staged(changed, "rescored")
    told = staged(group_changes(held), "moved").withColumnRenamed("url_key", "_k")
    return _keyed(held).join(told, "_k", "left").drop("_k")
