"""The candidate funnel: merge, filter with reasons, floor, rank, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.urls import block_reason, normalize_url


def merged_candidates(rows: DataFrame, url: str = "url", query: str = "query", rank: str = "rank", title: str = "title", seq: str = "seq", group: tuple[str, ...] = ()) -> DataFrame:
    """One row for each normalised URL (of each group): url_key, url (of the first row by seq), queries, best_rank, title (the longest, the first of equals), n, seq (the first).

    A grouped aggregate, combined before the shuffle. Of a URL only its different queries are gathered, in order of their first seq; they are as many as a dish has. Null ranks count as no rank, null titles as empty.
    """
    key = F.when(normalize_url(F.col(url)) == "", F.col(url)).otherwise(normalize_url(F.col(url)))
    name = F.coalesce(F.col(title), F.lit(""))
    keys, by = [*group, "url_key"], F.struct(F.length("_name").alias("l"), -F.col("_seq"))
    one = rows.select(*group, key.alias("url_key"), F.col(url).alias("_url"), F.col(query).alias("_query"), F.col(rank).alias("_rank"), name.alias("_name"), F.col(seq).alias("_seq"))
    # a row for each URL and query first
    one = one.groupBy(*keys, "_query").agg(F.min_by("_url", "_seq").alias("_url"), F.min("_seq").alias("_first"), F.min("_rank").alias("_rank"), F.max(F.struct(by.alias("by"), "_name")).alias("_title"), F.count("*").alias("_n"))
    held = F.transform(F.array_sort(F.collect_list(F.struct(F.col("_first").alias("s"), F.col("_query").alias("q")))), lambda x: x["q"])
    return one.groupBy(*keys).agg(F.min_by("_url", "_first").alias("url"), held.alias("queries"), F.min("_rank").alias("best_rank"), F.max("_title")["_name"].alias("title"), F.sum("_n").alias("n"), F.min("_first").alias("seq"))


def blocked(rows: DataFrame, url: str = "url", **lists: list[str]) -> DataFrame:
    """rows with drop_reason; null for those that stay."""
    return rows.withColumn("drop_reason", block_reason(F.col(url), **lists))


def floored(rows: DataFrame, ou: str = "ou", least: float = 0.0) -> DataFrame:
    return rows.where(F.coalesce(F.col(ou) >= least, F.lit(False)))


def kept_by_tree(fetched: Column, structured: Column, language: Column, plausible: Column, score: Column, least: int = 7) -> Column:
    """Why a page is no candidate, or null: not fetched; structured data always stays; foreign text must have a plausible translation; else the phrase score decides."""
    return F.when(~fetched, F.lit("fetch-failed")).when(structured, F.lit(None).cast("string")).when((F.lower(F.substring(language, 1, 2)) != "en") & ~F.coalesce(plausible, F.lit(False)), F.lit("translation-suspect")).when(score < least, F.lit("low-score"))


def top_n(rows: DataFrame, n: int, group: list[str], ou: str = "ou", seq: str = "seq") -> DataFrame:
    """The n best of each group with rank from 1: highest ou first, nulls last, ties by seq."""
    w = Window.partitionBy(*group).orderBy(F.col(ou).desc_nulls_last(), F.col(seq))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def bar_to_beat(ranked: DataFrame, group: list[str], ou: str = "ou") -> DataFrame:
    """The ou of each group's last ranked row."""
    return ranked.groupBy(*group).agg(F.max_by(ou, "rank").alias("bar"))


def best_authority(answers: DataFrame, key: str, seq: str = "seq", within: Column | None = None) -> DataFrame:
    """Of each key's answers the one to trust: crawled pages (200, 301, 302) before estimates (402) before all else, then the highest pa (null as 0), then the first.

    within: what takes the place of pa among answers of one tier, such as a pa that loses by the place of its answer; of equals still the first.
    """
    tier = F.when(F.col("http_code").isin(200, 301, 302), 2).when(F.col("http_code") == 402, 1).otherwise(0)
    return answers.groupBy(key).agg(F.max_by(F.struct("pa", "da", "title", "http_code"), F.struct(tier, F.coalesce("pa", F.lit(0.0)) if within is None else within, -F.col(seq))).alias("x")).select(key, "x.*")


def stage_counts(rows: DataFrame, reason: str = "drop_reason", stages: list[str] | None = None) -> DataFrame:
    """Rows by drop reason's stage (the part before a colon), in one pass; kept ones as `kept`."""
    return rows.groupBy(F.coalesce(F.regexp_extract(reason, "^([^:]*)", 1), F.lit("kept")).alias("stage")).agg(F.count("*").alias("n"))


def accepted(rows: DataFrame, url: str = "url", status: str = "status", rank: str = "rank") -> DataFrame:
    """Accepted http(s) rows by rank; rows without one come last."""
    return rows.where(F.col(url).rlike("^https?://") & (F.col(status) == "accepted")).orderBy(F.coalesce(rank, F.lit(9999)))
