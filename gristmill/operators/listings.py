"""Ordered listings. Those by group carry `position`, from 1; those of a whole table are sorted, and take a limit where a page is meant."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators.state import is_due, is_stale
from gristmill.session import staged


def placed(rows: DataFrame, group: list[str], *order: Column) -> DataFrame:
    """rows with `position`, from 1, in this order within each group (none: of the whole table).

    Rows are sorted by ranges of group and order, so that neither a whole table nor a large group meets in one task; a row's number is its place in
    its range and the counts of the ranges before it, less the number that its group begins with.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*[F.col(g).asc_nulls_first() for g in group], *order]
    held = staged(rows, "unplaced")  # else rows are computed once more for the ranges' bounds
    held = staged(held.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "placed")
    held = held.withColumn("_part", F.shiftright("_at", 33))
    counts = held.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    held = held.join(F.broadcast(before), "_part").withColumn("position", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_at", "_before")
    if not group:
        return held
    first = held.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]).agg((F.min("position") - 1).alias("_first"))
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    return held.join(first, functools.reduce(lambda a, b: a & b, same)).withColumn("position", F.col("position") - F.col("_first")).drop("_first", *[f"_g{i}" for i in range(len(group))])


def rejects(rows: DataFrame, group: str = "dish_name", id: str = "id") -> DataFrame:  # noqa: A002
    """A group's rejects: those nobody has looked at (`new`) first, then by ou, nulls last, then by id."""
    return placed(rows, [group], F.when(F.col("status") == "new", 0).otherwise(1), F.col("ou").desc_nulls_last(), F.col(id))


def would_qualify(rows: DataFrame, bars: DataFrame, group: str = "dish_name") -> DataFrame:
    """rows with would_qualify: ou reaches the bar of the group's last run; not where either is missing."""
    return rows.join(bars.select(group, "bar"), group, "left").withColumn("would_qualify", F.coalesce(F.col("ou") >= F.col("bar"), F.lit(False)))


def top_list(rows: DataFrame, group: list[str], rank: Column, id: str = "id") -> DataFrame:  # noqa: A002
    """A group's stored winners by rank, those without one first, then by id."""
    return placed(rows.withColumn("rank", rank), group, F.col("rank").asc_nulls_first(), F.col(id))


def cohort(rows: DataFrame, group: list[str], *ties: str) -> DataFrame:
    """A group's points: highest pa first, nulls last, then highest da."""
    return placed(rows, group, F.col("pa").desc_nulls_last(), F.col("da").desc_nulls_last(), *ties)


def chapter_members(rows: DataFrame, names: DataFrame, chapter: str, *ties: str) -> DataFrame:
    """rows (dish, da, pa) of a chapter's dishes, names told apart without regard to case: highest da first, then highest pa. Null names match nothing."""
    own = names.where((F.col("chapter") == chapter) & F.col("name").isNotNull()).select(F.lower("name").alias("_k")).distinct()
    return placed(rows.join(own, F.lower(rows["dish"]) == F.col("_k"), "left_semi"), [], F.col("da").desc_nulls_last(), F.col("pa").desc_nulls_last(), *ties)


def newest(rows: DataFrame, at: str = "created_at", id: str = "id", limit: int | None = None) -> DataFrame:  # noqa: A002
    out = rows.orderBy(F.col(at).desc_nulls_last(), F.col(id))
    return out if limit is None else out.limit(limit)


def due(rows: DataFrame, as_of: Column, last: str = "last_refreshed", ttl: str = "refresh_ttl_days", id: str = "id") -> DataFrame:  # noqa: A002
    """What a refresh has to take up: never run first, then the oldest; rows without a ttl are never due."""
    return rows.where(is_due(F.col(last), F.col(ttl), as_of)).orderBy(F.col(last).asc_nulls_first(), F.col(id))


def jobs(rows: DataFrame, type: str | None = None, entity_ref: object = None, status: str | None = None, limit: int = 100) -> DataFrame:  # noqa: A002
    """The newest jobs that pass all given filters."""
    for c, v in (("type", type), ("entity_ref", entity_ref), ("status", status)):
        rows = rows if v is None else rows.where(F.col(c) == v)
    return newest(rows, limit=limit)


def expiring(cache: DataFrame, cutoff: Column, id: str = "id", limit: int | None = None) -> DataFrame:  # noqa: A002
    """Cached rows made before the cutoff, oldest first."""
    out = cache.where(F.col("created_at") < cutoff).orderBy("created_at", id)
    return out if limit is None else out.limit(limit)


def stale(rows: DataFrame, days: float, as_of: Column, at: str = "scored_at") -> DataFrame:
    """Rows that were never scored, or longer ago than `days`."""
    return rows.where(is_stale(F.col(at), days, as_of))


def by_sorter(rows: DataFrame, sorter: str, attention: Column, name: str, number: str, at: str) -> DataFrame:
    """A list page's orders: attention (what needs it first), name (without regard to case), number (most first) or newest; then by name."""
    orders = {"attention": [attention.desc()], "name": [], "number": [F.col(number).desc_nulls_last()], "newest": [F.col(at).desc_nulls_last()]}
    if sorter not in orders:
        raise ValueError(f"unknown order {sorter}")
    return rows.orderBy(*orders[sorter], F.lower(name), name)
