"""Reports over records and their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def suggestions(records: DataFrame, known: DataFrame, least: int, name: str = "name", examples: int = 5) -> DataFrame:
    """Names that at least so many records wait for and that aren't known yet, whatever their case: name_key, waiting, distinct chapters and cuisines, up to five example ids; most waited for first.

    Of a name's ids only the least ones are gathered, cut off before the shuffle; chapters and cuisines are sets of a few values. Blank ones are left out.
    """
    key = F.lower(F.col(name))
    held = records.where(F.col(name).isNotNull()).join(known.where(F.col(name).isNotNull()).select(key.alias("_k")).distinct(), F.lower(records[name]) == F.col("_k"), "left_anti").withColumn("name_key", key)
    told = lambda c: F.array_sort(F.filter(F.collect_set(c), lambda x: x != "")).alias(c + "s")
    counts = held.groupBy("name_key").agg(F.count("*").alias("waiting"), told("chapter"), told("cuisine")).where(F.col("waiting") >= least)
    first = held.select("name_key", "id").distinct().withColumn("_r", F.row_number().over(Window.partitionBy("name_key").orderBy("id"))).where(F.col("_r") <= examples)
    first = first.groupBy("name_key").agg(F.array_sort(F.collect_list("id")).alias("examples"))
    return counts.join(first, "name_key").orderBy(F.desc("waiting"), "name_key")


def membership(points: DataFrame, saved: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """points with label: saved, rejected or dropped; saved wins."""
    s, r = saved.select(key).distinct().withColumn("_s", F.lit(True)), rejected.select(key).distinct().withColumn("_r", F.lit(True))
    return points.join(s, key, "left").join(r, key, "left").withColumn("label", F.when(F.col("_s"), "saved").when(F.col("_r"), "rejected").otherwise("dropped")).drop("_s", "_r")


def counts_onto(names: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """names with the number of rows of that key, 0 where there are none."""
    return names.join(rows.groupBy(key).agg(F.count("*").alias("n")), key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def chapter_status(names: DataFrame, fits: DataFrame, key: str = "chapter") -> DataFrame:
    """Each chapter's status: graded, below_min_n or never; in that order, then by name."""
    status = F.when(F.col("used"), "graded").when(F.col("used").isNotNull(), "below_min_n").otherwise("never")
    order = F.when(F.col("status") == "graded", 0).when(F.col("status") == "below_min_n", 1).otherwise(2)
    return names.where(F.col(key).cast("string") != "Uncertain").join(fits, key, "left").withColumn("status", status).orderBy(order, key)


def ordered_lists(rows: DataFrame, group: str, order: list[str], value: str, name: str = "items") -> DataFrame:
    """Each group's values as a list in order. A group must fit a row, as a conversation or a category does."""
    return rows.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda x: x["_v"]).alias(name))


def transitions(rows: DataFrame, old: str, new: str) -> DataFrame:
    """How often each old value became each new one, the most frequent first; unchanged ones are left out, nulls are values."""
    return rows.where(~F.col(old).eqNullSafe(F.col(new))).groupBy(old, new).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col(old).asc_nulls_first(), F.col(new).asc_nulls_first())


def deltas(rows: DataFrame, old: str, new: str) -> DataFrame:
    """How many gained, stayed and lost, and by how much on average."""
    d = F.col(new) - F.col(old)
    return rows.agg(F.count_if(d > 0).alias("gained"), F.count_if(d == 0).alias("unchanged"), F.count_if(d < 0).alias("lost"), F.avg(F.when(d > 0, d)).alias("mean_gain"), F.avg(F.when(d < 0, d)).alias("mean_loss"))


def top_gainers(rows: DataFrame, old: str, new: str, key: str, n: int = 10) -> DataFrame:
    """The n rows that gained most, with their delta."""
    return rows.withColumn("delta", F.col(new) - F.col(old)).where("delta > 0").orderBy(F.desc("delta"), key).limit(n)


def usage(journal: DataFrame) -> DataFrame:
    """Tokens by user, model and month."""
    return journal.groupBy("user_id", "model", F.date_trunc("month", "created_at").alias("month")).agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def normalized_usage(rows: DataFrame) -> DataFrame:
    """Two providers' names for the same two numbers; missing ones are 0."""
    pick = lambda *c: F.coalesce(*[F.col(x) for x in c if x in rows.columns], F.lit(0))
    return rows.withColumn("input_tokens", pick("prompt_tokens", "input_tokens")).withColumn("output_tokens", pick("completion_tokens", "output_tokens"))


def permitted(users: DataFrame, roles: dict[str, list[str]]) -> DataFrame:
    """users with the sorted permissions of their role; unknown roles have none."""
    held = F.create_map(*[x for r, p in roles.items() for x in (F.lit(r), F.array(*[F.lit(q) for q in sorted(set(p))]) if p else F.array().cast("array<string>"))])
    return users.withColumn("permissions", F.coalesce(F.try_element_at(held, F.col("role")), F.array().cast("array<string>")))
