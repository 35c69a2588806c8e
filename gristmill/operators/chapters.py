"""Chapters as stored rows: a fit and a list of the best as JSON beside a curator's notes, written whole and read with care."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIT = "used boolean, n long, reason string, model string, coefficients array<double>, r2 double, sigma_observed double, sigma_effective double"
TOP = "array<struct<id: long, title: string, ou: double>>"
COLUMNS = ["name", "last_ou_fit", "fit_recipe_count", "fit_updated_at", "top_recipes", "notes"]


def stored_fit(text: Column) -> Column:
    """A stored fit; null where there is none or it is malformed."""
    fit = F.from_json(text, FIT)
    return F.when(F.try_parse_json(text).isNotNull() & fit["used"].isNotNull(), fit)


def stored_top(text: Column) -> Column:
    """A stored list of the best; empty where there is none or it is malformed."""
    return F.when(F.try_parse_json(text).isNotNull(), F.coalesce(F.from_json(text, TOP), F.array().cast(TOP))).otherwise(F.array().cast(TOP))


def status_of(fit: Column) -> Column:
    return F.when(fit.isNull(), "never").when(fit["used"], "graded").otherwise("below_min_n")


def refreshed(stored: DataFrame, fits: DataFrame, best: DataFrame, as_of: Column, most: int = 10) -> DataFrame:
    """stored with new fits and the `most` best of each chapter; notes, and chapters without a new fit, stay as they are.

    fits: name and the fields of a fit; best: name, id, title, ou. Of a chapter's best only `most` are gathered, as an ordered partial list at each step.
    """
    fit = fits.select("name", F.to_json(F.struct("used", "n", "reason", "model", "coefficients", "r2", "sigma_observed", "sigma_effective")).alias("last_ou_fit"), F.col("n").alias("fit_recipe_count"))
    # a task's own best first, so that a large chapter brings `most` rows from each task at most
    own = best.where("ou is not null").withColumn("_task", F.spark_partition_id())
    order = F.struct((-F.col("ou")).alias("s"), "id", "title")
    some = lambda df, *by: df.groupBy("name", *by).agg(F.slice(F.array_sort(F.collect_list("x")), 1, most).alias("x"))
    part = some(own.select("name", "_task", order.alias("x")), "_task").select("name", F.explode("x").alias("x"))
    top = some(part).select("name", F.to_json(F.transform("x", lambda i: F.struct(i["id"].alias("id"), i["title"].alias("title"), (-i["s"]).alias("ou")))).alias("top_recipes"))
    new = fit.join(top, "name", "left").withColumn("top_recipes", F.coalesce("top_recipes", F.lit("[]"))).withColumn("fit_updated_at", as_of)
    new = new.join(stored.select("name", "notes"), "name", "left")
    return stored.join(new.select("name"), "name", "left_anti").select(*COLUMNS).unionByName(new.select(*COLUMNS))


def with_notes(stored: DataFrame, notes: DataFrame, as_of: Column) -> DataFrame:
    """stored with notes (name, notes) set or, where null, cleared; a chapter that isn't there yet gets a row without a fit."""
    n = notes.select("name", F.col("notes").alias("_n"), F.lit(True).alias("_set"))
    j = stored.join(n, "name", "full_outer")
    new = F.col("_set") & F.col("fit_updated_at").isNull() & F.col("last_ou_fit").isNull() & F.col("top_recipes").isNull() & F.col("notes").isNull()
    return j.select("name", "last_ou_fit", "fit_recipe_count", F.when(F.coalesce(new, F.lit(False)), as_of).otherwise(F.col("fit_updated_at")).alias("fit_updated_at"), "top_recipes", F.when(F.col("_set"), F.col("_n")).otherwise(F.col("notes")).alias("notes"))


def details(names: DataFrame, stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Of each of the names: fit, fit_recipe_count, fit_updated_at, status, top, notes and current_recipe_count, the rows (chapter) that it has now; known: whether it is stored."""
    live = rows.groupBy(F.col("chapter").alias("name")).agg(F.count("*").alias("_n"))
    j = names.select("name").join(stored.withColumn("_known", F.lit(True)), "name", "left").join(live, "name", "left").withColumn("fit", stored_fit(F.col("last_ou_fit")))
    return j.select("name", "fit", "fit_recipe_count", "fit_updated_at", status_of(F.col("fit")).alias("fit_status"), stored_top(F.col("top_recipes")).alias("top"), "notes", F.coalesce("_n", F.lit(0)).alias("current_recipe_count"), F.coalesce("_known", F.lit(False)).alias("known"))
