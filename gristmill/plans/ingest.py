"""Whole plans: pages to records, candidates to winners, records to stored state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.documents import eligible, find_record, parsed, quality_gate
from gristmill.functions.pages import envelope, main_region, markdown_at, open_graph, parsed_page, record_json
from gristmill.functions.sanitize import sanitized
from gristmill.functions.scores import opportunity
from gristmill.functions.text import fingerprint, language_of, verdict
from gristmill.functions.urls import normalize_url
from gristmill.operators.cohorts import LEAST_N, fit_groups, graded
from gristmill.operators.funnel import blocked, merged_candidates
from gristmill.operators.languages import told
from gristmill.operators.state import adopted, drifted, merged_by_key
from gristmill.session import staged


def pages_to_records(pages: DataFrame, model: DataFrame | None = None, key: str = "page_id") -> DataFrame:
    """Each page parsed once: its language, main region, metadata, verdict, embedded record (sanitised), gate and fingerprint.

    model: language profiles for pages that don't say their language; they are told by their visible text.
    """
    p = pages.withColumn("page", parsed_page(F.coalesce("html", F.lit("")))).withColumn("main", main_region(F.col("page")))
    if model is None:
        p = p.withColumn("_told", F.lit(None).cast("string"))
    else:
        p = staged(p, "pages")  # parsed once, though read twice
        p = p.join(told(p.select(key, F.col("page.visible").alias("_visible")), model, key, "_visible").select(key, F.col("lang").alias("_told")), key, "left")
    found = F.get(F.filter(F.transform("page.json", lambda j: find_record(parsed(j))), lambda v: v.isNotNull()), F.lit(0))
    p = p.withColumn("found", found).withColumn("record", F.when(F.col("found").isNotNull(), sanitized(F.col("found")))).withColumn("eligible", eligible(F.col("found")))
    return p.select(*pages.columns, normalize_url(F.col("url")).alias("url_normalized"), language_of(F.col("html"), F.lit(None).cast("string"), F.col("_told")).alias("language"), open_graph(F.col("page"), F.col("url")).alias("og"), verdict(F.col("page.visible")).alias("verdict"), envelope(F.col("page.title"), F.col("url"), record_json("page.json"), markdown_at(F.col("html"), F.col("main.at"))).alias("markdown"), "record", "eligible", quality_gate(F.col("record.name"), F.col("record.recipeIngredient"), F.col("record.recipeInstructions.text")).alias("gate"), fingerprint(F.col("record.name"), F.col("record.recipeIngredient"), F.col("record.recipeInstructions.text")).alias("fingerprint"))


def refreshed_group(results: DataFrame, authority: DataFrame, n: int = 10, least_n: int = LEAST_N, **lists: list[str]) -> tuple[DataFrame, DataFrame]:
    """Winners and rejects of each dish's search: merged by URL, blocked, scored, fitted, floored, ranked. results: dish, url, query, rank, title, seq; authority: url_key, pa, da.

    A URL that two dishes find is a candidate of both. Rejects say why: blocked, authority-unavailable, below-floor (no ou, or under 0) or below-cut. lists: see block_reason.
    """
    scored = blocked(merged_candidates(results, group=("dish",)), **lists).join(authority.select("url_key", "pa", "da"), "url_key", "left")
    scored = scored.withColumn("drop_reason", F.coalesce("drop_reason", F.when(F.col("pa").isNull(), "authority-unavailable"))).withColumn("ou", opportunity(F.col("pa"), F.col("da")))
    scored = staged(scored, "scored")
    fits = fit_groups(scored.where("drop_reason is null"), ["dish"], least_n=least_n, models=("linear", "quadratic", "power"))
    # one pass says of each candidate where it stands: those over the floor are ranked, and all others, and who comes after the last rank, have a reason
    placed = graded(scored, fits, ["dish"]).withColumn("_in", F.col("drop_reason").isNull() & F.coalesce(F.col("ou") >= 0, F.lit(False)))
    placed = placed.withColumn("rank", F.row_number().over(Window.partitionBy("dish", "_in").orderBy(F.col("ou").desc_nulls_last(), "seq")))
    placed = staged(placed.withColumn("_won", F.col("_in") & (F.col("rank") <= n)), "placed")
    won = placed.where("_won").drop("_in", "_won")
    reason = F.coalesce("drop_reason", F.when(~F.col("_in"), F.lit("below-floor")), F.lit("below-cut"))
    return won, placed.where("not _won").withColumn("drop_reason", reason).select(*scored.columns)


def saved(store: DataFrame, incoming: DataFrame, as_of) -> DataFrame:  # noqa: ANN001
    """store with incoming records that pass the gate: they take the id of the same URL and user, keep created_at, and are stamped where the content changed. incoming: id, user_id, url_normalized, name, ingredients, steps, data."""
    good = incoming.where(quality_gate(F.col("name"), F.col("ingredients"), F.col("steps"))["ok"])
    new = adopted(good, store).withColumn("fingerprint", fingerprint(F.col("name"), F.col("ingredients"), F.col("steps")))
    before = store.select("id", F.col("fingerprint").alias("_f"), F.col("source_changed_at").alias("_s"))
    new = new.join(before, "id", "left").withColumn("source_changed_at", F.when(drifted(F.col("_f"), F.col("fingerprint")), as_of).otherwise(F.col("_s"))).withColumn("created_at", as_of).withColumn("updated_at", as_of)
    return merged_by_key(store, new.select(*store.columns), ["id"], keep=("created_at",))
