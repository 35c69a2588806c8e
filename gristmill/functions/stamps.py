"""What is stamped onto records and read off them: verdicts, sources, scores, and whether something is still to be done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.documents import text_at, unwrapped_value
from gristmill.functions.named import let
from gristmill.functions.urls import normalize_url, root_domain

_MAP = "map<string,variant>"


def patched_block(data: Column, block: str, values: dict[str, Column], over: bool = True) -> Column:
    """A VARIANT object with fields of a block set where their values aren't null; all else stays. over: whether fields that are there are set too."""
    return let(data, lambda d: _patched(d, block, values, over))


def _patched(data: Column, block: str, values: dict[str, Column], over: bool) -> Column:
    empty = F.create_map().cast(_MAP)
    fields, own = F.coalesce(F.try_variant_get(data, "$", _MAP), empty), F.coalesce(F.try_variant_get(data, f"$['{block}']", _MAP), empty)
    new = F.map_filter(F.create_map(*[c for k, x in values.items() for c in (F.lit(k), x.cast("variant"))]), lambda _, x: x.isNotNull())
    if not over:
        new = F.map_filter(new, lambda k, _: ~F.array_contains(F.map_keys(own), k))
    now = F.map_concat(F.map_filter(own, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)
    return F.to_variant_object(F.map_concat(F.map_filter(fields, lambda k, _: k != block), F.create_map(F.lit(block), F.to_variant_object(now))))


def with_verdict(data: Column, score: Column, as_of: Column, least: int = 7) -> Column:
    """A record with its current_status, accepted from `least` on, and its score in `_scoring`."""
    reason = F.concat(F.lit("Recipe-phrase score "), score.cast("string"), F.lit(f" (threshold {least})"))
    status = {"value": F.when(score >= least, "accepted").otherwise("rejected"), "reason": reason, "timestamp": as_of.cast("string")}
    return patched_block(patched_block(data, "current_status", status), "_scoring", {"recipeScore": score.cast("long"), "recipeScoreThreshold": F.lit(least).cast("long")})


def with_source(data: Column, url: Column, title: Column) -> Column:
    """A record with where it was found: what `_source` and `_scoring` say already stays. Without URL and title nothing changes."""
    key = F.when(F.coalesce(url, F.lit("")) != "", F.nullif(normalize_url(url), F.lit("")))
    name, root = F.nullif(title, F.lit("")), F.nullif(root_domain(key), F.lit(""))

    def told(d: Column, of: Column) -> Column:
        said = lambda path: F.nullif(text_at(d, path), F.lit(""))
        out = patched_block(d, "_source", {"originalUrl": F.coalesce(said("$._source.originalUrl"), of["key"]), "origin": F.coalesce(said("$._source.origin"), of["root"], of["name"])})
        out = patched_block(out, "_source", {"type": F.lit("web")}, over=False)
        scored = lambda o: F.when(of["key"].isNull(), o).otherwise(patched_block(o, "_scoring", {"rootDomain": F.coalesce(of["root"], F.lit("")), "rawTitle": of["name"]}, over=False))
        return F.when(of["key"].isNull() & of["name"].isNull(), d).otherwise(let(out, scored))

    return let(F.struct(data.alias("data"), F.struct(key.alias("key"), name.alias("name"), root.alias("root")).alias("of")), lambda x: told(x["data"], x["of"]))


def needs_enrichment(data: Column) -> Column:
    """The story that only enrichment writes is blank."""
    return F.trim(F.coalesce(text_at(data, "$.classification.story"), F.lit(""))) == ""


def has_grade(data: Column, master: bool = False) -> Column:
    return F.coalesce(text_at(data, "$._master.exceptionalism.grade" if master else "$._grade.grade"), F.lit("")) != ""


def has_card(data: Column) -> Column:
    return F.trim(F.coalesce(text_at(data, "$._identity.likelyDish"), F.lit(""))) != ""


def link_of(data: Column, stored: Column) -> Column:
    """A record's own URL, or else the one beside it."""
    return F.coalesce(text_at(data, "$._source.originalUrl"), stored)


def image_size(orientation: Column, key: Column) -> Column:
    """The canvas of a generated image; without a known orientation landscape or portrait, by the key's hash, so that it is the same each time."""
    o = F.lower(F.trim(F.coalesce(orientation, F.lit(""))))
    return F.when(o == "landscape", "1536x1024").when(o == "portrait", "1024x1536").when(o == "square", "1024x1024").when(F.pmod(F.xxhash64(key), F.lit(2)) == 0, "1536x1024").otherwise("1024x1536")


def scene_of(chapter: Column, scenes: dict[str, str], default: str) -> Column:
    """The setting of a chapter, names told apart without regard to case and blanks around."""
    held = F.create_map(*[F.lit(x) for k, v in scenes.items() for x in (k.strip().lower(), v)]) if scenes else F.create_map().cast("map<string,string>")
    return F.coalesce(F.try_element_at(held, F.lower(F.trim(chapter))), F.lit(default))


def pre_scored(entry: Column) -> Column:
    """What a batch's entry knows of a page, plain or as {value, history}: scores as numbers, texts where they aren't empty."""
    text = lambda k: F.nullif(F.coalesce(text_at(entry, f"$.{k}.value"), F.when(~F.coalesce(F.schema_of_variant(F.try_variant_get(entry, f"$.{k}", "variant")), F.lit("VOID")).startswith("OBJECT"), text_at(entry, f"$.{k}"))), F.lit(""))
    number = lambda k: F.coalesce(unwrapped_value(F.try_variant_get(entry, f"$.{k}", "variant")), text(k).try_cast("double"))
    return F.struct(number("pa").alias("pageAuthority"), number("da").alias("domainAuthority"), number("ou").alias("ouScore"), text("domain").alias("rootDomain"), text("title").alias("rawTitle"))


def is_staff(role: Column, member: str = "member") -> Column:
    """Anyone whose role isn't that of a member; none counts as one."""
    return F.coalesce(F.nullif(role, F.lit("")), F.lit(member)) != member


def resolved(requests: DataFrame, users: DataFrame, header: str = "header") -> DataFrame:
    """requests with the user that their header names: user_id, name and role (member if none); null where it is no positive whole number, or nobody's."""
    own = users.select(F.col("user_id").alias("_u"), "name", F.coalesce(F.nullif("role", F.lit("")), F.lit("member")).alias("role"))
    text = F.trim(F.col(header))
    asked = F.when(text.rlike("^[+]?[0-9]{1,18}$"), text.try_cast("long"))
    # headers that name nobody get keys of their own below zero, so that they don't meet in one task
    keyed = requests.withColumn("_k", F.when(asked > 0, asked).otherwise(-F.abs(F.pmod(F.xxhash64(*requests.columns), F.lit(1 << 40))) - 1))
    return keyed.join(own, F.col("_k") == F.col("_u"), "left").withColumn("user_id", F.col("_u")).drop("_k", "_u")


def decoded_jobs(rows: DataFrame, folder: str = "/logs") -> DataFrame:
    """Jobs with params (an empty object if malformed or missing) and result (null then) as VARIANT, and log_url."""
    params = F.coalesce(F.try_parse_json(F.nullif("params", F.lit(""))), F.parse_json(F.lit("{}")))
    log = F.nullif("log_filename", F.lit(""))
    return rows.withColumns({"params": params, "result": F.try_parse_json(F.nullif("result", F.lit(""))), "log_url": F.when(log.isNotNull(), F.concat(F.lit(f"{folder}/"), log))})


def chapters_filled(rows: DataFrame, classify: Callable[[Column], Column]) -> DataFrame:
    """rows (id, data) with status and, where a chapter was still missing, data with the one that the name leads to: set, skipped-already-set or skipped-no-name."""
    name = F.trim(F.coalesce(text_at(F.col("data"), "$.name"), F.lit("")))
    there = F.coalesce(text_at(F.col("data"), "$.classification.chapter"), F.lit("")) != ""
    status = F.when(there, "skipped-already-set").when(name == "", "skipped-no-name").otherwise("set")
    return rows.withColumn("status", status).withColumn("chapter", F.when(F.col("status") == "set", classify(name))).withColumn("data", F.when(F.col("status") == "set", patched_block(F.col("data"), "classification", {"chapter": F.col("chapter")})).otherwise(F.col("data")))


def reclassified(rows: DataFrame, old: str, new: str) -> DataFrame:
    """The rows whose class is another one now, nulls told apart from values."""
    return rows.where(~F.col(old).eqNullSafe(F.col(new)))


def named(rows: DataFrame, names: DataFrame, key: str = "name") -> DataFrame:
    """Of each of the names, told apart without regard to case, its row; nothing where there is none."""
    asked = names.where(F.col(key).isNotNull()).select(F.col(key).alias("asked"), F.lower(key).alias("_k"))
    return asked.join(rows.withColumn("_k", F.lower(key)), "_k").drop("_k")
