"""Records as VARIANT: gates, JSON-LD and the sanitiser, as columns."""

from __future__ import annotations

import html
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType


def text_at(v: Column, path: str) -> Column:
    """A text or number at a path, else null."""
    return F.try_variant_get(v, path, "string")


def list_at(v: Column, path: str) -> Column:
    """A list of texts at a path; a single text is a list of one, anything else is empty."""
    many = F.try_variant_get(v, path, "array<string>")
    one = F.when(~F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID")).rlike("^(ARRAY|OBJECT|VOID)"), F.array(text_at(v, path)))
    return F.coalesce(many, one, F.array().cast("array<string>"))


def parsed(text: Column) -> Column:
    """VARIANT of a JSON text, null where it is malformed."""
    return F.try_parse_json(text)


def n_filled(parts: Column) -> Column:
    return F.size(F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda p: F.trim(p) != ""))


def quality_gate(name: Column, ingredients: Column, steps: Column, least_ingredients: int = 3, least_steps: int = 3) -> Column:
    """ok and reason: a name, enough ingredients and steps that aren't blank."""
    i, s = n_filled(ingredients), n_filled(steps)
    reason = F.when(F.trim(F.coalesce(name, F.lit(""))) == "", F.lit("no name")).when(i < least_ingredients, F.concat(F.lit(f"fewer than {least_ingredients} ingredients ("), i.cast("string"), F.lit(")"))).when(s < least_steps, F.concat(F.lit(f"fewer than {least_steps} instructions ("), s.cast("string"), F.lit(")"))).otherwise(F.lit("ok"))
    return F.struct((reason == "ok").alias("ok"), reason.alias("reason"))


def has_type(v: Column, wanted: str = "Recipe") -> Column:
    """@type is the wanted one, or a list with it."""
    return F.coalesce(F.array_contains(list_at(v, "$['@type']"), wanted), F.lit(False))


def find_record(v: Column, wanted: str = "Recipe") -> Column:
    """The first object of the wanted type: the value itself, an item of a list, or of a @graph."""
    pool = F.concat(F.array(v), F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>")), F.coalesce(F.try_variant_get(v, "$['@graph']", "array<variant>"), F.array().cast("array<variant>")))
    return F.get(F.filter(pool, lambda x: has_type(x, wanted)), F.lit(0))


def flat_steps(v: Column) -> Column:
    """Instructions as texts: a text by lines, a list of texts or steps, sections by their steps."""
    raw = F.try_variant_get(v, "$.recipeInstructions", "variant")
    lines = F.filter(F.transform(F.split(F.try_variant_get(raw, "$", "string"), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    step = lambda x: F.coalesce(text_at(x, "$.text"), text_at(x, "$.name"), F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
    nested = lambda x: F.when(has_type(x, "HowToSection"), F.transform(F.coalesce(F.try_variant_get(x, "$.itemListElement", "array<variant>"), F.array().cast("array<variant>")), step)).otherwise(F.array(step(x)))
    many = F.flatten(F.transform(F.try_variant_get(raw, "$", "array<variant>"), nested))
    return F.array_compact(F.coalesce(F.when(F.schema_of_variant(raw) == "STRING", lines), many, F.array().cast("array<string>")))


def eligible(v: Column) -> Column:
    """ok and reason: an object with a name, ingredients and instructions."""
    reason = F.when(v.isNull() | ~F.coalesce(F.schema_of_variant(v), F.lit("VOID")).startswith("OBJECT"), F.lit("not an object")).when(F.trim(F.coalesce(text_at(v, "$.name"), F.lit(""))) == "", F.lit("missing name")).when(n_filled(F.try_variant_get(v, "$.recipeIngredient", "array<string>")) == 0, F.lit("missing ingredients")).when(F.size(flat_steps(v)) == 0, F.lit("missing instructions")).otherwise(F.lit("ok"))
    return F.struct((reason == "ok").alias("ok"), reason.alias("reason"))


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("changed", IntegerType())]))
def decoded_json(x: pd.Series) -> pd.DataFrame:
    """A JSON text with the entities of all its texts decoded, whatever its shape, and how many texts that changed. Keys, numbers and layout stay; null stays null with 0 changes."""

    def one(text: str | None) -> tuple[str | None, int]:
        if text is None or ("&" not in text and "\\u0026" not in text):
            return text, 0
        n = 0

        def swap(m: re.Match[str]) -> str:
            nonlocal n
            held = m.group()
            if m[1] is not None or ("&" not in held and "\\u0026" not in held):
                return held
            try:
                old = json.loads(held)
            except ValueError:
                return held
            new = html.unescape(old)
            n += new != old
            return json.dumps(new, ensure_ascii=False) if new != old else held

        return _JSON_TEXT.sub(swap, text), n

    return pd.DataFrame([one(t) for t in x], columns=["text", "changed"])


#: A text of JSON, with the colon after it if it is a key.
_JSON_TEXT = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"(\s*:)?', re.S)


def decoded(v: Column) -> Column:
    """value: the VARIANT with the entities of all its texts decoded at any depth, keys untouched; changed: how many texts that changed."""
    held = decoded_json(F.to_json(v))
    return F.struct(F.parse_json(held["text"]).alias("value"), held["changed"].alias("changed"))


def fenced_json(md: Column) -> Column:
    """VARIANT of the first fenced JSON block of a markdown text."""
    return parsed(F.nullif(F.regexp_extract(md, r"(?s)```json\s*(.*?)```", 1), F.lit("")))


# Roles whose ingredients lead a dish; fields of a record, and of where it comes from, that don't belong to its owner.
PRIMARY_ROLES = ["main_protein", "primary_vegetable", "starch", "pastry", "sauce_base", "filling"]
STATIC_FIELDS = [
    "@context", "@type", "name", "headline", "description", "image", "author", "publisher", "datePublished", "dateModified", "recipeYield", "prepTime", "cookTime", "totalTime", "recipeCategory", "recipeCuisine", "keywords", "tags", "aggregateRating", "nutrition",
    "recipeIngredient", "recipeInstructions", "notes", "video", "servingSuggestions", "cookingMethod", "equipment", "suitableForDiet", "imageSource", "inputImage", "provenance", "classification", "editorial", "_scoring", "_batch", "_identity",
]
STATIC_SOURCE = ["type", "origin", "originalUrl", "previewImage", "previewDescription", "previewImageAlt", "siteName", "author", "publishedTime", "modifiedTime", "pageScreenshot", "originalLanguage", "translated", "translatedAt", "originalTitle"]


def primary(roles: Column, wanted: list[str] = PRIMARY_ROLES) -> Column:
    """The texts of ingredients whose role is a leading one, in order, trimmed; blank ones are left out. roles: array of text and role."""
    held = F.transform(F.filter(roles, lambda r: r["role"].isin(wanted)), lambda r: F.trim(r["text"]))
    return F.coalesce(F.filter(held, lambda t: t != ""), F.array().cast("array<string>"))


def static_fields(v: Column, kept: list[str] = STATIC_FIELDS, source: list[str] = STATIC_SOURCE, stamped: dict[str, Column] | None = None) -> Column:
    """A record without the fields that belong to its owner; of `_source` the part that doesn't, and nothing if that is empty. stamped: texts put into `_source` afterwards. A map of VARIANT."""
    fields = lambda path: F.try_variant_get(v, path, "map<string,variant>")
    empty = F.create_map().cast("map<string,variant>")
    own = F.coalesce(F.map_filter(fields("$"), lambda k, _: k.isin(kept)), empty)
    of = F.map_filter(F.coalesce(fields("$._source"), empty), lambda k, _: k.isin(source))
    if stamped:
        of = F.map_concat(of, F.create_map(*[c for k, x in stamped.items() for c in (F.lit(k), x.cast("variant"))]))
    return F.map_concat(own, F.when(F.size(of) > 0, F.create_map(F.lit("_source"), F.to_variant_object(of))).otherwise(empty))


def unwrapped_value(v: Column) -> Column:
    """The value of a {value, history} pair, or the value itself."""
    return F.coalesce(F.try_variant_get(v, "$.value", "double"), F.try_variant_get(v, "$", "double"))
