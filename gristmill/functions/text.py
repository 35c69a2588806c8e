"""Text, markdown and record functions as columns."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gristmill.functions.lexicons import PHRASES, REGION_PHRASES

# Unit words in the order in which they are tried.
UNITS = ["tablespoons", "tablespoon", "tbsp", "teaspoons", "teaspoon", "tsp", "cups", "cup", "ounces", "ounce", "oz", "pounds", "pound", "lbs", "lb", "grams", "g", "kilograms", "kg", "milliliters", "ml", "liters", "l"]
# Names of languages by code.
LANGUAGES = {"el": "Greek", "it": "Italian", "fr": "French", "es": "Spanish", "de": "German", "pt": "Portuguese", "ja": "Japanese", "zh": "Chinese", "ko": "Korean", "ru": "Russian", "tr": "Turkish", "ar": "Arabic", "he": "Hebrew", "nl": "Dutch", "pl": "Polish", "sv": "Swedish", "th": "Thai", "vi": "Vietnamese", "hi": "Hindi"}


def nullish(x: Column) -> Column:
    """Null, blank, or the words null and none."""
    return x.isNull() | F.lower(F.trim(x)).isin("", "null", "none")


def denulled(x: Column) -> Column:
    return F.when(~nullish(x), x)


def filled(x: Column, default: object) -> Column:
    return F.coalesce(denulled(x), F.lit(default))


def hits(text: Column, phrases: list[str]) -> Column:
    """How many of the phrases occur in the lower-cased text: presence, not occurrences; a phrase that is listed twice counts twice. The text is lowered once."""
    held = F.lit(phrases) if phrases else F.array().cast("array<string>")
    return F.get(F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), lambda t: F.size(F.filter(held, lambda p: F.contains(t, p)))), F.lit(0))


def verdict(text: Column, phrases: list[str] = PHRASES, least: int = 7) -> Column:
    """accepted, score, reason."""
    n = hits(text, phrases)
    return F.struct((n >= least).alias("accepted"), n.alias("score"), F.concat(F.lit("score "), n.cast("string"), F.when(n >= least, F.lit(" >= ")).otherwise(F.lit(" < ")), F.lit(str(least))).alias("reason"))


def region_score(text: Column, phrases: list[str] = REGION_PHRASES) -> Column:
    """Characters and 100 for each phrase."""
    return F.length(F.coalesce(text, F.lit(""))) + 100 * hits(text, phrases)


def normalized_markdown(text: Column) -> Column:
    """No byte-order mark, line feeds only, no blanks at line ends nor around the whole."""
    x = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "^﻿", ""), "\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(x, r"[ \t]+(?=\n|$)", ""), r"^\s+|\s+$", "")


def sniffed_url(md: Column) -> Column:
    """A Source: or URL: line, else the first "url" of embedded JSON, else null."""
    line = F.regexp_extract(md, r"(?im)^\s*(?:source|url):\s*(https?://\S+)", 1)
    held = F.regexp_extract(md, r'"url"\s*:\s*"(https?://[^"]+)"', 1)
    return F.coalesce(F.nullif(line, F.lit("")), F.nullif(held, F.lit("")))


def sniffed_title(md: Column) -> Column:
    return F.nullif(F.regexp_extract(md, r"(?m)^[ \t]*#[ \t]+(\S.*?)[ \t]*$", 1), F.lit(""))


def first_heading(md: Column) -> Column:
    """The first heading of level one, marked by # or underlined by =."""
    return F.coalesce(sniffed_title(md), F.nullif(F.regexp_extract(md, r"(?m)^(\S.*?)[ \t]*\n=+[ \t]*$", 1), F.lit("")))


def cleaned_markdown(md: Column) -> Column:
    """No inline images, and never more than one blank line."""
    return F.regexp_replace(F.regexp_replace(md, r"!\[[^\]]*\]\(data:[^)]*\)", ""), r"\n{3,}", "\n\n")


def unfenced(text: Column) -> Column:
    """Without a code fence around the whole."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*\n?", ""), r"\n?```\s*$", "")


def without_section(md: Column, heading: str) -> Column:
    """Without the section of this level-two heading, up to the next one or the end."""
    return F.regexp_replace(md, rf"(?sm)^##[ \t]*{heading}.*?(?=^##[ \t]|\z)", "")


def passthrough(md: Column, url: Column, title: Column) -> Column:
    """Normalised markdown with its URL and title: the caller's where they aren't blank, else what the text says."""
    x = normalized_markdown(md)
    return F.struct(x.alias("markdown"), F.coalesce(denulled(url), sniffed_url(x)).alias("url"), F.coalesce(denulled(title), sniffed_title(x)).alias("title"))


def language_of(html_text: Column, header: Column, told: Column, default: str = "en") -> Column:
    """Two letters: the page's lang attribute, the first language of the header, what a model tells of its text (null if it tells nothing), the default."""
    attr = F.lower(F.substring(F.regexp_extract(html_text, r"(?i)<html[^>]*\blang\s*=\s*[\"']([a-zA-Z]{2,3})", 1), 1, 2))
    head = F.substring(F.lower(F.trim(F.regexp_extract(header, "^([^,]*)", 1))), 1, 2)
    return F.coalesce(F.nullif(attr, F.lit("")), F.nullif(head, F.lit("")), F.nullif(told, F.lit("")), F.lit(default))


def is_foreign(code: Column) -> Column:
    return (F.coalesce(code, F.lit("")) != "") & (F.lower(F.substring(code, 1, 2)) != "en")


def language_name(code: Column) -> Column:
    held = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.when(F.coalesce(code, F.lit("")) == "", F.lit("")).otherwise(F.coalesce(F.try_element_at(held, F.lower(F.substring(code, 1, 2))), F.upper(code)))


# What counts as a quantity, and as a number by itself.
QUANTITY = r"(?i)\b\d+(?:[.,]\d+)?\s*(?:g|kg|mg|ml|l|tbsp|tsp|cup|cups|oz|lb|°[cf]?)\b"
INTEGER = r"\b\d{1,3}\b"


def plausible(original: Column, translated: Column, least: float = 0.4) -> Column:
    """ok and reason of a translation: not empty, not far shorter, with a quantity or three numbers, with some structure or length."""
    # format_number rounds a double for what it is and halves to even, as printf does elsewhere; format_string rounds its decimal text half up
    t, n = F.coalesce(translated, F.lit("")), F.length(F.coalesce(original, F.lit("")))
    share = F.length(t) / n
    reason = F.when(~t.rlike(r"\S"), "empty translation").when((n > 200) & (share < least), F.concat(F.lit("length ratio "), F.call_function("format_number", share, F.lit("0.00")), F.lit(f" < {least}")))
    reason = reason.when(~t.rlike(QUANTITY) & (F.regexp_count(t, F.lit(INTEGER)) < 3), "no quantities or numeric content")
    reason = F.coalesce(reason.when(~t.rlike(r"\n(- |\* |#)") & (F.length(t) < 800), "no list/heading structure"), F.lit("ok"))
    return F.struct((reason == "ok").alias("ok"), reason.alias("reason"))


# What decomposes to a letter or digit of ASCII and marks, as that; and all marks, as nothing. No other character can become one of a-z and 0-9.
_DECOMPOSED = {c: d[0] for i in range(0xC0, 0x30000) if (d := unicodedata.normalize("NFD", c := chr(i))) != c and d[0].isascii() and d[0].isalnum()}
_MARKS = "".join(chr(i) for i in range(0x300, 0x1F000) if unicodedata.combining(chr(i)))
_FOLD_FROM, _FOLD_TO = "".join(_DECOMPOSED) + _MARKS, "".join(_DECOMPOSED.values())


def normalized_title(title: Column) -> Column:
    """Without diacritics, lower, anything but a-z and 0-9 as single spaces, one space at either end so that phrases match whole words; empty where nothing is left."""
    x = F.lower(F.translate(F.coalesce(title, F.lit("")), _FOLD_FROM, _FOLD_TO))
    x = F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))
    return F.when(x == "", x).otherwise(F.concat(F.lit(" "), x, F.lit(" ")))


@F.pandas_udf(StringType())
def _unescaped(x: pd.Series) -> pd.Series:
    return x.map(lambda s: html.unescape(s) if s is not None and "&" in s else s)


def unescaped(x: Column, only: list[str] | None = None) -> Column:
    """HTML entities decoded; texts without & are left alone. only: the entities to decode, by name; all others, and those that are cut off, stay as they stand."""
    return _unescaped(x if only is None else F.regexp_replace(x, f"&(?!(?:{'|'.join(only)});)", "&amp;"))


def checked_shortcuts(held: dict[str, str], chapters: list[str], defer: str = "__DEFER__") -> tuple[dict[str, str], list[str]]:
    """Shortcuts (phrase to chapter) and traps (phrases that leave the choice to someone else) of a loaded table. Blank phrases are skipped; a chapter that isn't there is an error."""
    held = {p.strip(): c for p, c in held.items() if p.strip()}
    if unknown := sorted({c for c in held.values() if c != defer} - set(chapters)):
        raise ValueError(f"unknown chapters: {', '.join(unknown)}")
    return {p: c for p, c in held.items() if c != defer}, [p for p, c in held.items() if c == defer]


def shortcut_chapter(title: Column, shortcuts: dict[str, str], traps: list[str] = [], alone: list[str] = []) -> Column:  # noqa: B006
    """The one chapter whose phrases a title holds; null where a trap phrase stands, none or several chapters match. Chapters in `alone` need the phrase to be the whole title."""
    t = normalized_title(title)
    padded = lambda p: F.concat(F.lit(" "), F.trim(normalized_title(F.lit(p))), F.lit(" "))
    found = F.array_distinct(F.array_compact(F.array(*[F.when((t == padded(p)) if c in alone else F.contains(t, padded(p)), F.lit(c)) for p, c in sorted(shortcuts.items())])))
    trapped = F.lit(False)
    for p in traps:
        trapped = trapped | F.contains(t, padded(p))
    return F.when(~trapped & (F.size(found) == 1), F.try_element_at(found, F.lit(1)))


def chapter_of(title: Column, provided: Column, shortcuts: dict[str, str], **kw: list[str]) -> Column:
    """The shortcut's chapter, else the provider's, else Uncertain; blank titles are Uncertain."""
    return F.when(F.trim(F.coalesce(title, F.lit(""))) == "", F.lit("Uncertain")).otherwise(F.coalesce(shortcut_chapter(title, shortcuts, **kw), denulled(provided), F.lit("Uncertain")))


def cleaned_ingredient(x: Column) -> Column:
    """What an ingredient line names: up to the first comma, without quantity, the first unit that stands there, or closing parenthesis."""
    s = F.trim(F.regexp_extract(x, "^([^,]*)", 1))
    s = F.regexp_replace(s, r"^[\d\x{BC}-\x{BE}\x{2150}-\x{215E}\x{2189}.\-/\s]+", "")
    unit = F.lit(None).cast("string")
    for u in reversed(UNITS):
        unit = F.when(F.lower(s).startswith(u + " "), F.lit(u)).otherwise(unit)
    s = F.when(unit.isNotNull(), F.trim(F.substr(s, F.length(unit) + 2))).otherwise(s)
    return F.trim(F.regexp_replace(s, r"\s*\([^)]*\)\s*$", ""))


def fingerprint(name: Column, ingredients: Column, steps: Column) -> Column:
    """SHA-256 of name, ingredients and steps, trimmed and lower, a line each; blanks are left out."""
    parts = F.concat(F.array(F.coalesce(name, F.lit(""))), F.coalesce(ingredients, F.array().cast("array<string>")), F.coalesce(steps, F.array().cast("array<string>")))
    return F.sha2(F.encode(F.array_join(F.transform(parts, lambda p: F.lower(F.trim(p))), "\n"), "UTF-8"), 256)


def hash_prefix(x: Column, n: int) -> Column:
    return F.left(F.sha2(F.encode(x, "UTF-8"), 256), F.lit(n))


def joined(parts: Column, sep: str = ", ") -> Column:
    """A list's items that aren't blank, trimmed."""
    return F.array_join(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p.isNotNull() & (p != "")), sep)


def _said(x: Column, label: str = "") -> Column:
    """A trimmed text after its label, or null if there is none."""
    return F.when(F.trim(x) != "", F.concat(F.lit(label), F.trim(x)))


def identity_text(card: Column, title: Column) -> Column:
    """What an embedding is made of: likelyDish, title if it says something else, cuisine, ethnicity if it says something else, primaryIngredients and technique of an identity card."""
    dish, cuisine, ethnicity = (F.trim(F.coalesce(card[c], F.lit(""))) for c in ("likelyDish", "cuisine", "ethnicity"))
    leading = F.when(F.size(card["primaryIngredients"]) > 0, F.concat(F.lit("primary: "), F.array_join(F.filter(card["primaryIngredients"], lambda p: p != ""), ", ")))
    return F.concat_ws(". ", _said(dish), F.when(F.lower(F.trim(title)) != F.lower(dish), _said(title)), _said(cuisine, "cuisine: "), F.when(F.lower(ethnicity) != F.lower(cuisine), _said(ethnicity, "ethnicity: ")), leading, _said(card["technique"], "technique: "))


def distinct_ignoring_case(parts: Column) -> Column:
    """A list's items in order, the first of those that differ by case alone."""
    return F.aggregate(F.filter(parts, lambda p: F.trim(p) != ""), F.array().cast("array<string>"), lambda a, p: F.when(F.exists(a, lambda q: F.lower(q) == F.lower(p)), a).otherwise(F.array_append(a, p)))


def dish_text(card: Column, name: Column, description: Column, queries: Column) -> Column:
    """What an embedding of a dish is made of: its card if that names a dish, or else name, description and queries, the first of those that differ by case alone."""
    parts = F.concat(F.array(F.trim(name), F.trim(description)), F.transform(F.coalesce(queries, F.array().cast("array<string>")), lambda q: F.trim(q)))
    return F.when(F.trim(card["likelyDish"]) != "", identity_text(card, name)).otherwise(F.array_join(distinct_ignoring_case(F.filter(parts, lambda p: p.isNotNull())), ". "))


def recipe_text(card: Column, name: Column, signal: Column, cuisine: Column, ethnicity: Column, chapter: Column, ingredients: Column, most: int = 8) -> Column:
    """What an embedding of a record is made of: its card if that names a dish, or else signal, name, cuisine or ethnicity, chapter and what of the first ingredients isn't blank."""
    first = F.filter(F.transform(F.slice(F.coalesce(ingredients, F.array().cast("array<string>")), 1, most), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.trim(card["likelyDish"]) != "", identity_text(card, name)).otherwise(F.concat_ws(". ", _said(signal), _said(name), F.coalesce(_said(cuisine, "cuisine: "), _said(ethnicity, "cuisine: ")), _said(chapter, "chapter: "), F.when(F.size(first) > 0, F.concat(F.lit("ingredients: "), F.array_join(first, ", ")))))


def changed_count(old: Column, new: Column) -> Column:
    """How many of two lists' texts differ, place by place."""
    return F.size(F.filter(F.arrays_zip(old.alias("a"), new.alias("b")), lambda x: ~x["a"].eqNullSafe(x["b"])))


def first_image(images: Column) -> Column:
    """The first text of a list that isn't blank."""
    return F.get(F.filter(images, lambda x: x.isNotNull() & (F.trim(x) != "")), F.lit(0))


def is_local_url(url: Column) -> Column:
    """A path on our own server: one slash, not two."""
    return F.coalesce(url.startswith("/") & ~url.startswith("//"), F.lit(False))


def matches_search(q: str, *cells: Column) -> Column:
    return F.contains(F.lower(F.concat_ws(" ", *[c.cast("string") for c in cells])), F.lit(q.lower()))


def natural_key(x: Column) -> list[Column]:
    """Sort columns: numbers (with commas, or a percent sign behind) first by value, then texts without regard to case."""
    number = F.when(x.rlike(r"^\s*-?[0-9.,]+%?\s*$"), F.regexp_replace(x, r"[,%\s]", "").try_cast("double"))
    return [number.asc_nulls_last(), F.when(number.isNull(), F.lower(x)).asc_nulls_last()]


def age_text(seconds: Column) -> Column:
    """How long ago, in minutes, hours or days."""
    part = lambda n, unit: F.concat(F.floor(seconds / n).cast("string"), F.lit(f" {unit} ago"))
    return F.when(seconds < 60, F.lit("just now")).when(seconds < 3600, part(60, "min")).when(seconds < 86400, part(3600, "hr")).otherwise(part(86400, "d"))


def base64_length(n: Column) -> Column:
    return F.floor((n + 2) / 3) * 4


def aspect_bucket(width: Column, height: Column) -> Column:
    """The canvas of an image: wide from a ratio of 0.95 on."""
    return F.when(width / height >= 0.95, F.lit("1500x1000")).otherwise(F.lit("1000x1500"))
