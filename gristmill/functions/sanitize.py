"""Loose records to one typed record, by a table of rules: what each field becomes of whatever stands there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.documents import decoded
from gristmill.functions.named import let
from gristmill.functions.text import nullish

#: What a value becomes. A value is a struct of v, a VARIANT, and kind: STRING, OBJECT, ARRAY, BOOLEAN, VOID or a number's type; VOID too where nothing stands.
Rule = Callable[[Column], Column]


def by(v: Column, rule: Rule) -> Column:
    """The rule's answer for a VARIANT, which is read and told apart once however often the rule looks at it. Every name is one more round of Spark's analysis, so what holds it is one struct."""
    return let(F.struct(v.alias("v"), F.coalesce(F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0), F.lit("VOID")).alias("kind")), rule)


def held_at(x: Column, path: str) -> Column:
    return F.try_variant_get(x["v"], path, "variant")


def at(x: Column, path: str, rule: Rule) -> Column:
    return by(held_at(x, path), rule)


def _is(x: Column, *kinds: str) -> Column:
    return x["kind"].isin(*kinds)


def items(x: Column) -> Column:
    """The items of a list, as VARIANTs; of anything else none."""
    return F.coalesce(F.try_variant_get(x["v"], "$", "array<variant>"), F.array().cast("array<variant>"))


def each(x: Column, rule: Rule) -> Column:
    return F.transform(items(x), lambda i: by(i, rule))


def those(of: Column, rule: Rule) -> Column:
    return F.filter(of, lambda i: by(i, rule))


def blank(x: Column) -> Column:
    """Nothing, null, a blank text, the words null and none, an empty list or an empty object."""
    return _is(x, "VOID") | F.when(_is(x, "STRING"), nullish(F.try_variant_get(x["v"], "$", "string"))).when(_is(x, "ARRAY"), F.size(items(x)) == 0).when(_is(x, "OBJECT"), F.schema_of_variant(x["v"]) == "OBJECT<>").otherwise(F.lit(False))


def plain(x: Column) -> Column:
    """A text, number or truth as text; a list or object is none."""
    return F.when(~_is(x, "ARRAY", "OBJECT", "VOID"), F.try_variant_get(x["v"], "$", "string"))


def text(default: str | None = "") -> Rule:
    return lambda x: F.coalesce(F.when(~blank(x), plain(x)), F.lit(default).cast("string"))


def now(as_of: Column) -> Rule:
    return lambda x: F.coalesce(F.when(~blank(x), plain(x)), as_of)


def whole(default: int | None = 0) -> Rule:
    return lambda x: F.coalesce(F.when(~_is(x, "STRING", "ARRAY", "OBJECT", "BOOLEAN"), F.try_variant_get(x["v"], "$", "bigint")), F.lit(default).cast("bigint"))


def number(x: Column) -> Column:
    return F.coalesce(F.when(~_is(x, "STRING", "ARRAY", "OBJECT", "BOOLEAN"), F.try_variant_get(x["v"], "$", "double")), F.lit(0.0))


def truth(x: Column) -> Column:
    return F.coalesce(F.try_variant_get(x["v"], "$", "boolean"), F.lit(False))


def texts(x: Column) -> Column:
    """A list of texts; one text is a list of one."""
    many = F.filter(each(x, plain), lambda t: t.isNotNull())
    return F.when(blank(x), F.array().cast("array<string>")).when(_is(x, "ARRAY"), many).otherwise(F.array_compact(F.array(plain(x))))


def cut_texts(x: Column) -> Column:
    """A list of texts, or one text cut at commas."""
    cut = F.filter(F.transform(F.split(plain(x), ","), lambda t: F.trim(t)), lambda t: t != "")
    return F.when(_is(x, "STRING") & ~blank(x), cut).otherwise(texts(x))


def joined_text(x: Column) -> Column:
    """One text; the items of a list that aren't empty, with commas between."""
    parts = F.transform(those(items(x), lambda i: ~(_is(i, "VOID") | F.coalesce(plain(i) == "", F.lit(False)) | (_is(i, "ARRAY") & (F.size(items(i)) == 0)))), lambda v: by(v, lambda i: F.trim(F.coalesce(plain(i), F.to_json(i["v"])))))
    return F.when(_is(x, "ARRAY"), F.array_join(parts, ", ")).otherwise(text()(x))


def longest_text(x: Column) -> Column:
    """One text; of a list the longest, the first of several."""
    held = F.filter(each(x, lambda i: F.trim(plain(i))), lambda t: t.isNotNull() & (t != ""))
    best = F.array_max(F.transform(held, lambda t, i: F.struct(F.length(t).alias("n"), (-i).alias("i"), t.alias("t"))))["t"]
    return F.when(_is(x, "ARRAY"), F.coalesce(best, F.lit(""))).otherwise(text()(x))


def image_url(x: Column) -> Column:
    """A text, or the url, contentUrl or @id of an object; else empty."""
    named = F.coalesce(*[at(x, p, lambda m: F.when(_is(m, "STRING") & (F.trim(plain(m)) != ""), plain(m))) for p in ("$.url", "$.contentUrl", "$['@id']")])
    return F.coalesce(F.when(_is(x, "STRING"), plain(x)).when(_is(x, "OBJECT"), named), F.lit(""))


def images(x: Column) -> Column:
    return F.filter(F.when(_is(x, "ARRAY"), each(x, image_url)).otherwise(F.array(image_url(x))), lambda u: u != "")


def first_text(wanted: str) -> Rule:
    """One text; of a list the wanted one if it is there, else the first that isn't empty."""
    return lambda x: F.when(_is(x, "ARRAY"), F.when(F.array_contains(texts(x), wanted), wanted).otherwise(F.coalesce(F.get(F.filter(texts(x), lambda t: t != ""), F.lit(0)), F.lit(wanted)))).otherwise(text(wanted)(x))


def record(fields: dict[str, Rule], typed: str | None = None) -> Rule:
    """An object of these fields, each by its rule; a stated @type is written whatever stands there."""
    return lambda x: F.struct(*([F.lit(typed).alias("@type")] if typed else []), *[at(x, f"$['{name}']", rule).alias(name) for name, rule in fields.items()])


def only_if(condition: Callable[[Column], Column], rule: Rule, otherwise: Rule | None = None) -> Rule:
    return lambda x: F.when(condition(x), rule(x)).otherwise(otherwise(x) if otherwise else F.lit(None))


def _object(x: Column) -> Column:
    return _is(x, "OBJECT")


def _steps(x: Column) -> Column:
    """Steps in order: a text by its lines, texts and objects of a list, sections by their own lists. Positions are counted where none is given."""
    section = lambda i: F.when(F.array_contains(at(i, "$['@type']", texts), "HowToSection"), at(i, "$.itemListElement", items)).otherwise(F.array(i["v"]))
    lines = F.transform(F.filter(F.transform(F.split(plain(x), "\n"), lambda t: F.trim(t)), lambda t: t != ""), lambda t: F.to_variant_object(F.struct(t.alias("text"))))
    flat = F.when(_is(x, "STRING"), lines).otherwise(F.flatten(each(x, section)))
    known = those(F.coalesce(flat, F.array().cast("array<variant>")), lambda i: _is(i, "STRING", "OBJECT"))
    image = lambda i: let(F.when(_is(i, "ARRAY"), F.get(images(i), F.lit(0))).otherwise(image_url(i)), lambda u: F.nullif(u, F.lit("")))
    said = lambda i: F.coalesce(F.when(_is(i, "STRING"), plain(i)), at(i, "$.text", plain), at(i, "$.name", plain), F.lit(""))
    return F.transform(known, lambda v, n: by(v, lambda i: F.struct(F.lit("HowToStep").alias("@type"), F.coalesce(at(i, "$.position", whole(None)), n + 1).alias("position"), at(i, "$.name", text(None)).alias("name"), said(i).alias("text"), at(i, "$.image", image).alias("image"), at(i, "$.imageCredit", text(None)).alias("imageCredit"))))


def _author(x: Column) -> Column:
    """One author: an object, a name, or the first of a list that has a name."""
    named = F.get(those(items(x), lambda a: _object(a) & ~at(a, "$.name", blank)), F.lit(0))
    one = F.when(_is(x, "ARRAY"), named).otherwise(x["v"])
    return by(one, lambda a: F.struct(F.lit("Person").alias("@type"), F.when(_is(x, "STRING"), text()(x)).otherwise(at(a, "$.name", text())).alias("name"), at(a, "$.image", text(None)).alias("image")))


def _rating(x: Column) -> Column:
    """Value and count if all of it is well-formed, else zeros; a count of ratings stands in for one of reviews that isn't there."""
    stated = F.coalesce(_object(x) & (at(x, "$['@type']", plain) == "AggregateRating"), F.lit(False))

    def rated(value: Column, count: Column) -> Column:
        good = stated & (value["v"].isNull() | _is(value, "BIGINT", "DOUBLE", "DECIMAL", "FLOAT")) & (count["v"].isNull() | _is(count, "BIGINT"))
        return F.struct(F.lit("AggregateRating").alias("@type"), F.when(good, number(value)).otherwise(0.0).alias("ratingValue"), F.when(good, whole()(count)).otherwise(F.lit(0).cast("bigint")).alias("reviewCount"))

    return at(x, "$.ratingValue", lambda value: by(F.coalesce(held_at(x, "$.reviewCount"), held_at(x, "$.ratingCount")), lambda count: rated(value, count)))


def _tools(x: Column) -> Column:
    return F.transform(those(items(x), lambda i: _is(i, "STRING", "OBJECT")), lambda v: by(v, lambda i: F.struct(F.lit("HowToTool").alias("@type"), F.coalesce(F.when(_is(i, "STRING"), plain(i)), at(i, "$.name", plain), F.lit("")).alias("name"))))


# The fields of a record and of what it holds, in order.
NUTRITION = ("calories", "fatContent", "carbohydrateContent", "proteinContent")
SOURCE = ("origin", "originalUrl", "affiliateUrl", "previewImage", "previewDescription", "previewImageAlt", "siteName", "author", "publishedTime", "modifiedTime", "pageScreenshot", "originalLanguage")


def rules(key: Column, as_of: Column) -> dict[str, Rule]:
    """Every field of a record. key, as_of: what an id and the dates become where there are none."""
    blanks = lambda *names: {n: text() for n in names}
    video = record({"name": text(), "contentUrl": text(), "thumbnailUrl": text(), "uploadDate": text(), "description": text()}, "VideoObject")
    no_video = lambda x: F.struct(F.lit("VideoObject").alias("@type"), *[(as_of if n == "uploadDate" else F.lit("")).alias(n) for n in ("name", "contentUrl", "thumbnailUrl", "uploadDate", "description")])
    return {
        "@context": text("https://schema.org"), "@type": first_text("Recipe"), "id": now(key), "name": text(), "description": text(), "image": images, "author": _author, "datePublished": now(as_of), "dateModified": now(as_of),
        "recipeYield": longest_text, **blanks("prepTime", "cookTime", "totalTime"), "recipeCategory": joined_text, "recipeCuisine": joined_text, "keywords": cut_texts, "aggregateRating": _rating, "nutrition": record(blanks(*NUTRITION)),
        "recipeIngredient": texts, "recipeInstructions": _steps, "notes": text(), "tags": texts, "video": only_if(lambda x: F.coalesce((at(x, "$['@type']", plain) == "VideoObject") & at(x, "$.contentUrl", lambda u: _is(u, "STRING")), F.lit(False)), video, no_video),
        "servingSuggestions": joined_text, "cookingMethod": text(), "equipment": _tools, "suitableForDiet": texts,
        "provenance": record({**blanks("ethnicity", "originRegion"), "firstDocumented": text(None), "traditionalContext": text(), "notableVariations": texts, "relatedDishes": texts, "sources": lambda x: F.transform(those(items(x), _object), lambda i: F.to_json(i))}),
        "imageSource": text(), "inputImage": text(None), **blanks("_imported_from", "_editor_version"), "_access": record({"visibility": lambda x: F.coalesce(F.when(~blank(x), plain(x)), F.lit("public")), "sharedWith": texts}),
        "_source": record({"type": text("image"), **blanks(*SOURCE), "translated": truth, **blanks("translatedAt", "originalTitle")}),
        "_scoring": only_if(_object, record({**dict.fromkeys(("pageAuthority", "domainAuthority", "ouScore"), number), **blanks("rootDomain", "rawTitle", "iconUrl"), "recipeScore": whole(), "recipeScoreThreshold": whole()})),
        "_master": only_if(_object, record({"kind": text(None), "dish": text(None), "refreshed_at": text(None), "rank": whole(None), "queries": texts, "batch_source": text(None)})),
        "classification": only_if(_object, record({"confidence": whole(), **blanks("reasoning", "hierarchyPath", "story", "chapter")})), "editorial": only_if(_object, record(blanks("opinion", "scoreCommentary", "sourcingNotes"))),
        "current_status": only_if(lambda x: F.coalesce(at(x, "$.value", plain).isin("accepted", "rejected"), F.lit(False)), record({"value": text(None), "reason": text(None), "timestamp": text(None)})), "user_id": whole(None),
    }


def sanitized(v: Column, key: Column | None = None, as_of: Column | None = None) -> Column:
    """The typed record of a loose one: entities decoded, unions resolved and defaults filled by `rules`. Without a key or time for what has none, these are empty texts."""
    fields = rules(F.lit("") if key is None else key, F.lit("") if as_of is None else as_of)
    return let(decoded(v)["value"], lambda x: F.struct(*[by(F.try_variant_get(x, f"$['{name}']", "variant"), rule).alias(name) for name, rule in fields.items()]))
