"""Queries of what records are made of: decoding at any depth, the whole typed record, texts for embeddings, copies for another owner, vectors as bytes, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import documents as D
from gristmill.functions import text as T
from gristmill.functions import urls as U
from gristmill.functions import vectors as V
from gristmill.functions.sanitize import NUTRITION, SOURCE, sanitized
from gristmill.operators import state
from gristmill.plans.registry import query as _query
from gristmill.session import dealt, table


def _key(name: str) -> Column:
    return F.col(name).cast("string")


# --- decoding

@_query("""SELECT doc_id, 'A & ' || source AS title, sha256(text) AS body_sha256, '''' || lang || '''' AS tag, 'é<' AS deep, value AS n, '&lt;' AS kept_key, '&zzz; 1 < 2' AS unknown,
(3 + CASE WHEN contains(text, '&') THEN 1 ELSE 0 END + CASE WHEN event_id IS NULL THEN 0 ELSE 1 END)::INT AS changed, coalesce(props, '') AS props FROM documents LEFT JOIN events ON event_id = doc_id""")
def decoded_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an event in each as nested records whose texts hold entities; keys that look like some stay."""
    lit = F.lit
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "value", "props")
    d = table(spark, sf_dir, "documents").join(e, "doc_id", "left")
    deep = F.array(F.array(F.struct(F.col("value").alias("n"), lit("&eacute;&#x3C;").alias("t"))))
    doc = F.to_json(F.struct(F.concat(lit("A &amp; "), "source").alias("title"), F.replace("text", lit("&"), lit("&amp;")).alias("body"), F.array(F.concat(lit("&#39;"), "lang", lit("&apos;")), lit(None)).alias("tags"), deep.alias("deep"), F.create_map(lit("&lt;"), F.struct(lit("&lt;").alias("x"))).alias("&amp;"), lit("&zzz; 1 < 2").alias("unknown"), F.replace("props", lit('"'), lit("&quot;")).alias("props")))
    x = d.withColumn("x", D.decoded(F.parse_json(doc)))
    v, at = F.col("x.value"), lambda path: D.text_at(F.col("x.value"), path)
    inner = F.map_keys(F.try_variant_get(v, "$['&amp;']", "map<string,variant>"))
    # the text under the strange key is decoded as well, and counted
    return x.select("doc_id", at("$.title").alias("title"), F.sha2(F.encode(at("$.body"), "UTF-8"), 256).alias("body_sha256"), at("$.tags[0]").alias("tag"), at("$.deep[0][0].t").alias("deep"), F.try_variant_get(v, "$.deep[0][0].n", "double").alias("n"), F.get(inner, F.lit(0)).alias("kept_key"), at("$.unknown").alias("unknown"), (F.col("x.changed") - F.when(at("$['&amp;']['&lt;'].x") == "<", 1).otherwise(0)).alias("changed"), F.coalesce(at("$.props"), lit("")).alias("props"))


# --- the typed record

_EMPTY_SOURCE = '{"type":"«type»",' + ",".join(f'"{n}":""' for n in SOURCE) + ',"translated":false,"translatedAt":"","originalTitle":""}'
#: What a record holds where nothing stands, field by field in order.
_DEFAULT = {
    "@context": '"https://schema.org"', "@type": '"Recipe"', "id": '"id-«k»"', "name": '""', "description": '""', "image": "[]", "author": '{"@type":"Person","name":""}', "datePublished": '"2024-01-01"', "dateModified": '"2024-01-01"', "recipeYield": '""', "prepTime": '""', "cookTime": '""', "totalTime": '""', "recipeCategory": '""', "recipeCuisine": '""', "keywords": "[]",
    "aggregateRating": '{"@type":"AggregateRating","ratingValue":0.0,"reviewCount":0}', "nutrition": "{" + ",".join(f'"{n}":""' for n in NUTRITION) + "}", "recipeIngredient": "[]", "recipeInstructions": "[]", "notes": '""', "tags": "[]", "video": '{"@type":"VideoObject","name":"","contentUrl":"","thumbnailUrl":"","uploadDate":"2024-01-01","description":""}',
    "servingSuggestions": '""', "cookingMethod": '""', "equipment": "[]", "suitableForDiet": "[]", "provenance": '{"ethnicity":"","originRegion":"","traditionalContext":"","notableVariations":[],"relatedDishes":[],"sources":[]}', "imageSource": '""', "inputImage": "", "_imported_from": '""', "_editor_version": '""', "_access": '{"visibility":"public","sharedWith":[]}', "_source": _EMPTY_SOURCE.replace("«type»", "image"),
    "_scoring": "", "_master": "", "classification": "", "editorial": "", "current_status": "", "user_id": "",
}
#: Loose records, each with the fields in which the typed one differs from the defaults. «n» is a part's name and «k» its key.
_SHAPES: list[tuple[str, dict[str, str]]] = [
    ("{}", {}),
    ('{"@context": "null", "@type": ["Thing", "Recipe"], "id": "own", "name": "«n» &amp; more", "description": " None ", "image": "one.png", "author": "Ann", "datePublished": "2020", "dateModified": "", "recipeYield": ["4", 4, "4 dozen «n»", "another one"], "keywords": "a, «n»,, b ", "recipeCategory": ["x", "", null, " «n» "], "recipeCuisine": "Thai"}',
     {"id": '"own"', "name": '"«n» & more"', "image": '["one.png"]', "author": '{"@type":"Person","name":"Ann"}', "datePublished": '"2020"', "recipeYield": '"«y»"', "keywords": '["a","«n»","b"]', "recipeCategory": '"x, «n»"', "recipeCuisine": '"Thai"'}),
    ('{"@type": ["", "NewsArticle"], "name": null, "image": [{"@type": "ImageObject", "url": "u«k»"}, "v", {"contentUrl": "w"}, {"@id": "#x"}, 7, {"url": " "}], "author": [{"name": ""}, "skipped", {"@type": "Organization", "name": "«n»", "image": "face"}, {"name": "later"}], "recipeYield": 6, "keywords": ["k1", "k,2"], "aggregateRating": {"@type": "AggregateRating", "ratingValue": 4.5, "ratingCount": 17}, "nutrition": {"calories": 200, "fatContent": "null", "proteinContent": "3 g"}, "prepTime": "PT5M", "cookTime": "PT1H", "totalTime": "PT65M"}',
     {"@type": '"NewsArticle"', "image": '["u«k»","v","w","#x"]', "author": '{"@type":"Person","name":"«n»","image":"face"}', "recipeYield": '"6"', "keywords": '["k1","k,2"]', "aggregateRating": '{"@type":"AggregateRating","ratingValue":4.5,"reviewCount":17}', "nutrition": '{"calories":"200","fatContent":"","carbohydrateContent":"","proteinContent":"3 g"}', "prepTime": '"PT5M"', "cookTime": '"PT1H"', "totalTime": '"PT65M"'}),
    ('{"aggregateRating": {"@type": "AggregateRating", "ratingValue": "4.5", "reviewCount": 3}, "recipeIngredient": ["1 &lt; 2", "«n»"], "recipeInstructions": ["Mix", {"@type": "HowToStep", "name": "Bake", "text": "Bake «n»", "image": [{"url": ""}, {"url": "s.png"}], "position": 9}, {"type": "x", "text": "Cool &amp; serve", "image": {"contentUrl": "t.png"}, "imageCredit": "me"}, 3], "equipment": [{"@type": "HowToTool", "name": "pan"}, "pot"], "tags": ["t1", "t2"], "suitableForDiet": "Vegan", "servingSuggestions": ["warm", "", "cold"], "cookingMethod": "oven", "notes": "n&nbsp;b"}',
     {"recipeIngredient": '["1 < 2","«n»"]', "recipeInstructions": '[{"@type":"HowToStep","position":1,"text":"Mix"},{"@type":"HowToStep","position":9,"name":"Bake","text":"Bake «n»","image":"s.png"},{"@type":"HowToStep","position":3,"text":"Cool & serve","image":"t.png","imageCredit":"me"}]', "equipment": '[{"@type":"HowToTool","name":"pan"},{"@type":"HowToTool","name":"pot"}]', "tags": '["t1","t2"]', "suitableForDiet": '["Vegan"]', "servingSuggestions": '"warm, cold"', "cookingMethod": '"oven"', "notes": '"n b"'}),
    ('{"video": {"@type": "VideoObject", "contentUrl": "v.mp4", "name": "«n»"}, "provenance": {"ethnicity": "Thai", "firstDocumented": "1900", "notableVariations": ["a"], "relatedDishes": null, "sources": [{"u": 1}, "text"]}, "imageSource": "web", "inputImage": "in.png", "_imported_from": "x", "_editor_version": "2", "_access": {"visibility": "private", "sharedWith": ["a", "b"]}, "_source": {"type": "web", "originalUrl": "https://a.example/«k»", "translated": true, "siteName": null}}',
     {"video": '{"@type":"VideoObject","name":"«n»","contentUrl":"v.mp4","thumbnailUrl":"","uploadDate":"","description":""}', "provenance": '{"ethnicity":"Thai","originRegion":"","firstDocumented":"1900","traditionalContext":"","notableVariations":["a"],"relatedDishes":[],"sources":["{\\"u\\":1}"]}', "imageSource": '"web"', "inputImage": '"in.png"', "_imported_from": '"x"', "_editor_version": '"2"', "_access": '{"visibility":"private","sharedWith":["a","b"]}',
      "_source": _EMPTY_SOURCE.replace("«type»", "web").replace('"originalUrl":""', '"originalUrl":"https://a.example/«k»"').replace('"translated":false', '"translated":true')}),
    ('{"video": {"@type": "VideoObject", "contentUrl": 5}, "aggregateRating": {"@type": "AggregateRating", "ratingValue": 4, "reviewCount": 2.5}, "_scoring": {"pageAuthority": 31.5, "rootDomain": "a.example", "recipeScore": 8}, "_master": {"kind": "top", "rank": 3, "queries": ["q«k»"]}, "classification": {"confidence": 80, "chapter": "Soups"}, "editorial": {"opinion": "«n»!"}, "current_status": {"value": "accepted", "reason": "fine"}, "user_id": «k»}',
     {"_scoring": '{"pageAuthority":31.5,"domainAuthority":0.0,"ouScore":0.0,"rootDomain":"a.example","rawTitle":"","iconUrl":"","recipeScore":8,"recipeScoreThreshold":0}', "_master": '{"kind":"top","rank":3,"queries":["q«k»"]}', "classification": '{"confidence":80,"reasoning":"","hierarchyPath":"","story":"","chapter":"Soups"}', "editorial": '{"opinion":"«n»!","scoreCommentary":"","sourcingNotes":""}', "current_status": '{"value":"accepted","reason":"fine"}', "user_id": "«k»"}),
    ('{"name": [], "image": {}, "author": {"name": "«n»", "image": null}, "keywords": [], "recipeYield": [], "recipeInstructions": " first \\n\\n second ", "aggregateRating": {"@type": "AggregateRating"}, "nutrition": [], "provenance": "x", "current_status": {"value": "maybe"}, "_scoring": "no", "recipeCategory": "none", "equipment": "pan"}',
     {"author": '{"@type":"Person","name":"«n»"}', "recipeInstructions": '[{"@type":"HowToStep","position":1,"text":"first"},{"@type":"HowToStep","position":2,"text":"second"}]'}),
    ('{"recipeInstructions": [{"@type": "HowToSection", "itemListElement": [{"@type": "HowToStep", "text": "in «n»"}, "plain"]}, {"name": "named alone"}], "recipeIngredient": "one only", "tags": "lone", "author": {"@type": "Person"}}',
     {"recipeInstructions": '[{"@type":"HowToStep","position":1,"text":"in «n»"},{"@type":"HowToStep","position":2,"text":"plain"},{"@type":"HowToStep","position":3,"name":"named alone","text":"named alone"}]', "recipeIngredient": '["one only"]', "tags": '["lone"]'}),
]


def _expected(own: dict[str, str]) -> str:
    return "{" + ",".join(f'"{f}":{own.get(f, d)}' for f, d in _DEFAULT.items() if own.get(f, d)) + "}"


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_RECORDS = " ".join(f"WHEN {i} THEN {_sql_text(_expected(own))}" for i, (_, own) in enumerate(_SHAPES))


@_query(f"SELECT p_partkey, replace(replace(replace(CASE p_partkey % {len(_SHAPES)} {_RECORDS} END, '«y»', CASE WHEN length(p_name) > 3 THEN '4 dozen ' || p_name ELSE 'another one' END), '«n»', p_name), '«k»', p_partkey::VARCHAR) AS record FROM part")
def sanitized_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of the typed record, from records in which each stands in another shape, or in none."""
    k = F.col("p_partkey")
    shape = F.element_at(F.array(*[F.lit(x) for x, _ in _SHAPES]), (k % len(_SHAPES) + 1).cast("int"))
    v = F.parse_json(F.replace(F.replace(shape, F.lit("«n»"), F.col("p_name")), F.lit("«k»"), _key("p_partkey")))
    return dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name")).select("p_partkey", F.to_json(sanitized(v, F.concat(F.lit("id-"), _key("p_partkey")), F.lit("2024-01-01"))).alias("record"))


# --- texts for embeddings

_CARD = "CASE WHEN {i} % 4 = 0 THEN source || CASE WHEN {i} % 3 = 0 THEN '' ELSE '. Title ' || {i} END || CASE WHEN {i} % 8 = 0 THEN '. cuisine: ' || lang ELSE '' END || CASE WHEN {i} % 5 = 0 OR {i} % 8 <> 0 THEN '. ethnicity: ' || CASE WHEN {i} % 5 = 0 THEN 'other' ELSE upper(lang) END ELSE '' END || CASE WHEN {i} % 7 < 3 THEN '. primary: ' || CASE WHEN {i} % 7 = 0 THEN '' WHEN {i} % 7 = 1 THEN 'salt' ELSE 'salt, oil' END ELSE '' END || CASE WHEN {i} % 12 = 0 THEN '. technique: baked' ELSE '' END"


def _card(i: Column) -> Column:
    """An identity card for every fourth document; the others have none, or one that names no dish."""
    leading = F.when(i % 7 == 0, F.array(F.lit(""))).when(i % 7 == 1, F.array(F.lit("salt"))).when(i % 7 == 2, F.array(F.lit("salt"), F.lit(None), F.lit("oil"))).otherwise(F.array().cast("array<string>"))
    card = F.struct(F.when(i % 4 == 0, F.concat(F.lit(" "), "source")).otherwise(" ").alias("likelyDish"), F.when(i % 8 == 0, F.col("lang")).alias("cuisine"), F.when(i % 5 == 0, " other ").otherwise(F.upper("lang")).alias("ethnicity"), leading.alias("primaryIngredients"), F.when(i % 12 == 0, F.lit("baked")).alias("technique"))
    return F.when(i % 4 < 2, card)


def _title(i: Column) -> Column:
    return F.when(i % 3 == 0, F.upper("source")).otherwise(F.concat(F.lit("Title "), i.cast("string"), F.lit(" ")))


@_query(f"SELECT doc_id, {_CARD.format(i='doc_id')} ELSE '' END AS text FROM documents")
def identity_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards with and without each of their parts; titles that repeat the dish, and cards that are missing."""
    i = F.col("doc_id")
    held = F.when(F.trim(_card(i)["likelyDish"]) != "", _card(i))
    return table(spark, sf_dir, "documents").select("doc_id", T.identity_text(held, F.when(i % 4 == 0, _title(i))).alias("text"))


@_query(f"SELECT doc_id, {_CARD.format(i='doc_id')} ELSE CASE WHEN doc_id % 3 = 0 THEN upper(source) ELSE 'Title ' || doc_id END || '. ' || lang || CASE WHEN doc_id % 2 = 0 THEN '. q' || doc_id ELSE '' END END AS text FROM documents")
def dish_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card's text, or name, description and queries without those that differ by case alone."""
    i = F.col("doc_id")
    queries = F.array(F.upper("lang"), F.lit(" "), F.lower(_title(i)), F.when(i % 2 == 0, F.concat(F.lit(" q"), i.cast("string"))))
    return table(spark, sf_dir, "documents").select("doc_id", T.dish_text(_card(i), _title(i), F.concat(F.lit(" "), "lang"), queries).alias("text"))


@_query(f"""SELECT doc_id, {_CARD.format(i='doc_id')} ELSE CASE WHEN doc_id % 6 = 1 THEN 'signal. ' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN upper(source) ELSE 'Title ' || doc_id END || CASE WHEN doc_id % 2 = 0 THEN '. cuisine: ' || lang ELSE '. cuisine: eth' END || CASE WHEN doc_id % 5 = 0 THEN '. chapter: Soups' ELSE '' END
  || CASE WHEN len(f) > 0 THEN '. ingredients: ' || array_to_string(f, ', ') ELSE '' END END AS text FROM (SELECT *, list_filter(list_transform(string_split(text, ' ')[1:8], lambda x: trim(x)), lambda x: x <> '') AS f FROM documents)""")
def recipe_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card's text, or what the record itself says; of its ingredients, here the words of the whole text, the first eight."""
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", T.recipe_text(_card(i), _title(i), F.when(i % 6 == 1, " signal ").otherwise(" "), F.when(i % 2 == 0, F.col("lang")).otherwise(""), F.lit("eth"), F.when(i % 5 == 0, "Soups"), F.split("text", " ")).alias("text"))


@_query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN [lang, source] WHEN 1 THEN [source] WHEN 2 THEN [] ELSE CASE WHEN doc_id % 5 = 3 THEN [lang] ELSE [] END END AS leading FROM documents")
def primary_ingredients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading ingredients of a card by role, blank ones and other roles left out."""
    i, one = F.col("doc_id") % 5, lambda t, r: F.struct(t.alias("text"), F.lit(r).alias("role"))
    lang, source, blank = F.concat(F.lit(" "), "lang"), F.col("source"), F.lit("  ")
    roles = F.when(i == 0, F.array(one(lang, "main_protein"), one(blank, "starch"), one(source, "filling"))).when(i == 1, F.array(one(lang, "garnish"), one(source, "sauce_base"))).when(i == 2, F.array(one(lang, "base"))).when(i == 3, F.array(one(source, "star"), one(lang, "pastry")))
    return table(spark, sf_dir, "documents").select("doc_id", D.primary(roles).alias("leading"))


# --- copies for another owner

@_query("""SELECT c_custkey AS source_id, 'user:7' AS owner, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'master' ELSE 'user:' || (c_custkey % 5 + 20) END AS claimed_from, '1998-06-01 00:00:00' AS claimed_at, c_custkey::VARCHAR AS claimed_id, 'https://a.example/' || c_custkey AS original_url, false AS kept_private, '' AS url_normalized
FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 0)""")
def claim_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies for a user: what belongs to no owner, stamped with where it comes from and detached from its URL; what the user has already isn't copied again."""
    k, lit = F.col("c_custkey"), F.lit
    of = F.struct(F.concat(lit("https://a.example/"), k.cast("string")).alias("originalUrl"), lit("secret").alias("affiliateUrl"), lit("old").alias("claimedFrom"))
    data = F.to_variant_object(F.struct(F.col("c_name").alias("name"), lit(1).alias("user_id"), F.struct(lit("private").alias("visibility")).alias("_access"), of.alias("_source")))
    source = table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 2 == 0, 0).otherwise(k % 5 + 20).alias("user_id"), data.alias("data"))
    stamp = lambda c: F.to_variant_object(F.struct(F.struct(c.cast("string").alias("claimedFromRecipeId")).alias("_source")))
    own = table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(lit(7).alias("user_id"), stamp(F.col("o_custkey")).alias("data")).unionByName(source.select(lit(8).alias("user_id"), stamp(F.col("id")).alias("data")))
    made, at = state.claimed(source, own, 7, F.to_timestamp(lit("1998-06-01 00:00:00"))), lambda path: D.text_at(F.col("data"), path)
    private = F.coalesce(at("$._source.affiliateUrl"), at("$._access.visibility"), at("$.user_id")).isNotNull()
    return made.select(at("$._source.claimedFromRecipeId").cast("long").alias("source_id"), F.concat(lit("user:"), F.col("user_id").cast("string")).alias("owner"), at("$.name").alias("name"), at("$._source.claimedFrom").alias("claimed_from"), at("$._source.claimedAt").alias("claimed_at"), at("$._source.claimedFromRecipeId").alias("claimed_id"), at("$._source.originalUrl").alias("original_url"), private.alias("kept_private"), "url_normalized")


# --- vectors as bytes

_BITS = "(CASE WHEN x < 0 THEN 2147483648 ELSE 0 END + CASE WHEN x = 0 THEN 0 ELSE (e + 127) * 8388608 + ((abs(x::DOUBLE) / pow(2.0, e)) - 1) * 8388608 END)::BIGINT"
_EXPONENT = "(floor(log2(abs(x::DOUBLE))) + CASE WHEN abs(x::DOUBLE) >= pow(2.0, floor(log2(abs(x::DOUBLE))) + 1) THEN 1 WHEN abs(x::DOUBLE) < pow(2.0, floor(log2(abs(x::DOUBLE)))) THEN -1 ELSE 0 END)"


@_query(f"""SELECT v.vec_id, CASE v.vec_id % 6 WHEN 1 THEN 'torn' WHEN 2 THEN 'dimension' WHEN 3 THEN 'empty' WHEN 4 THEN 'empty' ELSE 'ok' END AS state, v.vec_id % 6 IN (0, 5) AS same, sha256(h.held) AS bytes_sha256
FROM embeddings v JOIN (SELECT vec_id, string_agg(printf('%02x%02x%02x%02x', b % 256, (b // 256) % 256, (b // 65536) % 256, b // 16777216), '' ORDER BY i) AS held FROM (SELECT vec_id, i, {_BITS} AS b FROM (SELECT *, CASE WHEN x <> 0 THEN {_EXPONENT} END AS e FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings))) GROUP BY vec_id) h USING (vec_id)""")
def vector_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as little-endian bytes, by the digest of their hex, and read again; some of the bytes are torn, short, empty or missing."""
    k = F.col("vec_id") % 6
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", V.to_bytes(F.col("embedding")).alias("held"))
    n = F.octet_length("held")
    damaged = F.when(k == 1, F.substring("held", F.lit(1), n - 1)).when(k == 2, F.substring("held", F.lit(1), n - 4)).when(k == 3, F.lit(b"").cast("binary")).when(k != 4, F.col("held"))
    v = v.withColumn("damaged", damaged).withColumn("back", V.from_bytes(F.col("damaged"), 64))
    return v.select("vec_id", V.byte_state(F.col("damaged"), 64).alias("state"), F.coalesce(F.col("back") == F.col("embedding"), F.lit(False)).alias("same"), F.sha2(F.lower(F.hex("held")), 256).alias("bytes_sha256"))


# --- names and links

@_query("""SELECT p_partkey, array_to_string(list_transform(CASE p_partkey % 3 WHEN 0 THEN list_filter(string_split_regex(p_name || '_x', '[-_\\s]+'), lambda w: w <> '') WHEN 1 THEN ['Bigred', 'Apple'] ELSE ['banana', 'bread'] END, lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title,
'https://shop.example/r/' || p_partkey AS link, CASE p_partkey % 2 WHEN 0 THEN 'a-b-c' ELSE 'part-' || p_partkey END AS slug, p_partkey % 4 = 0 AS own, p_partkey % 4 IN (1, 2) AS private FROM part""")
def file_and_link_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles from file names, permalinks, slugs, and which hosts are our own or private."""
    k, lit = F.col("p_partkey"), F.lit
    file = F.when(k % 3 == 0, F.concat(lit("/d/context-"), "p_name", lit("_x.json"))).when(k % 3 == 1, "in/BigredApple3.json").otherwise("context-banana-bread.json")
    url = F.when(k % 4 == 0, "https://www.Shop.example:443/x").when(k % 4 == 1, "http://192.168.0.7/y").when(k % 4 == 2, "http://localhost:8000/").otherwise("https://other.example/")
    return table(spark, sf_dir, "part").select("p_partkey", U.title_from_file(file).alias("title"), U.permalink("shop.example", k).alias("link"), U.slug(F.when(k % 2 == 0, " A  b/c!").otherwise(F.concat(lit("Part #"), k.cast("string")))).alias("slug"), U.is_self_host(url, ["shop.example"]).alias("own"), U.is_private_host(url).alias("private"))
