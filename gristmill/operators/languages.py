"""Languages of texts by letter trigrams of their words, as joins and grouped sums: a model is a table, and so is an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.session import dealt, staged


#: How many of the commonest words of the labelled texts a model holds whole, so that they need not be taken apart.
WHOLE_WORDS = 50_000
#: Languages are summed side by side, so many in a row.
BLOCK = 16


def _words(df: DataFrame, text: Column, keys: list[str]) -> DataFrame:
    """keys, w: every word, which is a run of letters, in lower case, with a blank at either end."""
    return df.select(*keys, F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("w")).where("w <> ''").withColumn("w", F.concat(F.lit(" "), "w", F.lit(" ")))


def _places(w: Column) -> Column:
    return F.sequence(F.lit(1), F.length(w) - 2)


def _gram(w: Column, i: Column) -> Column:
    return F.substring(w, i, F.lit(3))


def _blocks(df: DataFrame, key: str) -> DataFrame:
    """gram, weights: of rows key, block, place and w, the weights of each block in order; null where a language has none."""
    held = F.slice(F.array(*[F.max(F.when(F.col("place") == i, F.col("w"))) for i in range(BLOCK)]), F.lit(1), F.max("place") + 1)
    return df.groupBy(F.col(key).alias("gram"), "block").agg(held.alias("w")).groupBy("gram").agg(F.collect_list(F.struct("block", "w")).alias("weights"))


def profiles(df: DataFrame, text: str = "text", lang: str = "lang", whole_words: int = WHOLE_WORDS) -> DataFrame:
    """gram, weights, langs: for each trigram of the labelled texts, how much more than a trigram never seen it speaks for each language that has it; the row of the empty gram holds the languages, where each has its weights, and what a never-seen one weighs.

    The commonest words stand there too, with a blank at either end and the weights of their trigrams summed. Add-half smoothing over all trigrams. Texts without a label or null take no part.
    """
    labelled = dealt(df.where(F.col(lang).isNotNull()).select(lang, text))
    words = staged(_words(labelled, F.col(text), [lang]).groupBy(F.col(lang).alias("lang"), "w").agg(F.count("*").alias("c")), "words")
    counts = staged(words.select("lang", "c", "w", F.explode(_places(F.col("w"))).alias("i")).groupBy("lang", _gram(F.col("w"), F.col("i")).alias("gram")).agg(F.sum("c").alias("c")), "grams")
    kinds = counts.select("gram").distinct().agg((0.5 * F.count("*")).alias("v"))
    total = counts.groupBy("lang").agg(F.sum("c").alias("n")).crossJoin(F.broadcast(kinds)).select("lang", F.ln(F.lit(0.5) / (F.col("n") + F.col("v"))).alias("base"))
    named = total.agg(F.array_sort(F.collect_list(F.struct("lang", "base"))).alias("x")).select(F.posexplode("x").alias("i", "x")).select("x.*", F.floor(F.col("i") / BLOCK).cast("int").alias("block"), (F.col("i") % BLOCK).alias("place"))
    weighed = counts.join(F.broadcast(named), "lang").select("gram", "block", "place", F.ln((F.col("c") + 0.5) / 0.5).alias("w"))
    # a word of one letter is a trigram itself
    common = words.where(F.length("w") > 3).groupBy("w").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "w").limit(whole_words).select(F.col("w").alias("word"))
    apart = common.select("word", F.explode(_places(F.col("word"))).alias("i")).select("word", _gram(F.col("word"), F.col("i")).alias("gram"))
    whole = apart.join(weighed, "gram").groupBy("word", "block", "place").agg(F.sum("w").alias("w"))
    langs = named.agg(F.collect_list(F.struct("lang", "block", "place", "base")).alias("langs")).select(F.lit("").alias("gram"), "langs")
    return staged(_blocks(weighed, "gram").unionByName(_blocks(whole, "word")).unionByName(langs, allowMissingColumns=True), "profiles")


def told(df: DataFrame, model: DataFrame, key: str, text: str, least: int = 50) -> DataFrame:
    """key, lang, margin: the likeliest language of each text of at least `least` characters (trimmed) and how much likelier than the next it is, for each trigram.

    Of equals the first by name. Texts that are shorter, null or without a letter have no row, and nor has anything when the model is empty. Keys have to differ.
    Words that the model holds whole are looked up once, all others by their trigrams. Texts are dealt out by their keys; words and trigrams are not shuffled unless the model is too large to broadcast.
    """
    known = model.where("gram <> ''").select("gram", "weights")
    asked = df.where(F.length(F.trim(F.col(text))) >= least).select(key, text).repartition(F.col(key))  # what is summed of a text is summed in one task
    words = _words(asked, F.col(text), [key]).join(known.select(F.col("gram").alias("w"), F.col("weights").alias("whole")), "w", "left")
    parts = words.select(key, "w", "whole", F.explode(F.when(F.col("whole").isNull(), _places(F.col("w"))).otherwise(F.array(F.lit(0)))).alias("i"))
    held = parts.withColumn("gram", F.when(F.col("i") > 0, _gram(F.col("w"), F.col("i")))).join(known, "gram", "left")
    n = F.when(F.col("i") > 0, F.lit(1)).otherwise(F.length("w") - 2)  # how many trigrams stand here
    each = held.select(key, n.alias("n"), F.posexplode_outer(F.coalesce("whole", "weights")).alias("at", "x")).select(key, F.when(F.coalesce("at", F.lit(0)) == 0, F.col("n")).alias("n"), "x")
    summed = staged(each.groupBy(key, "x.block").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("x.w", F.lit(i))) for i in range(BLOCK)]).alias("w")), "asked")
    langs = model.where("gram = ''").select(F.explode("langs").alias("x")).select("x.*")
    sums = summed.where("block is not null").select(key, "block", "w")
    scores = summed.groupBy(key).agg(F.sum("n").alias("n")).crossJoin(F.broadcast(langs)).join(sums, [key, "block"], "left").withColumn("score", F.coalesce(F.get("w", "place"), F.lit(0.0)) + F.col("n") * F.col("base"))
    best = scores.groupBy(key).agg(F.first("n").alias("n"), F.slice(F.array_sort(F.collect_list(F.struct((-F.round("score", 9)).alias("s"), "lang"))), 1, 2).alias("x"))
    return best.select(key, F.get("x", F.lit(0))["lang"].alias("lang"), ((F.get("x", F.lit(1))["s"] - F.get("x", F.lit(0))["s"]) / F.col("n")).alias("margin"))
