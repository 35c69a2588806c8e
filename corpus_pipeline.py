"""A training corpus from documents: STAGES, each of them one operator of gristmill.llm, and run() that applies them in turn.

Every stage is written to the shared folder and read again before the next one. All but the last return the columns of
documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import jaccard_join, language_id, line_dedup, mixing, packing
from gristmill.session import staged, table

#: The share of a document that its languages must have together.
LEAST_SHARE = 0.5
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language that was learned: no letters or no text, or a selected set of languages with less than half of the document.

    Repeated rows and null keys are judged by their text like any other; an empty table stays empty.
    """
    held = language_id.identify(docs, language_id.fit(docs))
    return held.where((F.col("lang_pred") != "und") & (F.col("set_share") >= LEAST_SHARE)).select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines of recurring templates, and documents of which nothing is left; n_chars follows the text.

    Null and blank texts go. Repeated rows lose the same lines, null keys come after all others, and an empty table stays empty.
    """
    held = line_dedup.drop_recurring_lines(docs.select(COLUMNS))
    return held.where(F.length(F.btrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))) > 0).withColumn("n_chars", F.length("text").cast("long"))


def told_apart(docs: DataFrame) -> DataFrame:
    """docs with `_row`, a number that no two rows share and every reading repeats: a row's file and place in it, if docs are read from files as they are, else a number written beside the rows.

    Whether files and places do tell all rows apart is counted and not taken for granted, so joins, repeated rows or like hashes of two paths lead to the second way.
    """
    try:
        place = F.col("_metadata.row_index")
        held = docs.select(*COLUMNS, place.alias("_place"), (F.xxhash64("_metadata.file_path").bitwiseAND((1 << 36) - 1) * F.lit(1 << 27) + place).alias("_row"))
    except AnalysisException:
        held = None
    if held is not None and not held.groupBy("_row").agg(F.count("*").alias("n"), F.max("_place").alias("most")).where((F.col("n") > 1) | (F.col("most") >= 1 << 27)).limit(1).count():
        return held.drop("_place")
    return staged(docs.select(COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "rows")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each group that five-word shingles link at 0.8 or more.

    Rows are told apart by a number of their own, so repeated and null keys are groups like any other.
    """
    rows = told_apart(docs)
    found = jaccard_join.jaccard_components(rows, ngram=5, num=80, den=100, key="_row").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
    # of each group one row: a grouped minimum, not a window, since a group may hold any part of the rows
    ids = rows.select("_row", "doc_id").join(found, "_row")
    stay = ids.groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_row")).alias("_x")).select(F.col("_x._row").alias("_row"))
    return rows.join(stay, "_row", "left_semi").select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target asks: left out, once or twice; the copies come shard after shard, each shard shuffled.

    Null texts have no words and follow their block; null sources are a source of its own. Repeated rows and null keys count each for itself. An empty table stays empty.
    """
    plan = mixing.mix_plan(docs.select(COLUMNS), keep=("text", "lang", "n_chars"))
    return mixing.shuffled(plan).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix into sequences of 2048 tokens: a row for each piece of each copy.

    Null and empty texts are one token. Repeated rows and null keys are packed each for itself; an empty table gives none.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


STAGES = [("language ID", languages), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("mixing sources to target weights", mix), ("best-fit packing", pack)]

#: Language models, hash orders and packing are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, "stage")
    return docs
