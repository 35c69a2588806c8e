"""Operators on tables with columns of their own names, null keys and repeated rows."""

from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gristmill.llm import packing, sharding, token_count

NAMES = ("row_number", "_part", "_at", "_n", "_first", "shard", "slot", "size", "length", "piece", "start", "offset", "sequence_id", "ids_crc32", "ids", "n_bytes", "n_tokens", "over_limit", "text_crc32", "_row", "_x", "n", "key", "chunk")


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(1, "one two three"), (1, "one two three"), (None, "one two three"), (None, None), (2, ""), (3, "a b " * 3000), (None, "a b " * 3000), (4, "é 한국어 \x00 \n\n"), (4, "other")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache(), rows


def _both(df):
    return df, df.withColumns({c: F.lit("clash") for c in NAMES})


def test_token_counts_of_null_keys_and_repeats(spark, clashing):
    import sentencepiece

    df, rows = clashing
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter((d, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for d, t in rows)
    for held in _both(df):
        assert Counter(map(tuple, token_count.token_counts(held, public_tokenizers.path("piece_bpe_32k.model"), limit=4096).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())) == want


def test_shards_do_not_see_other_columns(spark, clashing):
    df, rows = clashing
    plain, clash = (Counter(map(tuple, sharding.shard_documents(held, 3).select("doc_id", "size", "text_crc32", "row_number", "shard", "slot").collect())) for held in _both(df))
    assert plain == clash and sum(plain.values()) == len(rows)
    assert Counter(r[0] for r in plain.elements()) == Counter(d for d, _ in rows)
    slots = Counter((r[4], r[5]) for r in plain.elements())
    assert max(slots.values()) == 1 and sorted(r[3] for r in plain.elements()) == list(range(len(rows)))


def test_packs_do_not_see_other_columns(spark, clashing):
    df, rows = clashing
    plain, clash = (sorted((tuple(r) for r in packing.pack(held, public_tokenizers.path("word_bpe_49k.json"), 512).select("doc_id", "piece", "start", "length", "ids_crc32").collect()), key=repr) for held in _both(df))
    assert plain == clash
    assert Counter(r[0] for r in plain if r[1] == 0) == Counter(d for d, _ in rows)


def test_repeats_are_the_removed_runs(spark):
    from gristmill.llm import substring_dedup

    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(25))
    rows = [(1, f"{a} {b}"), (2, f"x {b} y {a}"), (3, a.split(" ", 1)[1]), (4, None), (5, "short")]
    held = {r["doc_id"]: r for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True, with_repeats=True).collect()}
    assert {k: [tuple(x) for x in r["repeats"]] for k, r in held.items()} == {1: [], 2: [(1, 25), (27, 40)], 3: [(0, 39)], 4: [], 5: []}
    assert held[2]["kept"] == "x y" and all(sum(x["length"] for x in r["repeats"]) == r["n_removed"] for r in held.values())
