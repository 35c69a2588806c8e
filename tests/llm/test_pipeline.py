"""Each stage of the pipeline against plain Python, on the planted documents with null keys and repeated rows, and on an empty table."""

import glob
import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from gristmill.llm import language_id, mixing
from llm import brute

AT = {name: i for i, name in enumerate(pipeline.COLUMNS)}


@pytest.fixture(scope="module")
def rows(planted):
    """The planted documents, some of them again under the same key and under none."""
    held = planted.select(pipeline.COLUMNS)
    again = held.where("doc_id % 10 = 0")
    return held.unionByName(again).unionByName(again.where("doc_id % 20 = 0").withColumn("doc_id", F.lit(None).cast("long"))).cache()


def _listed(df):
    assert df.columns == pipeline.COLUMNS
    return [tuple(r) for r in df.collect()]


def test_languages_are_chosen_by_score(spark, rows):
    model = language_id.fit(rows)
    held = _listed(rows)
    pred, _, _, share = model.predict([r[AT["text"]] for r in held], 3.0)
    want = Counter(r for r, p, s in zip(held, pred, share, strict=True) if p != "und" and s >= 0.5)
    assert Counter(_listed(pipeline.languages(spark, rows, ""))) == want
    assert 0 < sum(want.values()) < len(held)


def test_lines_go_and_blank_texts_with_them(spark, rows):
    held = _listed(rows)
    # the twin takes distinct ids: copies of a text are one document, that of its least key, null last
    least = {}
    for r in held:
        if r[1] is not None:
            least[r[1]] = min(least.get(r[1], 1 << 62), 1 << 62 if r[0] is None else r[0])
    order = sorted(least, key=lambda t: (least[t], hashlib.md5(t.encode()).digest()))
    kept = {order[d]: text for d, (text, _, _) in brute.drop_recurring_lines(list(enumerate(order))).items()}
    want = Counter((r[0], kept[r[1]], r[2], r[3], len(kept[r[1]])) for r in held if r[1] is not None and kept[r[1]].strip(" \t\n\x0b\x0c\r"))
    assert Counter(_listed(pipeline.lines(spark, rows, ""))) == want


def test_one_document_of_each_group_stays(spark, rows):
    held = _listed(rows)
    groups = defaultdict(list)
    for i, (_, group) in brute.jaccard_components([(i, r[1]) for i, r in enumerate(held)], 5, 80, 100).items():
        groups[group].append(held[i])
    found = Counter(_listed(pipeline.near_duplicates(spark, rows, "")))
    assert sum(found.values()) == len(groups)
    # rows of a group that share its least key may differ, so what stays is told by key and group
    keys = Counter(min((r[0] is None, r[0] or 0) for r in own) for own in groups.values())
    assert Counter((r[0] is None, r[0] or 0) for r in found.elements()) == keys
    assert not found - Counter(held)


def test_rows_of_files_are_told_apart_by_their_place(spark, rows, tmp_path):
    at = str(tmp_path / "docs")
    rows.repartition(4).write.parquet(at)
    docs = spark.read.parquet(at)
    told = pipeline.told_apart(docs)
    assert not glob.glob(f"{tmp_path}/*rows*") and "rows-" not in told.inputFiles()[0]
    numbers = [r["_row"] for r in told.select("_row").collect()]
    assert len(set(numbers)) == len(numbers) == docs.count() and min(numbers) >= 0
    assert Counter(numbers) == Counter(r["_row"] for r in told.where("length(text) >= 0 or text is null").select("_row").collect())
    # rows that a join repeats share their place, and get numbers of their own
    twice = docs.crossJoin(spark.range(2)).select(docs["*"])
    assert pipeline.told_apart(twice).select("_row").distinct().count() == 2 * len(numbers)
    held = _listed(rows)
    found = Counter(_listed(pipeline.near_duplicates(spark, docs, "")))
    want = brute.jaccard_components([(i, r[1]) for i, r in enumerate(held)], 5, 80, 100)
    assert sum(found.values()) == len({g for _, g in want.values()}) and not found - Counter(held)


def test_the_mix_copies_whole_documents_up_to_each_target(spark, rows):
    held, found = Counter(_listed(rows)), Counter(_listed(pipeline.mix(spark, rows, "")))
    assert all(n <= 2 * held[r] for r, n in found.items())
    size, most = defaultdict(int), defaultdict(int)
    taken = defaultdict(int)
    for r in held.elements():
        size[r[3]] += len(brute.words(r[1]))
        most[r[3]] = max(most[r[3]], len(brute.words(r[1])))
    for r in found.elements():
        taken[r[3]] += len(brute.words(r[1]))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    total = [size[s] for s in order]
    for s, t in zip(order, mixing.water_filled(total, [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(total), 2), strict=True):
        assert abs(taken[s] - t) <= most[s]


def test_the_pack_holds_every_row(spark, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, by_seq = Counter(), defaultdict(int)
    for r in rows.collect():
        n = len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1
        want.update((r["doc_id"], k, a, min(2048, n - a)) for k, a in enumerate(range(0, n, 2048)))
    found = pipeline.pack(spark, rows, "").collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in found) == want
    for r in found:
        by_seq[r["sequence_id"]] += r["length"]
    assert max(by_seq.values()) <= 2048 and sum(by_seq.values()) == int(np.sum([k[3] * n for k, n in want.items()]))


def test_stages_of_an_empty_table(spark, rows):
    for _, stage in pipeline.STAGES:
        assert stage(spark, rows.limit(0), "").count() == 0


def test_run_applies_all_stages(spark, data):
    assert pipeline.run(spark, data).count() > 0
