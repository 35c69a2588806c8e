"""Repeated bytes, vector codes and spelling variants against plain Python, with the awkward rows among the others."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import column_suffixes, spelling, vector_codes

CLASH = ("part", "chunk", "g", "ph", "n", "word", "root", "codes", "_label", "id", "block", "cut")


def _clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns})


# --- 11: repeated bytes


def _removed(rows, window):
    """rows: (doc_id, text). A Counter of doc_id, bytes, removed, spans, digest."""
    texts = [(t or "").encode() for _, t in rows]
    seen = defaultdict(list)
    for i, b in enumerate(texts):
        for s in range(len(b) - window + 1):
            seen[b[s : s + window]].append((i, s))
    gone = [np.zeros(len(b) + 1, int) for b in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                gone[i][s] += 1
                gone[i][s + window if s + window <= len(texts[i]) else -1] -= 1
    out = Counter()
    for (d, _), b, g in zip(rows, texts, gone, strict=True):
        cover = (np.cumsum(g) > 0)[:-1]
        spans = int((np.diff(np.r_[0, cover.astype(int)]) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~cover])
        out[d, len(b), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def _told(df):
    return Counter(map(tuple, df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()))


@pytest.fixture(scope="module")
def bytes_rows(planted):
    """The planted documents without the two longest, with rows that repeat, null keys and passages at edges and across letters of several bytes."""
    rows = [(r["doc_id"], r["text"]) for r in planted.select("doc_id", "text").collect() if len(r["text"] or "") < 100_000]
    line = "é".join(f"{i}ü" for i in range(70))
    more = [line, "x" + line, line[1:], line[:-1] + "?", "a" * 450, "ab" * 260, "ba" * 130 + "c", "q" * 199, "q" * 199, "r" * 200, "r" * 200, ("s%d " % 7) * 90, line + "tail" + line]
    rows += [(900_000 + i, t) for i, t in enumerate(more)]
    return rows + rows[:9] + [(None, t) for _, t in rows[5:14]]


def test_repeated_bytes_equal_brute_force(spark, bytes_rows):
    df = _clashing(spark.createDataFrame(bytes_rows, "doc_id long, text string").repartition(5))
    assert _told(column_suffixes.remove_repeated_bytes(df)) == _removed(bytes_rows, 200)


@pytest.mark.parametrize("crowd", [0, 2])
def test_crowded_anchors_are_taken_apart_without_a_change(spark, bytes_rows, crowd, monkeypatch):
    monkeypatch.setattr(column_suffixes, "PART_BYTES", 50_000)
    df = spark.createDataFrame(bytes_rows, "doc_id long, text string").repartition(5)
    assert _told(column_suffixes.remove_repeated_bytes(df, crowd=crowd)) == _removed(bytes_rows, 200)


def test_other_windows_many_small_collections_and_spans(spark, monkeypatch):
    monkeypatch.setattr(column_suffixes, "SLICE", 997)
    monkeypatch.setattr(column_suffixes, "BATCH", 16)
    rng = np.random.default_rng(3)
    base = "".join(rng.choice(list("abc"), 4000))
    texts = [base[a : a + int(k)] + "".join(rng.choice(list("abc"), 30)) for a, k in zip(rng.integers(0, 3900, 120).tolist(), rng.integers(0, 300, 120), strict=True)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for window in (12, 25, 60):
        assert _told(column_suffixes.remove_repeated_bytes(df, window=window)) == _removed(rows, window)
    held = column_suffixes.remove_repeated_bytes(df, window=25, with_spans=True).collect()
    for r in held:
        text, left = texts[r["doc_id"]].encode(), bytearray()
        at = 0
        for s in r["spans"]:
            left += text[at : s["start"]]
            at = s["start"] + s["length"]
        assert bytes(left + text[at:]) == bytes(r["kept"]) and len(r["spans"]) == r["n_spans"]


def test_repeated_bytes_of_few_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (3, "short")], "doc_id long, text string")
    empty = hashlib.sha256(b"").hexdigest()
    short = hashlib.sha256(b"short").hexdigest()
    assert _told(column_suffixes.remove_repeated_bytes(df)) == Counter({(1, 0, 0, 0, empty): 1, (2, 0, 0, 0, empty): 1, (3, 5, 0, 0, short): 2})
    assert column_suffixes.remove_repeated_bytes(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        column_suffixes.remove_repeated_bytes(df, window=11)


def test_rounds_find_what_pieces_share():
    rng = np.random.default_rng(5)
    core = rng.integers(0, 2, 30).astype(np.uint8).tobytes()
    pieces = [core[a : 14 + int(k)] for a, k in zip(rng.integers(0, 4, 40).tolist(), rng.integers(0, 12, 40), strict=True)]
    lo = np.array([core.find(p) + 0 for p in pieces])
    lo = lo.max() - lo
    group = np.sort(rng.integers(0, 5, 40))
    group = np.unique(group, return_inverse=True)[1]
    got = column_suffixes.repeated_windows(pieces, lo, group, 8)
    for i, p in enumerate(pieces):
        want = [any(group[j] == group[i] and j != i and lo[j] - lo[i] + t >= 0 and pieces[j][lo[j] - lo[i] + t : lo[j] - lo[i] + t + 8] == p[t : t + 8] for j in range(40)) for t in range(len(p) - 7)]
        assert got[i].tolist() == want


# --- 12: vector codes


def _codes(rows, entries, parts, rounds, scale):
    """rows: (id, vector, label), all usable. Sorted (id, code, error, label_error, digest)."""
    x = {i: np.floor(np.array(v, float) * scale).astype(int).reshape(parts, -1) for i, (_, v, _) in enumerate(rows)}
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    books = [[x[i][p].tolist() for i in first] for p in range(parts)]

    def nearest(p, v):
        far = [sum((int(a) - b) ** 2 for a, b in zip(v, e, strict=True)) for e in books[p]]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = defaultdict(list)
            for i in x:
                own[nearest(p, x[i][p])[0]].append(x[i][p])
            new.append([[int(s) // len(own[e]) for s in np.sum(own[e], 0)] if e in own else b for e, b in enumerate(books[p])])
        books = new
    digest = hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()
    found = [[nearest(p, x[i][p]) for p in range(parts)] for i in x]
    error = [sum(f[1] for f in own) for own in found]
    by = defaultdict(int)
    for (_, _, label), e in zip(rows, error, strict=True):
        by[label] += e
    return sorted(((rows[i][0], "".join(f"{f[0]:02x}" for f in own), error[i], by[rows[i][2]], digest) for i, own in enumerate(found)), key=repr)


def _rows(df):
    return sorted(map(tuple, df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def test_codes_equal_plain_rounds(spark, data, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", 64)
    rows = [(r["vec_id"], [float(v) for v in r["embedding"]], r["label"]) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    rows = rows[:150] + rows[:20] + [(None, rows[3][1], None), (None, rows[4][1], 1), (7000, rows[5][1], None)]
    bad = [(-5, None, 1), (-4, [float("nan")] * 64, 1), (-3, [None] + [0.5] * 63, 1), (-2, [float("-inf")] * 64, None)]
    df = _clashing(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int").repartition(3))
    assert _rows(vector_codes.compress(df)) == _codes(rows, 64, 16, 2, 256)


def test_codes_of_ties_few_vectors_and_other_shapes(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "LEAF", 2)
    rng = np.random.default_rng(1)
    rows = [(i, v, i % 3) for i, v in enumerate(rng.integers(-2, 3, (200, 6)).astype(float).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for entries, parts, rounds in ((64, 2, 2), (7, 3, 5), (1, 6, 1), (256, 1, 0)):
        assert _rows(vector_codes.compress(df, entries, parts, rounds, 1)) == _codes(rows, entries, parts, rounds, 1)
    few = df.where("vec_id < 3")
    assert _rows(vector_codes.compress(few, parts=2)) == _codes(rows[:3], 64, 2, 2, 256)
    held = vector_codes.compress(df, 4, 3, 1, 1, with_codebooks=True).first()
    assert hashlib.sha256(",".join(map(str, held["codebooks"])).encode()).hexdigest() == held["codebooks_sha256"] and len(held["codebooks"]) == 3 * 4 * 2
    assert vector_codes.compress(df.limit(0)).count() == 0
    assert vector_codes.compress(df.withColumn("embedding", F.lit(None).cast("array<double>"))).count() == 0


@pytest.mark.parametrize("bad", [[1.0] * 8, [1.0] * 15, [], [1e12] * 16])
def test_vectors_that_cannot_be_cut_are_errors(spark, bad):
    from pyspark.errors import PySparkException

    df = spark.createDataFrame([(1, [0.5] * 16, 1), (2, bad, 1)], "vec_id long, embedding array<double>, label int").coalesce(1)
    with pytest.raises((PySparkException, ValueError)):
        vector_codes.compress(df).count()


def test_trees_assign_as_a_plain_search_does():
    rng = np.random.default_rng(2)
    for n, k, dim, spread in ((1, 3, 2, 5), (8, 64, 4, 3), (1000, 64, 4, 40), (777, 17, 3, 2), (500, 9, 1, 4)):
        x, book = rng.integers(-spread, spread + 1, (n, dim)), rng.integers(-spread, spread + 1, (k, dim))
        tree = vector_codes.Tree.unpacked(vector_codes.Tree.over(x).packed(), dim)
        code, count, total = tree.assigned(book)
        want = ((x[:, None] - book) ** 2).sum(2).argmin(1)
        assert (code == want[tree.order]).all()
        assert (count == np.bincount(want, minlength=k)).all()
        assert all((total[e] == x[want == e].sum(0)).all() for e in range(k))


# --- 13: spelling variants


def _words(rows, spoil=199):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % spoil == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def _variants(n, times=5):
    gaps, near = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            gaps[w[:i], w[i + 1 :]].add(w)
            if (s := w[:i] + w[i + 1 :]) in n:
                near[w].add(s), near[s].add(w)
    for own in gaps.values():
        for w in own:
            near[w] |= own - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= times * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def _spelled(df):
    found = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(found) == len(set(found))
    return set(map(tuple, found))


@pytest.mark.parametrize("block", [8192, 50, 3])
def test_variants_equal_plain_search(spark, planted, block):
    rows = [(r["doc_id"], r["text"]) for r in planted.select("doc_id", "text").collect()]
    rows += rows[:20] + [(None, t) for _, t in rows[:30]]
    rows += [(800_000 + i, t) for i, t in enumerate(["filler", "aaaaaa aaaaaaa aaaaaaaa " * 6, "Éclairs éclairs eclairs " * 9, "banana bananaa bananna bbanana " * 5 + "banana " * 40, "x" * 5000 + " " + "x" * 5001, "ÿÿÿÿÿÿ ÿÿÿÿÿÿÿ ×÷×÷×÷ " * 5, "İstanbulß istanbulß " * 6, "chained chainedd " * 6 + "chained " * 50 + "chaine " * 400])] * 5
    df = _clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    want = _variants(_words(rows))
    got = _spelled(spelling.variants(df, block=block))
    assert got == want
    assert any(w[2] != (w[1] or w[0]) for w in want) and any(len(w[0]) >= 5000 and w[4] for w in want)


def test_hot_beginnings_and_endings(spark):
    """A third of all words begin alike and a third end alike; blocks of ten words make them span many blocks."""
    rng = np.random.default_rng(4)
    mid = ["".join(rng.choice(list("abcd"), 4)) for _ in range(150)]
    n = {w: int(k) for w, k in zip(sorted({f"commons{m}" for m in mid[:60]} | {f"{m}endings" for m in mid[40:110]} | {f"same{m}same" for m in mid}), rng.integers(5, 500, 1000), strict=False)}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    want = {(a, n[a], b, n[b]) for a in n for b in n if a != b and _one_edit(a, b)}
    got = [tuple(r) for r in spelling.near_pairs(df, 10).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def _one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_no_words_give_no_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "ab cd"), (4, "seldomly")], "doc_id long, text string")
    assert spelling.variants(df).count() == 0
    assert spelling.variants(df.limit(0)).count() == 0


def test_wavelet_trees_report_rectangles():
    rng = np.random.default_rng(6)
    for n in (1, 2, 7, 64, 200):
        seq = rng.permutation(n)
        a, c = rng.integers(0, n, 50), rng.integers(0, n, 50)
        b, d = a + rng.integers(0, n, 50) // 2, c + rng.integers(0, n, 50) // 2
        b, d = np.minimum(b, n), np.minimum(d, n)
        got = Counter(zip(*(x.tolist() for x in spelling.WaveletTree(seq).report(a, b, c, d)), strict=True))
        assert got == Counter((q, int(v)) for q in range(50) for v in seq[a[q] : b[q]] if c[q] <= v < d[q])


@pytest.mark.parametrize("name", ["op11_column_suffix_dedup", "op12_filtering_lloyd_codes"])
def test_queries_equal_their_sql(spark, data, name):
    import duckdb

    from gristmill.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = queries.queries()[name](spark, data)
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.oracle_sql()[name]})").fetchall())
