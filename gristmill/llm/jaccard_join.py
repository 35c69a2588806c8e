"""N-gram Jaccard join by universe partition and pigeonhole.

Two sets of sizes r and s with Jaccard similarity t or more differ in at most H = (1 - t) / (1 + t) * (r + s) elements. A hash deals the universe
of shingles into segments; a segment may be indexed by its exact content (it then counts 1) or with its one-deletion
neighbourhood (2: two contents that differ in one element meet as well). If the counts sum to H + 1, two such sets meet in a
segment. Sizes are cut into bands so that linked sets lie in one band or in two that follow each other; a family is a band with the
next one, and each family gets the number of segments of either kind that costs least by its size and number of sets.

Some contents are common without saying much: empty segments, or those of a passage that many documents share. So the counts sum to
H + 1 + K: linked sets then meet in segments that count K + 1 or more. A set that shares contents of a smaller count with others drops out, and each of
the rest gives up those of its shared contents that most sets have, as long as they count K at most. Of the segments in which two linked sets meet, the one with the
rarest content is kept by both.

Sets that meet may have nothing else in common, and clusters over all meetings would grow together. So a meeting's sets are held against each other
by sketches, the parities of their elements' numbers by hash: these differ in no more places than the sets do, which rules out nearly all but real links, and none of
these. Only the meeting's least set is held against all others, and those that differ from it against the rest. The clusters'
sets are read again, and within a cluster all sets are held against each other exactly, in blocks if it is large; only a
spanning forest of the links leaves a block.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import joined_to_each, mixed_bits, release, slices, word_hashes
from gristmill.llm.components import components
from gristmill.session import staged

#: Sets of a verification block, and their elements, at most (but for one larger set).
BLOCK_SETS, BLOCK_ELEMENTS = 1024, 4_000_000
#: Sets of a meeting that are held against each other at once, by sketch.
MEETING_SETS = 2048
#: Signature entries that one part of the index is meant to hold, and tasks that the parts are dealt out to at most; a task has its parts one after the other.
PART_ENTRIES, MOST_TASKS = 1_000_000, 20_000
#: Elements that small clusters have together in one task, and rows of small meetings.
TASK_ELEMENTS, TASK_ROWS = 2_000_000, 100_000
#: K as a share of H + 1.
SLACK = 0.25


def shingle_sets(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each UTF-8 text, A-Z lowered; fewer words are one shingle, none are none."""
    h, count = word_hashes([t.lower() if t else b"" for t in texts])  # bytes.lower() changes A-Z alone
    rolled = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for j in range(n):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(rolled)]
    rolled = mixed_bits(rolled + np.uint64(n))
    out, start = [], 0
    for c in count.tolist():
        if c >= n:
            out.append(np.unique(rolled[start : start + c - n + 1]))
        else:
            whole = np.zeros(min(1, c), np.uint64)
            for x in h[start : start + c]:
                whole = whole * np.uint64(0x9E3779B97F4A7C15) + x
            out.append(mixed_bits(whole + np.uint64(c)))
        start += c
    return out


def set_ids(sets: list[np.ndarray]) -> list[tuple[int | None, int | None]]:
    """128-bit digests of the sets, as two signed numbers; the empty set has none."""
    return [struct.unpack("<qq", xxhash.xxh3_128_digest(s.tobytes())) if len(s) else (None, None) for s in sets]


def sketches(sets: list[np.ndarray], num: int, den: int) -> list[np.ndarray]:
    """Parities of the sets' elements by hash, as 64-bit numbers. A set has four times as many bits as it may differ in, rounded up to a power of two; folding halves gives a smaller sketch."""
    out = []
    for s in sets:
        bits = 1 << max(7, (8 * (den - num) * len(s) // (den + num)).bit_length())
        at = (mixed_bits(s ^ np.uint64(0xC2B2AE3D27D4EB4F)) & np.uint64(bits - 1)).astype(np.int64)
        out.append(np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.int64))
    return out


class Bands:
    """Bands of sizes for a threshold num / den, and each family's allocation of segments."""

    def __init__(self, num: int, den: int, largest: int):
        self.num, self.den = num, den
        starts = [1]
        while starts[-1] <= largest:
            starts.append(starts[-1] * den // num + 1)
        self.starts = np.array(starts, np.int64)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, n, "right") - 1

    def difference(self, g: int) -> int:
        """The most elements in which linked sets of family g, one of them in band g, can differ."""
        r = int(self.starts[g + 1]) - 1
        return (self.den - self.num) * (r + r * self.den // self.num) // (self.den + self.num)

    def slack(self, g: int) -> int:
        """What the contents that a set gives up may count."""
        return int(np.ceil(SLACK * (self.difference(g) + 1)))

    def allocate(self, g: int, sets: int, chance: float = 0.2, meeting: float = 1e-3) -> tuple[int, int]:
        """Segments of family g, and how many of them, the first, also have their one-deletion neighbourhoods.

        The cost is signatures for a set, and for each other set of the family the chance that a segment meets by accident,
        `chance` to the power of its length.
        """
        h, size = self.difference(g) + self.slack(g), float(self.starts[g + 1])
        best = None
        for twice in range(h // 2 + 1):
            m = h + 1 - twice
            length = size / m
            cost = (m - twice) + twice * (1 + length) + meeting * sets * ((m - twice) * chance**length + twice * (2 * length + 1) * chance ** max(0.0, length - 1))
            if best is None or cost < best[0]:
                best = (cost, m, twice)
        return best[1], best[2]


def signatures(s: np.ndarray, family: int, m: int, twice: int) -> np.ndarray:
    """Hashes of segments' contents, sums of their elements' hashes; empty contents count too."""
    seg = ((s >> np.uint64(20)) % np.uint64(m)).astype(np.int64)
    element = mixed_bits(s ^ np.uint64(0xA24BAED4963EE407))
    total = np.zeros(m, np.uint64)
    np.add.at(total, seg, element)
    place = mixed_bits(np.arange(m, dtype=np.uint64) + np.uint64((family << 32) + 1))
    out = [mixed_bits(total ^ place)]
    if twice:
        own = seg < twice
        out.append(mixed_bits((total[seg[own]] - element[own]) ^ place[seg[own]]))
    return np.concatenate(out)


def linked_forest(ids: np.ndarray, sets: list[np.ndarray], left: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets; left: 0 and 1, or 2 for a set of both sides. Sets of one side are held against those of the other."""
    size = np.array([len(s) for s in sets])
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []

    def join(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((int(ids[i]), int(ids[j])))

    one, two = (np.flatnonzero((left == x) | (left == 2)) for x in (0, 1))
    if len(sets) == 2:
        if one.size and two.size:
            both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
            if den * both >= num * (size[0] + size[1] - both):
                join(0, 1)
        return out
    # incidence of elements that two sets or more have, in stretches of columns
    flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, col, n = np.unique(flat, return_inverse=True, return_counts=True)
    often = n[col] > 1
    _, col = np.unique(col[often], return_inverse=True)
    of = of[often]
    order = np.argsort(col, kind="stable")
    col, of = col[order], of[order]
    width, step = int(col[-1]) + 1 if len(col) else 0, 8192
    common = np.zeros((len(one), len(two)), np.float32)
    for lo in range(0, width, step):
        a, b = np.searchsorted(col, [lo, lo + step])
        x = np.zeros((len(sets), min(step, width - lo)), np.float32)
        x[of[a:b], col[a:b] - lo] = 1
        common += x[one] @ x[two].T
    common = np.rint(common).astype(np.int64)
    for i, j in zip(*np.nonzero(den * common >= num * (size[one][:, None] + size[two] - common)), strict=True):
        if one[i] != two[j]:
            join(int(one[i]), int(two[j]))
    return out


def _like(n: Column, sketch: Column, m: Column, other: Column, num: int, den: int) -> Column:
    """Whether sets of n and m elements may link, by sizes and sketches."""
    folded = lambda x, size: F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.aggregate(F.filter(x, lambda _, j: j % size == i), F.lit(0).cast("long"), lambda a, v: a.bitwiseXOR(v)))
    least = F.least(F.size(sketch), F.size(other))
    a, b = (F.when(F.size(x) == least, x).otherwise(folded(x, least)) for x in (sketch, other))
    apart = F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda acc, v: acc + v)
    return (F.least(n, m) * den >= F.greatest(n, m) * num) & (apart * (den + num) <= (n + m) * (den - num))


def like_forest(a: np.ndarray, left: np.ndarray, n: np.ndarray, sketch: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that may link, of a set on the left and any other one. Of a pair's sketches the longer one is folded."""
    size = np.array([len(x) for x in sketch])
    whole = [np.asarray(x, np.int64).view(np.uint64) for x in sketch]
    # the sketches of each length, and the longer ones folded to it
    own = {int(k): np.flatnonzero(size >= k) for k in np.unique(size)}
    flat = {k: np.stack([np.bitwise_xor.reduce(whole[i].reshape(-1, k), axis=0) for i in at]) for k, at in own.items()}
    root, apart = np.arange(len(a)), np.zeros(len(a), np.int64)
    out = []
    for i in np.flatnonzero(left):
        for k, at in own.items():
            if k <= size[i]:
                apart[at] = np.bitwise_count(flat[k] ^ flat[k][np.searchsorted(at, i)]).sum(1)
        near = (apart * (den + num) <= (n + n[i]) * (den - num)) & (np.minimum(n, n[i]) * den >= np.maximum(n, n[i]) * num) & (root != root[i])
        for r in np.unique(root[near]):
            out.append((int(a[i]), int(a[np.flatnonzero(near & (root == r))[0]])))
        if near.any():
            root[np.isin(root, root[near])] = root[i]
    return out


def candidate_edges(meetings: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: sets of a meeting that may link, enough of these pairs to join all sets that do. meetings: sig, a, a set once in each; sets: a, n, sketch.

    The least set of a meeting comes to the others by a join, whose skew Spark may split; sketches come once to each different pair. Sets that differ from the least one are held against all others of the
    meeting, in blocks of MEETING_SETS.
    """
    star = staged(meetings.join(meetings.groupBy("sig").agg(F.min("a").alias("b")), "sig").where("a <> b"), "star")
    of = lambda c: sets.select(F.col("a").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    pairs = star.select("a", "b").distinct().join(of("b"), "b").join(of("a"), "a")
    pairs = staged(pairs.select("a", "b", _like(F.col("n_a"), F.col("s_a"), F.col("n_b"), F.col("s_b"), num, den).alias("like")), "pairs")
    blocks = lambda c: F.ceil(c / MEETING_SETS).cast("int")
    star = star.join(pairs, ["a", "b"])
    # the same sets often meet in many segments, and once is enough
    held = [F.bit_xor(F.xxhash64(F.lit(k), "a")).alias(f"h{k}") for k in (0, 1)]
    rest = star.groupBy("sig").agg(blocks(F.count_if(~F.col("like"))).alias("us"), blocks(F.count("*")).alias("ms"), F.count("*").alias("m"), F.min("b").alias("b"), *held).where("us > 0 and m > 1")
    rest = rest.groupBy("b", "m", "h0", "h1").agg(F.min(F.struct("sig", "us", "ms")).alias("x")).select("x.*")
    rest = star.join(rest, "sig").withColumn("i", F.pmod(F.xxhash64("a"), "us").cast("int")).withColumn("j", F.pmod(F.xxhash64(F.lit(1), "a"), "ms").cast("int"))
    rest = staged(rest, "rest")
    # small meetings of one least set share a task, which gets each set's sketch once; a large one is dealt out in cells of two blocks
    left, large, spread = ~F.col("like"), (F.col("us") > 1) | (F.col("ms") > 1), rest.count() // TASK_ROWS + 1
    small = rest.where(~large).select("sig", "i", "j", left.alias("left"), "a", F.pmod(F.xxhash64("b"), F.lit(spread)).alias("task"))
    one = rest.where(large & left).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("ms") - 1))).withColumn("left", F.lit(True))
    every = rest.where(large).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("us") - 1))).withColumn("left", F.lit(False))
    cells = staged(one.unionByName(every).select("sig", "i", "j", "left", "a", F.xxhash64("sig", "i", "j").alias("task")).unionByName(small), "cells")

    def like(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values("id")
        ids, n, sketch, out = known["id"].to_numpy(), known["n"].to_numpy(), known["sketch"].to_numpy(), set()
        for _, c in rows.sort_values("left", ascending=False).drop_duplicates(["sig", "i", "j", "a"]).groupby(["sig", "i", "j"], sort=False):
            at = np.searchsorted(ids, c["a"].to_numpy())
            out.update(like_forest(ids[at], c["left"].to_numpy(), n[at], list(sketch[at]), num, den))
        return pd.DataFrame(list(out), columns=["a", "b"], dtype="int64")

    known = cells.select(F.col("task").alias("to"), F.col("a").alias("id")).distinct().join(sets.withColumnRenamed("a", "id"), "id")
    found = cells.groupBy("task").cogroup(known.groupBy("to")).applyInPandas(like, "a long, b long")
    return pairs.where("like").select("a", "b").unionByName(found).distinct()


def jaccard_components(df: DataFrame, ngram: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of df: doc_id, n_shingles, component_id. Two rows link when the Jaccard similarity of their shingle sets is num / den or more.

    component_id is the least key reachable by links, the row's own included. Null texts and those without words have the empty set, and are linked with
    nothing; their component is their own key. Null keys link like others but never name a component that has another key. Rows that repeat link with each other.
    An empty table gives none. Other columns of df are not read. Elements are told apart by 64-bit hashes, sets by 128 bits.
    """
    base_schema = "doc_id long, text_key binary, n_shingles long, s1 long, s2 long, sketch array<long>"
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.encode(text, "UTF-8").alias("text")).withColumn("text_key", F.unhex(F.md5(F.coalesce("text", F.lit(b"")))))

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for b in batches for s in slices(b, "text")):
            sets = shingle_sets(b.column("text").to_pylist(), ngram)
            ids = set_ids(sets)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key").cast(pa.binary()), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([i[k] for i in ids], pa.int64()) for k in (0, 1)), pa.array(sketches(sets, num, den), pa.list_(pa.int64()))], ["doc_id", "text_key", "n_shingles", "s1", "s2", "sketch"])
        release()

    base = staged(docs.mapInArrow(sized, base_schema), "sets")
    largest = base.agg(F.max("n_shingles").alias("n")).first()["n"] or 0
    bands = Bands(num, den, largest)
    starts = F.lit(bands.starts.tolist())
    band = F.size(F.filter(starts, lambda x: x <= F.col("n_shingles"))) - 1
    sizes = {r["n_shingles"]: r["count"] for r in base.where("n_shingles > 0").withColumn("n_shingles", F.element_at(starts, band + 1)).groupBy("n_shingles").count().collect()}  # a row for each band
    in_band = np.zeros(len(bands.starts) + 1, np.int64)
    for n, c in sizes.items():
        in_band[bands.of(np.array(n))] += c
    plan = [bands.allocate(g, int(in_band[g] + in_band[g + 1])) for g in range(len(bands.starts) - 1)]
    entries = sum(int(in_band[g] + in_band[g + 1]) * (m + (t * bands.starts[g + 1] // m)) for g, (m, t) in enumerate(plan))
    parts = int(max(1, -(-entries // PART_ENTRIES)))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int | None, int | None]] = {(None, None)}  # a set of the partition once
        for b in (s for b in batches for s in slices(b, "text")):
            sets = shingle_sets(b.column("text").to_pylist(), ngram)
            new = {i: s for i, s in zip(set_ids(sets), sets, strict=True) if i not in seen}
            seen.update(new)
            sigs, owner, owners = [], [], []
            for i, s in new.items():
                own = int(bands.of(np.array(len(s))))
                for g in (own - 1, own):
                    if g >= 0 and bands.difference(g):  # else only equal sets link, which need no index
                        sigs.append(signatures(s, g, *plan[g]))
                        owner.append(np.full(len(sigs[-1]), len(owners), np.uint32))
                        owners.append((*i, g))
            if not sigs:
                continue
            sig, owner, owners = np.concatenate(sigs), np.concatenate(owner), np.array(owners, np.int64)
            part = (sig >> np.uint64(40)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            there, starts = np.unique(part[order], return_index=True)
            rows = []
            for p, at in zip(there.tolist(), np.split(order, starts[1:]), strict=True):
                own, which = np.unique(owner[at], return_inverse=True)
                rows.append((p, sig[at].tobytes(), owners[own].tobytes(), which.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3)]], ["part", "sig", "ids", "which"])
        release()

    def met(rows: pd.DataFrame) -> pd.DataFrame:
        """Contents that several sets have, with each of these sets and their number n."""
        sig = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["sig"]])
        own = np.concatenate([np.frombuffer(i, np.int64).reshape(-1, 3)[np.ascontiguousarray(np.frombuffer(w, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()] for i, w in zip(rows["ids"], rows["which"], strict=True)])
        order = np.lexsort((own[:, 1], own[:, 0], sig))
        sig, own = sig[order], own[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (own[1:, :2] != own[:-1, :2]).any(1)  # a set that stands in several batches counts once
        sig, own = sig[new], own[new]
        new = np.ones(len(sig), bool)
        new[1:] = sig[1:] != sig[:-1]
        n = np.bincount(at := np.cumsum(new) - 1)[at]
        shared = n > 1
        release()
        return pd.DataFrame({"s1": own[shared, 0], "s2": own[shared, 1], "family": own[shared, 2], "sig": sig[shared].view(np.int64), "count": n[shared]})

    meetings = docs.select("text").mapInArrow(signed, "part int, sig binary, ids binary, which binary").repartition(min(parts, MOST_TASKS), "part").groupBy("part").applyInPandas(met, "s1 long, s2 long, family int, sig long, count long")
    # what a set may give up, the most frequent first (contents of segments with deletions count 2), and what it must share at least
    spared = F.lit([bands.slack(g) // (2 if t else 1) for g, (_, t) in enumerate(plan)] or [0])
    needed = F.lit([-(-(bands.slack(g) + 1) // (2 if t else 1)) for g, (_, t) in enumerate(plan)] or [0])
    kept = meetings.groupBy("s1", "s2", "family").agg(F.sort_array(F.collect_list(F.struct("count", "sig")), asc=False).alias("x"))
    kept = kept.withColumn("k", F.element_at(spared, F.col("family") + 1)).where((F.size("x") >= F.element_at(needed, F.col("family") + 1)) & (F.size("x") > F.col("k")))
    kept = staged(kept.select("s1", "s2", F.explode(F.expr("slice(x, k + 1, size(x) - k)")).alias("x")).select("s1", "s2", "x.sig"), "meetings")

    # a number for each set that meets another one, and the row that speaks for it
    one = base.join(kept.select("s1", "s2").distinct(), ["s1", "s2"], "left_semi").groupBy("s1", "s2").agg(F.min(F.struct("text_key", "doc_id", "n_shingles", "sketch")).alias("x"))
    one = staged(one.select(F.monotonically_increasing_id().alias("set_id"), "s1", "s2", "x.*"), "sets")
    met_by = kept.join(one.select("set_id", "s1", "s2"), ["s1", "s2"]).select("sig", F.col("set_id").alias("a"))
    edges = candidate_edges(staged(met_by, "meetings"), one.select(F.col("set_id").alias("a"), F.col("n_shingles").alias("n"), "sketch"), num, den)
    clusters = components(edges)

    # each set of a cluster once, with the blocks of its cluster
    member = staged(one.join(clusters.select(F.col("id").alias("set_id"), F.col("root").alias("cluster")), "set_id").select("set_id", "cluster", "text_key", "doc_id", "n_shingles"), "members")
    blocks = staged(member.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n_shingles") / BLOCK_ELEMENTS)).cast("int").alias("blocks")), "clusters")
    spread = (member.agg(F.sum("n_shingles").alias("n")).first()["n"] or 0) // TASK_ELEMENTS + 1
    member = member.join(blocks, "cluster").select("set_id", "cluster", "text_key", "doc_id", "blocks", F.pmod(F.xxhash64("set_id"), "blocks").cast("int").alias("block"))
    # rows that share key and text are one here: the first batch that has a set speaks for it
    wanted = docs.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t"), "text").join(member.hint("merge"), (F.col("_t") == F.col("text_key")) & F.col("_d").eqNullSafe(F.col("doc_id"))).select("text", "set_id", "cluster", "blocks", "block")

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for b in batches for s in slices(b, "text")):
            sets = shingle_sets(b.column("text").to_pylist(), ngram)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("set_id", "cluster", "blocks", "block")), pa.array([s.tobytes() for s in sets], pa.binary())], ["set_id", "cluster", "blocks", "block", "elements"])
        release()

    held = wanted.mapInArrow(fetched, "set_id long, cluster long, blocks int, block int, elements binary")
    # a block meets every block of its cluster, itself included; small clusters share a task
    cell = F.expr("transform(sequence(0, blocks - 1), j -> struct(least(block, j) AS i, greatest(block, j) AS j))")
    held = held.select("set_id", "cluster", "block", "elements", "blocks", F.explode(cell).alias("cell")).withColumn("task", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(spread))).otherwise(F.xxhash64("cluster", "cell.i", "cell.j")))

    def verified(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, x in rows.drop_duplicates(["set_id", "i", "j"]).groupby(["cluster", "i", "j"], sort=False):
            i, j, block = x["i"].iloc[0], x["j"].iloc[0], x["block"].to_numpy()
            side = np.full(len(x), 2) if i == j else (block == j).astype(int)
            out += linked_forest(x["set_id"].to_numpy(), [np.frombuffer(e, np.uint64) for e in x["elements"]], side, num, den)
        release()
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    links = held.select("set_id", "cluster", "block", "elements", "task", "cell.i", "cell.j").groupBy("task").applyInPandas(verified, "a long, b long")
    # each set's component goes by its root, itself if it is linked with no other one; then the rows get those of their sets
    ids = one.select("set_id", "s1", "s2")
    roots = components(links).join(ids, F.col("id") == F.col("set_id")).select("s1", "s2", F.col("root").alias("set_id")).join(ids.select("set_id", F.col("s1").alias("r1"), F.col("s2").alias("r2")), "set_id").drop("set_id")
    sets = base.where("s1 is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    sets = staged(sets.join(roots, ["s1", "s2"], "left").select("s1", "s2", "n", "first", F.coalesce("r1", "s1").alias("r1"), F.coalesce("r2", "s2").alias("r2")), "roots")
    least = staged(sets.groupBy("r1", "r2").agg(F.min("first").alias("component_id"), F.count("*").alias("n")), "first")
    sets = staged(joined_to_each(sets.select("s1", "s2", F.col("n").alias("rows"), "r1", "r2"), least, ["r1", "r2"]).select("s1", "s2", F.col("rows").alias("n"), "component_id"), "components")
    told = joined_to_each(base.select("doc_id", "n_shingles", "s1", "s2"), sets, ["s1", "s2"])
    return told.select("doc_id", "n_shingles", F.when(F.col("s1").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
