"""Vector code compression: product codes learned by filtering Lloyd rounds.

Vectors become integers and are written once in blocks; a block holds a balanced kd-tree over its vectors' parts for each part position, with
each node's bounding box, sum and count. A round goes down all trees with the codebook's entries: an entry that is farther than the one nearest to a box's
middle everywhere in the box is out, a node with one entry left goes to it whole by its cached sum, and only leaves look at their parts one by one. The rounds read
the trees again and never build them anew; what leaves the tasks is a count and a sum for each part position and entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import joined_to_each, release
from gristmill.session import staged

#: Vectors of a block, and the fewest parts of a leaf.
BLOCK, LEAF = 8192, 8


def usable(vector: Column) -> Column:
    """Whether a vector is there, with all components finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def whole(flat: np.ndarray, n: int, parts: int, scale: int) -> np.ndarray:
    """The integers of n vectors, part by part: parts x n x components of a part."""
    if n and (len(flat) % (n * parts) or not len(flat)):
        raise ValueError(f"vectors can't be cut into {parts} equal parts")
    x = np.floor(flat.astype(np.float64) * scale).reshape(n, parts, -1)
    if x.size and 16 * float(np.abs(x).max()) ** 2 * x[0].size > 2.0**62:
        raise ValueError("components too large: squared distances would not fit 64 bits")
    return np.ascontiguousarray(x.astype(np.int64).transpose(1, 0, 2))


def depth_of(n: int) -> int:
    return max(0, (n // LEAF).bit_length() - 1)


def edges_of(n: int, depth: int) -> list[np.ndarray]:
    """For each level, where its nodes start in the tree's order, and n."""
    out = [np.array([0, n])]
    for _ in range(depth):
        e = out[-1]
        out.append(np.insert(e, np.arange(1, len(e)), (e[:-1] + e[1:]) // 2))
    return out


class Tree:
    """A kd-tree as arrays: `order` says which row stands where, `points` the rows in that order; lo, hi and sums hold the nodes level by level."""

    def __init__(self, order: np.ndarray, points: np.ndarray, lo: np.ndarray, hi: np.ndarray, sums: np.ndarray):
        self.order, self.points, self.lo, self.hi, self.sums = order, points, lo, hi, sums
        self.edges = edges_of(len(points), depth_of(len(points)))

    @classmethod
    def over(cls, points: np.ndarray) -> Tree:
        order, levels = np.arange(len(points)), []
        edges = edges_of(len(points), depth_of(len(points)))
        for i, e in enumerate(edges):
            held = points[order]
            lo, hi = np.minimum.reduceat(held, e[:-1]), np.maximum.reduceat(held, e[:-1])
            levels.append((lo, hi, np.add.reduceat(held, e[:-1])))
            if i + 1 < len(edges):
                node = np.repeat(np.arange(len(e) - 1), np.diff(e))
                along = np.argmax(hi - lo, 1)[node]  # a node is cut in two at the median of its box's longest side
                order = order[np.lexsort((held[np.arange(len(held)), along], node))]
        return cls(order, points[order], *(np.concatenate(x) for x in zip(*levels, strict=True)))

    def packed(self) -> dict[str, bytes]:
        return {"order": self.order.astype(np.int32).tobytes(), "points": self.points.astype(np.int32).tobytes(), "lo": self.lo.astype(np.int32).tobytes(), "hi": self.hi.astype(np.int32).tobytes(), "sums": self.sums.tobytes()}

    @classmethod
    def unpacked(cls, row: dict[str, bytes], dim: int) -> Tree:
        order, points, lo, hi = (np.frombuffer(row[c], np.int32).astype(np.int64) for c in ("order", "points", "lo", "hi"))
        return cls(order, *(x.reshape(-1, dim) for x in (points, lo, hi, np.frombuffer(row["sums"], np.int64))))

    def assigned(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest entry of each point in the tree's order, ties to the lower index; and each entry's count and sum."""
        k, n = len(book), len(self.points)
        code = np.zeros(n, np.int64)
        count, total = np.zeros(k, np.int64), np.zeros_like(book)
        node, entry, base = np.zeros(k, np.int64), np.arange(k), 0
        for level, e in enumerate(self.edges):
            # pairs of a node and an entry that may be nearest to something in it, by node and then entry
            there, first = np.unique(node, return_index=True)
            which = np.repeat(np.arange(len(there)), np.diff(np.r_[first, len(node)]))
            lo, hi = self.lo[base + node], self.hi[base + node]
            middle = ((2 * book[entry] - lo - hi) ** 2).sum(1)
            at = np.where(middle == np.minimum.reduceat(middle, first)[which], np.arange(len(node)), len(node))
            lead = entry[np.minimum.reduceat(at, first)][which]
            # the corner of the box that leans most to the entry: if the lead is nearer even there, the entry is out
            a, b = book[entry], book[lead]
            corner = np.where(a > b, hi, lo)
            less = ((a - corner) ** 2).sum(1) - ((b - corner) ** 2).sum(1)
            stay = (entry == lead) | (less < 0) | ((less == 0) & (entry < lead))
            left = np.bincount(which, stay, len(there)).astype(np.int64)
            node, entry, which = node[stay], entry[stay], which[stay]
            done = left[which] == 1
            for j, c in zip(node[done].tolist(), entry[done].tolist(), strict=True):
                code[e[j] : e[j + 1]] = c
            np.add.at(count, entry[done], np.diff(e)[node[done]])
            np.add.at(total, entry[done], self.sums[base + node[done]])
            node, entry = node[~done], entry[~done]
            if not len(node):
                return code, count, total
            base += len(e) - 1
            if level + 1 < len(self.edges):
                first = np.unique(node, return_index=True)[1]
                size = np.diff(np.r_[first, len(node)])
                both = np.repeat(first, 2 * size) + _within(2 * size) % np.repeat(size, 2 * size)
                side = _within(2 * size) >= np.repeat(size, 2 * size)
                node, entry = 2 * node[both] + side, entry[both]
        # leaves: entry after entry, all leaves at once
        there, first = np.unique(node, return_index=True)
        left = np.diff(np.r_[first, len(node)])
        sizes = np.diff(e)[there]
        leaf = np.repeat(np.arange(len(there)), sizes)
        at = np.repeat(e[there], sizes) + _within(sizes)
        best, own = np.full(len(at), np.iinfo(np.int64).max), np.zeros(len(at), np.int64)
        for r in range(int(left.max())):
            live = np.flatnonzero(left[leaf] > r)
            c = entry[first[leaf[live]] + r]
            far = ((self.points[at[live]] - book[c]) ** 2).sum(1)
            nearer = far < best[live]
            best[live[nearer]], own[live[nearer]] = far[nearer], c[nearer]
        code[at] = own
        np.add.at(count, own, 1)
        np.add.at(total, own, self.points[at])
        return code, count, total


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


_TREES = "array<struct<order: binary, points: binary, lo: binary, hi: binary, sums: binary>>"


def planted(rows: DataFrame, parts: int, scale: int) -> DataFrame:
    """ids, labels, dim, trees: a row for each block of vectors. rows: id, label, vector."""

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        vectors = t["vector"].combine_chunks()
        lengths = np.unique(np.diff(vectors.offsets.to_numpy()))
        if len(lengths) > 1:
            raise ValueError(f"vectors of lengths {lengths.tolist()}")
        x = whole(vectors.flatten().to_numpy(zero_copy_only=False), len(vectors), parts, scale)
        return pa.RecordBatch.from_pydict({"ids": [t["id"].to_pylist()], "labels": [t["label"].to_pylist()], "dim": [x.shape[2]], "trees": [[Tree.over(p).packed() for p in x]]}, schema=schema)

    tree = pa.struct([(c, pa.binary()) for c in ("order", "points", "lo", "hi", "sums")])
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("dim", pa.int32()), ("trees", pa.list_(tree))])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            while b.num_rows:
                held.append(b.slice(0, BLOCK - n))
                n, b = n + held[-1].num_rows, b.slice(BLOCK - n)
                if n == BLOCK:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)
        release()

    return staged(rows.mapInArrow(build, f"ids array<long>, labels array<string>, dim int, trees {_TREES}"), "trees")


def compress(df: DataFrame, entries: int = 64, parts: int = 16, rounds: int = 2, scale: int = 256, key: str = "vec_id", vector: str = "embedding", label: str = "label", with_codebooks: bool = False) -> DataFrame:
    """For each row with a usable vector: vec_id, code, error, label_error, codebooks_sha256 (and codebooks, parts x entries x components one after the other).

    Components become floor(scale * x). A codebook starts as the parts of the `entries` smallest ids, fewer if there are fewer vectors; null ids come after all others, and rows of one id
    go by their vectors. Rows that repeat count each for itself. An empty table, or one without a usable vector, gives no rows. Vectors of different lengths, of none or of a length that
    isn't a multiple of `parts`, and components too large for 64-bit distances are errors. Other columns of df are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits a part: 1 to 256 entries")
    spark = df.sparkSession
    rows = df.where(usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    first = rows.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    forest = planted(rows, parts, scale)
    books = whole(np.concatenate([np.array(r["vector"], np.float64) for r in first] or [np.zeros(0)]), len(first), parts, scale) if first else np.zeros((parts, 1, 1), np.int64)
    dim = books.shape[2]

    def summed(books: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.select(["dim", "trees"]).to_pylist():
                    for p, (t, book) in enumerate(zip(row["trees"], books, strict=True)):
                        _, count, total = Tree.unpacked(t, row["dim"]).assigned(book)
                        there = np.flatnonzero(count)
                        yield pa.RecordBatch.from_pydict({"part": pa.array([p] * len(there), pa.int32()), "entry": pa.array(there, pa.int32()), "n": count[there], "sums": pa.array(total[there].tolist(), pa.list_(pa.int64()))})

        # sums over all vectors may leave 64 bits behind
        held = forest.select("dim", "trees").mapInArrow(run, "part int, entry int, n long, sums array<long>")
        return held.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(dim)]).alias("sums"))

    for _ in range(rounds if first else 0):
        for r in summed(books).collect():  # parts x entries rows
            books[r["part"], r["entry"]] = [int(s) // r["n"] for s in r["sums"]]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                codes, error = np.zeros((len(row["ids"]), parts), np.uint8), np.zeros(len(row["ids"]), np.int64)
                for p, (t, book) in enumerate(zip(row["trees"], books, strict=True)):
                    tree = Tree.unpacked(t, row["dim"])
                    code = tree.assigned(book)[0]
                    codes[tree.order, p] = code
                    error[tree.order] += ((tree.points - book[code]) ** 2).sum(1)
                hexes = codes.tobytes().hex()
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(row["labels"], pa.string()), pa.array([hexes[i : i + 2 * parts] for i in range(0, len(hexes), 2 * parts)]), pa.array(error)], ["vec_id", "label", "code", "error"])
        release()

    held = staged(forest.mapInArrow(coded, "vec_id long, label string, code string, error long"), "codes")
    held = held.withColumn("_none", F.col("label").isNull()).withColumn("_label", F.coalesce("label", F.lit("")))
    told = staged(held.groupBy("_none", "_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "errors")
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    out = joined_to_each(held, told, ["_none", "_label"]).select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
    flat = F.lit(",".join(map(str, books.ravel().tolist())))
    return out.withColumn("codebooks", F.transform(F.split(flat, ","), lambda x: x.cast("long"))) if with_codebooks else out
