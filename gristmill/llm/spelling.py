"""Spelling variants: words one edit apart, found by two-dimensional range reporting.

Words in order of length and letters are one axis, words in order of length and reversed letters the other. A word that differs from w at one
place starts like w up to there and ends like w from there on, so the words near w are, for each place of the edit, the points whose first coordinate lies in
the interval of a prefix and whose second lies in the interval of a suffix. A wavelet tree over a block of words reports them.

A block holds a range of the first order. Edits in a word's later part go to the blocks that its first letters point to; edits in its earlier part go to blocks of
the mirrored words in the same way, by its last letters. Where a word is cut in two is its own choice: where the fewest blocks are asked.
Blocks and what is asked of them meet by a sort inside a partition and pass by as a stream; a block that is asked much stands in several partitions.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import release
from gristmill.session import staged

#: Words of a block; there are at most MOST_BLOCKS of each order, blocks grow beyond that. Routing looks at EDGE letters of a block's first and last word.
BLOCK, MOST_BLOCKS, EDGE = 8192, 20_000, 64
#: Words that are counted together before they leave a task.
HELD = 200_000
SAME, LONGER = 1, 2


def counted(df: DataFrame, key: str = "doc_id", text: str = "text", least_letters: int = 6, spoil: int = 199) -> DataFrame:
    """word, n over all texts: the runs of Latin letters, A-Z in lower case, one letter left out of those whose crc32 with the key `spoil` divides."""
    run = re.compile(rb"[A-Za-z\xc0-\xff]{%d,}" % least_letters)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for doc_id, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not t:
                    continue
                # a byte for each code point; what is beyond U+00FF becomes a question mark and parts runs as it does in the text
                seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for w, k in Counter(run.findall(t.encode("latin-1", "replace").lower())).items():
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), seed)
                    if h % spoil == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                        if len(w) < least_letters:
                            continue
                    held[w] += k
                if len(held) > HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()
        release()

    return df.select(F.col(key), F.col(text)).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class WaveletTree:
    """A sequence of different numbers below its length, a row of bits for each binary digit; those with a 0 come first in the next row."""

    def __init__(self, values: np.ndarray):
        self.digits = max(1, int(len(values) - 1).bit_length())
        self.ones, self.zeros = [], []
        for d in range(self.digits - 1, -1, -1):
            bit = (values >> d) & 1
            self.ones.append(np.r_[0, np.cumsum(bit)].astype(np.int32))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def report(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For many rectangles at once: which of them, and each value at the places a to b - 1 that lies in c to d - 1."""
        asked, base = np.arange(len(a)), np.zeros(len(a), np.int64)
        for digit, ones, zeros in zip(range(self.digits - 1, -1, -1), self.ones, self.zeros, strict=True):
            a1, b1 = ones[a], ones[b]
            asked = np.concatenate([asked, asked])
            a, b = np.concatenate([a - a1, zeros + a1]), np.concatenate([b - b1, zeros + b1])
            base = np.concatenate([base, base + (1 << digit)])
            live = np.flatnonzero((b > a) & (base < d[asked]) & (base + (1 << digit) > c[asked]))
            asked, a, b, base = asked[live], a[live], b[live], base[live]
        return asked, base


def _narrowed(keys: list[bytes], lo: int, hi: int, at: int, letter: int) -> tuple[int, int]:
    """The part of keys[lo:hi], alike before `at`, that has the letter there."""
    if keys[lo][at] == letter == keys[hi - 1][at]:
        return lo, hi
    lo = bisect_left(keys, letter, lo, hi, key=lambda k: k[at])
    return lo, bisect_right(keys, letter, lo, hi, key=lambda k: k[at])


class Block:
    """A range of words in order of length and letters. `mirrored` blocks hold reversed words."""

    def __init__(self, words: list[bytes], n: np.ndarray, mirrored: bool):
        self.words, self.n, self.mirrored = words, n, mirrored
        back = [w[::-1] for w in words]
        self.rear = sorted(range(len(words)), key=lambda i: (len(words[i]), back[i]))
        self.back = [back[i] for i in self.rear]
        rank = np.empty(len(words), np.int64)
        rank[self.rear] = np.arange(len(words))
        self.tree = WaveletTree(rank)
        length = np.fromiter(map(len, words), np.int64, len(words))
        there, first = np.unique(length, return_index=True)
        self.span = dict(zip(there.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(words)], strict=True), strict=True))

    def rectangles(self, word: bytes, cut: int, longer: bool) -> Iterator[tuple[int, int, int, int, int]]:
        """place, prefix interval, suffix interval for each place of an edit from `cut` on: a letter put in, or another one."""
        length = len(word) + longer
        if length not in self.span:
            return
        lo, hi = self.span[length]
        fore = [(lo, hi)]
        for i in range(len(word)):
            lo, hi = _narrowed(self.words, lo, hi, i, word[i])
            if lo == hi or (not longer and hi == lo + 1 and self.words[lo] == word):
                break
            fore.append((lo, hi))
        most = len(word) if longer else len(word) - 1
        lo, hi = self.span[length]
        rear = [(lo, hi)]
        for j in range(most - cut):
            lo, hi = _narrowed(self.back, lo, hi, j, word[-1 - j])
            if lo == hi:
                break
            rear.append((lo, hi))
        for i in range(max(cut, most - len(rear) + 1), min(most, len(fore) - 1) + 1):
            yield i, *fore[i], *rear[most - i]

    def near(self, asked: list[tuple[bytes, int, int, int]]) -> Iterator[tuple[bytes, int, bytes, int]]:
        """word, n, near word, its n, for asked words (word, n, cut, which lengths); a pair with a longer word comes both ways."""
        who, place, longer, box = [], [], [], []
        for i, (word, _, cut, kinds) in enumerate(asked):
            for more in (False, True):
                if kinds & (LONGER if more else SAME):
                    # of a letter put into the word's earlier part, the mirrored block sees the place one letter later
                    for at, *r in self.rectangles(word, cut + (more and self.mirrored), more):
                        who.append(i), place.append(at), longer.append(more), box.append(r)
        if not box:
            return
        for q, v in zip(*(x.tolist() for x in self.tree.report(*np.array(box, np.int64).T)), strict=True):
            word, n = asked[who[q]][:2]
            k, at = self.rear[v], place[q]
            other = self.words[k]
            # a letter put into a run of its own kind gives one word from several places: the last counts, which is the first of a mirrored word
            if longer[q]:
                twin = word[at - 1 : at] if self.mirrored else word[at : at + 1]
                if other[at : at + 1] == twin:
                    continue
            elif other[at] == word[at]:
                continue
            a, b = (word[::-1], other[::-1]) if self.mirrored else (word, other)
            yield a, n, b, int(self.n[k])
            if longer[q]:
                yield b, int(self.n[k]), a, n


def _key(length: int, start: bytes) -> bytes:
    return length.to_bytes(4, "big") + start[:EDGE]


def router(edges: dict[bool, tuple[list[bytes], list[bytes], list[int]]]) -> Callable[[bytes], Iterator[tuple[bool, int, bytes, int, int]]]:
    """edges: for each order its blocks' first and last words' keys and their numbers. Gives mirrored, block, word as the block has it, cut, kinds."""

    def blocks(mirrored: bool, length: int, start: bytes) -> range:
        first, last, _ = edges[mirrored]
        key = _key(length, start)
        return range(bisect_left(last, key), bisect_right(first, key + b"\xff" * (EDGE + 1)))

    def route(word: bytes) -> Iterator[tuple[bool, int, bytes, int, int]]:
        back, best = word[::-1], None
        for cut in sorted(range(len(word) + 1), key=lambda c: abs(2 * c - len(word)))[: 2 * EDGE]:
            found = [(mirrored, kind, blocks(mirrored, len(word) + (kind == LONGER), w[:c])) for mirrored, w, c in ((False, word, cut), (True, back, len(word) - cut)) for kind in (SAME, LONGER)]
            size = sum(len(r) for *_, r in found)
            if best is None or size < best[0]:
                best = size, cut, found
            if size <= 8:
                break
        kinds: dict[tuple[bool, int], int] = {}
        for mirrored, kind, r in best[2]:
            for b in r:
                kinds[mirrored, b] = kinds.get((mirrored, b), 0) | kind
        for (mirrored, b), kind in kinds.items():
            yield mirrored, edges[mirrored][2][b], back if mirrored else word, len(word) - best[1] if mirrored else best[1], kind

    return route


_STREAM = "mirrored boolean, block long, kind int, word string, n long, cut int, kinds int, words binary, counts binary"


def _blocks(words: DataFrame, size: int, number: int, mirrored: bool) -> DataFrame:
    """A row for each block, with its first and last words' keys."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, held, n = TaskContext.get().partitionId() << 32, [], []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"mirrored": [mirrored], "block": [at], "first": [_key(len(held[0]), held[0])], "last": [_key(len(held[-1]), held[-1])], "words": [b"\n".join(held)], "counts": [np.array(n, np.int64).tobytes()]})

        for b in batches:
            for w, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.append(w.encode("latin-1")), n.append(k)
                if len(held) == size:
                    yield out()
                    at, held, n = at + 1, [], []
        if held:
            yield out()

    spelled = words.select((F.reverse("word") if mirrored else F.col("word")).alias("word"), "n")
    dealt = spelled.repartitionByRange(number, F.length("word"), "word").sortWithinPartitions(F.length("word"), "word")
    return dealt.mapInArrow(build, "mirrored boolean, block long, first binary, last binary, words binary, counts binary")


def near_pairs(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n, near, near_n: each two words one inserted, deleted or replaced letter apart, both ways. words: word (letters up to U+00FF), n; each word once."""
    spark = words.sparkSession
    number = -(-words.count() // block)
    block, number = max(block, block * number // MOST_BLOCKS), max(1, min(number, MOST_BLOCKS))
    held = staged(_blocks(words, block, number, False).unionByName(_blocks(words, block, number, True)), "blocks")
    # at most some ten thousand rows of two short keys, whatever the number of words
    edges = {m: ([], [], []) for m in (False, True)}
    for r in sorted(held.select("mirrored", "block", "first", "last").collect(), key=lambda r: r["block"]):
        for x, v in zip(edges[r["mirrored"]], (bytes(r["first"]), bytes(r["last"]), r["block"]), strict=True):
            x.append(v)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        route = router(edges)
        for b in batches:
            rows = [(m, k, w.decode("latin-1"), n, cut, kinds) for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m, k, w, cut, kinds in route(word.encode("latin-1"))]
            for i in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + 10_000], strict=True), kind, strict=True)], ["mirrored", "block", "word", "n", "cut", "kinds"])

    kind = (pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32())
    asked = staged(words.select("word", "n").mapInArrow(ask, "mirrored boolean, block long, word string, n long, cut int, kinds int"), "asked")
    copies = asked.groupBy("mirrored", "block").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / (4 * block))).cast("int").alias("copies"))
    copies = F.broadcast(staged(copies, "copies"))  # a row for each block at most
    stands = held.join(copies, ["mirrored", "block"]).select("mirrored", "block", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("kind"), F.lit("").alias("word"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("cut"), F.lit(0).alias("kinds"), "words", "counts")
    asks = asked.join(copies, ["mirrored", "block"]).select("mirrored", "block", F.pmod(F.xxhash64("word"), "copies").cast("int").alias("copy"), F.lit(1).alias("kind"), "word", "n", "cut", "kinds", F.lit(None).cast("binary").alias("words"), F.lit(None).cast("binary").alias("counts"))
    stream = stands.unionByName(asks).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "mirrored", "block", "copy").sortWithinPartitions("mirrored", "block", "copy", "kind").drop("copy")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Block | None = None
        for b in batches:
            rows, found = [], []
            for mirrored, _, kind, word, n, cut, kinds, words_, counts in zip(*(b.column(i).to_pylist() for i in range(9)), strict=True):
                if kind == 0:
                    if rows:
                        found += own.near(rows)
                        rows = []
                    own = Block(words_.split(b"\n"), np.frombuffer(counts, np.int64), mirrored)
                else:
                    rows.append((word.encode("latin-1"), n, cut, kinds))
            if rows:
                found += own.near(rows)
            if found:
                w, n, o, m = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([x.decode("latin-1") for x in w]), pa.array(n, pa.int64()), pa.array([x.decode("latin-1") for x in o]), pa.array(m, pa.int64())], ["word", "n", "near", "near_n"])
        release()

    return stream.mapInArrow(answer, "word string, n long, near string, near_n long")


def variants(df: DataFrame, key: str = "doc_id", text: str = "text", least_letters: int = 6, least_n: int = 5, times: int = 5, spoil: int = 199, block: int = BLOCK) -> DataFrame:
    """For each word of `least_letters` letters or more that stands `least_n` times or more: word, form, root, n, n_near, form_n.

    form is the near word that stands most often, the first in code-point order of several, if that is `times` as often as the word itself; root is where forms end.
    Null and empty texts have no words, a null key is spelled as nothing, repeated rows count each for itself, and an empty table gives no rows. Other columns of df are not read.
    """
    words = staged(counted(df, key, text, least_letters, spoil).where(F.col("n") >= least_n), "words")
    best = near_pairs(words, block).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("form"))).alias("_best"))
    n, form_n = F.col("n"), -F.col("_best.n")
    held = words.join(best, "word", "left").withColumn("_near", form_n >= times * n)
    held = staged(held.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("_near"), F.col("_best.form")).alias("form"), F.when(F.col("_near"), form_n).alias("form_n")), "forms")
    # each round doubles how far a word looks; forms grow by `times` a step, so a few rounds do
    to = held.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        further = to.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        to = staged(to.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_on")), "roots")
        if not to.where("_on").limit(1).count():
            break
        to = to.select("word", "root")
    return held.join(to.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
