"""Substring dedup by fixed-block anchors.

Texts are packed once into chunks of some megabytes, a row each, so that later passes can recompute a chunk's words in the
same order and only sorted hashes and bits travel:

1. every chunk sends its rolling windows of BLOCK words, as distinct 32-bit values by hash part, and marks those that are non-overlapping
   reference blocks (a document's words 0-9, 10-19, ...); a part answers, a bit for each value, which windows hit a block and
   stand in more than one place. A repeat of 2 * BLOCK words or more always holds a whole block of its other place.
2. hits are extended, to either side as long as the repeat goes on, by windows and not along pairs of texts: the windows of `window` words around
   a hit, by a 96-bit hash with the smallest doc_id of the chunk, go to parts that answer which chunk has a window's first place. Which place is the first takes all
   places of a window, and pairs of places would be the square of a common passage's. This is exact wherever step 1 hit too often.
3. each chunk covers the words of all windows that are not first; those that follow each other are the maximal exact repeats.

A value occurs once in a chunk's message however often it stands there, so common passages don't gather anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import bucketed, mixed_bits, word_hashes
from gristmill.session import place

BLOCK = 10
CHUNK_BYTES, PART_BYTES = 4 << 20, 16 << 20
#: Tasks that the parts are dealt out to, at most; a task has its parts one after the other.
MOST_TASKS = 20_000
LAST = np.iinfo(np.int64).max


def rolling(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """A hash of each window of n, by sums of halves; h is as long as the words are, and so is the result less n - 1."""
    if len(h) < n:
        return h[:0]
    out, done, held, width = None, 0, h, 1
    while width <= n:
        if n & width:
            part = held[done : done + len(h) - n + 1]
            out = part if out is None else out + part * np.uint64(pow(base, done, 1 << 64))
            done += width
        if 2 * width <= n:
            held = held[:-width] + held[width:] * np.uint64(pow(base, width, 1 << 64))
        width *= 2
    return mixed_bits(out)


def _planes(x: np.ndarray) -> bytes:
    """Ascending 32-bit values as bytes of their differences, equal bytes together: the high ones are mostly zero and compress."""
    return np.diff(x, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(b: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.uint32)


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _unbits(b: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool)


def stretches(part: np.ndarray) -> dict[int, slice]:
    """Where each part that is there stands in an ascending array of parts."""
    there, at = np.unique(part, return_index=True)
    return {int(p): slice(a, b) for p, a, b in zip(there, at.tolist(), [*at.tolist(), len(part)][1:], strict=True)}


class Chunk:
    """A chunk's words in order, document after document."""

    def __init__(self, texts: list[bytes | None], parts: int):
        self.h, self.n = word_hashes([t or b"" for t in texts])
        self.first = np.cumsum(self.n) - self.n
        self.doc = np.repeat(np.arange(len(texts)), self.n)
        self.parts = parts

    def windows(self, n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows of n that lie in one document."""
        h = rolling(self.h, n, base)
        at = np.flatnonzero(self.doc[: len(h)] == self.doc[n - 1 :])
        return at, h[at]

    def probes(self) -> None:
        """Distinct values by part, which of them each window has, and where each part's values start."""
        self.at, h = self.windows(BLOCK, 0x9E3779B97F4A7C15)
        part = (h >> np.uint64(33)) % np.uint64(self.parts)
        self.values, self.which = np.unique((part << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)), return_inverse=True)
        self.cut = stretches(self.values >> np.uint64(32))

    def candidates(self, answers: dict[int, bytes], window: int) -> None:
        """Windows around hits; their distinct hashes by part, which of them each has, and the first place of each."""
        hit = np.zeros(len(self.values), bool)
        for p, b in answers.items():
            s = self.cut[p]
            hit[s] = _unbits(b, s.stop - s.start)
        here = np.zeros(len(self.h) + 1, np.int64)
        here[self.at[hit[self.which]] + 1] = 1
        here = np.cumsum(here)
        at, h = self.windows(window, 0x9E3779B97F4A7C15)
        near = here[np.minimum(at + window - BLOCK + 1, len(self.h))] > here[at]
        self.start, h = at[near], h[near]
        h2 = rolling(self.h, window, 0xD1342543DE82EF95)[self.start].astype(np.uint32) if len(h) else np.zeros(0, np.uint32)
        part = (h >> np.uint64(33)) % np.uint64(self.parts)
        order = np.lexsort((self.start, h2, h, part))
        new = np.ones(len(order), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        self.kind = np.empty(len(order), np.int64)
        self.kind[order] = np.cumsum(new) - 1
        self.lead = order[new]
        self.h1, self.h2 = h[self.lead], h2[self.lead]
        self.cut2 = stretches(part[self.lead])

    def removed(self, answers: dict[int, bytes], window: int) -> np.ndarray:
        """Which words a window covers that isn't the first of its kind."""
        won = np.zeros(len(self.lead), bool)
        for p, b in answers.items():
            s = self.cut2[p]
            won[s] = _unbits(b, s.stop - s.start)
        first = np.zeros(len(self.start), bool)
        first[self.lead[won]] = True
        cover = np.zeros(len(self.h) + 1, np.int64)
        again = self.start[~first]
        np.add.at(cover, again, 1)
        np.add.at(cover, again + window, -1)
        return np.cumsum(cover)[:-1] > 0


def runs(gone: np.ndarray) -> list[dict[str, int]]:
    """Where stretches of true begin, and how long they are."""
    turns = np.flatnonzero(np.diff(gone, prepend=False, append=False)).tolist()
    return [{"start": a, "length": e - a} for a, e in zip(turns[::2], turns[1::2], strict=True)]


def _packed(df: DataFrame, key: str, text: str) -> DataFrame:
    """chunk, doc_ids, texts: rows of about CHUNK_BYTES, in a table bucketed by chunk, so that answers come to the texts and not the other way."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, size = TaskContext.get().partitionId() << 32, [], 0

        def out() -> pa.RecordBatch:
            held.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1] or b""))
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([[r[0] for r in held]], pa.list_(pa.int64())), pa.array([[r[1] for r in held]], pa.list_(pa.binary())), pa.array([size], pa.int64())], ["chunk", "doc_ids", "texts", "size"])

        for b in batches:
            for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.append(row)
                size += len(row[1] or b"")
                if size >= CHUNK_BYTES or len(held) >= 1 << 20:
                    yield out()
                    chunk, held, size = chunk + 1, [], 0
        if held:
            yield out()

    rows = df.select(F.col(key).cast("long"), F.encode(text, "UTF-8")).mapInArrow(packed, "chunk long, doc_ids array<long>, texts array<binary>, size long")
    return bucketed(rows, "chunk", "chunks")


def _answered(chunks: DataFrame, *answers: DataFrame) -> DataFrame:
    """Each chunk's texts with the parts' answers."""
    for i, a in enumerate(answers):
        held = a.groupBy("chunk").agg(F.collect_list(F.struct("part", "bits")).alias(f"a{i}"))
        chunks = chunks.join(held.hint("merge"), "chunk", "left")
    return chunks


def _by_part(answers: object) -> dict[int, bytes]:
    return {r["part"]: r["bits"] for r in answers} if answers is not None else {}


def remove_repeats(df: DataFrame, window: int = 20, key: str = "doc_id", text: str = "text", with_text: bool = False, with_repeats: bool = False) -> DataFrame:
    """For each row of df: doc_id, n_words, n_removed, kept_sha256 (and kept, the words that stay joined by single spaces; and repeats, the first word and length of each maximal run that repeats what stands earlier).

    A word goes if a window of `window` words covers it whose words also start earlier: in a smaller doc_id, or earlier in the
    same document. Null and empty texts have no words. Null keys come after all others, and rows that repeat a key go by text and
    then in a fixed but arbitrary order, so of repeated rows one keeps its words. An empty table gives none. Other columns of df are not read.
    """
    if window < 2 * BLOCK - 1:
        raise ValueError(f"a window of {window} words may hold no whole block; at least {2 * BLOCK - 1} are needed")
    chunks = _packed(df, key, text)
    parts = max(1, -(-(chunks.agg(F.sum("size")).first()[0] or 0) // PART_BYTES))
    tasks = min(parts, MOST_TASKS)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                c = Chunk(row["texts"], parts)
                c.probes()
                many = np.bincount(c.which, minlength=len(c.values)) > 1
                block = np.zeros(len(c.values), bool)
                block[c.which[(c.at - c.first[c.doc[c.at]]) % BLOCK == 0]] = True
                cut = list(c.cut.items())
                low = c.values.astype(np.uint32)
                yield pa.RecordBatch.from_pydict({"part": pa.array([p for p, _ in cut], pa.int32()), "chunk": pa.array([row["chunk"]] * len(cut), pa.int64()), "value": [_planes(low[s]) for _, s in cut], "many": [_bits(many[s]) for _, s in cut], "block": [_bits(block[s]) for _, s in cut]}, schema=probe_schema)

    probe_schema = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("value", pa.binary()), ("many", pa.binary()), ("block", pa.binary())])

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        values = [_unplanes(v) for v in rows["value"]]
        size = [len(v) for v in values]
        _, which = np.unique(np.concatenate(values), return_inverse=True)
        ends = np.cumsum(size)
        n = np.bincount(which, np.concatenate([1.0 + _unbits(b, k) for b, k in zip(rows["many"], size, strict=True)]))
        block = np.bincount(which, np.concatenate([_unbits(b, k) for b, k in zip(rows["block"], size, strict=True)]))
        hit = ((n > 1) & (block > 0))[which]
        return pd.DataFrame({"chunk": rows["chunk"], "part": rows["part"], "bits": [_bits(hit[e - k : e]) for e, k in zip(ends, size, strict=True)]})

    answer = "chunk long, part int, bits binary"
    sent = chunks.mapInArrow(probe, "part int, chunk long, value binary, many binary, block binary")
    hits = sent.repartition(tasks, "part").groupBy("part").applyInPandas(match, answer)
    at = place(df.sparkSession, "hits")
    hits.write.parquet(at)
    hits = df.sparkSession.read.schema(answer).parquet(at)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                if not (found := _by_part(row["a0"])):
                    continue
                c = Chunk(row["texts"], parts)
                c.probes()
                c.candidates(found, window)
                doc = c.doc[c.start[c.lead]]
                ids = np.array([LAST if i is None else i for i in row["doc_ids"]], np.int64)
                cut = list(c.cut2.items())
                own = [np.unique(doc[s], return_inverse=True) for _, s in cut]
                yield pa.RecordBatch.from_pydict({"part": pa.array([p for p, _ in cut], pa.int32()), "chunk": pa.array([row["chunk"]] * len(cut), pa.int64()), "h1": [c.h1[s].tobytes() for _, s in cut], "h2": [c.h2[s].tobytes() for _, s in cut], "ids": [ids[d].tobytes() for d, _ in own], "which": [w.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes() for _, w in own]}, schema=extend_schema)

    extend_schema = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("h1", pa.binary()), ("h2", pa.binary()), ("ids", pa.binary()), ("which", pa.binary())])

    def first(rows: pd.DataFrame) -> pd.DataFrame:
        h1 = [np.frombuffer(b, np.uint64) for b in rows["h1"]]
        size = [len(v) for v in h1]
        ends = np.cumsum(size)
        h1, h2 = np.concatenate(h1), np.concatenate([np.frombuffer(b, np.uint32) for b in rows["h2"]])
        doc = np.concatenate([np.frombuffer(i, np.int64)[np.ascontiguousarray(np.frombuffer(w, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()] for i, w in zip(rows["ids"], rows["which"], strict=True)])
        chunk = np.repeat(rows["chunk"].to_numpy(), size)
        order = np.lexsort((chunk, doc, h2, h1))
        lead = np.ones(len(order), bool)
        lead[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        won = np.zeros(len(order), bool)
        won[order[lead]] = True
        return pd.DataFrame({"chunk": rows["chunk"], "part": rows["part"], "bits": [_bits(won[e - k : e]) for e, k in zip(ends, size, strict=True)]})

    extended = _answered(chunks, hits).select("chunk", "doc_ids", "texts", "a0").mapInArrow(extend, "part int, chunk long, h1 binary, h2 binary, ids binary, which binary")
    firsts = extended.repartition(tasks, "part").groupBy("part").applyInPandas(first, answer)
    at = place(df.sparkSession, "firsts")
    firsts.write.parquet(at)
    firsts = df.sparkSession.read.schema(answer).parquet(at)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                c = Chunk(row["texts"], parts)
                gone = np.zeros(len(c.h), bool)
                if found := _by_part(row["a0"]):
                    c.probes()
                    c.candidates(found, window)
                    gone = c.removed(_by_part(row["a1"]), window)
                count = np.bincount(c.doc[gone], minlength=len(c.n))
                stay = (~gone).tolist()
                # bytes.split() cuts at just the blanks of the contract
                split = [(t or b"").split() for t in row["texts"]]
                kept = [b" ".join(compress(w, stay[a : a + n]) if k else w) for w, k, a, n in zip(split, count, c.first, c.n, strict=True)]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(c.n, pa.int64()), pa.array(count, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), *[pa.array([k.decode() for k in kept], pa.string())] * with_text]
                if with_repeats:
                    columns.append(pa.array([runs(gone[a : a + n]) for a, n in zip(c.first, c.n, strict=True)], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept"] * with_text, *["repeats"] * with_repeats])

    return _answered(chunks, hits, firsts).select("chunk", "doc_ids", "texts", "a0", "a1").mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text + ", repeats array<struct<start: long, length: long>>" * with_repeats)
