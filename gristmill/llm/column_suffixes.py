"""Suffix-array dedup by column-wise construction over many documents.

The repeated strings of a corpus are found in a collection of short documents, its pieces, whose suffixes are put in order all at once:

1. every `window` bytes have an anchor, the `gram` bytes among them with the least hash, so equal strings have equal anchors at equal
   offsets. Windows that follow each other and share an anchor are a piece. Texts are packed into chunks of some megabytes, and each chunk sends its
   pieces' hashes, by anchor, to parts; a part answers which anchors stand in more than one place, which pieces do so as a whole, and which chunk
   sends the bytes of a piece, so that bytes of copies travel once.
2. in a part, all pieces of an anchor are one collection, aligned at the anchor. Column by column from the right, a round inserts one symbol
   of each piece: the symbols before the sorted suffixes, which are the round's Burrows-Wheeler column, sort the longer suffixes stably, and
   the common prefix of two neighbours is one more than the least between their places before. Suffixes that may be equal for `window` bytes come in
   in the same round, as their anchors are aligned; so a round's order and common prefixes are read once from start to end and written anew, and
   what earlier rounds inserted is finished. A window repeats where a neighbour shares `window` bytes or more.
3. each chunk covers the bytes of its repeated windows.

The files of a collection stand in the shared folder as tables between these steps, and as arrays of at most BATCH pieces (a single anchor's may be more)
inside one; a task writes to no folder of its machine. An anchor with more than `crowd` different pieces, such as a phrase of many contexts, is taken
apart: pieces are cut by their windows' offsets to the anchor, `window` // 12 offsets each, and dealt out by the bytes that all windows of such a cut share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import mixed_bits, release
from gristmill.llm.substring_dedup import MOST_TASKS, PART_BYTES, _answered, _bits, _by_part, _packed, _unbits, stretches
from gristmill.session import place

#: Bytes of a chunk whose anchors are looked for at a time, and pieces that are put in order together.
SLICE, BATCH = 1 << 21, 1 << 15
#: What a part says of a piece: its anchor has too many pieces; this chunk sends the bytes, as there are other pieces to hold it against; it repeats as a whole.
CROWDED, SEND, WHOLE = 1, 2, 4
_SYMBOL = mixed_bits(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)


def gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """A 32-bit hash of each `gram` bytes, a power of two."""
    h, width = _SYMBOL[b], 1
    while width < gram:
        h = h[:-width] + h[width:] * np.uint32(pow(0x9E3779B1, width, 1 << 32))
        width *= 2
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x846CA68B)
    return h ^ (h >> np.uint32(16))


def least_ahead(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n values in a row."""
    width = 1
    while width < n:
        step = min(width, n - width)
        x = np.minimum(x[:-step], x[step:])
        width += step
    return x


class Pieces:
    """A chunk's pieces: first byte, number of windows, offset of the anchor, hash of the anchor and of the piece's bytes."""

    def __init__(self, texts: list[bytes | None], window: int, gram: int):
        self.window, self.sizes = window, [len(t or b"") for t in texts]
        self.buf = b"".join(t or b"" for t in texts)
        ends = np.cumsum(self.sizes)
        at, n, lo = [], [], []
        for s in range(0, max(0, len(self.buf) - window + 1), SLICE):
            b = np.frombuffer(self.buf, np.uint8)[s : s + SLICE + window - 1]
            key = gram_hashes(b, gram).astype(np.uint64) << np.uint64(32)
            key |= np.arange(len(key), dtype=np.uint64)
            anchor = (least_ahead(key, window - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            inside = np.ones(len(anchor), bool)
            for e in ends[np.searchsorted(ends, s, "right") : np.searchsorted(ends, s + len(b), "right") + 1].tolist():
                inside[max(0, e - s - window + 1) : max(0, e - s)] = False
            first = inside.copy()
            first[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1])
            first = np.flatnonzero(first)
            at.append(first + s)
            n.append(np.diff(np.r_[np.cumsum(inside)[first] - 1, np.count_nonzero(inside)]))
            lo.append(anchor[first] - first)
        self.at, self.n, self.lo = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (at, n, lo))
        anchors = (self.at + self.lo).tolist()
        self.g = np.array([xxhash.xxh3_64_intdigest(self.buf[p : p + gram]) for p in anchors], np.uint64)
        self.ph = self.hashed(self.at, self.n)

    def hashed(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.array([xxhash.xxh3_64_intdigest(self.buf[a:e]) for a, e in zip(at.tolist(), (at + n + (self.window - 1)).tolist(), strict=True)], np.uint64)

    def wanted(self, kinds: Kinds, answers: dict[int, bytes], cut: int) -> Cuts:
        """The pieces whose windows have to be held against others, those of crowded anchors taken apart; notes which pieces repeat as a whole."""
        code = np.zeros(len(kinds.lead), np.uint8)
        for p, b in answers.items():
            code[kinds.cut[p]] = np.frombuffer(b, np.uint8)
        self.whole = (code[kinds.which] & WHOLE) > 0
        plain = kinds.lead[(code & (SEND | CROWDED)) == SEND]
        crowded = kinds.lead[(code & CROWDED) > 0]
        at, n, lo, g = [self.at[plain]], [self.n[plain]], [self.lo[plain]], [self.g[plain]]
        found = []
        for a, k, o in zip(self.at[crowded].tolist(), self.n[crowded].tolist(), self.lo[crowded].tolist(), strict=True):
            p, t = a + o, 0
            while t < k:
                band = (o - t) // cut
                upto = min(k, o - band * cut + 1)
                core = self.buf[p - band * cut : p - band * cut - cut + 1 + self.window]
                found.append((a + t, upto - t, o - t, xxhash.xxh3_64_intdigest(core, band + 1)))
                t = upto
        if found:
            a, k, o, h = zip(*found, strict=True)
            at.append(np.array(a)), n.append(np.array(k)), lo.append(np.array(o)), g.append(np.array(h, np.uint64))
        at, n = np.concatenate(at), np.concatenate(n)
        return Cuts(at, n, np.concatenate(lo), np.concatenate(g), self.hashed(at, n))


class Cuts:
    def __init__(self, at: np.ndarray, n: np.ndarray, lo: np.ndarray, g: np.ndarray, ph: np.ndarray):
        self.at, self.n, self.lo, self.g, self.ph = at, n, lo, g, ph


class Kinds:
    """Different pieces by part, anchor and bytes: the first piece of each, which of them each piece is, and how many there are."""

    def __init__(self, g: np.ndarray, ph: np.ndarray, parts: int):
        part = (g >> np.uint64(33)) % np.uint64(parts)
        order = np.lexsort((ph, g, part))
        new = np.ones(len(order), bool)
        new[1:] = (g[order][1:] != g[order][:-1]) | (ph[order][1:] != ph[order][:-1])
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1
        self.lead = order[new]
        self.many = np.bincount(self.which, minlength=len(self.lead)) > 1
        self.cut = stretches(part[self.lead])


def repeated_windows(pieces: list[bytes], lo: np.ndarray, group: np.ndarray, window: int) -> list[np.ndarray]:
    """For each piece, which of its windows stand in another piece of its group too. Groups are ascending from 0, and pieces are aligned at lo.

    A round a column, from the right: `order` holds the pieces by group and by their suffix from the column on, `common` the prefix that
    each shares with the one before, up to `window`.
    """
    base, m = int(lo.max()), len(pieces)
    size = np.fromiter(map(len, pieces), np.int64, m)
    start = base - lo
    width = int((start + size).max())
    symbols = np.zeros((m, width), np.uint16)
    for i, (b, s) in enumerate(zip(pieces, start.tolist(), strict=True)):
        symbols[i, s : s + len(b)] = np.frombuffer(b, np.uint8)
    symbols += 1
    inside = np.arange(width)
    symbols[(inside < start[:, None]) | (inside >= (start + size)[:, None])] = 0  # no symbol: shares nothing with anything
    symbols = np.ascontiguousarray(symbols.T)
    repeats = np.zeros((width, m), bool)
    order, common, group = np.arange(m), np.zeros(m + 1, np.int16), group.astype(np.uint16)
    for x in range(width - 1, -1, -1):
        column = symbols[x][order]
        to = np.argsort(column, kind="stable")
        to = to[np.argsort(group[order[to]], kind="stable")]
        order, column = order[to], column[to]
        same = np.flatnonzero((column[1:] == column[:-1]) & (column[1:] > 0) & (group[order[1:]] == group[order[:-1]])) + 1
        fresh = np.zeros(m + 1, np.int16)
        if len(same):
            between = np.stack([to[same - 1] + 1, to[same] + 1], 1).ravel()
            fresh[same] = np.minimum(np.minimum.reduceat(common, between)[::2] + 1, window)
        common = fresh
        if x <= width - window:
            full = common >= window
            repeats[x, order] = full[:-1] | full[1:]
    return [repeats[s : s + k - window + 1, i] for i, (s, k) in enumerate(zip(start.tolist(), size.tolist(), strict=True))]


def _judged(rows: pd.DataFrame, crowd: int) -> pd.DataFrame:
    """A part's answer on all pieces of its anchors."""
    size = [len(b) // 8 for b in rows["g"]]
    ends = np.cumsum(size)
    g, ph = (np.frombuffer(b"".join(rows[c]), np.uint64) for c in ("g", "ph"))
    times = 1 + np.concatenate([_unbits(b, k) for b, k in zip(rows["many"], size, strict=True)]).astype(np.int64)
    order = np.lexsort((ph, g))
    new_g = np.ones(len(order), bool)
    new_g[1:] = g[order][1:] != g[order][:-1]
    new = new_g.copy()
    new[1:] |= ph[order][1:] != ph[order][:-1]
    kind, anchor = np.cumsum(new) - 1, np.cumsum(new_g) - 1
    kinds = np.bincount(anchor, new)[anchor]
    code = np.where(kinds > crowd, CROWDED, 0) | np.where(new & (kinds > 1), SEND, 0) | np.where(np.bincount(kind, times[order])[kind] > 1, WHOLE, 0)
    out = np.empty(len(order), np.uint8)
    out[order] = code
    return pd.DataFrame({"chunk": rows["chunk"], "part": rows["part"], "bits": [out[e - k : e].tobytes() for e, k in zip(ends, size, strict=True)]})


def _ordered(rows: pd.DataFrame, window: int) -> pd.DataFrame:
    """A part's answer on all windows of the pieces it was sent."""
    size = [len(b) // 8 for b in rows["g"]]
    owner = np.repeat(np.arange(len(rows)), size)
    g, ph = (np.frombuffer(b"".join(rows[c]), np.uint64) for c in ("g", "ph"))
    lo, n = (np.frombuffer(b"".join(rows[c]), np.int32).astype(np.int64) for c in ("lo", "n"))
    times = 1 + np.concatenate([_unbits(b, k) for b, k in zip(rows["many"], size, strict=True)]).astype(np.int64)
    length = n + window - 1
    at = np.concatenate([np.cumsum(x) - x for x in np.split(length, np.cumsum(size)[:-1])])
    blobs = rows["bytes"].tolist()
    order = np.lexsort((ph, g))
    new = np.ones(len(order), bool)
    new[1:] = (g[order][1:] != g[order][:-1]) | (ph[order][1:] != ph[order][:-1])
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    lead = order[new]
    whole = np.bincount(kind, times) > 1
    masks = [np.full(k, w) for k, w in zip(n[lead].tolist(), whole.tolist(), strict=True)]
    _, first, held = np.unique(g[lead], return_index=True, return_counts=True)
    shared = held > 1
    first, held = first[shared], held[shared]
    batch = np.cumsum(held) // BATCH
    for b in np.unique(batch):
        own = np.flatnonzero(batch == b)
        which = np.concatenate([np.arange(f, f + k) for f, k in zip(first[own].tolist(), held[own].tolist(), strict=True)])
        i = lead[which]
        texts = [blobs[o][a : a + k] for o, a, k in zip(owner[i].tolist(), at[i].tolist(), length[i].tolist(), strict=True)]
        for k, mask in zip(which.tolist(), repeated_windows(texts, lo[i], np.repeat(np.arange(len(own)), held[own]), window), strict=True):
            masks[k] = masks[k] | mask
    ends = np.cumsum(size)
    return pd.DataFrame({"chunk": rows["chunk"], "part": rows["part"], "bits": [_bits(np.concatenate([masks[k] for k in kind[e - s : e].tolist()])) for e, s in zip(ends, size, strict=True)]})


def remove_repeated_bytes(df: DataFrame, window: int = 200, key: str = "doc_id", text: str = "text", with_spans: bool = False, crowd: int = 2048) -> DataFrame:
    """For each row of df: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that stay, with spans, the first byte and length of each removed run).

    A byte of the UTF-8 text goes if `window` bytes that cover it stand anywhere else too, in another row or at another place of the same one, overlaps
    included; so of equal texts of `window` bytes or more nothing stays. Null and empty texts have no bytes. Repeated rows and null keys count each for itself; an empty table
    gives none. Other columns of df are not read.
    """
    if window < 12:
        raise ValueError(f"a window of {window} bytes; at least 12 are needed")
    gram, cut = 1 << (window // 3).bit_length() - 1, window // 12
    chunks = _packed(df, key, text)
    parts = max(1, -(-(chunks.agg(F.sum("size")).first()[0] or 0) // PART_BYTES))
    tasks = min(parts, MOST_TASKS)
    spark, answer = df.sparkSession, "chunk long, part int, bits binary"

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                p = Pieces(row["texts"], window, gram)
                k = Kinds(p.g, p.ph, parts)
                yield message(row["chunk"], k, {"g": p.g[k.lead], "ph": p.ph[k.lead]})
        release()

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                if not (found := _by_part(row["a0"])):
                    continue
                p = Pieces(row["texts"], window, gram)
                c = p.wanted(Kinds(p.g, p.ph, parts), found, cut)
                k = Kinds(c.g, c.ph, parts)
                at, end = c.at[k.lead], (c.at + c.n)[k.lead] + window - 1
                texts = [b"".join(p.buf[a:e] for a, e in zip(at[s].tolist(), end[s].tolist(), strict=True)) for s in k.cut.values()]
                yield message(row["chunk"], k, {"g": c.g[k.lead], "ph": c.ph[k.lead], "lo": c.lo[k.lead].astype(np.int32), "n": c.n[k.lead].astype(np.int32)}, bytes=texts)
        release()

    def message(chunk: int, k: Kinds, columns: dict[str, np.ndarray], **more: list[bytes]) -> pa.RecordBatch:
        cut = list(k.cut.items())
        held = {"part": pa.array([p for p, _ in cut], pa.int32()), "chunk": pa.array([chunk] * len(cut), pa.int64()), **{c: pa.array([x[s].tobytes() for _, s in cut], pa.binary()) for c, x in columns.items()}, "many": pa.array([_bits(k.many[s]) for _, s in cut], pa.binary()), **{c: pa.array(x, pa.binary()) for c, x in more.items()}}
        return pa.RecordBatch.from_arrays(list(held.values()), list(held))

    def answered(messages: DataFrame, by: object, name: str) -> DataFrame:
        at = place(spark, name)
        messages.repartition(tasks, "part").groupBy("part").applyInPandas(by, answer).write.parquet(at)
        return spark.read.schema(answer).parquet(at)

    judged = answered(chunks.select("chunk", "texts").mapInArrow(told, "part int, chunk long, g binary, ph binary, many binary"), lambda rows: _judged(rows, crowd), "pieces")
    pieces = _answered(chunks, judged).select("chunk", "texts", "a0").mapInArrow(sent, "part int, chunk long, g binary, ph binary, lo binary, n binary, many binary, bytes binary")
    ordered = answered(pieces, lambda rows: _ordered(rows, window), "repeats")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                turn = np.zeros(sum(len(t or b"") for t in row["texts"]) + 1, np.int32)
                if found := _by_part(row["a0"]):
                    p = Pieces(row["texts"], window, gram)
                    c = p.wanted(Kinds(p.g, p.ph, parts), found, cut)
                    k = Kinds(c.g, c.ph, parts)
                    again = k.many[k.which]  # cuts that the chunk has more than once repeat as a whole
                    for at, n in ((p.at[p.whole], p.n[p.whole]), (c.at[again], c.n[again])):
                        np.add.at(turn, at, 1)
                        np.add.at(turn, at + n + window - 1, -1)
                    at, n = c.at[k.lead], c.n[k.lead]
                    for part, bits in _by_part(row["a1"]).items():
                        s = k.cut[part]
                        starts = np.repeat(at[s] - (np.cumsum(n[s]) - n[s]), n[s]) + np.arange(n[s].sum())
                        starts = starts[_unbits(bits, len(starts))]
                        np.add.at(turn, starts, 1)
                        np.add.at(turn, starts + window, -1)
                gone, edge, rows = np.cumsum(turn)[:-1] > 0, 0, []
                for doc_id, t in zip(row["doc_ids"], row["texts"], strict=True):
                    t = t or b""
                    own = gone[edge : edge + len(t)]
                    edge += len(t)
                    turns = np.flatnonzero(np.diff(own, prepend=False, append=False))
                    runs = list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True))
                    kept = np.frombuffer(t, np.uint8)[~own].tobytes() if runs else t
                    rows.append((doc_id, len(t), len(t) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept, [{"start": a, "length": e - a} for a, e in runs]))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), out, strict=False)], schema=out)
        release()

    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if with_spans:
        fields += [("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))]
        schema += ", kept binary, spans array<struct<start: long, length: long>>"
    out = pa.schema(fields)
    return _answered(chunks, judged, ordered).select("chunk", "doc_ids", "texts", "a0", "a1").mapInArrow(finish, schema)
