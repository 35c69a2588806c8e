"""Best-fit packing of tokenised documents by bin completion.

Documents are tokenised once, on the executors, and cut into pieces of at most the capacity. Pieces of one length are
alike, so the packing is solved on their counts by length, a table of at most `capacity` rows whatever the corpus. Best-fit decreasing gives the
first incumbent; if it needs more sequences than the bound, a branch-and-bound search fills the sequence of the largest piece left, again and
again: all its undominated fillings, least waste first, in as many sequences at once as the counts allow, then in fewer. A branch ends
where waste or the bound of what is left says that it can't beat the incumbent. The search is exhaustive unless its steps run out; then it goes on
over a few sequences at a time, the least filled ones and some others, as long as steps are left. Pieces find their places by their number in order of length.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import Memo, numbered, release, slices

#: Latin letters that neither normalising nor lowering turns into anything but as many letters, then ASCII marks but the apostrophe.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ňŊ-ɏ]+)([!-&(-/:-@\[-`{-~]*)")
#: Texts that tell whether a tokenizer may be asked run by run.
PROBES = ["", " a  b\n\tc", "Café (été), DON'T 12,345 x2\n\n  Zz. ÀÉ!? ﬁ İ", "a\u00a0b\u3000c \u200bd <unk> </s> [PAD] <|endoftext|>", "word " * 40 + "end\x00x\r\ny"]
#: A filling of a sequence: (length, pieces of it) from long to short.
Pieces = tuple[tuple[int, int], ...]
#: A filling, and how many sequences are filled so.
Filling = tuple[Pieces, int]
#: Fillings of one waste that are looked at together, so that those of common lengths are tried first. Steps of the search, some 0.2 ms each.
TOGETHER, STEPS = 64, 30_000
#: How many of a branch's last choices keep their enumeration; those before it begin theirs again where they are needed.
LIVE = 32


def best_fit(counts: dict[int, int], cap: int) -> list[Filling]:
    """Best-fit decreasing over counts: each piece goes to the fullest open sequence with room for it."""
    open_: dict[int, Counter] = {}  # room left -> fillings
    rooms: list[int] = []

    def put(room: int, filling: tuple[int, ...], n: int) -> None:
        if room not in open_:
            open_[room] = Counter()
            rooms.insert(bisect_left(rooms, room), room)
        open_[room][filling] += n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                each = min(left, cap // length)
                put(cap - each * length, (length,) * each, max(1, left // each))
                left -= each * max(1, left // each)
                continue
            room = rooms[k]
            filling, n = next(iter(open_[room].items()))
            n = min(n, left)
            open_[room][filling] -= n
            if not open_[room][filling]:
                del open_[room][filling]
            if not open_[room]:
                del open_[room], rooms[k]
            put(room - length, (*filling, length), n)
            left -= n
    return [(tuple(sorted(Counter(f).items(), reverse=True)), n) for held in open_.values() for f, n in held.items()]


def least_sequences(n: np.ndarray, cap: int) -> int:
    """A lower bound on the sequences for n[length] pieces of each length, by sums of dual feasible functions of the lengths."""
    size = np.arange(cap + 1)
    number, total, half = np.cumsum(n), np.cumsum(n * size), cap // 2
    a = np.arange(half + 1)
    # pieces over half a sequence have one each; beside those of cap - a at most there is some room for pieces of a or more
    beside, theirs = np.maximum(number[cap - a] - number[half], 0), np.maximum(total[cap - a] - total[half], 0)
    rest = total[half] - np.where(a > 0, total[a - 1], 0) - (beside * cap - theirs)
    return max(-(-int(total[cap]) // cap), int(number[cap] - number[half] + np.maximum(0, -(-rest // cap)).max()))


def least_by_parts(n: np.ndarray, cap: int, most: int = 60) -> int:
    """Another lower bound: lengths rounded to k-ths of a sequence, where they are no multiple of a (k + 1)-th, for each k."""
    at = np.flatnonzero(n)
    best = 0
    for k in range(1, most):
        x = (k + 1) * at
        best = max(best, -(-int(np.where(x % cap == 0, at * k, x // cap * cap) @ n[at]) // (k * cap)))
    return best


def _sums(lengths: list[int], left: dict[int, int], room: int) -> list[int]:
    """Up to `room`, as bits: what the first i lengths can sum to, for each i."""
    whole, sums = (1 << room + 1) - 1, 1
    out = [sums]
    for length in lengths:
        c, k = min(left[length], room // length), 1
        while c > 0 and sums != whole:
            sums |= (sums << min(k, c) * length) & whole
            c, k = c - k, 2 * k
        out.append(sums)
    return out


def _summing(lengths: list[int], left: dict[int, int], free: int, i: int, sums: list[int]) -> Iterator[Pieces]:
    """All choices among the first i lengths that sum to `free`, those of the longest pieces first."""
    if not free:
        yield ()
        return
    i = min(i, bisect_right(lengths, free))
    while i and sums[i] >> free & 1:
        i -= 1
        length = lengths[i]
        for c in range(min(left[length], free // length), 0, -1):
            if sums[i] >> (free - c * length) & 1:
                for rest in _summing(lengths, left, free - c * length, i, sums):
                    yield ((length, c), *rest)


def _dominated(filling: Pieces, waste: int, lengths: list[int], left: dict[int, int]) -> bool:
    """Whether one piece that is left over fits beside the filling, or in place of one or two of its pieces that are shorter."""
    used = dict(filling)

    def spare(lo: int) -> bool:
        """A piece of lo to lo + waste that the filling leaves over."""
        if not waste:
            return left.get(lo, 0) > used.get(lo, 0)
        return any(left[x] > used.get(x, 0) for x in lengths[bisect_left(lengths, lo) : bisect_right(lengths, lo + waste)])

    if waste and (any(left[x] > used.get(x, 0) for x in lengths[: bisect_right(lengths, waste)]) or any(any(left[x] > used.get(x, 0) for x in lengths[bisect_right(lengths, a) : bisect_right(lengths, a + waste)]) for a in used)):
        return True
    return any(spare(a + b) for i, (a, n) in enumerate(filling) for b in [a] * (n > 1) + [x for x, _ in filling[i + 1 :]])


def fillings(lengths: list[int], left: dict[int, int], room: int, most_waste: int) -> Iterator[tuple[int, list[Pieces]]]:
    """(waste, some undominated fillings of `room` with it), least waste first, all of them bit by bit; lengths ascend."""
    if left.get(room):
        yield 0, [((room, 1),)]  # one piece that fills the room dominates all else
        return
    lengths = lengths[: bisect_right(lengths, room)]
    sums = _sums(lengths, left, room)
    for waste in range(min(most_waste, room) + 1):
        if sums[-1] >> (room - waste) & 1:
            found = _summing(lengths, left, room - waste, len(lengths), sums)
            while some := list(islice(found, TOGETHER)):
                some = [f for f in some if not _dominated(f, waste, lengths, left)]
                # scarce lengths are kept for later, when little else fits
                some.sort(key=lambda f: (sum(c for _, c in f), -min((left[x] // c for x, c in f), default=0), -sum(left[x] for x, _ in f)))
                yield waste, some


class Search:
    """Branch-and-bound for `most` sequences or fewer. found: the fillings, or None; whole: nothing was left untried; deepest: the longest branch; used: steps."""

    def __init__(self, n: np.ndarray, cap: int, most: int, steps: int):
        self.cap, self.n, self.steps, self.used = cap, n.copy(), steps, 0
        self.left = {int(x): int(n[x]) for x in np.flatnonzero(n)}
        self.lengths = sorted(self.left)
        self.spare = most * cap - int(n @ np.arange(cap + 1))  # waste that there may be
        self.deepest: tuple[int, list[Filling], np.ndarray] = (0, [], self.n.copy())
        self.found, self.whole = self._run(most) if self.spare >= 0 else (None, True)

    def _choices(self, spare: int) -> Iterator[tuple[Pieces, int, int]]:
        """(filling around the largest piece, its waste, sequences), step by step."""
        left, lengths = self.left, self.lengths
        largest = lengths[-1]
        left[largest] -= 1
        rest, own = {x: left[x] for x in lengths if left[x]}, lengths if left[largest] else lengths[:-1]
        left[largest] += 1
        for waste, some in fillings(list(own), rest, self.cap - largest, spare):
            self.used += 1
            for f in some:
                whole = ((largest, 1 + f[0][1]), *f[1:]) if f and f[0][0] == largest else ((largest, 1), *f)
                n = min(left[x] // c for x, c in whole)
                for m in range(min(n, spare // waste) if waste else n, 0, -1):
                    self.used += 1
                    yield whole, waste, m

    def _take(self, f: Pieces, m: int) -> None:
        for x, c in f:
            if not self.left[x]:
                insort(self.lengths, x)
            self.left[x] -= c * m
            self.n[x] -= c * m
            if not self.left[x]:
                del self.lengths[bisect_left(self.lengths, x)]

    def _run(self, most: int) -> tuple[list[Filling] | None, bool]:
        path: list[tuple[Pieces, int, int, Iterator | None, int, int]] = []
        spent = made = 0
        seen: dict[tuple, int] = {}
        todo, tried, spare = self._choices(self.spare), 0, self.spare
        while self.lengths:
            if self.used > self.steps:
                return None, False
            if (choice := next(todo, None)) is None:
                if not path:
                    return None, True
                f, waste, m, todo, tried, spare = path.pop()
                self._take(f, -m)
                spent, made = spent - waste * m, made - m
                todo = todo or islice(self._choices(spare), tried, None)
                continue
            f, waste, m = choice
            tried += 1
            self._take(f, m)
            spent, made = spent + waste * m, made + m
            path.append((f, waste, m, todo, tried, spare))
            if len(path) > LIVE:
                path[-LIVE - 1] = (*path[-LIVE - 1][:3], None, *path[-LIVE - 1][4:])
            if made > self.deepest[0]:
                self.deepest = made, [(x, k) for x, _, k, *_ in path], self.n.copy()
            state = (*self.lengths, *(self.left[x] for x in self.lengths))
            if seen.get(state, spent + 1) <= spent or made + least_sequences(self.n, self.cap) > most:
                todo = iter(())
                continue
            if len(seen) * len(state) < 1_000_000:
                seen[state] = spent
            tried, spare = 0, self.spare - spent
            todo = self._choices(spare)
        return [(x, k) for x, _, k, *_ in path], True


def completed(counts: dict[int, int], cap: int, steps: int = STEPS, seed: int = 0) -> tuple[list[Filling], int]:
    """The fillings, and a lower bound on their number; where they are equal the packing is the best there is.

    steps: after so many the best packing so far is returned. They bound the time, not the packing's validity.
    """
    n = np.zeros(cap + 1, np.int64)
    for length, c in counts.items():
        n[length] += c
    bound = max(least_sequences(n, cap), least_by_parts(n, cap))
    held = Counter()

    def take(*some: list[Filling]) -> None:
        """Keeps the packing if it needs fewer sequences."""
        new = Counter()
        for f, m in (x for part in some for x in part):
            new[f] += m
        if not held or new.total() < held.total():
            held.clear()
            held.update(new)

    def rest_of(left: np.ndarray) -> list[Filling]:
        return best_fit({int(x): int(left[x]) for x in np.flatnonzero(left)}, cap)

    take(rest_of(n))
    used, rng = 0, np.random.default_rng(seed)
    while bound < held.total() and used < steps // 2:
        # first for the bound itself, then for one sequence less than there are
        most = bound if not used else held.total() - 1
        s = Search(n, cap, most, steps // 4)
        used += s.used
        if s.found is not None:
            take(s.found)
        elif s.whole:
            bound = most + 1
        else:
            take(s.deepest[1], rest_of(s.deepest[2]))
    while bound < held.total() and used < steps:
        kinds = list(held)
        many, waste = np.array([held[f] for f in kinds]), np.array([cap - sum(x * c for x, c in f) for f in kinds])
        size = int(rng.integers(6, 25))
        picked = Counter()
        for i in np.argsort(-waste * (rng.random(len(kinds)) < 0.9), kind="stable")[: size // 2].tolist():
            if waste[i]:
                picked[i] = min(int(many[i]), size // 2 - picked.total())
        for i in rng.choice(len(kinds), size, p=many / many.sum()).tolist():
            if picked.total() < size and picked[i] < many[i]:
                picked[i] += 1
        part = np.zeros(cap + 1, np.int64)
        for i, m in picked.items():
            for x, c in kinds[i]:
                part[x] += c * m
        s = Search(part, cap, picked.total() - 1, 150)
        used += s.used + 5
        if s.found is not None:
            take(list((held - Counter({kinds[i]: m for i, m in picked.items()})).items()), s.found)
    return list(held.items()), bound


@cache
def _ids_of(path: str) -> Memo:
    """Little-endian 32-bit ids of each run between spaces and line feeds: such runs are tokenised alike wherever they stand."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    encode = getattr(t, "encode_batch_fast", t.encode_batch)
    suffix = getattr(t.model, "end_of_word_suffix", None) or ""
    ends = np.zeros(max(t.get_vocab(with_added_tokens=True).values()) + 1, bool)
    ends[[i for w, i in t.get_vocab(with_added_tokens=False).items() if suffix and w.endswith(suffix)]] = True

    def one_by_one(new: list[str]) -> Iterator[bytes]:
        return (np.array(e.ids, "<u4").tobytes() for e in encode(new, add_special_tokens=False))

    def word_ids(new: list[str]) -> list[bytes]:
        """Letters alone are one word of the tokenizer each: many go to a line, which is cut again where words end. Were a line's ends not as many as its words, it would go word by word."""
        out: list[bytes] = []
        lines = [new[i : i + 256] for i in range(0, len(new), 256)]
        for line, e in zip(lines, encode([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            stops = (4 * (np.flatnonzero(ends[ids]) + 1)).tolist()
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)] if len(stops) == len(line) else one_by_one(line)
        return out

    letters, marks = Memo(word_ids), Memo(one_by_one)

    def all_ids(new: list[str]) -> list[bytes]:
        """Letters with marks after them are two words of the tokenizer, and case makes no difference to it."""
        cut = [(w.lower(), "") if w.isascii() and w.isalpha() else (m[1].lower(), m[2]) if (m := PLAIN.fullmatch(w)) else (None, w) for w in new] if suffix else [(None, w) for w in new]
        head, tail = letters.of({a for a, _ in cut if a is not None}), marks.of({b for a, b in cut if a is not None and b})
        rest = iter(one_by_one([b for a, b in cut if a is None]))
        return [next(rest) if a is None else head[a] + tail[b] if b else head[a] for a, b in cut]

    whole = Memo(all_ids)
    for probe in PROBES:
        if _text_ids(pa.array([probe]), whole) != list(one_by_one([probe])):
            raise ValueError("this tokenizer does not treat runs between blanks alike wherever they stand")
    return whole


def _text_ids(texts: pa.Array, memo: Memo) -> list[bytes]:
    """The ids of each text; a null one has none. Runs are cut and told apart by Arrow, so that Python sees each different one of a batch once."""
    runs = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
    flat = runs.flatten().dictionary_encode()
    different = flat.dictionary.to_pylist()
    held = memo.of(different)
    ids = [held[w] for w in different]
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    which = flat.indices.to_numpy()
    n, start = size[which], (np.cumsum(size) - size)[which]
    ends = np.r_[0, np.cumsum(n)]
    out = np.frombuffer(b"".join(ids), "<u4")[np.arange(ends[-1]) + np.repeat(start - ends[:-1], n)].tobytes()
    edges = (4 * ends[runs.offsets.to_numpy() - runs.offsets[0].as_py()]).tolist()
    return [out[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def pieces(df: DataFrame, tokenizer: str, capacity: int, key: str = "doc_id", text: str = "text", end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of every row."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        memo = _ids_of(tokenizer)
        for b in batches:
            for own in slices(b, "text"):
                keys, texts = own.column(0).to_pylist(), own.column(1)
                rows = [(k, i // step, i // 4, len(x) // 4, zlib.crc32(x), *[x] * with_ids) for k, ids in zip(keys, _text_ids(texts, memo), strict=True) for whole in [ids + end] for i in range(0, len(whole), step) for x in [whole[i : i + step]]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        release()

    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * with_ids]
    names = [f.split(" ")[0] for f in schema.split(", ")]
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, schema)


def pack(df: DataFrame, tokenizer: str, capacity: int = 2048, key: str = "doc_id", text: str = "text", end_id: int = 0, with_ids: bool = False, steps: int = STEPS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, least_sequences (and ids) of every piece.

    sequence_id goes from 0 without gaps; least_sequences, the same in all rows, is a number of sequences that no packing can go below.

    A document is its ids and then end_id; only longer ones than the capacity are cut. Null and empty texts are end_id alone, so every row has a
    piece. Rows that repeat are packed each for itself, null keys like any other; which of equal pieces goes where is not told apart. An empty
    table gives none. Other columns of df are not read. tokenizer: a file, at the same path on every executor.
    """
    extra = ["ids"] * with_ids
    rows, n = numbered(pieces(df, tokenizer, capacity, key, text, end_id, with_ids), ["length", "doc_id", "piece", "start", "ids_crc32"], "_number")
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most `capacity` rows
    found, bound = completed(counts, capacity, steps)
    first = dict(zip(sorted(counts), np.cumsum([0, *[counts[k] for k in sorted(counts)]]), strict=False))
    places, base = [], 0
    for filling, times in found:
        offset = 0
        for length, c in filling:
            places.append((first[length], base, c, offset, length))
            first[length] += c * times
            offset += c * length
        base += times
    at = np.array(sorted(places), np.int64).reshape(-1, 5)  # a few rows for each length

    @F.pandas_udf("sequence_id long, offset long")
    def placed(x: pd.Series) -> pd.DataFrame:
        x = x.to_numpy()
        own = at[np.searchsorted(at[:, 0], x, "right") - 1]
        within = x - own[:, 0]
        return pd.DataFrame({"sequence_id": own[:, 1] + within // own[:, 2], "offset": own[:, 3] + within % own[:, 2] * own[:, 4]})

    return rows.withColumn("_place", placed("_number")).select("doc_id", "piece", "start", "length", "ids_crc32", "_place.sequence_id", "_place.offset", F.lit(bound).cast("long").alias("least_sequences"), *extra)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (binary, little-endian 32-bit) and doc_ids of each sequence; packed: pack(..., with_ids=True). A group is at most one sequence long."""
    held = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(held.alias("_x")).select("sequence_id", F.aggregate("_x.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"), F.col("_x.doc_id").alias("doc_ids"))
