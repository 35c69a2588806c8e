"""Token counts by rank-synchronous merging of ragged numpy arrays.

Each batch's distinct pre-tokens lie in one flat array of symbols, sequence after sequence. In each round every sequence finds its
lowest rank among adjacent pairs and merges that pair at all its places, left to right, all sequences at once; the
sequences that have none left are done, and their surviving symbols are counted. One case needs care: if a pair that a merge
makes ranks no higher than the merge itself, the library would take it before the pair's other places, so
such a sequence merges its leftmost place alone in that round. The counts are the library's own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import PandasUDFType

from gristmill.llm.common import Memo, release

SPACE = "▁"
NONE = np.iinfo(np.int32).max


class PieceCounter:
    """Counts a sentencepiece BPE model's tokens; the library only reads the model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)
        scores = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not special(i)}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        # symbols: the pieces, then one number for any character that is no piece (never merged)
        self.ids = {p: i for i, p in enumerate(scores)}
        self.unknown, width = len(self.ids), len(self.ids) + 1
        pairs = [(self.ids[a] * width + self.ids[b], order[s], self.ids[p]) for p, s in scores.items() for k in range(1, len(p)) if (a := p[:k]) in self.ids and (b := p[k:]) in self.ids]
        pairs.sort()
        self.width = width
        self.keys, self.ranks, self.made = (np.array(x, t) for x, t in zip(zip(*pairs, strict=True), (np.int64, np.int32, np.int32), strict=True))
        self.bigrams = {p[k : k + 2] for p in scores for k in range(len(p) - 1)}
        if any(a != SPACE and b == SPACE for a, b in self.bigrams):
            raise ValueError("a piece holds a space after another character")
        # a line feed that is in no piece stands alone; other spaces start a new pre-token
        alone = "\n" if not any("\n" in p for p in scores) else ""
        self.split = re.compile(f"{alone}|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.memo = Memo(self.count_all)
        for probe in ("", " a  b\n\tc <s> ▁x", "Café é ﬁ ² 12,345 </s>\U0001f600", "aaaaaaa  \n\n  zz\u0000"):
            if self.counts([probe])[0] != len(sp.encode(probe)):
                raise ValueError("this model's text rules are not the ones that are counted here")

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; NONE where there is no such merge."""
        want = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        hit = self.keys[at] == want
        return np.where(hit, self.ranks[at], NONE), self.made[at]

    def _parts(self, token: str) -> list[str]:
        """A long pre-token, cut where two characters meet in no piece: no merge ever crosses there."""
        out, start = [], 0
        for k in range(1, len(token)):
            if token[k - 1 : k + 1] not in self.bigrams:
                out.append(token[start:k])
                start = k
        return [*out, token[start:]]

    def count_all(self, tokens: list[str]) -> list[int]:
        """Surviving symbols of each pre-token; characters that are no piece count as their bytes."""
        if not tokens:
            return []
        parts, owner = [], []
        for i, t in enumerate(tokens):
            own = [t] if len(t) < 40 else self._parts(t)
            parts += own
            owner += [i] * len(own)
        sym = np.array([self.ids.get(c, self.unknown) for p in parts for c in p], np.int32)
        size = np.array([len(p) for p in parts], np.int64)
        seq = np.repeat(np.arange(len(parts)), size)
        total = np.bincount(np.array(owner), weights=self._merged(sym, seq, len(parts)), minlength=len(tokens)).astype(np.int64)
        if (sym == self.unknown).any():
            for i, t in enumerate(tokens):
                total[i] += sum(len(c.encode("utf-8", "surrogatepass")) - 1 for c in t if c not in self.ids)
        return total.tolist()

    def _merged(self, sym: np.ndarray, seq: np.ndarray, n: int) -> np.ndarray:
        done = np.zeros(n, np.int64)
        rank, made = np.full(len(sym), NONE, np.int32), np.zeros(len(sym), np.int32)
        inner = seq[:-1] == seq[1:]
        rank[:-1][inner], made[:-1][inner] = self._ranked(sym[:-1][inner], sym[1:][inner])
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            lengths = np.diff(np.r_[starts, len(sym)])
            least = np.minimum.reduceat(rank, starts)
            over = least == NONE
            if over.any():
                done[seq[starts[over]]] = lengths[over]
                stay = np.repeat(~over, lengths)
                sym, seq, rank, made = sym[stay], seq[stay], rank[stay], made[stay]
                continue
            least = np.repeat(least, lengths)
            here = rank == least
            # where places overlap (a a a), those at even distance from the first of their run merge
            at = np.flatnonzero(here)
            first = np.r_[True, np.diff(at) != 1]
            run = np.flatnonzero(first)
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
            # places whose merge makes a pair of as low a rank, with the symbol right of it as it is now
            after = at + 2
            inside = (after < len(sym)) & (seq[np.minimum(after, len(sym) - 1)] == seq[at])
            risky = np.zeros(len(at), bool)
            risky[inside] = self._ranked(made[at[inside]], sym[after[inside]])[0] <= least[at[inside]]
            new, gone = sym.copy(), np.zeros(len(sym), bool)
            new[at] = made[at]
            gone[at + 1] = True
            left, spot = self._neighbour_ranks(new, seq, gone, at)
            risky |= left[spot] <= least[at] if len(at) else False
            if risky.any():
                alone = np.isin(seq[at], seq[at[risky]])
                lead = np.r_[True, seq[at][1:] != seq[at][:-1]]
                at = at[~alone | lead]
                new, gone = sym.copy(), np.zeros(len(sym), bool)
                new[at] = made[at]
                gone[at + 1] = True
            # the pairs on both sides of a merge are ranked anew
            touched = np.zeros(len(sym), bool)
            touched[at] = True
            keep = ~gone
            sym, seq, rank, made, touched = new[keep], seq[keep], rank[keep], made[keep], touched[keep]
            touched[:-1] |= touched[1:].copy()
            rank[touched] = NONE
            pair = np.flatnonzero(touched[:-1] & (seq[:-1] == seq[1:]))
            rank[pair], made[pair] = self._ranked(sym[pair], sym[pair + 1])
        return done

    def _neighbour_ranks(self, new: np.ndarray, seq: np.ndarray, gone: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each merged place, the lower rank of the pairs that it makes with its neighbours once all have merged."""
        keep = np.flatnonzero(~gone)
        s, q = new[keep], seq[keep]
        r = np.full(len(keep) + 1, NONE, np.int32)
        pos = np.searchsorted(keep, at)
        for first in (pos - 1, pos):
            ok = (first >= 0) & (first + 1 < len(s))
            f = first[ok]
            same = q[f] == q[f + 1]
            f = f[same]
            r[pos[ok][same]] = np.minimum(r[pos[ok][same]], self._ranked(s[f], s[f + 1])[0])
        return r, pos

    def counts(self, texts: list[str | None]) -> list[int]:
        split = [self.split(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        held = self.memo.of(set().union(*split)) if split else {}
        return [sum(map(held.__getitem__, s)) for s in split]


@cache
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def token_counts(df: DataFrame, model: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of df: doc_id, n_bytes, n_tokens, over_limit. model: the model file, at the same path on every executor.

    Nulls and empty texts have no bytes and no tokens. Repeated rows and null keys are counted like any other; an empty table gives none. Other columns
    of df are not read.
    """

    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter(model)
        for x in batches:
            texts = x.tolist()
            yield pd.Series([n for i in range(0, len(texts), 512) for n in own.counts(texts[i : i + 512])], dtype="int64")
        release()

    counted = F.pandas_udf(counted, "long", PandasUDFType.SCALAR_ITER)
    body = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.col(key).alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), counted(body).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
