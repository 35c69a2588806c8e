"""Language identification as multilingual mixture inference.

Each language is a distribution over hashed letter trigrams, counted over all labelled documents. A document is taken for a
mixture of languages: expectation-maximisation estimates its proportions from the trigrams' likelihoods, and the set of
languages grows, largest proportion first, while the likelihood gains more than the penalty for one more language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import PandasUDFType

from gristmill.llm.common import release
from gristmill.session import staged

BUCKETS = 1 << 16
#: Letters that are worked on at once.
CHUNK = 1 << 19
#: Languages of one block of the model, a row of BUCKETS numbers each, 0.75 MB; and how many languages, the likeliest by themselves, a document's mixture is taken over.
BLOCK_LANGUAGES, MIXED_LANGUAGES = 256, 256


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Document and bucket of each letter with its neighbours; whatever is no letter counts as a space."""
    texts = [t.lower() if t else "" for t in texts]
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    code = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(_letters()[code], code, np.uint32(32))
    at = np.flatnonzero(code != 32)
    if not len(at):
        return at, at
    left = np.where(at > 0, code[at - 1], np.uint32(32)).astype(np.uint64)
    h = ((left * np.uint64(0x1F123BB5) + code[at]) * np.uint64(0x9E3779B97F4A7C15) + code[at + 1]) * np.uint64(0xD6E8FEB86659FD93)
    return np.repeat(np.arange(len(texts)), size)[at], (h >> np.uint64(48)).astype(np.int64)


def _chunks(texts: list[str | None], most: int) -> Iterator[slice]:
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= most:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


class Model:
    """langs and, for each, the log-likelihood of each bucket (add-half smoothing)."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        smooth = counts + 0.5
        self.log = np.log(smooth / smooth.sum(1, keepdims=True)).T.astype(np.float32) if len(langs) else np.zeros((BUCKETS, 0), np.float32)
        self.like = np.exp(self.log.astype(np.float64))

    @property
    def mixed(self) -> int:
        return min(len(self.langs), MIXED_LANGUAGES)

    def alone(self, g: np.ndarray, c: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Each document's log-likelihood under each language by itself."""
        return np.stack([np.bincount(doc, c * self.log[g, j], n) for j in range(len(self.langs))], 1)

    def candidates(self, g: np.ndarray, c: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Likelihoods of the trigrams under the languages that a document is taken for a mixture of, log-likelihoods of these by themselves, and which they are."""
        return self.like[g], self.alone(g, c, doc, n), np.broadcast_to(np.arange(len(self.langs)), (n, len(self.langs)))

    def _em(self, like: np.ndarray, c: np.ndarray, doc: np.ndarray, n: int, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Proportions of n documents and their log-likelihood. like, c, doc: of each distinct trigram, documents in order."""
        total = np.bincount(doc, c, n)[:, None]
        out, live, where = share.copy(), np.arange(n), np.ones(len(doc), bool)
        for _ in range(rounds):
            lk, d = like[where], doc[where]
            starts = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
            weighed = lk * out[d]
            new = np.add.reduceat(weighed * (c[where] / weighed.sum(1))[:, None], starts) / total[d[starts]]
            moved = np.abs(new - out[d[starts]]).max(1) > 2e-3
            out[d[starts]] = new
            if not moved.any():
                break
            live = np.zeros(n, bool)
            live[d[starts][moved]] = True
            where = live[doc]
        return out, np.bincount(doc, c * np.log((like * out[doc]).sum(1)), n)

    def predict(self, texts: list[str | None], penalty: float) -> tuple[list[str], list[float], list[str], list[float]]:
        """Language, its proportion, the selected set (largest first), and the share that this set has in the mixture of all languages, of each text."""
        pred, score, chosen, of_set = ["und"] * len(texts), [0.0] * len(texts), [""] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return pred, score, chosen, of_set
        for part in _chunks(texts, max(1 << 14, CHUNK * 4 // max(4, self.mixed))):
            at, bucket = trigrams(texts[part])
            if not len(at):
                continue
            key, c = np.unique(at * BUCKETS + bucket, return_counts=True)
            ids, doc = np.unique(key // BUCKETS, return_inverse=True)
            n, g, c = len(ids), key % BUCKETS, c.astype(np.float64)
            likes, alone, names = self.candidates(g, c, doc, n)
            share, _ = self._em(likes, c, doc, n, np.full((n, self.mixed), 1 / self.mixed), 25)
            order = np.argsort(-share, axis=1, kind="stable")
            cost = penalty * np.log(np.maximum(np.bincount(doc, c, n), 2))
            # one language: the best by itself
            best = alone.argmax(1)
            value, size, top = alone[np.arange(n), best] - cost, np.ones(n, np.int64), share[np.arange(n), best]
            lead, open_ = best.copy(), np.ones(n, bool)
            for k in range(2, self.mixed + 1):
                # the next language joins only where it has some share and all smaller sets were better than those before
                open_ &= share[np.arange(n), order[:, k - 1]] > 0.01
                if not (rows := np.flatnonzero(open_)).size:
                    break
                mine = open_[doc]
                to = np.cumsum(open_) - 1
                d = to[doc[mine]]
                like = np.take_along_axis(likes[mine], order[rows[d], :k], 1)
                own, ll = self._em(like, c[mine], d, len(rows), np.full((len(rows), k), 1 / k), 25)
                better = ll - k * cost[rows] > value[rows]
                won = rows[better]
                value[won], size[won] = ll[better] - k * cost[won], k
                first = own[better].argmax(1)
                lead[won], top[won] = order[won, first], own[better].max(1)
                open_[rows[~better]] = False
            for r, i in enumerate(ids + part.start):
                pred[i], score[i] = self.langs[names[r, lead[r]]], float(min(1.0, max(0.0, top[r])))
                of_set[i] = float(min(1.0, share[r, lead[r]] if size[r] == 1 else share[r, order[r, : size[r]]].sum()))
                chosen[i] = self.langs[names[r, lead[r]]] if size[r] == 1 else ",".join(self.langs[names[r, j]] for j in order[r, : size[r]])
        return pred, score, chosen, of_set


class Blocks(Model):
    """A model of many languages in blocks, each broadcast by itself; a task holds one at a time."""

    def __init__(self, langs: list[str], blocks: list):
        self.langs, self.blocks = langs, blocks

    def _each(self) -> Iterator[tuple[int, Model]]:
        at = 0
        for b in self.blocks:
            block = b.load_from_path(b._path) if getattr(b, "_path", None) else b.value
            yield at, block
            at += len(block.langs)

    def candidates(self, g: np.ndarray, c: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The likeliest languages by themselves, in order of names."""
        alone, names = np.zeros((n, 0)), np.zeros((n, 0), np.int64)
        for at, block in self._each():
            alone = np.concatenate([alone, block.alone(g, c, doc, n)], 1)
            names = np.concatenate([names, np.broadcast_to(np.arange(at, at + len(block.langs)), (n, len(block.langs)))], 1)
            if alone.shape[1] > self.mixed:
                keep = np.sort(np.argsort(-alone, axis=1, kind="stable")[:, : self.mixed], 1)
                alone, names = np.take_along_axis(alone, keep, 1), np.take_along_axis(names, keep, 1)
        likes = np.empty((len(g), self.mixed))
        for at, block in self._each():
            row, col = np.nonzero((names[doc] >= at) & (names[doc] < at + len(block.langs)))
            likes[row, col] = block.like[g[row], names[doc[row], col] - at]
        return likes, alone, names


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Counts over every document that has a label, a text and is not held out.

    A table of counts by language and bucket is written once. The driver then makes the model block by block of at most BLOCK_LANGUAGES labels and
    holds no more than one block's counts; of the labels it holds the names.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}

        def out() -> Iterator[pd.DataFrame]:
            for name, held in sums.items():
                at = np.flatnonzero(held)
                yield pd.DataFrame({"lang": name, "bucket": at.astype(np.int32), "n": held[at]})
            sums.clear()

        for b in batches:
            for name, own in b.groupby("lang"):
                held, texts = sums.setdefault(name, np.zeros(BUCKETS, np.int64)), own["text"].tolist()
                for part in _chunks(texts, CHUNK):
                    held += np.bincount(trigrams(texts[part])[1], minlength=BUCKETS)
                if len(sums) >= BLOCK_LANGUAGES:
                    yield from out()
        yield from out()
        release()

    spark = df.sparkSession
    labelled = df.where(~held_out(F.col(key)) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    table = staged(labelled.mapInPandas(counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    langs = sorted(r["lang"] for r in table.select("lang").distinct().collect())

    def block(own: list[str]) -> Model:
        counts = np.zeros((len(own), BUCKETS))
        to = {x: i for i, x in enumerate(own)}
        # a row for each language, its counts as bytes: at most 12 bytes a bucket reach the driver
        held = table.where(F.col("lang").isin(own)).groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n")).mapInArrow(packed, "lang string, bucket binary, n binary")
        for r in held.toLocalIterator():
            counts[to[r["lang"]], np.frombuffer(r["bucket"], np.int32)] = np.frombuffer(r["n"], np.int64)
        return Model(own, counts)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                yield pa.RecordBatch.from_arrays([row.column(0), *[pa.array([row.column(j).flatten().to_numpy().astype(t).tobytes()], pa.binary()) for j, t in ((1, np.int32), (2, np.int64))]], ["lang", "bucket", "n"])

    if len(langs) <= BLOCK_LANGUAGES:
        return block(langs)
    return Blocks(langs, [spark.sparkContext.broadcast(block(langs[i : i + BLOCK_LANGUAGES])) for i in range(0, len(langs), BLOCK_LANGUAGES)])


def identify(df: DataFrame, model: Model, penalty: float = 3.0, text: str = "text") -> DataFrame:
    """df with lang_pred, score (proportion of that language), lang_set (the selected languages) and set_share (how much of the mixture of all languages is theirs).

    Texts that are null or have no letters, and all texts when nothing was learned, are `und` with score 0. Repeated rows get the same answer; an
    empty table stays empty. The four columns replace columns of these names.
    """
    spark = df.sparkSession
    # at most BLOCK_LANGUAGES x BUCKETS numbers, whatever the corpus; blocks are broadcast already
    shared = None if isinstance(model, Blocks) else spark.sparkContext.broadcast(model)
    own = model if shared is None else None

    def predicted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in texts:
            yield pd.DataFrame(dict(zip(("lang_pred", "score", "lang_set", "set_share"), (own or shared.value).predict(x.tolist(), penalty), strict=True)))
        release()

    predicted = F.pandas_udf(predicted, "lang_pred string, score double, lang_set string, set_share double", PandasUDFType.SCALAR_ITER)
    held = df.drop("lang_pred", "score", "lang_set", "set_share").withColumn("_lang", predicted(F.col(text)))
    return held.select("*", "_lang.lang_pred", "_lang.score", "_lang.lang_set", "_lang.set_share").drop("_lang")
