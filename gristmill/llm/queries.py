"""The operators as queries over whole tables: queries() and, where SQL can say the same, oracle_sql()."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import ann, column_suffixes, exact_dedup, jaccard_join, language_id, line_dedup, mixing, packing, sharding, spelling, substring_dedup, token_count, vector_codes
from gristmill.session import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_cross_polytope_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_fixed_block_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=20)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), ngram=3, num=90, den=100)


def op5_log_template_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = line_dedup.drop_recurring_lines(table(spark, sf_dir, "documents"), counts=True)
    return held.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"), batches=2)


def op7_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=16)
    return held.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op8_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = language_id.identify(docs, language_id.fit(docs))
    return held.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "lang_set", "set_share")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = mixing.mix_plan(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2, shards=16)
    return held.select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "shards", "shuffle_keys")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op11_column_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_suffixes.remove_repeated_bytes(table(spark, sf_dir, "documents"), window=200)


def op12_filtering_lloyd_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"), entries=64, parts=16, rounds=2, scale=256)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), least_letters=6, least_n=5, times=5, spoil=199)


#: Digests are whole-table equality groups, which SQL says directly.
OP6_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


#: Every string of 200 bytes by its digest; runs of starts that lie 200 bytes apart or less are one removed run. Bytes are pairs of hexadecimal digits.
OP11_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT r, i, md5_number(substring(h, 2 * i + 1, 400)) AS k FROM d, LATERAL (SELECT unnest(range(n - 199)) AS i) WHERE n >= 200),
s AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1),
g AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM s)),
p AS (SELECT r, run, min(i) AS a, max(i) + 200 AS e FROM g GROUP BY r, run),
q AS (SELECT r, a, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a), 0) AS f FROM p),
t AS (SELECT d.r, string_agg(substring(h, 2 * f + 1, 2 * (a - f)), '' ORDER BY a) AS head, max(e) AS last, sum(e - a) AS gone, count(*) AS spans FROM q JOIN d USING (r) GROUP BY d.r)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN t USING (r)
"""

_NEAR = "(a.v[1] - b.v[1]) ** 2 + (a.v[2] - b.v[2]) ** 2 + (a.v[3] - b.v[3]) ** 2 + (a.v[4] - b.v[4]) ** 2"


def _round_sql(before: str, after: str) -> str:
    """A round over tables p (vec_id, part, v) and a codebook (part, entry, v): every part's entry and its distance, and the codebook after it."""
    return f"""{before}_a AS (SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT a.vec_id, a.part, b.entry, ({_NEAR})::BIGINT AS d FROM p a JOIN {before} b USING (part)) GROUP BY vec_id, part),
{after} AS (SELECT part, entry, coalesce(m.v, b.v) AS v FROM {before} b LEFT JOIN (SELECT part, entry, list(floor(s / n)::BIGINT ORDER BY i) AS v FROM (SELECT part, entry, i, sum(x)::DOUBLE AS s, count(*) AS n FROM (SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS i FROM {before}_a JOIN p USING (vec_id, part)) GROUP BY part, entry, i) GROUP BY part, entry) m USING (part, entry))"""


#: Lloyd rounds as joins of all parts with all entries; vectors have 64 components here, four to a part.
OP12_SQL = f"""
WITH k AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT vec_id, part, list_transform(embedding[part * 4 + 1 : part * 4 + 4], lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM k, range(16) t(part)),
c0 AS (SELECT part, entry, v FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id, embedding) - 1 AS entry FROM k ORDER BY vec_id, embedding LIMIT 64) USING (vec_id)),
{_round_sql("c0", "c1")}, {_round_sql("c1", "c2")}, {_round_sql("c2", "c3")},
f AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM c2_a GROUP BY vec_id),
h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS i FROM c2))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM f JOIN k USING (vec_id), h
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_cross_polytope_ann, op2_fixed_block_substring_dedup, op3_best_fit_packing, op4_ngram_jaccard_join, op5_log_template_line_dedup, op6_exact_dedup, op7_feistel_sharding, op8_language_mixture, op9_source_mixing, op10_token_counts, op11_column_suffix_dedup, op12_filtering_lloyd_codes, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": OP6_SQL, "op11_column_suffix_dedup": OP11_SQL, "op12_filtering_lloyd_codes": OP12_SQL}
