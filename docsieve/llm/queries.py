"""One query per training-data operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, langid, linededup, media, mixing, packing, secrets, simhash, substring, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(_table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats_report(_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(_table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokenizer = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.packed(_table(spark, sf_dir, "documents"), tokenizer)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(_table(spark, sf_dir, "documents"))


#: Words of more than one document's windows go from all but the smallest doc_id's.
_OP6 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w),
x AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM p),
f AS (SELECT k, min(doc_id) AS owner FROM x GROUP BY k),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM x JOIN f USING (k) WHERE owner < doc_id),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM t ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3's columns that the method does not decide."""
    return op3_secret_scan(spark, sf_dir).drop("spans")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2's sources, and whether what is taken of each is within a word of its target."""
    docs = _table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs).groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("taken").alias("taken"))
    return mixed.select("source", "source_size", F.round("target", 3).alias("target"), (F.abs(F.col("taken") - F.col("target")) <= 1).alias("met"))


def nearest_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5's search where every leaf is visited, so that nothing is missed."""
    found = ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, visits=1 << 30)
    return found.withColumn("score", F.round("score", 6))


def media_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10's columns of the payload as it was read back."""
    return op10_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


_OP3 = r"""
WITH p(kind, pattern) AS (VALUES (0, '(?i)(?:password|passwd|secret|token|api_?key)["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)'), (1, '(AKIA[A-Z0-9]+)'), (2, '([0-9a-f]+)')),
t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS (
  SELECT r, 0 AS kind, regexp_extract_all(text, '{assign}') AS m, regexp_extract_all(text, '{assign}', 1) AS v, string_split_regex(text, '{assign}') AS g FROM t
  UNION ALL SELECT r, 1, regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), string_split_regex(text, 'AKIA[A-Z0-9]+') FROM t
  UNION ALL SELECT r, 2, regexp_extract_all(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+'), string_split_regex(text, '[0-9a-f]+') FROM t),
l AS (SELECT r, kind, m, v, list_transform(m, lambda x: length(x)) AS ml, list_transform(g, lambda x: length(x)) AS gl FROM m),
x AS (SELECT r, kind, v, ml, gl, unnest(range(1, len(m) + 1)) AS i FROM l),
s AS (SELECT r, kind, length(v[i]) AS n, ml[i] AS w, (sum(gl[i]) OVER o + sum(ml[i]) OVER o - ml[i])::BIGINT AS a FROM x WINDOW o AS (PARTITION BY r, kind ORDER BY i)),
k AS (SELECT r, kind, a, a + w AS b FROM s WHERE n >= [6, 20, 24][kind + 1])
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(['assign', 'access', 'hex'][kind + 1] || ':' || a || ':' || b, ',' ORDER BY a, kind), '')) AS base_sha256
FROM t LEFT JOIN k USING (r) GROUP BY r, doc_id"""
_ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

_SQL = {
    "op6_substring_dedup": _OP6,
    "secrets_base": _OP3.replace("{assign}", _ASSIGN),
    # sources by cap over weight: those before the first that its cap does not bind are at their caps
    "mix_targets": f"""
WITH s AS (SELECT source, sum({_WORDS})::BIGINT AS source_size FROM documents GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s),
r AS (SELECT *, 2 * source_size / w AS ratio, 1.5 * sum(source_size) OVER () AS total FROM w),
o AS (SELECT *, coalesce(sum(2 * source_size) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
        sum(w) OVER (ORDER BY ratio, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM r),
v AS (SELECT min_by((total - capped) / open, ratio) FILTER (ratio > (total - capped) / open) AS level FROM o)
SELECT source, source_size, round(least(2 * source_size, coalesce(level * w, 2 * source_size))::DOUBLE, 3) AS target, true AS met FROM o, v""",
    "nearest_exact": """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(q.v, e.v) AS score FROM e q, e WHERE q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id),
k AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM p)
SELECT query_id, rank::INT AS rank, vec_id, round(score, 6) AS score FROM k WHERE rank <= 20""",
    "media_payload": r"""
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT *, octet_length(b) AS n, greatest(1, (octet_length(b) + 575) // 576) * 576 AS size FROM t)
SELECT doc_id, n AS n_bytes, size AS payload_bytes, sha256(b || repeat('\xFF'::BLOB, size - n)) AS payload_sha256 FROM n""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The ten, and parts of four of them that SQL can express."""
    ten = {name: f for name, f in globals().items() if name[:2] == "op" and name[2:3].isdigit()}
    return ten | {f.__name__: f for f in (secrets_base, mix_targets, nearest_exact, media_payload)}


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query; the others are tested against plain Python versions."""
    return dict(_SQL)
