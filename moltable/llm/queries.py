"""The numbered queries: thin functions of (spark, folder of tables) over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_automaton, cgk_decontam, feistel_shards, merkle_audit, neardup, paragraph_dedup, pii_sanitise, quality_crf, rotation_codes, token_counts, toxicity_channel, vector_codes, whitening

try:
    import public_tokenizers

    VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
except ImportError:
    VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hyperminhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_documents(table(spark, sf_dir, "documents"), neardup.Banding(shingle=2))


def held_out(modulus: int, remainder: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus == remainder


def quality_model(spark: SparkSession, sf_dir: str) -> quality_crf.Model | None:
    labels = table(spark, sf_dir, "labels").where(~held_out(5, 0)).select("doc_id", F.col("quality").alias("label"))
    return quality_crf.fit(table(spark, sf_dir, "documents"), labels)


def op2_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_crf.scored(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir), ["doc_id"])
    score = F.col("quality_score")
    return out.select("doc_id", F.coalesce(held_out(5, 0), F.lit(False)).alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


def op3_rotation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotation_codes.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_pii_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_sanitise.found(table(spark, sf_dir, "documents"))


def op5_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = feistel_shards.Layout()
    return feistel_shards.index(feistel_shards.shards(table(spark, sf_dir, "documents"), layout), layout)


def op6_toxicity_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_channel.CharModel.of(toxicity_channel.count_characters(docs))
    labels = table(spark, sf_dir, "labels").where(~held_out(4, 2)).select("doc_id", F.col("toxic").alias("label"))
    out = toxicity_channel.scored(docs, model, toxicity_channel.fit(docs, labels, model), ["doc_id"])
    score = F.col("toxicity")
    return out.select("doc_id", F.coalesce(held_out(4, 2), F.lit(False)).alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


def op7_cgk_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cgk_decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.repeated(table(spark, sf_dir, "documents"))


def op9_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits pages against a replica with faults of fixed places: a changed byte in some records, and lost last records of files."""
    pages = table(spark, sf_dir, "pages")
    flipped = F.when(F.pmod("page_id", F.lit(97)) == 5, F.concat(F.lit("#"), F.expr("substring(html, 2)"))).otherwise(F.col("html"))
    replica = pages.where(F.pmod("page_id", F.lit(4096)) != 4095).select("page_id", "url", flipped.alias("html"))
    return merkle_audit.audit(pages, replica)


def op10_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op11_two_tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(table(spark, sf_dir, "documents"), VOCABULARY)


def op12_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.coded(table(spark, sf_dir, "embeddings"))


def _nearest(books: str) -> str:
    """SQL: each part with its nearest entry of the codebook table, the first of equal ones."""
    far = "CAST(list_sum(list_transform(list_zip(y, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    return f"SELECT row_id, p, y, min({{'d': {far}, 'k': k}}) AS near FROM parts JOIN {books} USING (p) GROUP BY ALL"


def _improved(books: str, assigned: str) -> str:
    """SQL: each entry's floored mean, position by position; an unused entry stays."""
    return f"""
  SELECT b.p, b.k, coalesce(m.c, b.c) AS c FROM {books} b LEFT JOIN (
    SELECT p, k, list(v ORDER BY j) AS c FROM (
      SELECT p, near.k AS k, j, CAST(floor(sum(y[j]) / count(*)) AS BIGINT) AS v FROM {assigned}, (SELECT unnest(range(1, width + 1)) AS j FROM size) GROUP BY ALL
    ) GROUP BY ALL
  ) m ON b.p = m.p AND b.k = m.k"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hyperminhash_neardup": op1_hyperminhash_neardup,
    "op2_quality_crf": op2_quality_crf,
    "op3_rotation_codes": op3_rotation_codes,
    "op4_pii_sanitise": op4_pii_sanitise,
    "op5_feistel_shards": op5_feistel_shards,
    "op6_toxicity_channel": op6_toxicity_channel,
    "op7_cgk_decontam": op7_cgk_decontam,
    "op8_paragraph_dedup": op8_paragraph_dedup,
    "op9_merkle_audit": op9_merkle_audit,
    "op10_bpe_automaton": op10_bpe_automaton,
    "op11_two_tier_counts": op11_two_tier_counts,
    "op12_jacobi_whitening": op12_jacobi_whitening,
    "op13_product_codes": op13_product_codes,
}
ORACLES: dict[str, str] = {
    "op9_merkle_audit": r"""
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, page_id // 4096 AS file FROM pages WHERE page_id IS NOT NULL
), damaged AS (
  SELECT page_id, url, CASE WHEN page_id % 97 = 5 THEN '#' || substring(html, 2) ELSE html END AS html, file FROM parts WHERE page_id % 4096 <> 4095
), both_sides AS (
  SELECT 'a' AS side, * FROM parts UNION ALL SELECT 'b' AS side, * FROM damaged
), rec AS (
  SELECT side, page_id, file, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
    || 'Content-Length: ' || CAST(strlen(html) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS body FROM both_sides
), laid AS (
  SELECT side, page_id, file, strlen(body) AS len, sha256(body) AS digest FROM rec
), placed AS (
  SELECT *, coalesce(sum(len) OVER (PARTITION BY side, file ORDER BY page_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM laid
), a AS (SELECT * FROM placed WHERE side = 'a'), b AS (SELECT * FROM placed WHERE side = 'b')
SELECT coalesce(a.file, b.file) AS file, coalesce(a.page_id, b.page_id) AS page_id,
  CASE WHEN b.digest IS NULL THEN 'missing' WHEN a.digest IS NULL THEN 'added' WHEN a.digest = b.digest THEN 'moved' ELSE 'corrupt' END AS status,
  CAST(a.off AS BIGINT) AS "offset", CAST(a.len AS BIGINT) AS length, a.digest AS digest,
  CAST(b.off AS BIGINT) AS replica_offset, CAST(b.len AS BIGINT) AS replica_length, b.digest AS replica_digest
FROM a FULL JOIN b ON a.page_id = b.page_id
WHERE a.digest IS DISTINCT FROM b.digest OR a.off IS DISTINCT FROM b.off
""",
    "op13_product_codes": f"""
WITH whole AS (
  SELECT vec_id, label, row_number() OVER () AS row_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), size AS (SELECT greatest(1, (max(len(x)) + 15) // 16) AS width FROM whole
), padded AS (
  SELECT vec_id, label, row_id, list_concat(x, list_transform(range(16 * width - len(x)), lambda z: CAST(0 AS BIGINT))) AS x, width FROM whole, size
), parts AS (
  SELECT row_id, p, x[p * width + 1 : p * width + width] AS y FROM padded, (SELECT unnest(range(16)) AS p)
), c0 AS (
  SELECT p, k, c FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id NULLS LAST, x) - 1 AS k, y AS c FROM parts JOIN padded USING (row_id)) WHERE k < 64
), a0 AS ({_nearest("c0")}), c1 AS ({_improved("c0", "a0")}), a1 AS ({_nearest("c1")}), c2 AS ({_improved("c1", "a1")}), a2 AS ({_nearest("c2")}
), coded AS (
  SELECT row_id, string_agg(printf('%02x', CAST(near.k AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(near.d) AS BIGINT) AS error FROM a2 GROUP BY row_id
), digest AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM c2
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN padded USING (row_id), digest
""",
}
