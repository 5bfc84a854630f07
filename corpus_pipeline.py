"""A cleaning pipeline over documents: quality, near duplicates, benchmark leaks, personal data, token ids.

STAGES lists (name, function) in order.  A function takes (spark, docs, sf_dir) and
returns a DataFrame; each stage works on all rows its predecessor kept and all but the
last return the columns of documents.  run() writes every stage as Parquet to the shared
folder and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moltable.llm import bpe_automaton, cgk_decontam, neardup, pii_sanitise, quality_crf
from moltable.llm.queries import VOCABULARY, held_out, table
from moltable.llm.shared import fresh, plain, stored

THRESHOLD = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a quality score of at least THRESHOLD stay; the model learns from labelled rows that are not held out.

    A null or empty text has the share of good documents as its score; repeated rows go or stay together.
    """
    labels = table(spark, sf_dir, "labels").where(~held_out(5, 0)).select("doc_id", F.col("quality").alias("label"))
    score = fresh(docs, "quality_score")
    return quality_crf.scored(docs, quality_crf.fit(docs, labels), name=score).where(F.col(score) >= THRESHOLD).drop(score)


def row_keys(docs: DataFrame, key: str) -> DataFrame:
    """docs with a column `key`: the doc_id, or, for a null id and for one that several rows share, a hash of id and text above all ids."""
    same, mark = fresh(docs, "__id"), fresh(docs, "__shared")
    shared = plain(docs, "doc_id").where("doc_id is not null").groupBy(F.col("doc_id").alias(same)).count().where("count > 1").select(same)
    if shared.isEmpty() and docs.where("doc_id is null").isEmpty():
        return docs.withColumn(key, F.col("doc_id").cast("long"))
    own = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2).bitwiseOR(F.lit(1 << 62))
    known = docs.join(shared.withColumn(mark, F.lit(True)), F.col("doc_id") == F.col(same), "left")
    return known.withColumn(key, F.when(F.col("doc_id").isNull() | F.col(mark).isNotNull(), own).otherwise(F.col("doc_id"))).drop(same, mark)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8 or more) the row of the smallest doc_id stays.

    Rows of a null id or of one that others share stand behind all others, in the order of a hash of id and text; of
    rows that are equal in both one stays.  Texts that are null or without words are in no group: all their rows stay.
    An empty table gives an empty one.
    """
    key = fresh(docs, "__key")
    keyed = row_keys(docs, key)
    out = neardup.near_documents(plain(keyed, key, "text"), neardup.Banding(shingle=5), id_col=key)
    gone = out.where("not kept").select(F.col("doc_id").alias(key)).distinct()
    left = keyed.join(gone, key, "left_anti")
    many = (F.col(key) >= F.lit(1 << 62)) & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return left.where(~many).unionByName(left.where(many).dropDuplicates([key])).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text holds a benchmark item go, whatever their id; null and empty texts hold none and stay.  Repeated rows go or stay together."""
    held, mark = F.xxhash64("text"), fresh(docs, "__text")
    leaks = cgk_decontam.contaminated(docs.select(held.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(mark)).distinct()
    return docs.withColumn(mark, held).join(leaks, mark, "left_anti").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced in the text; n_chars follows.

    A null text stays null and an empty one empty; repeated rows each stay and are treated alike.  An empty table gives an empty one.
    """
    out = pii_sanitise.sanitised(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): ids as an array, and the digest of the text that they decode to.

    A null or empty text has no ids and decodes to an empty text; a null id stays null, repeated rows each give a row,
    other columns are left behind.  An empty table gives an empty one.
    """
    out = bpe_automaton.encode_decode(docs, VOCABULARY)
    ids = F.when(F.col("ids") == "", F.array().cast("array<int>")).otherwise(F.split("ids", " ").cast("array<int>"))
    return out.select("doc_id", "n_tokens", ids.alias("ids"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("token_ids", token_ids),
]

#: Learned scores, Viterbi-like walks and tokenisation have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
