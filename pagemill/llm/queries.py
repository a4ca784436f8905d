"""The registered queries of this subpackage: each operator over its whole table, and what the contracts return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_round_trip
from .common import documents
from .fingerprints import fingerprint_report
from .jaccard import jaccard_components
from .langid import predict_language
from .media import media_round_trip
from .neardup import near_duplicates
from .negatives import NEGATIVES_SQL, mine_negatives
from .packing import pack_documents
from .pii import replace_private, session_key
from .repair import damaged, repair_conversations
from .tokenfile import token_file_digest
from .toxicity import score_toxicity
from .warc import AUDIT_SQL, audit_pages

Query = Callable[[SparkSession, str], DataFrame]


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_report(documents(spark, sf_dir))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(documents(spark, sf_dir), keep=False)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_language(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), keep=False)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_round_trip(documents(spark, sf_dir), keep=False)


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = replace_private(documents(spark, sf_dir).select("doc_id", "text"), session_key(spark))
    return found.select("doc_id", "text", F.size("_pii_entities").alias("n_entities"), F.col("_pii_entities").alias("entities"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op10_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digest(documents(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(rows.withColumn("label", moved), "vec_id % 100 = 0")


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair_conversations(damaged(rows), rows)


QUERIES: dict[str, Query] = {q.__name__: q for q in (op1_fingerprints, op2_bpe, op3_toxicity, op4_warc_audit, op5_language_id, op6_packing, op7_media, op8_surrogates, op9_near_dedup, op10_token_file, op11_hard_negatives, op12_jaccard_join, op13_conversation_repair)}
ORACLES: dict[str, str] = {"op4_warc_audit": AUDIT_SQL, "op11_hard_negatives": NEGATIVES_SQL}
