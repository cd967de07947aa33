"""The corpus pipeline: quality rules, exact dedup, near-duplicate removal, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All stages but the last return
the columns of documents with their values unchanged: rejected documents go, of equal and of near-equal texts one stays
(the largest doc_id of equal texts, the smallest doc_id of a near class), and the mix repeats documents as drawn.
The last one returns doc_id, source, n_tokens, ids_sha256 and decoded_sha256, one row per document drawn. Stages
read their input from Parquet and put theirs into the shared folder, so a lost executor costs only its tasks.

Null keys, null and empty texts, ties, empty tables and extra columns are defined as in the operators' docstrings:
null and empty texts fail the quality rules, so later stages meet none of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import byte_bpe, exact_dedup, mixing, near_dedup, quality
from vigil.llm.shared import remove, work_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    index = exact_dedup.fresh_index(spark)
    out = exact_dedup.dedup(docs, index, "pipeline")
    index.close()
    return out


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = byte_bpe.round_trip(docs, path, public_tokenizers.PATTERN, carry=("doc_id", "source"))
    return out.select("doc_id", "source", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality_rules), ("exact dedup", exact), ("near dedup", near), ("mix sources", mix), ("byte-level BPE", tokenise)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path := work_path(spark, "stage"))
        docs = spark.read.schema(out.schema).parquet(path)
        if before:  # its successor is committed
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)


#: Near-duplicate search and BPE can't be put in SQL; the stages are tested against brute force.
ORACLE_SQL = None
