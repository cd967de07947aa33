"""Operator 8, exact dedup: a persistent index of text digests, bucketed and sorted by digest.

Method: each row is reduced to its SHA-256 digest; a batch's rows are pre-aggregated to one row per digest before
they are shuffled; the digests that no earlier batch brought come out of a sort-merge anti-join against the
bucketed, sorted index table, whose side isn't shuffled (a bucket that several batches wrote to is several sorted files,
which the scan's task merges by a sort), and are appended to it. The decisions then join back by digest: both sides are plain
shuffles, so a digest with a third of all rows is a partition that adaptive execution splits. Only digests and numbers are
shuffled until the last step, which takes the kept rows out of the input.

A batch is a partition of the index and replaces what an earlier run of the same batch left there, and it never looks
at its own entries. Which of its rows stays is found in the batch as it is read now. So a batch that failed, or
that is read again in other partitions, is decided as the first time and loses nothing.

Defined cases: a null text counts as empty; texts are compared byte for byte; of equal texts the row with the
largest doc_id stays (null is smallest; of rows with equal doc_id, one); rows of a text that an earlier batch
brought are all dropped and point at that batch's row; an empty table gives an empty result; doc_id must be castable to a 64-bit
integer; in dedup(), columns come back unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.shared import Work, buckets, chosen, exists, identified, work_path

SCHEMA = "digest binary, keep_id long, batch string"


class DigestIndex:
    """The index at a path. Its table is registered anew in every session; the files outlive it."""

    def __init__(self, spark: SparkSession, path: str, n_buckets: int = 16):
        self.spark, self.path = spark, path
        self.table = "digest_index_" + hashlib.md5(path.encode()).hexdigest()[:16]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({SCHEMA}) USING parquet PARTITIONED BY (batch)"
            f" CLUSTERED BY (digest) SORTED BY (digest) INTO {n_buckets} BUCKETS LOCATION '{path}'"
        )
        if exists(spark, path):  # partitions of earlier sessions
            spark.sql(f"MSCK REPAIR TABLE {self.table}")

    def others(self, batch: str) -> DataFrame:
        """The entries of all other batches: digest, keep_id."""
        return self.spark.table(self.table).filter(F.col("batch") != batch).select("digest", "keep_id")

    def put(self, fresh: DataFrame, batch: str) -> None:
        """Make these digests the batch's entries: digest, keep_id. They must not be read from the index itself."""
        name = batch.replace("'", "''")
        fresh.createOrReplaceTempView(view := self.table + "_new")
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.table} PARTITION (batch = '{name}') SELECT digest, keep_id FROM {view}")
        self.spark.catalog.dropTempView(view)
        self.spark.catalog.refreshTable(self.table)

    def close(self) -> None:
        """Take the table out of the session's catalog; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def _decide(digests: DataFrame, index: DigestIndex, batch: str, work: Work) -> DataFrame:
    """digests: row, key, digest, of a written table. One row per row of it: row, key, digest, keep_id, kept; the batch is in the index then."""
    groups = digests.groupBy("digest").agg(F.max(F.struct("key", "row")).alias("keep"))
    fresh = work.write(groups.hint("merge").join(index.others(batch), "digest", "left_anti"), "fresh")
    index.put(fresh.select("digest", F.col("keep.key").alias("keep_id")), batch)
    here = fresh.select("digest", F.col("keep.key").alias("keep_id"), F.col("keep.row").alias("keep_row"))
    before = groups.select("digest").hint("merge").join(index.others(batch), "digest")
    answers = here.union(before.select("digest", "keep_id", F.lit(None).cast(fresh.schema["keep"].dataType["row"].dataType)))
    out = digests.join(answers.hint("merge"), "digest")
    return out.select("row", "key", "digest", "keep_id", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"))


def _digests(rows: DataFrame, key: str, text: str, work: Work) -> DataFrame:
    return work.write(rows.select("row", F.col(f"doc.`{key}`").cast("long").alias("key"), _digest(F.col(f"doc.`{text}`")).alias("digest")), "digests")


def _numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """For results that are only numbers: doc, row, whose numbers hold for one evaluation."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in {key: 0, text: 0}]).alias("doc"), F.monotonically_increasing_id().alias("row"))


def decide(docs: DataFrame, index: DigestIndex, batch: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, kept, text_sha256. The batch's new digests are in the index afterwards."""
    work = Work(docs.sparkSession, "exact")
    out = work.last(_decide(_digests(_numbered(docs, key, text), key, text, work), index, batch, work), "decisions")
    return out.select(F.col("key").alias("doc_id"), "keep_id", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def dedup(docs: DataFrame, index: DigestIndex, batch: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with their columns as they were."""
    work, rows = Work(docs.sparkSession, "exact"), identified(docs, "exact")
    keep = work.last(_decide(_digests(rows, key, text, work), index, batch, work).filter("kept").select("row"), "kept")
    return chosen(rows, keep)


def fresh_index(spark: SparkSession, n_buckets: int | None = None) -> DigestIndex:
    """An empty index below the shared folder, with a bucket for each of the session's shuffle partitions unless told otherwise."""
    return DigestIndex(spark, work_path(spark, "digest-index"), n_buckets or buckets(spark))


def groups(docs: DataFrame, index: DigestIndex, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs, brought to the index as two batches, the upper half of the keys first: doc_id, keep_id, group_size, kept, text_sha256.

    The second batch meets the first one's digests in the index, so of equal texts the largest key stays all the same.
    """
    work = Work(docs.sparkSession, "exact")
    digests = _digests(_numbered(docs, key, text), key, text, work)
    low, high = digests.agg(F.min("key"), F.max("key")).first()
    upper = F.coalesce(F.col("key") > F.lit(((low or 0) + (high or 0)) // 2), F.lit(False))
    parts = [work.write(_decide(digests.filter(c), index, name, work), name) for c, name in ((upper, "upper"), (~upper, "lower"))]
    size = digests.groupBy("digest").agg(F.count("*").alias("group_size"))
    out = work.last(parts[0].union(parts[1]).join(size.hint("merge"), "digest"), "decisions")
    return out.select(F.col("key").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = fresh_index(spark)
    out = groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), index)
    index.close()
    return out


SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
