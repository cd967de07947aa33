"""Operator 9, mixing sources to target weights by systematic sampling.

Method: a source's target divided by its size is each of its documents' expected number of copies. These are
summed up along the source, one random offset is added, and a document is emitted once for every integer that the
sum passes while it goes over the document. Documents are laid out by size, so the picks spread evenly over short
and long ones and the words taken come within about one long document of the target.

The running sum is two-level: rows are range-partitioned by (source, size, id), which cuts a hot source into many
partitions; each partition sums on its own, and the partitions' totals (one row per partition and source) are
summed once more to give each partition its start. Expected copies are integers in units of 2**-24, so the sums
are exact in any order and reruns agree. Only identifiers, sources and sizes are shuffled.

Defined cases: a null text has size 0; sources are ordered by code point, null last, and null is a source of its
own; a source of size 0 gets target 0 and gives nothing; equal documents are told apart by doc_id, then by row;
an empty table gives an empty result; doc_id must be castable to a 64-bit integer; in mix(), columns come back
unchanged, whatever their names, a document once per copy. The windows over sources run in one task: a source is one row there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.llm.shared import WORD, Work, identified

WEIGHTS, MOST, UNIT, SEED = (5, 2, 1), 3, 1 << 24, "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes: source, size, one row per document. One row per source: source, sid, source_size, weight, target.

    Sources that reach most times their size are exactly those first in the order of size by weight, so one
    running sum over the sources finds them; the rest share what is left by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("sid", F.row_number().over(by_name))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    src = src.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    src = src.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(rest))
    src = src.withColumn("full", F.col("cap") <= F.col("weight") * F.col("level"))
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0))
    share = left.cast("double") / F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * share)
    return src.select("source", "sid", "source_size", "weight", target.alias("target"))


def _running(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds to rows in order the sum of `expected` over the rows of their source before them, within this partition."""
    from pyspark import TaskContext

    part, last, total = TaskContext.get().partitionId(), None, 0
    for f in frames:
        e, sid = f["expected"].to_numpy(np.int64), f["sid"].to_numpy(np.int64)
        start = np.flatnonzero(np.r_[True, sid[1:] != sid[:-1]]) if len(sid) else np.zeros(0, int)
        before = np.cumsum(e) - e
        before -= np.repeat(before[start], np.diff(np.r_[start, len(sid)]))
        if len(sid):
            if sid[0] == last:
                before[: start[1] if len(start) > 1 else len(sid)] += total
            last, total = sid[-1], int(before[-1] + e[-1])
        yield f.assign(before=before, part=part)


def copies(sizes: DataFrame, work: Work, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """sizes: row, doc_id, source, size, in a written table. The same rows with source_size, target and copies; other work tables are gone."""
    spark = sizes.sparkSession
    src = work.write(targets(sizes, weights, most), "sources")
    expected = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * UNIT).cast("long")).otherwise(F.lit(0))
    rows = sizes.alias("a").join(src.alias("b"), F.expr("a.source <=> b.source")).select("a.*", "sid", "source_size", "target", expected.alias("expected"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ("sid", "size", "doc_id", "row")
    laid = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    laid = work.write(laid.mapInPandas(_running, f"{kinds}, before long, part int"), "laid")
    parts = laid.groupBy("sid", "part").agg(F.sum("expected").alias("total"))
    start = F.sum("total").over(Window.partitionBy("sid").orderBy("part")) - F.col("total")
    laid = laid.join(parts.select("sid", "part", start.alias("start")), ["sid", "part"])
    offset = F.conv(F.substring(F.md5(F.concat(F.coalesce("source", F.lit("")), F.lit(f":{seed}"))), 1, 6), 16, 10).cast("long")
    low = F.col("before") + F.col("start") + offset
    passed = F.shiftright(low + F.col("expected"), 24) - F.shiftright(low, 24)
    return work.last(laid.select("row", "doc_id", "source", "size", "source_size", "target", passed.alias("copies")), "copies")


def _sizes(rows: DataFrame, key: str, source: str, text: str, work: Work) -> DataFrame:
    """rows: doc, row."""
    named = F.col(f"doc.`{key}`").cast("long").alias("doc_id"), F.col(f"doc.`{source}`").cast("string").alias("source")
    return work.write(rows.select("row", *named, word_count(F.col(f"doc.`{text}`")).alias("size")), "sizes")


def plan(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    work = Work(docs.sparkSession, "mix")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in {key: 0, source: 0, text: 0}]).alias("doc"), F.monotonically_increasing_id().alias("row"))
    return copies(_sizes(rows, key, source, text, work), work).drop("row").withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of the mix: each document as often as it was drawn."""
    work, rows = Work(docs.sparkSession, "mix"), identified(docs, "mix")
    drawn = copies(_sizes(rows, key, source, text, work), work).filter("copies > 0").select("row", "copies")
    # Both sides are shuffled at any size; a row's number of copies is at most MOST by its target.
    return rows.join(drawn.hint("merge"), "row").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return plan(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def mix_sql(documents: str = "documents") -> str:
    """The operator in DuckDB SQL: doc_id, source, size, source_size, target, copies."""
    return f"""
    SELECT doc_id, source, size, source_size, target,
           ((before + expected + off) >> 24) - ((before + off) >> 24) AS copies
    FROM (
      SELECT *, (sum(expected) OVER (PARTITION BY sid ORDER BY size, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT - expected AS before,
             ('0x' || substr(md5(coalesce(source, '') || ':{SEED}'), 1, 6))::BIGINT AS off
      FROM (
        SELECT d.doc_id, d.source, d.size, s.sid, s.source_size, s.target,
               CASE WHEN s.source_size > 0 THEN round(s.target / s.source_size * {UNIT})::BIGINT ELSE 0 END AS expected
        FROM (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM {documents}) d
        JOIN (
          SELECT source, sid, source_size,
                 CASE WHEN is_full THEN cap::DOUBLE ELSE weight * (((sum(source_size) OVER () - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0))::BIGINT)::DOUBLE / (sum(CASE WHEN NOT is_full THEN weight END) OVER ())::BIGINT) END AS target
          FROM (
            SELECT *, cap <= weight * (((sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT)::DOUBLE
                    / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT) AS is_full
            FROM (
              SELECT *, source_size * {MOST} AS cap, ([{", ".join(map(str, WEIGHTS))}])[((sid - 1) % {len(WEIGHTS)} + 1)::INT]::BIGINT AS weight
              FROM (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid
                    FROM (SELECT source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM {documents}) GROUP BY source)))) s
        ON d.source IS NOT DISTINCT FROM s.source))"""


SQL = f"SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies, source FROM ({mix_sql()})"
