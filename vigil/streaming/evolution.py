"""Knowledge evolution: an append log of resolved cases is taken in as a batch; a bad record goes to a table of failures and stops nothing."""

from __future__ import annotations

import json
import traceback
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Evolution:
    """What has been added and what has failed, below one path, in partitions of batches.

    checks: reason -> condition that a good record meets (null counts as not met); the first one that isn't met is the reason of a failure. process: a DataFrame function
    that keeps all rows and columns and adds what is stored with a record. each: a function of one record (a dict) whose result is stored as JSON; what it
    raises is the reason of a failure of that record only. It has to give the same result when it is called again.

    A record whose key was added before is passed over; of several in a batch the one with the largest `order` counts. Failures are tried again with every
    later batch until they are added, or a newer record of their key comes. A batch depends only on the log and on batches before it and replaces its own
    partitions, so a run that broke off anywhere is repeated with the same result: each record is added once.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, order: str, checks: dict[str, Column], process: Callable[[DataFrame], DataFrame] | None = None, each: Callable[[dict], dict] | None = None):
        self.spark, self.path, self.schema, self.key, self.order = spark, path, schema, key, order
        self.checks, self.process, self.each = {f"no {key}": F.col(key).isNotNull()} | checks, process, each

    def run(self, log: str, files_per_batch: int | None = None) -> int:
        """Take in what the log (a folder of Parquet files) has that was not read yet; the number of batches."""
        stream = self.spark.readStream.schema(self.schema)
        if files_per_batch:
            stream = stream.option("maxFilesPerTrigger", files_per_batch)
        made: list[int] = []

        def sink(batch: DataFrame, number: int) -> None:
            self.take(batch, number)
            made.append(number)

        stream.parquet(log).writeStream.foreachBatch(sink).option("checkpointLocation", f"{self.path}/progress").trigger(availableNow=True).start().awaitTermination()
        return len(made)

    def take(self, batch: DataFrame, number: int) -> None:
        """One batch; it may be repeated."""
        names = self.schema.names
        again = self.failures(before=number).select(*names, "attempts")
        rows = batch.select(*names, F.lit(0).cast("long").alias("attempts")).unionByName(again)
        keyed = rows.filter(F.col(self.key).isNotNull()).groupBy(F.col(self.key).alias("__key")).agg(F.max_by(F.struct(*rows.columns), F.struct(self.order, "attempts")).alias("r")).select("r.*")
        nameless = batch.filter(F.col(self.key).isNull()).select(*names, F.lit(0).cast("long").alias("attempts"))
        fresh = keyed.join(self._part("added", number).select(self.key), self.key, "left_anti").select(*rows.columns)
        reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(why)) for why, ok in self.checks.items()])
        judged = fresh.unionByName(nameless).withColumn("reason", reason)
        if self.each:
            judged = self._apply(judged)
        judged = judged.persist()
        try:
            good = judged.filter("reason IS NULL").drop("reason", "attempts")
            (self.process(good) if self.process else good).write.mode("overwrite").parquet(f"{self.path}/added/batch={number}")
            bad = judged.filter("reason IS NOT NULL").withColumn("attempts", F.col("attempts") + 1)
            bad.write.mode("overwrite").parquet(f"{self.path}/failed/batch={number}")
            self.spark.range(1).write.mode("overwrite").parquet(f"{self.path}/taken/batch={number}")  # that the batch is complete, though nothing may have failed in it
        finally:
            judged.unpersist()

    def _apply(self, judged: DataFrame) -> DataFrame:
        each = self.each

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in batches:
                results, reasons = [], []
                for record, why in zip(f["__record"], f["reason"], strict=True):
                    result = None
                    if why is None:
                        try:
                            result = json.dumps(each(json.loads(record)))
                        except Exception as e:  # noqa: BLE001  one bad record must not stop the others
                            why = traceback.format_exception_only(e)[-1].strip()
                    results.append(result)
                    reasons.append(why)
                yield f.drop(columns="__record").assign(reason=reasons, result=results)

        rows = judged.withColumn("__record", F.to_json(F.struct(*self.schema.names)))
        schema = StructType([*judged.schema.fields]).add("result", "string")
        return rows.mapInPandas(run, schema)

    def _part(self, what: str, before: int | None) -> DataFrame:
        """The rows of earlier batches; none if there is no such table yet."""
        schema = StructType([*self.schema.fields])
        if what == "failed":
            schema = schema.add("attempts", "long").add("reason", "string")
        schema = schema.add("batch", "long")
        if not self._there(f"{self.path}/{what}"):
            return self.spark.createDataFrame([], schema)
        if what == "added" and before is None:  # with what process and each have added
            return self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/added")
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{what}")
        return rows if before is None else rows.filter(F.col("batch") < before)

    def _there(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def added(self) -> DataFrame:
        """Records that were added, with what was stored with them and the batch."""
        return self._part("added", None)

    def failures(self, before: int | None = None) -> DataFrame:
        """Records that failed when they were tried last (in a batch before this one), with the reason and the number of attempts. Every batch tries all
        failures with a key again, so those are in the last batch alone; those without a key are tried once."""
        rows = self._part("failed", before)
        if before is not None:  # batches are numbered without gaps
            return rows.filter((F.col("batch") == before - 1) & F.col(self.key).isNotNull())
        if not self._there(f"{self.path}/taken"):
            return rows
        last = self.spark.read.schema("batch long").parquet(f"{self.path}/taken").agg(F.max("batch").alias("__last"))  # one row
        return rows.join(F.broadcast(last)).filter((F.col("batch") == F.col("__last")) | F.col(self.key).isNull()).drop("__last")
