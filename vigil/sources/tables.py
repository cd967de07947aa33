"""Readers and writers: raw CSV, JSON lines, Parquet tables with schema evolution, append logs and latest views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vigil.sources import excel

# Columns that mark an event log, and name fragments of free-text columns.
EVENT_LOG_MARKERS = ("CI_Cat", "CI_Subcat", "Impact", "Urgency", "Priority", "Closure_Code", "Open_Time")
TEXT_FRAGMENTS = ("description", "solution", "resolution", "details", "notes", "summary")


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; casting with try_ functions comes later, so no value is lost here."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')


def text_columns(df: DataFrame) -> list[str]:
    """String columns whose name has a text fragment and whose values average two words or more."""
    names = [c for c, t in df.dtypes if t == "string" and any(x in c.lower() for x in TEXT_FRAGMENTS)]
    if not names:
        return []
    words = df.agg(*[F.avg(F.regexp_count(F.col(f"`{c}`"), F.lit(r"\S+"))).alias(c) for c in names]).first()
    return [c for c in names if (words[c] or 0) >= 2]


def role_of(df: DataFrame) -> str | None:
    """structured: an event log (five marks or more) without text; text_rich: anything with text; else none."""
    if text_columns(df):
        return "text_rich"
    return "structured" if sum(c in df.columns for c in EVENT_LOG_MARKERS) >= 5 else None


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file or, by its suffix, the first sheet of a workbook; all columns as strings."""
    if path.lower().endswith(".xlsx"):
        spark.dataSource.register(excel.Workbook)
        return spark.read.format("workbook").load(path)
    return read_raw_csv(spark, path)


def detect(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """Role -> path; of several files of a role the last by name. Missing roles are an error."""
    found = {role_of(read_any(spark, p)): p for p in sorted(paths)}
    if missing := {"structured", "text_rich"} - found.keys():
        raise ValueError(f"no file for {sorted(missing)}")
    found.pop(None, None)
    return found


def compare_columns(df: DataFrame, expected: list[str]) -> dict[str, list[str]]:
    have = df.columns
    return {"present": [c for c in expected if c in have], "missing": [c for c in expected if c not in have], "unexpected": [c for c in have if c not in expected]}


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, merge_schema: bool = False) -> DataFrame:
    """A table, pruned to columns. merge_schema reads every file's footer, so ask for it only where appends have changed the schema."""
    df = spark.read.option("mergeSchema", str(merge_schema).lower()).parquet(path)
    return df.select(*columns) if columns else df


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def export_csv(df: DataFrame, path: str) -> int:
    """CSV export in UTF-8 with a byte order mark ahead of the header; the rows read back must be as many as were written, which are counted while they are."""
    seen = Observation()
    marked = df.observe(seen, F.count(F.lit(1)).alias("n")).withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    marked.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', encoding="UTF-8")
    wrote, back = seen.get["n"], df.sparkSession.read.csv(path, header=True, multiLine=True, escape='"').count()
    if wrote != back:
        raise AssertionError(f"{wrote} rows were written, {back} read")
    return wrote


def enforce(df: DataFrame, schema: dict[str, str], sources: tuple[str, ...]) -> DataFrame:
    """The columns of a schema (name to type), in its order and types; an absent column is an error, and so is a provenance outside its classes when rows are read."""
    if missing := [c for c in schema if c not in df.columns]:
        raise ValueError(f"columns are missing: {missing}")
    out = df.select(*[F.col(c).cast(t).alias(c) for c, t in schema.items()])
    for c in schema:
        if c.endswith("_source"):
            out = out.withColumn(c, F.when(F.col(c).isNull() | F.col(c).isin(*sources), F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"{c}: no provenance class: "), F.col(c)))))
    return out


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """The current view of an append-only log: the last row per key, found by partial aggregation."""
    whole = F.struct(order, *[c for c in log.columns if c != order])
    return log.groupBy(F.col(key).alias("__k")).agg(F.max(whole).alias("r")).select(*[F.col(f"r.`{c}`").alias(c) for c in log.columns])


def top_up(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Rows whose keys aren't there yet."""
    return wanted.join(have.select(key), key, "left_anti")


def metadata_predicate(values: dict[str, list] | None = None, exclude: dict[str, list] | None = None, time: str | None = None, since=None, until=None, floor: tuple[str, float] | None = None) -> Column:
    """IN lists, NOT IN lists, a time range and a least value, as one predicate; empty parts don't restrict."""
    out = F.lit(True)
    for c, v in (values or {}).items():
        out = out & F.col(c).isin(v) if v else out
    for c, v in (exclude or {}).items():
        out = out & ~F.col(c).isin(v) if v else out
    if time and since is not None:
        out = out & (F.col(time) >= F.lit(since))
    if time and until is not None:
        out = out & (F.col(time) <= F.lit(until))
    return out & (F.col(floor[0]) >= floor[1]) if floor and floor[1] else out
