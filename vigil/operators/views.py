"""Projections of records for other stores and for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields that a record's metadata and provenance views show.
METADATA = ("incident_id", "ci_name", "ci_group", "category", "impact", "urgency", "priority", "closure_code", "closure_class", "open_time", "resolved_time", "resolution_hours", "reopened", "reassignments")
PROVENANCE = ("title", "description", "resolution_notes", "category", "impact", "urgency", "priority", "closure_code", "open_time", "resolved_time", "reopened", "reassignments")


def vector_metadata(df: DataFrame, key: str, texts: dict[str, str], times: dict[str, str]) -> DataFrame:
    """What a vector store keeps beside a vector: texts without nulls and times in epoch seconds, 0 if there is none."""
    return df.select(key, *[F.coalesce(F.col(c), F.lit(d)).alias(c) for c, d in texts.items()], *[F.coalesce(F.unix_timestamp(F.col(c).cast("timestamp")), F.lit(0)).alias(n) for c, n in times.items()])


def no_nan(c: Column, kind: str) -> Column:
    """NaN as null; other types as they are."""
    return F.when(~F.isnan(c), c) if kind in ("double", "float") else c


def storable(df: DataFrame, sourced: list[str], truth: list[str]) -> DataFrame:
    """df with NaN as null, a map of its fields' provenance (missing ones left out) and a map of its known ground truth (empty ones left out)."""
    clean = df.select(*[no_nan(F.col(f"`{c}`"), t).alias(c) for c, t in df.dtypes])
    of = lambda names, value: F.map_from_entries(F.array_compact(F.array(*[F.when(value(n).isNotNull(), F.struct(F.lit(n), value(n))) for n in names])))
    provenance = of(sourced, lambda n: F.nullif(F.col(f"{n}_source"), F.lit("missing")))
    return clean.withColumns({"provenance": provenance, "truth": of(truth, lambda n: F.nullif(F.col(n).cast("string"), F.lit("")))})


def metadata_view(df: DataFrame) -> DataFrame:
    """incident_id and metadata, a struct of the fields of METADATA that df has."""
    return df.select("incident_id", F.struct(*[F.col(c) for c in METADATA if c in df.columns]).alias("metadata"))


def provenance_view(df: DataFrame) -> DataFrame:
    """incident_id and provenance, a struct of the sources of the fields of PROVENANCE that df has."""
    return df.select("incident_id", F.struct(*[F.col(f"{c}_source").alias(c) for c in PROVENANCE if f"{c}_source" in df.columns]).alias("provenance"))
