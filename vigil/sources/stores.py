"""Stores: vector tables, knowledge bases with additions, artefact tables, batch commits, model bundles, an answer cache and encoders."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def commit_batch(df: DataFrame, path: str, batch: str) -> DataFrame:
    """Write one batch as its own partition, replacing what a failed run of it left; the partition appears when the write is committed. Returns the batch as read back.

    One table is atomic per batch; Spark has no transaction over several tables, so readers join them by batch.
    """
    target = f"{path}/batch={batch}"
    df.write.mode("overwrite").parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def replace_all(path: str, **tables: DataFrame) -> dict[str, int]:
    """Replace tables as a whole and say how many rows each has. Tables may be nested: documents of patterns, chains or strategies keep their structure."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    return {name: df.sparkSession.read.parquet(f"{path}/{name}").count() for name, df in tables.items()}


def write_artefacts(path: str, incidents: DataFrame, fingerprints: DataFrame, families: DataFrame, chains: DataFrame, edges: DataFrame) -> dict[str, int]:
    """Replace the tables built offline: fingerprints; members of families; links of chains, one row each; edges; and incidents with their family filled in by a join."""
    members = families.select("family", F.explode("members").alias("incident_id"))
    links = chains.select("incident_id", F.posexplode("links").alias("position", "link")).select("incident_id", "position", "link.*")
    filled = incidents.drop("family").join(members, "incident_id", "left")
    return replace_all(path, fingerprints=fingerprints, family_members=members, chain_links=links, edges=edges, incidents=filled)


class VectorTable:
    """Vectors by id in an append-only log whose last entry per id counts, with the name of the encoder that made them. Order in the files means nothing."""

    def __init__(self, spark: SparkSession, path: str, encoder: str):
        self.spark, self.path, self.encoder = spark, path, encoder

    def upsert(self, vectors: DataFrame, batch: int) -> None:
        """vectors: id, v, metadata columns. Batches are numbered; a repeated batch replaces itself."""
        vectors.withColumn("encoder", F.lit(self.encoder)).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def read(self) -> DataFrame:
        log = self.spark.read.option("mergeSchema", "true").parquet(self.path)
        rest = [c for c in log.columns if c not in ("id", "batch")]
        return log.groupBy("id").agg(F.max_by(F.struct(*rest), "batch").alias("r")).select("id", "r.*")

    def by_ids(self, ids: DataFrame) -> DataFrame:
        return self.read().join(ids.select("id"), "id", "left_semi")

    def top_up(self, wanted: DataFrame) -> DataFrame:
        """What has no vector yet: only this needs to be encoded."""
        return wanted.join(self.read().select("id"), "id", "left_anti")

    def health(self) -> dict:
        """Whether the table can be read, how many vectors it has and which encoders made them."""
        try:
            g = self.read().groupBy("encoder").count().collect()  # one row per encoder
        except Exception as e:  # noqa: BLE001  any store error is what is asked for
            return {"ok": False, "reason": str(e).splitlines()[0][:200]}
        return {"ok": True, "count": sum(r["count"] for r in g), "encoders": sorted(r["encoder"] for r in g)}


class KnowledgeBase:
    """Records and chunks as DataFrames. Additions are unions; lookups are joins, so nothing is held in the driver."""

    def __init__(self, records: DataFrame, chunks: DataFrame):
        self.records, self.chunks = records, chunks

    def get(self, incident_id: str) -> DataFrame:
        return self.records.filter(F.col("incident_id") == incident_id)

    def duplicates_of(self, incident_id: str) -> DataFrame:
        own = self.get(incident_id).select("dup_group")
        return self.records.join(F.broadcast(own), "dup_group", "left_semi").filter(F.col("incident_id") != incident_id)  # own is one record

    def add(self, records: DataFrame, chunks: DataFrame) -> KnowledgeBase:
        """With further records and their chunks; those that are there already stay as they are."""
        fresh = records.join(self.records.select("incident_id"), "incident_id", "left_anti")
        parts = chunks.join(fresh.select("incident_id"), "incident_id", "left_semi")
        return KnowledgeBase(self.records.unionByName(fresh, allowMissingColumns=True), self.chunks.unionByName(parts, allowMissingColumns=True))

    def accepted(self, incidents: DataFrame, quality: DataFrame, chunks: DataFrame) -> KnowledgeBase:
        """With the incidents whose quality says that they were indexed, merged at start-up."""
        ok = incidents.join(quality.filter(F.col("status") == "indexed").drop("status"), "incident_id")
        return self.add(ok, chunks)


def cache_key(*parts: Column) -> Column:
    """SHA-256 of what a question depends on, as JSON."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])), 256)


class AnswerCache:
    """An append-only table of answers by key; the first answer to a key counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, answers: DataFrame, batch: int) -> None:
        answers.select("key", "answer").write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def look_up(self, questions: DataFrame) -> DataFrame:
        """questions (key, ...) with answer, null if there is none."""
        first = self.spark.read.parquet(self.path).groupBy("key").agg(F.min_by("answer", "batch").alias("answer"))
        return questions.join(first, "key", "left")


Encoder = Callable[[list[str]], np.ndarray]


def embed(df: DataFrame, text: str, encoders: list[tuple[str, Callable[[], Encoder]]], batch: int = 64, out: str = "v") -> tuple[DataFrame, str, str | None]:
    """df with unit vectors of its texts by the first encoder that loads; its name; and why earlier ones were passed over.

    encoders: (name, loader). A loader is tried once here and then runs once per task; texts are encoded in batches and vectors brought to unit length again.
    """
    why = []
    for name, load in encoders:
        try:
            load()
        except Exception as e:  # noqa: BLE001  a provider that isn't there is passed over, and said so
            why.append(f"{name}: {str(e)[:120]}")
            continue

        def run(frames: Iterator[pd.DataFrame], load=load) -> Iterator[pd.DataFrame]:
            encode = load()
            for f in frames:
                texts = [t if isinstance(t, str) else "" for t in f[text]]
                parts = [np.asarray(encode(texts[i : i + batch]), np.float64) for i in range(0, len(texts), batch)]
                x = np.concatenate(parts) if parts else np.zeros((0, 1))
                yield f.assign(**{out: list((x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32))})

        kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
        return df.mapInPandas(run, f"{kinds}, {out} array<float>"), name, "; ".join(why) or None
    raise ValueError("no encoder loads: " + "; ".join(why))


def hashing_encoder(size: int = 256) -> Callable[[], Encoder]:
    """An encoder without a model: counts of words by hash. It tells texts apart by their words only."""

    def load() -> Encoder:
        import zlib

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), size))
            for i, t in enumerate(texts):
                for w in t.lower().split():
                    out[i, zlib.crc32(w.encode()) % size] += 1
            return out

        return encode

    return load


def save_bundle(models: dict, metrics: dict, path: str, spark: SparkSession) -> None:
    """Save fitted pipeline models by name, and their measures as one JSON row."""
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(metrics, sort_keys=True), sorted(models))], "metrics string, models array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/bundle")


def load_bundle(path: str, spark: SparkSession) -> tuple[dict, dict]:
    from pyspark.ml import PipelineModel

    row = spark.read.schema("metrics string, models array<string>").json(f"{path}/bundle").first()
    return {name: PipelineModel.load(f"{path}/{name}") for name in row["models"]}, json.loads(row["metrics"])


def grounding(answer: DataFrame, sources: DataFrame, least: float = 0.45) -> DataFrame:
    """answer: sentence_no, sentence, v; sources: source_id, v (the few that the answer cites). Per sentence its best source and whether it is grounded: similar enough, with no citation of anything else."""
    from vigil.functions.math import dot
    from vigil.functions.text import citations

    known = sources.agg(F.collect_set("source_id").alias("known"))  # the sources of one answer
    pairs = answer.select("sentence_no", F.col("v").alias("a")).join(F.broadcast(sources.select("source_id", F.col("v").alias("b"))))
    best = pairs.groupBy("sentence_no").agg(F.max(F.struct(dot(F.col("a"), F.col("b")).alias("s"), "source_id")).alias("m"))
    out = answer.join(best, "sentence_no", "left").join(F.broadcast(known))
    wrong = F.array_except(citations(F.col("sentence")), "known")
    return out.select("sentence_no", F.col("m.source_id").alias("source_id"), F.col("m.s").alias("similarity"), wrong.alias("unknown_citations"), ((F.col("m.s") >= least) & (F.size(wrong) == 0)).alias("grounded"))


class StageTimer:
    """Milliseconds by stage; a stage that runs again adds up."""

    def __init__(self):
        self.ms: dict[str, float] = {}

    def stage(self, name: str):
        from contextlib import contextmanager
        from time import perf_counter

        @contextmanager
        def timed():
            began = perf_counter()
            try:
                yield
            finally:
                self.ms[name] = self.ms.get(name, 0.0) + (perf_counter() - began) * 1000

        return timed()
