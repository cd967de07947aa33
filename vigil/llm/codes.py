"""Operator 13, vector code compression: product codes of integer vectors, by exact rounds over a ball tree a part.

Method: components become floor(scale * x); vectors are cut into equal parts, each with a codebook of its own. A part's
nearest entry is found by branch and bound in a ball tree over the entries (ball_tree.BallTree): radii and bounds are
rounded to the safe side, balls that could hold an equal entry are visited, and distances are verified in integers. Each
round gives every entry the floor of its parts' mean; the last assignment gives the codes.

Scale: the integer vectors are written once. A round reads them, and each task puts out sums and counts of its own parts
by entry (parts * entries * width numbers, whatever it reads), which Spark adds up; the codebooks, of that same
fixed size, are all that passes the driver or is sent to tasks. No vector is shuffled but for the sums of equal labels,
which are added up before they are shuffled.

Defined cases: a null vector, one with a null component or one that isn't finite is dropped. The length is that of the
kept vector with the smallest id (ties: the smaller vector; null ids last); a vector of another length, or any if the parts don't
divide it, keeps a null code and error. With fewer kept vectors than entries, codebooks are smaller; with none, no row. Repeated
ids and vectors are coded alike. Components of any size are exact; an error or label sum that no long holds is
null. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.ball_tree import BallTree, integers
from vigil.llm.shared import Work

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4_096
#: Sums travel as digits of this many bits, so that no sum of longs can overflow.
LIMB = 40
_TOP = (1 << 63) - 1


def digits(x: int) -> list[int]:
    """x as signed digits of LIMB bits, lowest first."""
    sign, x, out = (-1, -x, []) if x < 0 else (1, x, [])
    while x:
        out.append(sign * (x & ((1 << LIMB) - 1)))
        x >>= LIMB
    return out


def scaled(vectors: list[list[float]], scale: int) -> np.ndarray:
    """floor(scale * x) for vectors of one length, exact for every finite x (scale is a power of two)."""
    with np.errstate(over="ignore"):
        x = np.array(vectors, np.float64) * scale
    if np.abs(x).max(initial=0) < 1 << 52:
        return np.floor(x).astype(np.int64)
    return np.array([[math.floor(v * scale) if abs(v) < 1e300 else math.floor(v) * scale for v in row] for row in vectors], object).reshape(len(vectors), -1)


def _parts(batch: list[list[float]], scale: int, parts: int) -> list[np.ndarray]:
    rows = scaled(batch, scale)
    return [integers(p) for p in np.split(rows.astype(object) if np.abs(rows).max(initial=0) > 1 << 25 else rows, parts, axis=1)]


def kept(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """id, label, v: the rows whose vector is there, without null, and finite throughout."""
    v = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce((F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x), F.lit(False)))
    return df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").alias("label"), v.alias("v")).filter(F.col("v").isNotNull() & finite)


def _update(rows: DataFrame, books: list[np.ndarray], scale: int) -> list[np.ndarray]:
    """The codebooks after one round."""
    parts, width, n_entries = len(books), books[0].shape[1], len(books[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [BallTree(b) for b in books]
        sums: dict[tuple, int] = defaultdict(int)
        for b in batches:
            vectors = b.column("v").to_pylist()
            if not vectors:
                continue
            for p, (tree, x) in enumerate(zip(trees, _parts(vectors, scale, parts))):
                best, _ = tree.nearest(x)
                for e in range(n_entries):
                    mine = x[best == e]
                    if len(mine):
                        sums[p, e, -1] += len(mine)
                        for j, s in enumerate(mine.sum(0).tolist()):
                            sums[p, e, j] += s
        rows = [(*k, i, d) for k, s in sums.items() for i, d in enumerate(digits(s))]
        columns = list(zip(*rows)) if rows else [()] * 5
        yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["part", "entry", "at", "digit", "s"])

    sums = rows.select("v").mapInArrow(run, "part int, entry int, at int, digit int, s long").groupBy("part", "entry", "at", "digit").agg(F.sum("s").alias("s"))
    total: dict[tuple, int] = defaultdict(int)
    for r in sums.collect():  # parts * entries * (width + 1) numbers of a few digits, for any number of rows
        total[r.part, r.entry, r["at"]] += r.s << (LIMB * r.digit)
    out = []
    for p, book in enumerate(books):
        new = book.astype(object)
        for e in range(len(book)):
            if n := total.get((p, e, -1)):
                new[e] = [total.get((p, e, j), 0) // n for j in range(width)]
        out.append(integers(new))
    return out


def encode(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """id, label, code (two hex digits a part), error for every kept vector, and the codebooks."""
    work = Work(df.sparkSession, "codes")
    rows = work.write(kept(df, key, vector, label), "vectors")
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(1).collect()
    if not first:
        return rows.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), []
    length = len(first[0].v)
    fits = F.size("v") == (length if length and length % parts == 0 else -1)
    starts = rows.filter(fits).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    books = [integers(p.astype(object)) for p in np.split(scaled([r.v for r in starts], scale), parts, axis=1)] if starts else []
    for _ in range(rounds if books else 0):
        books = _update(rows.filter(fits), books, scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [BallTree(b) for b in books]
        for b in batches:
            vectors = b.column("v").to_pylist()
            codes, errors = [], [0] * len(vectors)
            if vectors:
                for tree, x in zip(trees, _parts(vectors, scale, parts)):
                    best, error = tree.nearest(x)
                    codes.append([f"{i:02x}" for i in best.tolist()])
                    errors = [a + e for a, e in zip(errors, error.tolist())]
            errors = [e if e <= _TOP else None for e in errors]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(["".join(c) for c in zip(*codes)], pa.string()), pa.array(errors, pa.int64())], names=["id", "label", "code", "error"])

    kinds = rows.select("id", "label").schema.add("code", "string").add("error", "long")
    coded = rows.filter(fits).mapInArrow(run, kinds)
    other = rows.filter(~fits).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return coded.union(other) if books else other, books


def codebooks_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for entry in b.tolist() for x in entry).encode()).hexdigest()


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    work = Work(spark, "coded")
    coded = work.write(coded, "coded")
    sums = coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def _sql() -> str:
    near = """SELECT p.vec_id, p.part, p.x, e.entry, list_sum([(a[1] - a[2]) * (a[1] - a[2]) FOR a IN list_zip(p.x, e.x)]) AS d FROM parts p JOIN {book} e USING (part)"""
    one = "SELECT * FROM ({near}) QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1".format(near=near)
    out = f"""
WITH kept AS (
  SELECT vec_id, label, [CAST(floor(CAST({SCALE} AS DOUBLE) * x) AS HUGEINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS MATERIALIZED (SELECT vec_id, part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] AS x FROM kept, range({PARTS}) r(part)),
book0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES}))"""
    for i in range(ROUNDS):
        out += f""",
near{i} AS MATERIALIZED ({one.format(book=f"book{i}")}),
mean{i} AS (SELECT part, entry, list(m ORDER BY j) AS x FROM (
  SELECT part, entry, j, (s - ((s % n) + n) % n) // n AS m FROM (
    SELECT part, entry, j, sum(x[j]) AS s, count(*) AS n FROM near{i}, generate_series(1, len(x)) g(j) GROUP BY ALL)) GROUP BY ALL),
book{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.x, b.x) AS x FROM book{i} b LEFT JOIN mean{i} m USING (part, entry))"""
    return out + f""",
last AS MATERIALIZED ({one.format(book=f"book{ROUNDS}")}),
codes AS (SELECT vec_id, string_agg(lpad(lower(hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN codes USING (vec_id), digest
"""


SQL = _sql()
