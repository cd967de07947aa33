"""Operator 11, benchmark decontamination: words of documents that stand in a window of a benchmark item.

Method: a generalised suffix automaton over the items' normalised words (suffix_automaton.Automaton). Each document's
words stream through it, which keeps the longest match that ends at every word. A match of at least `window` words, or
of a whole shorter item, is a hit; hit spans are cut out of the text, and a document whose hit share exceeds
`coverage` is marked for removal.

Scale: documents are read once and not shuffled. Items are cut into pieces that overlap by window - 1 words and dealt
to automata of about SHARD_WORDS words, which Spark builds, one task each. A set of tests fits into one. A larger set has
several; each is broadcast on its own (so what is broadcast never grows with the input), and only spans of hit
documents are shuffled to be united.

Defined cases: a null text has no words and stays null; items without words or with null text match nothing; a null item
id is written as an empty string; a match longer than a piece
counts with the longest part that is in one piece for longest_match (spans are whole); repeated documents are judged alike, repeated items count once; very long texts and
items are read whole; empty tables give empty or clean results; columns of the input stay, and one that has the name
of an output column is replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.shared import identified, written
from vigil.llm.suffix_automaton import NORMAL, WORD, Automaton, words_of

WINDOW = 10
#: Words of items in one automaton, on average; its dictionaries take about 300 bytes a word.
SHARD_WORDS = 100_000
_SPANS = T.ArrayType(T.StructType().add("first", "integer").add("last", "integer"))
_KINDS = T.StructType().add("n_words", "long").add("n_hit", "long").add("longest_match", "integer").add("spans", _SPANS).add("items", T.ArrayType(T.StringType())).add("clean_text", "string")
OUT = _KINDS.names


def _pieces(items: DataFrame, key: str, text: str, window: int, most: int) -> DataFrame:
    """item, n, whole, body: stretches of at most `most` words that overlap by window - 1, so that no window is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, x in zip(b.column("item").to_pylist(), b.column("text").to_pylist()):
                words = words_of(x)
                for at in range(0, max(1, len(words) - window + 1), most - window + 1):
                    part = words[at : at + most]
                    if part:
                        rows.append((item, len(part), len(part) == len(words), b" ".join(part)))
            names = ["item", "n", "whole", "body"]
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else ((),) * 4, (pa.string(), pa.int64(), pa.bool_(), pa.binary()))], names=names)

    item = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    rows = items.select(item.alias("item"), F.col(f"`{text}`").cast("string").cast("binary").alias("text")).distinct()
    return rows.mapInArrow(run, "item string, n long, whole boolean, body binary")


def automata(items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """shard, data: one pickled automaton a row, written to the shared folder."""
    pieces = written(_pieces(items, key, text, window, max(2 * window, shard_words // 4)), "pieces")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    n = max(1, -(-total // shard_words))

    def build(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("item").to_pylist(), table.column("body").to_pylist(), table.column("whole").to_pylist()))
        data = pickle.dumps(Automaton([(item, body.split(b" "), whole) for item, body, whole in rows], window))
        return pa.table({"shard": table.column("shard")[:1], "data": pa.array([data], pa.binary())})

    shard = F.pmod(F.xxhash64("item", "body"), F.lit(n)).cast("int")
    return written(pieces.withColumn("shard", shard).groupBy("shard").applyInArrow(build, "shard int, data binary"), "automata")


def _cut(text: str | None, spans: list[list[int]]) -> tuple[int, int, str | None]:
    """Words, hit words, and the text without the bytes from the first to the last word of each span."""
    if text is None:
        return 0, 0, None
    raw = text.encode("utf-8")
    normal = raw.translate(NORMAL)
    if not spans:
        return len(normal.split()), 0, text
    places = [m.span() for m in WORD.finditer(normal)]
    out, at = [], 0
    for first, last in spans:
        out.append(raw[at : places[first][0]])
        at = places[last][1]
    return len(places), sum(b - a + 1 for a, b in spans), b"".join([*out, raw[at:]]).decode("utf-8")


def _arrays(rows: list[tuple], names: list[str]) -> list[pa.Array]:
    pair = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    kinds = {"n_words": pa.int64(), "n_hit": pa.int64(), "longest_match": pa.int32(), "spans": pair, "items": pa.list_(pa.string()), "clean_text": pa.string()}
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return [pa.array([[{"first": a, "last": b} for a, b in s] for s in c] if n == "spans" else list(c), kinds[n]) for n, c in zip(names, columns)]


def _schema(rows: DataFrame) -> T.StructType:
    return T.StructType([rows.schema["doc"], *_KINDS.fields])


def _united(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _one(rows: DataFrame, automaton) -> DataFrame:
    """All rows with OUT, by one automaton."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = automaton.value.match if automaton else None
        for b in batches:
            found = []
            for text in b.column("text").to_pylist():
                spans, items, longest = match(words_of(text.encode("utf-8"))) if match and text else ([], (), 0)
                n, hit, clean = _cut(text, spans)
                found.append((n, hit, longest, spans, sorted(items), clean))
            yield pa.RecordBatch.from_arrays([b.column("doc"), *_arrays(found, OUT)], names=["doc", *OUT])

    return rows.mapInArrow(run, _schema(rows))


def _hits(rows: DataFrame, automaton) -> DataFrame:
    """row, longest_match, spans, items of the documents that one of several automata hits or matches in part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match, names = automaton.value.match, ["longest_match", "spans", "items"]
        for b in batches:
            found = [match(words_of(t)) for t in b.column("text").to_pylist()]
            at = [i for i, x in enumerate(found) if x[2]]
            yield pa.RecordBatch.from_arrays([b.column("row").take(pa.array(at, pa.int64())), *_arrays([(found[i][2], found[i][0], sorted(found[i][1])) for i in at], names)], names=["row", *names])

    text = F.col("text").cast("binary").alias("text")
    return rows.select("row", text).mapInArrow(run, T.StructType([rows.schema["row"], *_KINDS.fields[2:5]]))


def _finish(rows: DataFrame) -> DataFrame:
    """OUT for rows that carry united matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for text, spans, items, longest in zip(*(b.column(c).to_pylist() for c in ("text", "spans", "items", "longest_match"))):
                spans = _united([(x["first"], x["last"]) for x in spans or []])
                n, hit, clean = _cut(text, spans)
                found.append((n, hit, longest or 0, spans, sorted(items or []), clean))
            yield pa.RecordBatch.from_arrays([b.column("doc"), *_arrays(found, OUT)], names=["doc", *OUT])

    return rows.mapInArrow(run, _schema(rows))


def decontaminate(
    docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, coverage: float = 0.5, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """docs with n_words, n_hit, longest_match, spans (word places), items, clean_text, contaminated, and reject (hit share over coverage)."""
    spark = docs.sparkSession
    built = automata(items, item_key, item_text, window, shard_words)
    shards = sorted(r.shard for r in built.select("shard").collect())
    # One automaton at a time passes the driver; its size is bound by SHARD_WORDS.
    load = lambda k: spark.sparkContext.broadcast(pickle.loads(built.filter(F.col("shard") == k).first().data))
    whole = F.col(f"`{text}`").cast("string").alias("text")
    if len(shards) < 2:
        doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
        out = _one(docs.select(doc, whole), load(shards[0]) if shards else None)
    else:
        told = identified(docs, "documents")
        rows = told.select("doc", "row", F.col(f"doc.`{text}`").cast("string").alias("text"))
        parts = [_hits(rows, load(k)) for k in shards]
        hits = parts[0]
        for p in parts[1:]:
            hits = hits.union(p)
        hits = hits.groupBy("row").agg(F.max("longest_match").alias("longest_match"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        out = _finish(rows.join(hits, "row", "left").select("doc", "text", "longest_match", "spans", "items"))
    given = [F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in {*OUT, "contaminated", "reject"}]
    return out.select(*given, *OUT, (F.col("n_hit") > 0).alias("contaminated"), (F.col("n_hit") > coverage * F.col("n_words")).alias("reject"))


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    joined = F.array_join("items", ",")  # sorted as strings
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT item_id, unnest([w[i : i + 9] FOR i IN range(1, greatest(len(w) - 8, 2))]) AS g FROM b WHERE len(w) > 0),
lens AS (SELECT DISTINCT len(g) AS k FROM iw),
dw AS (SELECT r, k, unnest(range(1, len(w) - k + 2)) AS p, unnest([w[i : i + k - 1] FOR i IN range(1, len(w) - k + 2)]) AS g FROM d, lens WHERE len(w) >= k),
hit AS (SELECT r, p, k, item_id FROM dw JOIN iw USING (g)),
places AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT r, p, k FROM hit)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN named USING (r)
"""
