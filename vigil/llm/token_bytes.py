"""Byte-level BPE decoding by a join with the token-byte table (see byte_bpe). Its tasks need no pandas, which keeps them small."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.bpe import load_ranks
from vigil.llm.hashing import ragged

#: Identifiers of a group of texts, and bytes up to which the token-byte table is broadcast.
CHUNK, TABLE_BYTES = 200_000, 64_000_000


def token_table(spark: SparkSession, vocabulary: str) -> DataFrame:
    """The token-byte table: id, token."""
    ranks = load_ranks(vocabulary)
    return spark.createDataFrame(pa.table({"id": pa.array(ranks.values(), pa.int32()), "token": pa.array(ranks.keys(), pa.binary())}))


def groups(docs: pa.StructArray, ids: str, row: int) -> Iterator[pa.RecordBatch]:
    """Texts in groups of about CHUNK identifiers, numbered by row and counted by at: first the texts (doc), then the distinct identifiers of them (id)."""
    values = docs.field(ids)
    sizes = np.fromiter((len(v.as_py() or b"") // 4 for v in values), np.int64, len(values))
    begin = 0
    while begin < len(values):
        end = max(begin + 1, int(np.searchsorted(np.cumsum(sizes[begin:]), CHUNK, "right")) + begin)
        found = np.unique(np.concatenate([np.frombuffer(values[i].as_py() or b"", "<i4") for i in range(begin, end)]))
        n, m = end - begin, len(found)
        place = pa.array(np.r_[np.arange(begin, end), np.zeros(m, np.int64)], pa.int64(), mask=np.arange(n + m) >= n)
        column = pa.array(np.r_[np.zeros(n, np.int32), found.astype(np.int32)], pa.int32(), mask=np.arange(n + m) < n)
        yield pa.record_batch([docs.take(place), pa.array(np.full(n + m, row)), pa.array(np.arange(n + m)), column], names=["doc", "row", "at", "id"])
        row, begin = row + 1, end


def empty_groups(doc: pa.DataType) -> pa.Table:
    return pa.schema([("doc", doc), ("row", pa.int64()), ("at", pa.int64()), ("id", pa.int32())]).empty_table()


def _explode(ids: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for group in groups(batch.column("doc"), ids, row):
                yield group
                row += 1

    return run


def _assemble(ids: str):
    def whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        group = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        if not (group.column("at").to_numpy() == np.arange(group.num_rows)).all():
            raise RuntimeError("a group of texts is out of order")
        n = group.column("id").null_count
        docs, found = group.column("doc").slice(0, n), group.column("id").slice(n).to_numpy()
        tokens = [t.as_py() or b"" for t in group.column("token").slice(n)]
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        data, starts = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths
        order = np.argsort(found)
        out = []
        for v in docs.field(ids):
            numbers, parts_ = np.frombuffer(v.as_py() or b"", "<i4"), []
            for x in range(0, len(numbers), CHUNK):
                at = order[np.searchsorted(found[order], numbers[x : x + CHUNK])]
                parts_.append(ragged(data, starts[at], lengths[at]).tobytes())
            out.append(b"".join(parts_))
        return pa.record_batch([docs, pa.array(out, pa.binary())], names=["doc", "decoded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A group's rows come one after the other; a batch can hold the end of one and the beginning of another."""
        row, held = None, []
        for batch in batches:
            rows = batch.column("row").to_numpy()
            cuts = [0, *(np.flatnonzero(rows[1:] != rows[:-1]) + 1).tolist(), len(rows)] if len(rows) else [0]
            for x, y in zip(cuts, cuts[1:]):
                if row is not None and rows[x] != row:
                    yield whole(held)
                    held = []
                row = rows[x]
                held.append(batch.slice(x, y - x))
        if held:
            yield whole(held)

    return run


def joined(each: DataFrame, ids: str, vocabulary: str) -> DataFrame:
    """doc and decoded, from groups of texts joined with the token-byte table."""
    table = token_table(each.sparkSession, vocabulary)
    if sum(map(len, load_ranks(vocabulary))) <= TABLE_BYTES:
        rows = each.join(F.broadcast(table), "id", "left")
    else:
        rows = each.join(table.hint("merge"), "id", "left").repartition("row").sortWithinPartitions("row", "at")
    kind = each.schema["doc"].dataType.simpleString()
    return rows.select("doc", "row", "at", "id", "token").mapInArrow(_assemble(ids), f"doc {kind}, decoded binary")


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes that the identifiers stand for."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"))
    each = rows.mapInArrow(_explode(ids), f"doc {rows.schema['doc'].dataType.simpleString()}, row long, at long, id int")
    return joined(each, ids, vocabulary).select(*[F.col(f"doc.`{c}`").alias(c) for c in df.columns if c != out], F.col("decoded").alias(out))
