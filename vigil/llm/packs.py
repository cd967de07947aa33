"""Packed exchanges: how operators look up something global for every distinct item without shuffling every occurrence.

A task cuts its rows into blocks of bounded size. For each block it emits one payload (the rows in a compact form)
and, for each of P hash buckets, one pack with the block's distinct items of that bucket. One shuffle brings each
bucket's packs together and leaves each payload where its block will be finished; a reducer answers every pack
from all packs of its bucket; a second shuffle takes the answers to their blocks. An item with any share of all
occurrences is in one pack per block, so hot items neither grow a bucket nor need salting, and nothing is
pre-aggregated, capped or dropped. Packs and answers are compressed, a few bytes per distinct item.

The number of packs is blocks times buckets, as the segments of any shuffle. Both sides of finish() read the first
shuffle's files, which Spark reuses because it is the same plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from vigil.llm.hashing import ragged  # noqa: F401  a helper on arrays, for those who unpack

SCHEMA = "key long, src long, data binary"
#: Bytes of text after which a block is closed, and rows; a longer text is a block of its own.
BLOCK_BYTES, BLOCK_ROWS = 8_000_000, 65_536


def squeeze(data: bytes) -> bytes:
    return zstandard.compress(data, 3)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.decompress(data)


def put(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays and byte strings as one compressed byte string. Integers are stored plane by plane, which compresses better."""
    out = []
    for a in arrays:
        if isinstance(a, bytes):
            out.append(np.array([0, len(a)], np.int64).tobytes() + a)
        else:
            a = np.ascontiguousarray(a)
            planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
            out.append(np.array([1 + "BHILdf".index({"u1": "B", "u2": "H", "u4": "I", "u8": "L", "f8": "d", "f4": "f"}[a.dtype.str[1:]]), len(a)], np.int64).tobytes() + planes)
    return squeeze(b"".join(out))


_KINDS = (np.uint8, np.uint16, np.uint32, np.uint64, np.float64, np.float32)


def take(data: bytes) -> list:
    """What put() was given."""
    raw, at, out = unsqueeze(data), 0, []
    while at < len(raw):
        kind, n = np.frombuffer(raw, np.int64, 2, at).tolist()
        at += 16
        if kind == 0:
            out.append(raw[at : at + n])
            at += n
        else:
            t = np.dtype(_KINDS[kind - 1])
            planes = np.frombuffer(raw, np.uint8, n * t.itemsize, at).reshape(t.itemsize, n)
            out.append(np.ascontiguousarray(planes.T).reshape(-1).view(t))
            at += n * t.itemsize
    return out


def small(a: np.ndarray) -> np.ndarray:
    """The values in the narrowest unsigned type."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def join_bytes(items: list[bytes]) -> tuple[np.ndarray, bytes]:
    return small(np.fromiter(map(len, items), np.int64, len(items))), b"".join(items)


def split_bytes(lengths: np.ndarray, data: bytes) -> list[bytes]:
    ends = np.cumsum(lengths.astype(np.int64)).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def by_bucket(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions grouped by bucket in their order, and where each bucket begins and ends."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unipc(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


Packs = dict[int, bytes]


def scatter(df: DataFrame, text: str, emit: Callable[[pa.Table, list], tuple[bytes, Packs]], block_bytes: int | None = None) -> DataFrame:
    """Blocks of df as rows of SCHEMA. emit(rows, texts) gives a block's payload and its packs by bucket."""
    most = block_bytes or BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held, weight, rows = TaskContext.get().partitionId(), 0, [], 0, 0

        def flush():
            nonlocal seq, held, weight, rows
            if held:
                table = pa.Table.from_batches(held)
                at = table.schema.get_field_index(text)
                payload, packs = emit(table.remove_column(at), table.column(at))
                src = -1 - ((part << 24) + seq)
                seq, held, weight, rows = seq + 1, [], 0, 0
                keys = [src, *packs]
                yield pa.record_batch([pa.array(keys, pa.int64()), pa.array([src] * len(keys), pa.int64()), pa.array([payload, *packs.values()], pa.binary())], names=["key", "src", "data"])

        for batch in batches:
            at = 0
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).cumsum()
            while at < batch.num_rows:
                room = most - weight + (int(sizes[at - 1]) if at else 0)
                end = min(max(int(np.searchsorted(sizes, room, "right")), at + (not held)), batch.num_rows, at + BLOCK_ROWS - rows)
                if end > at:
                    held.append(batch.slice(at, end - at))
                    weight += int(sizes[end - 1]) - (int(sizes[at - 1]) if at else 0)
                    rows += end - at
                if end < batch.num_rows:
                    yield from flush()
                at = end
        yield from flush()

    return df.mapInArrow(run, SCHEMA)


def _rows(key: int, srcs: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(srcs, pa.int64()), pa.array([key] * len(srcs), pa.int64()), pa.array(data, pa.binary())], names=["key", "src", "data"])


def answer(x: DataFrame, reduce: Callable[[list[int], list[bytes]], list[bytes]]) -> DataFrame:
    """For every pack of x its answer, under the block's key: key (block), src (bucket), data. A bucket's packs are taken in the order of blocks, so a repeated task gives the same."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = key[0].as_py()
        if bucket >= 0:  # else a payload, which is left where it is
            pairs = sorted((s, d) for b in batches for s, d in zip(b.column("src").to_pylist(), b.column("data").to_pylist()))
            yield _rows(bucket, [s for s, _ in pairs], reduce([s for s, _ in pairs], [d for _, d in pairs]))

    return x.groupBy("key").applyInArrow(run, SCHEMA)


def answer_each(x: DataFrame, reduce: Callable[[], Callable[[bytes], bytes]]) -> DataFrame:
    """As answer(), for answers that don't depend on other packs: reduce() gives a function for one bucket, which sees one pack at a time."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = key[0].as_py()
        if bucket >= 0:
            one = reduce()
            for b in batches:
                yield _rows(bucket, b.column("src").to_pylist(), [one(d.as_py()) for d in b.column("data")])

    return x.groupBy("key").applyInArrow(run, SCHEMA)


def rescatter(x: DataFrame, answers: DataFrame, emit: Callable[[bytes, dict[int, bytes]], tuple[bytes, Packs]]) -> DataFrame:
    """A further round: emit(payload, answers by bucket) gives every block a new payload and new packs."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if key[0] >= 0:
            return pd.DataFrame({"key": pd.Series(dtype="int64"), "src": pd.Series(dtype="int64"), "data": pd.Series(dtype="object")})
        payload, packs = emit(left["data"].iloc[0], dict(zip(right["src"].tolist(), right["data"].tolist())))
        return pd.DataFrame({"key": [key[0], *packs], "src": key[0], "data": [payload, *packs.values()]})

    return x.groupBy("key").cogroup(answers.groupBy("key")).applyInPandas(run, SCHEMA)


def finish(x: DataFrame, answers: DataFrame, end: Callable[[bytes, dict[int, bytes]], pd.DataFrame], schema: str) -> DataFrame:
    """end(payload, answers by bucket) for every block."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if key[0] >= 0:
            return end(None, {})
        return end(left["data"].iloc[0], dict(zip(right["src"].tolist(), right["data"].tolist())))

    return x.groupBy("key").cogroup(answers.groupBy("key")).applyInPandas(run, schema)


def finish_arrow(x: DataFrame, answers: DataFrame, end: Callable[[int, bytes, dict[int, bytes]], pa.Table], empty: pa.Schema, schema: str) -> DataFrame:
    """As finish(), with tables: end(block, payload, answers by bucket) for every block; blocks are numbered from 0."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        block = key[0].as_py()
        if block >= 0:
            return empty.empty_table()
        return end(-1 - block, left.column("data")[0].as_py(), dict(zip(right.column("src").to_pylist(), right.column("data").to_pylist())))

    return x.groupBy("key").cogroup(answers.groupBy("key")).applyInArrow(run, schema)
