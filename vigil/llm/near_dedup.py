"""Operator 10, near-duplicate detection by BagMinHash over bags of five-word shingles.

Method: every shingle with its count in a text runs Poisson processes over (time, weight). The weight axis is
discretised to whole counts and split dyadically, [0,1), [1,2), [2,4), ..., so a count of w runs about log2(w)
processes; points at a weight that the count doesn't reach are passed over, which is how the hierarchy thins a
parent interval to its part. Each point falls on one of m registers, and a register keeps its earliest point. A
process stops once its time is past the text's latest register, so most shingles draw a single point. Two texts
agree in a register with probability equal to their weighted Jaccard similarity.

Registers are banded, 21 bands of 6: a pair of similarity 0.8 shares a bucket with probability 0.998, one of 0.85 with
0.9999. Pairs that share a bucket are candidates if their bag sizes, their register sketches (four bits of each register; all but
two in a million of the pairs at similarity 0.8 pass) and their parity sketches allow the threshold; all are conditions of the join, so other
pairs of a bucket are never rows. A parity sketch has, for each of four to eight times as many slots as the bag has shingles, whether an odd number of
shingles fell on it: two differ in at most as many slots as there are shingles in one bag only, so no link is lost by it,
and few pairs below the threshold pass. In a first round a bucket's texts are paired with one of them only, its
leader by a random rank that differs from bucket to bucket, so each text of a group meets up to 21 others; links are verified on the
whole bags. Where a bucket then holds several components, the texts outside the most frequent one meet another leader of that one, twice;
then those that are still outside are paired with all of the bucket's texts in other components. So a group of n texts of which a fair part are links
costs about 63 n comparisons, and no candidate pair between two components is left out. Only texts with a candidate are fetched for verification. Equal
texts are one node from the start. Components of the links are the classes.

Defined cases: equal texts share a class, null counting as empty; texts of one to four words have a single
shingle, all of their words; texts without words have no links but to equal texts; a class is named by its smallest
doc_id, whose row is kept (of rows with equal doc_id, one; null only if the class has no other); an empty table
gives an empty result; doc_id must be castable to a 64-bit integer; in dedup(), columns come back unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.components import components
from vigil.llm.hashing import GOLD, WordHashes, mix, ngram_hashes, unit
from vigil.llm.packs import squeeze, unsqueeze
from vigil.llm.shared import Work, chosen, identified

SHINGLE, SIMILARITY, REGISTERS, BANDS = 5, 0.8, 126, 21
#: Registers in which two sketches may differ. At similarity s a sketch differs in a register with probability 15/16 (1 - s): at 0.8 in 23.6, standard deviation 4.4.
BITS, DIFFERENT = 4, 45
#: Rounds after the first: in all but the last a bucket's unlinked texts meet one further leader of its most frequent component.
LEADERS = 3
PLANES = tuple(f"s{k}" for k in range(2 * BITS))
#: Slots of a parity sketch: the power of two from SLOTS times the bag's size. Beyond the maximum fewer pairs are told apart, and still none is lost.
SLOTS, MOST_SLOTS = 4, 1 << 16
#: Words whose hashes a task remembers, and texts whose registers are filled at a time.
MEMO_WORDS, BATCH = 100_000, 512

_HASHES = WordHashes()


def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct shingle hashes, ascending, and their counts."""
    words = text.split()  # on exactly the six separators, as the text is bytes
    if len(_HASHES) > MEMO_WORDS:
        _HASHES.clear()
    h = _HASHES.of(words)
    grams = ngram_hashes(h, SHINGLE) if len(h) >= SHINGLE else ngram_hashes(h, len(h)) if len(h) else h
    return np.unique(grams, return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags."""
    total = int(a[1].sum() + b[1].sum())
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    return shared / (total - shared) if total else 0.0


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int = REGISTERS) -> np.ndarray:
    """Earliest times, one row of m registers per bag. Registers of an empty bag are infinite."""
    out = np.full((len(bags), m), np.inf)
    doc = np.repeat(np.arange(len(bags)), [len(h) for h, _ in bags])
    if not len(doc):
        return out
    keys, counts = np.concatenate([h for h, _ in bags]), np.concatenate([c for _, c in bags]).astype(np.int64)
    levels = 1 + np.ceil(np.log2(counts)).astype(np.int64)
    level = np.arange(int(levels.sum())) - np.repeat(np.cumsum(levels) - levels, levels)
    doc, keys, counts = (np.repeat(x, levels) for x in (doc, keys, counts))
    width = np.where(level == 0, 1, 1 << np.maximum(level - 1, 0))
    low = np.where(level == 0, 0, width)
    seed, time, draw = mix(keys ^ mix((level.astype(np.uint64) + np.uint64(1)) * GOLD)), np.zeros(len(doc)), 0
    with np.errstate(over="ignore"):
        while len(doc):
            step = seed + np.uint64((3 * draw + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
            time = time - np.log(unit(mix(step))) / (m * width)
            register = (mix(step + GOLD) % np.uint64(m)).astype(np.int64)
            weight = low + np.minimum((unit(mix(step + GOLD + GOLD)) * width).astype(np.int64), width - 1)
            hit = weight < counts
            np.minimum.at(out, (doc[hit], register[hit]), time[hit])
            go = time < out.max(axis=1)[doc]
            doc, seed, time, counts, width, low = (x[go] for x in (doc, seed, time, counts, width, low))
            draw += 1
    return out


def band_hashes(registers: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One hash per band, for each row of registers."""
    bits = registers.view(np.uint64).reshape(len(registers), bands, -1)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * GOLD, bits.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for k in range(bits.shape[2]):
            h = mix(h * GOLD + bits[:, :, k])
    return h


def sketches(registers: np.ndarray) -> np.ndarray:
    """BITS bits of every register's hash, for each row of registers as pairs of integers: the first bits of all registers, the second bits, and so on."""
    bits = mix(registers.view(np.uint64) * GOLD)
    wide = np.zeros((len(bits), BITS, 128), np.uint8)
    for k in range(BITS):
        wide[:, k, : bits.shape[1]] = (bits >> np.uint64(63 - k)) & np.uint64(1)
    return np.packbits(wide.reshape(len(bits), -1), axis=1).view(np.int64)


def parities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A bag's parity sketch, 64 slots to an integer. The copies of a shingle are told apart, so sketches bound weighted similarity."""
    n = int(counts.sum())
    slots = min(MOST_SLOTS, max(64, 1 << (SLOTS * n - 1).bit_length()))
    copy = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    at = mix(np.repeat(hashes, counts) + copy.astype(np.uint64) * GOLD) & np.uint64(slots - 1)
    odd = (np.bincount(at.astype(np.int64), minlength=slots) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            texts = [x.as_py() for x in part.column("text")]
            raw = [(t or "").encode("utf-8") for t in texts]
            bags = [bag(t) for t in raw]
            registers = signatures(bags)
            hashes = band_hashes(registers).view(np.int64)
            columns = {n: part.column(n) for n in part.schema.names if n != "text"}
            columns["digest"] = pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in raw], pa.binary())
            columns["size"] = pa.array([int(c.sum()) for _, c in bags], pa.int64())
            columns["bands"] = pa.array([h if len(b[0]) else [] for h, b in zip(hashes, bags)], pa.list_(pa.int64()))
            columns |= {f"s{k}": pa.array(x, pa.int64()) for k, x in enumerate(sketches(registers).T)}
            columns["odd"] = pa.array([parities(*b) for b in bags], pa.list_(pa.int64()))
            columns["packed"] = pa.array(map(squeeze, raw), pa.binary())
            yield pa.RecordBatch.from_pydict(columns)


def _verify(threshold: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, tuple] = {}

        def of(i: int, packed: bytes):
            found = known.get(i)
            if found is None:
                if len(known) >= 256:
                    known.clear()
                found = known[i] = bag(unsqueeze(packed))
            return found

        for f in frames:
            linked = [similarity(of(-1 - a, pa_), of(b, pb)) >= threshold for a, b, pa_, pb in zip(f["a"], f["b"], f["packed_a"], f["packed_b"])]
            yield f.loc[np.array(linked, bool), ["a", "b"]]

    return run


def _links(pairs: DataFrame, table: DataFrame, threshold: float, work: Work) -> DataFrame:
    """Those pairs (a, b) whose texts are similar. The texts of all pairs are drawn out of the table in one shuffle first."""
    wanted = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "n")
    held = work.write(table.select(F.col("n"), "packed").join(wanted.hint("merge"), "n", "left_semi"), "held")
    one, two = held.select(F.col("n").alias("a"), F.col("packed").alias("packed_a")), held.select(F.col("n").alias("b"), F.col("packed").alias("packed_b"))
    links = work.write(pairs.join(one, "a").join(two, "b").select("a", "b", "packed_a", "packed_b").mapInPandas(_verify(threshold), "a long, b long"), "links")
    work.drop(held)
    return links


def _close(x: str, y: str, threshold: float) -> Column:
    """Whether sizes, sketches and parities allow the threshold."""
    def apart(half: int) -> Column:
        out = None
        for k in range(half, 2 * BITS, 2):
            other = F.col(f"{x}.s{k}").bitwiseXOR(F.col(f"{y}.s{k}"))
            out = other if out is None else out.bitwiseOR(other)
        return F.bit_count(out)

    def folded(one: str, other: str) -> Column:
        """Parities of one in as many slots as the other's, if it has twice as many."""
        a, n = F.col(f"{one}.odd"), F.size(f"{other}.odd")
        return F.when(F.size(a) == 2 * n, F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, n + 1, n), lambda p, q: p.bitwiseXOR(q))).otherwise(a)

    # Similarity s of bags of m and n shingles means (m + n) (1 - s) / (1 + s) shingles in one of them only.
    only = F.aggregate(F.zip_with(folded(x, y), folded(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, k: total + k)
    allowed = (F.col(f"{x}.size") + F.col(f"{y}.size")) * ((1 - threshold) * (1 + 1e-9))
    alike = F.coalesce(only * (1 + threshold) <= allowed, F.lit(True))  # null: other numbers of slots
    fits = F.least(f"{x}.size", f"{y}.size") >= F.greatest(f"{x}.size", f"{y}.size") * threshold
    return fits & (apart(0) + apart(1) <= DIFFERENT) & alike


def _linked(label: DataFrame, pairs: DataFrame, table: DataFrame, threshold: float, work: Work) -> DataFrame:
    """label (rep, label of every text) after the links among these pairs: components of the components, over the links between them."""
    ends = _links(pairs, table, threshold, work)
    ends = ends.join(label.select(F.col("rep").alias("a"), F.col("label").alias("la")), "a").join(label.select(F.col("rep").alias("b"), F.col("label").alias("lb")), "b")
    over = components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b")), work).select(F.col("node").alias("label"), F.col("label").alias("top"))
    return work.write(label.join(over, "label", "left").select("rep", F.coalesce("top", "label").alias("label")), "label")


def _classes(table: DataFrame, threshold: float, work: Work) -> DataFrame:
    """table: n, row, key, digest, size, bands, PLANES, odd, packed. One row per row of it: row, key, class_id, class_size, n_copies, kept."""
    first = F.min(F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"), F.col("n").alias("n")))
    some = [F.any_value(c).alias(c) for c in ("bands", "size", *PLANES, "odd")]
    texts = work.write(table.groupBy("digest").agg(F.min("n").alias("rep"), first.alias("first"), F.count("*").alias("copies"), *some), "texts")
    sketch = texts.select("rep", "size", *PLANES, "odd")
    banded = texts.select("rep", F.explode("bands").alias("h"))
    rank = F.struct(F.xxhash64("rep", "h").alias("rank"), F.col("rep").alias("lead"))
    lead = banded.groupBy("h").agg(F.min(rank).alias("least"), F.count("*").alias("n")).filter("n > 1").select("h", F.col("least.lead").alias("lead"))
    members = work.write(banded.join(lead.hint("merge"), "h"), "members")
    pairs = members.filter("rep <> lead").select("rep", "lead").distinct()
    pairs = pairs.alias("p").join(sketch.alias("x"), F.col("p.rep") == F.col("x.rep")).join(sketch.alias("y"), (F.col("p.lead") == F.col("y.rep")) & _close("x", "y", threshold))
    pairs = work.write(pairs.select(F.col("p.rep").alias("a"), F.col("p.lead").alias("b")), "pairs")
    done = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    label = texts.select("rep", F.col("rep").alias("label"))
    label = _linked(label, pairs, table, threshold, work)
    # What a bucket holds besides its most frequent component: paired with another leader of that component, a few times, and then with
    # the bucket's texts in all other components.
    for turn in range(LEADERS):
        known = work.write(members.select("h", "rep").join(label, "rep"), "known")
        shares = known.groupBy("h", "label").agg(F.count("*").alias("n"))
        main = shares.groupBy("h").agg(F.max(F.struct("n", "label")).alias("most"), F.count("*").alias("labels")).filter("labels > 1").select("h", F.col("most.label").alias("main"))
        mixed = work.write(known.join(main, "h").join(texts.select("rep", "size", "bands", *PLANES, "odd"), "rep"), "mixed")
        x = mixed.filter("label <> main").alias("x")
        if turn < LEADERS - 1:
            least = F.min(F.struct(F.xxhash64("rep", "h", F.lit(turn)).alias("rank"), "rep", "label", "size", *PLANES, "odd"))
            y = mixed.filter("label = main").groupBy("h").agg(least.alias("y")).select("h", "y.*").alias("y")
            more = x.join(y, (F.col("x.h") == F.col("y.h")) & _close("x", "y", threshold))
        else:
            y = mixed.alias("y")
            once = (F.col("y.label") == F.col("y.main")) | (F.col("x.rep") < F.col("y.rep"))
            # A pair that shares several buckets is taken in the one with the smallest hash.
            here = F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.h")
            more = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.label") != F.col("y.label")) & once & _close("x", "y", threshold) & here)
        more = more.select(F.greatest("x.rep", "y.rep").alias("a"), F.least("x.rep", "y.rep").alias("b")).distinct()
        more = work.write(more.join(done, ["a", "b"], "left_anti"), "more")
        work.drop(known, mixed)
        if not more.isEmpty():
            label = _linked(label, more, table, threshold, work)
        done = done.union(more)
    named = work.write(texts.select("digest", "rep", "first", "copies").join(label, "rep"), "named")
    whole = named.groupBy("label").agg(F.min("first").alias("least"), F.sum("copies").alias("class_size"))
    cols = [F.col("least.key").alias("class_id"), F.col("least.n").alias("keep"), "class_size", F.col("copies").alias("n_copies")]
    answers = work.write(named.join(whole, "label").select("digest", *cols), "answers")
    out = table.select("n", "row", "key", "digest").join(answers, "digest")
    return work.last(out.select("row", "key", "class_id", "class_size", "n_copies", (F.col("n") == F.col("keep")).alias("kept")), "classes")


def _search(rows: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """rows: doc, row."""
    work = Work(rows.sparkSession, "near")
    planes = ", ".join(f"{p} long" for p in PLANES)
    table = rows.select(F.monotonically_increasing_id().alias("n"), "row", F.col(f"doc.`{key}`").cast("long").alias("key"), F.col(f"doc.`{text}`").cast("string").alias("text"))
    schema = f"n long, row struct<file: long, at: long>, key long, digest binary, size long, bands array<long>, {planes}, odd array<long>, packed binary"
    return _classes(work.write(table.mapInArrow(_sketch, schema), "table"), threshold, work)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: doc_id, class_id, class_size (rows), n_copies (rows with its text), kept. The search has run when it returns."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in {key: 0, text: 0}]).alias("doc"), F.lit(None).cast("struct<file: long, at: long>").alias("row"))
    return _search(rows, key, text, threshold).select(F.col("key").alias("doc_id"), "class_id", "class_size", "n_copies", "kept")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stay, one of each class, with their columns as they were."""
    rows = identified(docs, "near")
    return chosen(rows, _search(rows, key, text, threshold).filter("kept").select("row"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
