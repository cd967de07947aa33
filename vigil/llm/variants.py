"""Operator 12, spelling variant grouping: words one edit apart, each with its commonest near word and its root.

Method: a positional q-gram inverted index with a count filter. Each word has padded bigrams with their places; postings
of a query's bigrams, limited to words of the same length at the same place and of the next shorter length at the same
place or one before, are heap-merged (with skips: a word that too few lists can hold is passed over by bisection), and those
that are on at least as many lists as one edit must leave are verified.

Scale: the index is cut into blocks that need nothing of one another. Two words at most one edit apart, the longer of M
code points, agree on the first half or on the last half of M, so a word enters four blocks (M its length or one more;
first or last half fixed), and the index is built on what isn't fixed. A block of more than BLOCK_WORDS words is cut again:
its free stretch is halved in the same way, as often as needed. Where the free stretch is one code point, a block holds no
more words than there are letters. No block is capped, none is sent to one task whole beyond that bound, and each pair is
found exactly once, in the block that holds the last place at which the edit can be. Tasks read blocks as runs of sorted
rows and put out per word sums and bests, never pairs.

Defined cases of count_words: null and empty texts have no words; a null key is written as an empty string where words
are altered; very long texts and words are read whole; repeated rows count again; an empty table gives none; only the
two named columns are read, so others can't clash. Of variants: ties of n go to the smaller word in code-point order;
words of any length from one code point on are allowed; null words are ignored and repeated words are added up.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vigil.llm.shared import Work

#: Words of a block that are indexed together.
BLOCK_WORDS = 2_000
#: Distinct words that a task counts before it hands them on.
COUNTED = 400_000
#: Latin-1, byte by byte: A-Z to a-z, a-z and C0-FF stay, everything else separates words.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def altered(word: bytes, key_crc: int, every: int) -> bytes:
    """The Latin-1 word, without one code point if `every` divides the checksum of key and word."""
    h = crc32(word if word.isascii() else word.decode("latin-1").encode("utf-8"), key_crc)
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def count_words(df: DataFrame, key: str = "doc_id", text: str = "text", every: int | None = None, least_length: int = 1, least_count: int = 1) -> DataFrame:
    """word, n: letter runs in lower case (A-Z only). With `every`, a code point is dropped from runs whose key and run hash to a multiple of it."""
    rows = df.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("key"), F.col(f"`{text}`").cast("string").alias("text"))

    def batch(total: dict[bytes, int]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = defaultdict(int)
        for b in batches:
            for k, x in zip(b.column("key"), b.column("text")):
                if not (x := x.as_py()):
                    continue
                found, start = Counter(x.encode("latin-1", "replace").translate(_LETTERS).split()), crc32(f"{k.as_py()}:".encode())
                for w, n in found.items():
                    if len(w) >= least_length:
                        if every:
                            w = altered(w, start, every)
                            if len(w) < least_length:
                                continue
                        total[w] += n
                if len(total) > COUNTED:
                    yield batch(total)
                    total.clear()
        yield batch(total)

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter((F.col("n") >= least_count) & (F.length("word") > 0))


def merged(lists: list[list[int]], starts: list[int], need: int) -> Iterator[int]:
    """Numbers on at least `need` (from 1) of the sorted lists, read from the given places on."""
    at = list(starts)
    heap = [(x[i], k) for k, (x, i) in enumerate(zip(lists, at)) if i < len(x)]
    heapify(heap)
    while len(heap) >= need:
        top, out = heap[0][0], []
        while heap and heap[0][0] == top:
            out.append(heappop(heap)[1])
        if len(out) >= need:
            yield top
            goal = top + 1
        else:
            # What comes before the need-th list's front is on too few lists: skip to it.
            while heap and len(out) < need - 1:
                out.append(heappop(heap)[1])
            if not heap:
                return
            goal = heap[0][0]
        for k in out:
            x = lists[k]
            i = at[k] = bisect_left(x, goal, at[k])
            if i < len(x):
                heappush(heap, (x[i], k))


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point lies between a and b."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a[i + 1 :] == b[i + (len(a) == len(b)) :]


def near_in_block(words: list[str], counts: list[int], longest: int, left: int, right: int) -> dict[int, list]:
    """Place of a word -> [near words, n of the best, the best], for words with equal first `left` and last `right` code points.

    Their lengths are `longest` or one less; of the latter only pairs with the former are wanted here.
    """
    order = sorted(range(len(words)), key=lambda i: (-len(words[i]), words[i]))
    n_long = sum(len(w) == longest for w in words)
    free = longest - left - right
    need, best = free - 1, {}
    middles = [words[i][left : len(words[i]) - right] for i in order]
    index: tuple[dict, dict] = (defaultdict(list), defaultdict(list))
    grams = []
    for j, m in enumerate(middles):
        padded = f"\0{m}\0"
        grams.append([(padded[p : p + 2], p) for p in range(len(m) + 1)])
        for g in grams[-1]:
            index[j >= n_long][g].append(j)

    def note(i: int, j: int) -> None:
        n, w = counts[j], words[j]
        x = best.get(i)
        if x is None:
            best[i] = [1, n, w]
        else:
            x[0] += 1
            if n > x[1] or n == x[1] and w < x[2]:
                x[1:] = n, w

    long, short = index
    for j in range(n_long):
        if need > 0:
            lists, starts = [], []
            for g, p in grams[j]:
                if (x := long.get((g, p))) and x[-1] > j:
                    lists.append(x)
                    starts.append(bisect_right(x, j))
                for q in (p, p - 1):
                    if x := short.get((g, q)):
                        lists.append(x)
                        starts.append(0)
            candidates = merged(lists, starts, need)
        else:  # one free code point: all are near
            candidates = iter(range(j + 1, len(order)))
        a = words[order[j]]
        for c in candidates:
            b = words[order[c]]
            if c >= n_long and right and a[left : longest - right] == b[left : longest - right]:
                continue  # the edit can also be further right, in another block
            if one_edit(a, b):
                note(order[j], order[c])
                note(order[c], order[j])
    return best


def _near(blocks: DataFrame) -> DataFrame:
    """word, near, best_n, best for blocks of rows that are sorted by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], []]
        block: tuple | None = None
        out: list[tuple] = []

        def close() -> None:
            words, counts = held
            if len(words) > 1:
                best = near_in_block(words, counts, *block[:3])
                out.extend((words[i], *x) for i, x in best.items())
            held[0], held[1] = [], []

        def take() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * 4
            out.clear()
            return pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "near", "best_n", "best"])

        for b in batches:
            for m, l, r, k, w, n in zip(*(b.column(c).to_pylist() for c in ("longest", "left", "right", "fixed", "word", "n"))):
                if block != (m, l, r, k):
                    close()
                    block = (m, l, r, k)
                held[0].append(w)
                held[1].append(n)
            yield take()
        close()
        yield take()

    return blocks.mapInArrow(run, "word string, near long, best_n long, best string")


_BLOCK = ["longest", "left", "right", "fixed"]


def _halved(longest: Column, left: Column, right: Column) -> Column:
    """The two blocks of (left, right) in which half of the free stretch is fixed as well; a stretch of one stays."""
    free = longest - left - right
    half = F.floor(free / 2).cast("int")
    pair = lambda a, b: F.struct(longest.alias("longest"), a.cast("int").alias("left"), b.cast("int").alias("right"))
    return F.when(free < 2, F.array(pair(left, right))).otherwise(F.array(pair(left + half, right), pair(left, right + free - half)))


def _placed(rows: DataFrame, blocks: Column) -> DataFrame:
    out = rows.select("word", "n", F.explode(blocks).alias("b")).select("word", "n", "b.*")
    word, left, right = F.col("word"), F.col("left"), F.col("right")
    fixed = F.concat(word.substr(F.lit(1), left), word.substr(F.length("word") - right + 1, right))
    return out.withColumn("fixed", fixed)


def near_words(words: DataFrame, work: Work, block_words: int = BLOCK_WORDS) -> DataFrame:
    """word, n_near, best_n, best for each word that has a near word. words: word, n, each word once."""
    length, zero = F.length("word"), F.lit(0)
    state = _placed(words, F.concat(_halved(length, zero, zero), _halved(length + 1, zero, zero)))
    found = []
    while True:
        sizes = state.groupBy(_BLOCK).agg(F.count(F.lit(1)).alias("size"), F.max(F.length("word") == F.col("longest")).alias("any_long"))
        # A block of one word, or of shorter words only, has no pair to find.
        seen = Observation()
        sized = state.join(sizes.filter("size > 1 AND any_long"), _BLOCK)
        large = (F.col("size") > block_words) & (F.col("longest") - F.col("left") - F.col("right") > 1)
        sized = work.write(sized.withColumn("large", large).observe(seen, F.count_if("large").alias("n")), "blocks")
        ready = sized.filter("NOT large").select(*_BLOCK, "word", "n").repartition(*_BLOCK).sortWithinPartitions(*_BLOCK)
        found.append(_near(ready))
        if not seen.get["n"]:
            break
        state = _placed(sized.filter("large").select("word", "n", *_BLOCK), _halved(F.col("longest"), F.col("left"), F.col("right")))
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best"))).alias("b")
    return out.groupBy("word").agg(F.sum("near").alias("n_near"), best).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def _roots(forms: DataFrame, work: Work) -> DataFrame:
    """word, root for words with a form. Every round doubles the steps taken; a form is at least `ratio` times as frequent, so rounds are few."""
    steps = work.write(forms.select("word", F.col("form").alias("root")), "steps")
    while True:
        seen = Observation()
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = steps.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        after = work.write(moved.observe(seen, F.count_if("moved").alias("n")).select("word", "root"), "steps")
        work.drop(steps)
        steps = after
        if not seen.get["n"]:
            return steps


def variants(words: DataFrame, ratio: float = 2, block_words: int = BLOCK_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n. words: word, n. The form is the commonest near word if its n is at least ratio * n."""
    work = Work(words.sparkSession, "variants")
    words = work.write(words.filter("length(word) > 0").groupBy("word").agg(F.sum("n").cast("long").alias("n")), "words")
    near = near_words(words, work, block_words)
    has = F.col("best_n") >= ratio * F.col("n")
    linked = words.join(near, "word", "left").select(
        "word", F.when(has, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best_n")).alias("form_n")
    )
    linked = work.write(linked, "linked")
    roots = _roots(linked.filter("form IS NOT NULL"), work)
    out = linked.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    return work.last(out, "variants")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return variants(count_words(docs, every=97, least_length=5, least_count=3))
