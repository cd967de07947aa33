"""Operator 7, toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

Method: a word's vector is the mean of the embeddings of its character n-grams and of itself; a text's vector is
the weighted mean over its words; a linear softmax tells toxic from clean. Embeddings and softmax are trained together by
Adam on mini-batches. Misspellings that training never saw share n-grams with words that it did.

Training reads a bounded sample: at most SAMPLE labelled rows of each class, those whose keys hash lowest, so it
is the same in every run, and of these the ones whose texts have at most TEXT_BYTES bytes; longer ones are scored whole but not
learned from. So the driver holds 2 * SAMPLE * TEXT_BYTES bytes of text at most. Which share of all labelled rows is toxic is counted over all of them and corrects the
bias. Once trained, each n-gram bucket comes down to one number, so scoring is one projection over the scan: a
table of fixed size is sent to the executors, and a task remembers the numbers of words that it has met.

Defined cases: a null or empty text has the mean vector 0, so its score is the bias alone; without labels of both
classes the score is the known class's share, or 0; texts count whole at any length; repeated rows score alike;
null keys are hashed as empty texts; columns stay, and one with an output's name is replaced.
"""

from __future__ import annotations

from array import array
from collections import Counter
from dataclasses import dataclass
from math import log

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.lm_score import fold
from vigil.llm.packs import ragged

SAMPLE, TEXT_BYTES, BUCKETS, DIM, GRAMS, EPOCHS, BATCH, RATE, SEED = 3000, 1 << 15, 1 << 17, 8, (3, 4, 5), 8, 128, 0.06, 7
MEMO_WORDS = 300_000
_EDGES = ".,;:!?\"'()[]{}<>*#%&$|-_"


def grams(word: str) -> list[int]:
    """Buckets of a word's n-grams and of the word."""
    w = f"<{word.strip(_EDGES)}>"
    parts = [w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1)]
    return [xxhash.xxh3_64_intdigest(p.encode("utf-8", "replace")) % BUCKETS for p in (*parts, w)]


def shares(text: str | None) -> dict[str, float]:
    """A text's words with their weights in its mean: 1 + log(count), so that a word said a hundred times isn't the text."""
    counts = Counter(text.lower().split()) if text else {}
    weights = {w: 1 + log(n) for w, n in counts.items()} if len(counts) else {}
    total = sum(weights.values())
    return {w: x / total for w, x in weights.items()}


@dataclass
class Model:
    """What is left of embeddings and softmax for two classes: one number per bucket, and the bias."""

    weight: np.ndarray
    bias: float


class _Adam:
    def __init__(self, *shapes):
        self.m, self.v, self.t = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], 0

    def step(self, values: list[np.ndarray], grads: list[np.ndarray]) -> None:
        self.t += 1
        for x, g, m, v in zip(values, grads, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= RATE * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


@dataclass
class Batch:
    """Texts as pairs of a word and its share (word, share, doc), words as runs of n-gram buckets (gram, n of each word), and labels."""

    word: np.ndarray
    share: np.ndarray
    doc: np.ndarray
    gram: np.ndarray
    n: np.ndarray
    label: np.ndarray

    def gradients(self, embedding: np.ndarray, softmax: np.ndarray, bias: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The mean cross-entropy, and its gradients by embedding, softmax and bias."""
        n_docs, n_words, dims = len(self.label), len(self.n), range(embedding.shape[1])
        of_word = np.repeat(np.arange(n_words), self.n)
        vector = np.stack([np.bincount(of_word, embedding[self.gram, d], n_words) for d in dims], 1) / self.n[:, None]
        mean = np.stack([np.bincount(self.doc, vector[self.word, d] * self.share, n_docs) for d in dims], 1)
        z = mean @ softmax + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        at = np.arange(n_docs), self.label
        loss = float(-np.log(p[at]).mean())
        p[at] -= 1
        p /= n_docs
        back = p @ softmax.T
        on_word = np.stack([np.bincount(self.word, back[self.doc, d] * self.share, n_words) for d in dims], 1) / self.n[:, None]
        on_gram = np.stack([np.bincount(self.gram, on_word[of_word, d], len(embedding)) for d in dims], 1)
        return loss, [on_gram, mean.T @ p, p.sum(axis=0)]


def fit(texts: list[str | None], labels: list[int], share: float) -> Model:
    """share: of toxic texts among all labelled ones."""
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        p = min(max(share, 1e-9), 1 - 1e-9)
        return Model(np.zeros(BUCKETS), float(np.log(p / (1 - p))))
    rng, number = np.random.default_rng(SEED), {}
    ids, counts, sizes, flat, n_grams = array("q"), array("d"), array("q"), array("q"), array("q")
    for t in texts:
        c = shares(t)
        ids.extend(number.setdefault(w, len(number)) for w in c)
        counts.extend(c.values())
        sizes.append(len(c))
    for w in number:
        flat.extend(g := grams(w))
        n_grams.append(len(g))
    ids, counts, sizes, flat, n_grams = map(np.array, (ids, counts, sizes, flat, n_grams))
    begin, g_begin = np.cumsum(sizes) - sizes, np.cumsum(n_grams) - n_grams
    embedding, softmax, bias = rng.normal(0, 0.01, (BUCKETS, DIM)), rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)
    adam = _Adam(embedding.shape, softmax.shape, bias.shape)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            docs = order[at : at + BATCH]
            size = sizes[docs]
            w, inverse = np.unique(ragged(ids, begin[docs], size), return_inverse=True)
            batch = Batch(inverse, ragged(counts, begin[docs], size), np.repeat(np.arange(len(docs)), size), ragged(flat, g_begin[w], n_grams[w]), n_grams[w], y[docs])
            adam.step([embedding, softmax, bias], batch.gradients(embedding, softmax, bias)[1])
    sampled = y.mean()
    prior = np.log(share / (1 - share)) - np.log(sampled / (1 - sampled))
    return Model(embedding @ (softmax[:, 1] - softmax[:, 0]), float(bias[1] - bias[0] + prior))


class _WordScores(dict):
    def __init__(self, model: Model):
        self.weight = model.weight

    def __missing__(self, w: str) -> float:
        s = self[w] = float(self.weight[grams(w)].mean())
        return s


def score_texts(texts, model: Model, known: _WordScores | None = None) -> np.ndarray:
    known = _WordScores(model) if known is None else known
    out = np.empty(len(texts))
    for i, t in enumerate(texts):
        found = Counter(t.lower().split()) if t else {}
        total, weight = sum(map(known.__getitem__, found)), len(found)
        for w, n in found.items():
            if n > 1:
                x = log(n)
                total, weight = total + x * known[w], weight + x
        out[i] = total / weight if weight else 0.0
        if len(known) > MEMO_WORDS:
            known.clear()
    return 1 / (1 + np.exp(-(out + model.bias)))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """docs and labels share the key; labels holds the rows that may be learned from."""
    usable = labels.filter(F.col(label).isin(0, 1)).select(F.col(key).alias("__key"), F.col(label).alias("__label"))
    share = usable.agg(F.avg("__label")).first()[0] or 0.0
    order = [F.xxhash64(F.col("__key").cast("string")), F.col("__key")]
    chosen = usable.filter("__label = 1").orderBy(*order).limit(SAMPLE).union(usable.filter("__label = 0").orderBy(*order).limit(SAMPLE))
    texts = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").cast("string").alias("__text")).filter(F.coalesce(F.octet_length("__text"), F.lit(0)) <= TEXT_BYTES)
    texts = texts.join(F.broadcast(chosen), "__key")  # 2 * SAMPLE rows at most
    rows = texts.orderBy(*order, "__label", "__text").limit(2 * SAMPLE).collect()
    return fit([r["__text"] for r in rows], [r["__label"] for r in rows], share)


_KNOWN: dict[bytes, _WordScores] = {}


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with score and predicted."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    token = xxhash.xxh3_128_digest(model.weight.tobytes())

    @F.pandas_udf("double")
    def scores(s: pd.Series) -> pd.Series:
        if token not in _KNOWN:
            _KNOWN.clear()
            _KNOWN[token] = _WordScores(sent.value)
        return pd.Series(score_texts([x if isinstance(x, str) else None for x in s], sent.value, _KNOWN[token]))

    return df.withColumn("score", scores(F.col(f"`{text}`").cast("string"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(fold("doc_id", 5) != 0)
    model = train(docs, labels)
    return score(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
