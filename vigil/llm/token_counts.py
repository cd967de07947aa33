"""Operator 1, token counts: how many tokens a word-BPE vocabulary gives each text, without making identifiers.

Method: heap-and-linked-list byte-pair merging (see bpe.merge). A word's count is its initial symbols minus its
merges. White space never belongs to a token here, so a text's count is the sum over its words, and each task
keeps the counts of the words that it has met in a memo of bounded size.

The plan is one projection over the scan: no shuffle, any number of partitions, nothing to lose with an executor.

Defined cases: null and empty texts count 0 tokens and 0 bytes; very long texts and words take O(n log n);
repeated rows get equal counts; an empty table gives an empty result; columns of the input stay, and one that has
the name of an output column is replaced.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.bpe import byte_symbols, load_word_bpe, merge
from vigil.llm.shared import SPACE

#: Words that a task's memo holds before it starts anew; this bounds memory, never the result.
MEMO_WORDS = 300_000
# The vocabulary's normaliser and splitter (canonical composition, lower case, then these matches; L and N are classes).
PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{SPACE}{L}{N}]+"
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
_EXTRA_CONTROLS = re.compile(r"[\x1c-\x1f]")


#: Planes with letters and numbers; the others have none.
_PLANES = range(0x80, 0x40000)


def _class(points: list[int]) -> str:
    """Sorted code points as the inside of a character class."""
    out, first, last = [], None, None
    for c in [*points, None]:
        if first is not None and c == last + 1:
            last = c
            continue
        if first is not None:
            out.append(f"\\U{first:08x}-\\U{last:08x}")
        first = last = c
    return "".join(out)


class Letters:
    """Letters and numbers as the vocabulary's own library has them, and the code points that Python's tables don't know.

    Both follow Unicode, in versions of their own. What is assigned in Python's tables keeps its category; of the rest the library
    is asked by how its splitter treats the code point between letters and between marks.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normal = library.normalizer.normalize_str
        by = {"L": [*map(ord, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")], "N": [*map(ord, "0123456789")], "Cn": []}
        for c in _PLANES:
            kind = unicodedata.category(chr(c))
            by.get(kind if kind == "Cn" else kind[0], []).append(c)
        self.unknown = re.compile(f"[{_class(by['Cn'])}]")
        split = library.pre_tokenizer.pre_tokenize_str
        alone = lambda c, mark: len(split(f"{mark}{chr(c)}{mark}"))
        for c in by["Cn"]:
            if alone(c, "a") == 1:
                by["L"].append(c)
            elif alone(c, "!") == 3:
                by["N"].append(c)
        self.letters, self.numbers = (_class(sorted(by[k])) for k in "LN")

    def pieces(self) -> str:
        return PIECES.replace("{L}", self.letters).replace("{N}", self.numbers).replace("{SPACE}", SPACE)


class WordCounts(dict):
    """Lower-case word -> number of tokens, filled on demand."""

    def __init__(self, path: str):
        import regex

        self.ranks, special, self.suffix = load_word_bpe(path)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.marks = {t[:2] for t in special}  # a quick look ahead of the pattern
        self.letters = Letters(path)
        self.pieces = regex.compile(self.letters.pieces())
        self.space = regex.compile(f"[{SPACE}]+")
        self.symbols = byte_symbols()

    def __missing__(self, word: str) -> int:
        if word.isascii():
            found = _ASCII_PIECES.findall(word)
        else:  # normalising is idempotent and doesn't cross white space, so a word can be taken to the library's version of it
            found = self.pieces.findall(self.letters.normal(word) if self.letters.unknown.search(word) else word)
        n = self[word] = sum(map(self.piece, found))
        return n

    def piece(self, piece: str) -> int:
        symbols = [self.symbols[b] for b in piece.encode("utf-8")]
        symbols[-1] += self.suffix
        return len(symbols) - merge(symbols, self.ranks)[1]

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special and any(m in text for m in self.marks):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self.section, parts))
        return self.section(text)

    def section(self, text: str) -> int:
        if not text.isascii():
            # The library lower-cases character by character, so a final capital sigma isn't special.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        found = self.space.split(text) if _EXTRA_CONTROLS.search(text) else text.split()
        return sum(map(self.__getitem__, found))


_COUNTS: dict[str, WordCounts] = {}


def text_tokens(texts: list[str | None], path: str) -> list[int]:
    counts = _COUNTS.get(path)
    if counts is None:
        counts = _COUNTS[path] = WordCounts(path)
    out = []
    for text in texts:
        out.append(counts.text(text))
        if len(counts) > MEMO_WORDS:
            counts.clear()
    return out


def count_tokens(df: DataFrame, vocabulary: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """The rows of df with n_bytes, n_tokens and over_limit (n_tokens > limit)."""

    @F.pandas_udf("long")
    def tokens(s: pd.Series) -> pd.Series:
        return pd.Series(text_tokens([x if isinstance(x, str) else None for x in s], vocabulary), dtype="int64")

    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return df.withColumns({"n_bytes": F.octet_length(whole).cast("long"), "n_tokens": tokens(whole)}).withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")
