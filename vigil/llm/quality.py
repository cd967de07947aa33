"""Operator 6, quality rules, with DataFrame functions only: line-first cleaning, then document rejection.

Method: each line with a word is judged on its own by punctuation, shouting, navigation and boilerplate rules;
failing lines are removed; a document that loses too large a share of its words is rejected. Before that, base
rules reject documents with too few words or too many words in repeated five-word windows.

Everything is one projection over the scan: arrays and higher-order functions, no shuffle and no Python. Repeated
windows are found by sorting a text's (window hash, position) pairs, O(n log n) in its words; the hashes have 64
bits and are only compared within one text.

Defined cases: a null or empty text has no words and lines, so it fails the base rules; a text of any length is
judged whole; repeated rows are judged alike; an empty table gives an empty result; columns of the input stay, and
one that has the name of an output column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.shared import SEPARATORS, WORD

MIN_WORDS, WINDOW, MAX_REPEATED, MAX_LOST, MAX_MARKED = 10, 5, 0.2, 0.6, 0.3
SYMBOLS = "#*$%&|<>"
_W = r"[^\x20\x09-\x0D]*"
#: Words that carry a symbol or a doubled exclamation mark.
MARKED = rf"{_W}(?:[#*$%&|<>]|!!){_W}"
SEPARATOR = r" [|>/»›•·] "
MENU = r"(?i)^\s*(?:home|menu|login|log in|sign in|sign up|search|contact|contact us|about|about us|next|previous|share|tweet|skip to content|back to top)\s*$"
BOILERPLATE = (
    r"(?i)all rights reserved|cookies? (?:policy|settings|notice)|use of cookies|privacy policy|terms of (?:use|service)"
    r"|licensed under|released under the|copyright|©|enable javascript|lorem ipsum|subscribe to|click here|read more"
)


#: Phrases of which at least one is in any text that BOILERPLATE matches, lower-cased; a quick look ahead of the pattern.
_HINTS = ("all rights", "cookie", "privacy policy", "terms of", "licensed", "released under", "copyright", "©", "enable java", "lorem ip", "subscribe", "click here", "read more")


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | F.contains(text, F.lit(p))
    return found


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SEPARATORS, -1), lambda w: w != "")


def _line_fails(line: Column) -> Column:
    """The rules on a line. __marks, __bars and __phrases say whether the whole text can have what a rule looks for."""
    words = F.regexp_count(line, F.lit(WORD))
    marked = F.col("__marks") & (F.regexp_count(line, F.lit(MARKED)) * 10 >= words * 3)
    shouted = ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}") & (words >= 3)
    separators = F.regexp_count(line, F.lit(SEPARATOR))
    navigation = (F.col("__bars") & (separators >= 2) & (separators * 4 >= words)) | line.rlike(MENU)
    return marked | shouted | navigation | (F.col("__phrases") & line.rlike(BOILERPLATE))


def _window_hash(hashes: Column, i: Column) -> Column:
    return F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])


def _starts(hashes: Column) -> Column:
    """0 to the last window's start; null if there is one window or none."""
    last = F.size(hashes) - WINDOW
    return F.when(last >= 1, F.sequence(F.lit(0), F.greatest(last, F.lit(0))))


def _covered(windows: Column) -> Column:
    """From sorted (h, p): how many words the windows with an equal neighbour cover."""
    same = lambda i, k: F.coalesce(F.get(windows, i)["h"] == F.get(windows, i + k)["h"], F.lit(False))
    at = F.filter(F.sequence(F.lit(0), F.size(windows) - 1), lambda i: ((i > 0) & same(i, -1)) | same(i, 1))
    starts = F.array_sort(F.transform(at, lambda i: F.get(windows, i)["p"]))
    first = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    total = F.aggregate(starts, first, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")), lambda a: a["n"])
    return F.coalesce(F.when(windows.isNotNull(), total), F.lit(0)).cast("long")


#: The columns that judging adds; an input column of such a name is replaced.
OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words", "base_failed", "kept", "cleaned")


def _judged(df: DataFrame, text: str) -> DataFrame:
    """__doc, a struct of all columns of df, and the columns of OUT. As df's own columns are in the struct, none can clash."""
    c = F.coalesce(F.col("__raw").cast("string"), F.lit(""))
    df = df.select(F.struct(*[F.col(f"`{x}`") for x in df.columns]).alias("__doc"), F.col(f"`{text}`").alias("__raw"))
    df = df.withColumns({"__hashes": F.transform(_words(c), lambda w: F.xxhash64(w)), "__lines": F.filter(F.split(c, "\n", -1), lambda x: x.rlike(WORD)), "__text": c, "__low": F.lower(c)})
    marks, bars = tuple([*SYMBOLS, "!!"]), tuple(f" {x} " for x in "|>/»›•·")
    df = df.withColumns({"__windows": F.transform(_starts(F.col("__hashes")), lambda i: _window_hash(F.col("__hashes"), i)), "__phrases": _any(F.col("__low"), _HINTS), "__marks": _any(F.col("__text"), marks), "__bars": _any(F.col("__text"), bars)})
    # Only texts with a repeated window have the pairs sorted; for others the set of hashes says so in linear time.
    pairs = F.transform(F.sequence(F.lit(0), F.size("__windows") - 1), lambda i: F.struct(F.get("__windows", i).alias("h"), i.alias("p")))
    repeated = F.size(F.array_distinct("__windows")) < F.size("__windows")
    df = df.withColumns({"__sorted": F.when(repeated, F.array_sort(pairs)), "__bad": F.filter("__lines", _line_fails)})
    count = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.regexp_count(x, F.lit(WORD)))
    df = df.withColumns(
        {
            "n_words": F.size("__hashes").cast("long"),
            "word_chars": (F.length("__text") - F.regexp_count("__text", F.lit(SEPARATORS.removesuffix("+")))).cast("long"),
            "n_symbols": F.when(F.col("__marks"), F.regexp_count("__text", F.lit(f"[{SYMBOLS}]"))).otherwise(F.lit(0)).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": _covered(F.col("__sorted")),
            "n_lost_words": count(F.col("__bad")).cast("long"),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * round(100 * MAX_REPEATED))
    df = df.withColumn("base_failed", failed)
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("n_lost_words") * 10 <= F.col("n_words") * round(10 * MAX_LOST)))
    kept_lines = F.filter(F.split("__text", "\n", -1), lambda x: ~(x.rlike(WORD) & _line_fails(x)))
    df = df.withColumn("cleaned", F.when(F.size("__bad") == 0, F.col("__text")).otherwise(F.array_join(kept_lines, "\n")))
    return df.select("__doc", *OUT)


def judge(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the columns of OUT: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lost_words, base_failed, kept and cleaned.

    cleaned is the text without its failing lines; n_lost_words counts the words in those.
    """
    own = [F.col(f"__doc.`{c}`").alias(c) for c in df.columns if c not in OUT]
    return _judged(df, text).select(*own, *OUT)


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of df whose documents are kept, with their columns as they were."""
    # A filter on a projection is otherwise moved below it and into the functions on arrays, which are then
    # computed for every element; it doesn't pass a column that differs from run to run.
    judged = _judged(df, text).select("__doc", "kept", F.monotonically_increasing_id().alias("__stop"))
    return judged.filter(F.col("kept") & (F.col("__stop") >= 0)).select("__doc.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_words"]
    return judge(docs).select(*names)


def verdict_sql(documents: str = "documents") -> str:
    """The operator in DuckDB SQL, over a table with doc_id and text; doc_id must differ for every row."""
    line = lambda p: f"len(regexp_extract_all(l, '{p}'))"
    fails = (
        f"({line(MARKED)} * 10 >= {line(WORD)} * 3 OR ({line(WORD)} >= 3 AND regexp_matches(l, '\\p{{Lu}}') AND NOT regexp_matches(l, '\\p{{Ll}}'))"
        f" OR ({line(SEPARATOR)} >= 2 AND {line(SEPARATOR)} * 4 >= {line(WORD)}) OR regexp_matches(l, '{MENU}') OR regexp_matches(l, '{BOILERPLATE}'))"
    )
    return f"""
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lost_words, base_failed,
           NOT base_failed AND n_lost_words * 10 <= n_words * {round(10 * MAX_LOST)} AS kept
    FROM (
      SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {round(100 * MAX_REPEATED)} AS base_failed
      FROM (
        SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '{SEPARATORS}', '', 'g')) AS word_chars,
               length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols,
               len(real) - len(list_distinct(real)) AS n_dup_lines,
               coalesce(r.n, 0)::BIGINT AS n_repeat_words,
               coalesce(list_sum([{line(WORD)} FOR l IN real IF {fails}]), 0)::BIGINT AS n_lost_words
        FROM (
          SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
                 [l FOR l IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(l, '{WORD}')] AS real
          FROM {documents}) d
        LEFT JOIN (
          SELECT doc_id, sum(least({WINDOW}, p - coalesce(before, -{WINDOW}))) AS n
          FROM (
            SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before
            FROM (
              SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS times
              FROM (
                SELECT doc_id, unnest(range(1, len(w) - {WINDOW - 2})) AS p, unnest([w[i : i + {WINDOW - 1}] FOR i IN range(1, len(w) - {WINDOW - 2})]) AS g
                FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM {documents})))
            WHERE times > 1)
          GROUP BY doc_id) r USING (doc_id)))"""


SQL = verdict_sql()
