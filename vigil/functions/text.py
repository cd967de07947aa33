"""Text expressions: normalising, tokens, stems, sentences, chunks and masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning for search, and suffixes in the order in which they are tried.
STOPWORDS = (
    "a an the and or but if then else of to in on at by for with from as is are was were be been being it its this that these those"
    " i we you they he she my our your their me us them do does did done have has had not no so very can could would should will just"
    " also into after before when while than there here out up about all any some more most other such only own same too s t"
).split()
SUFFIXES = ("ations", "ation", "ing", "edly", "ed", "es", "s", "ly")


def normalize_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def stem(token: Column) -> Column:
    out = None
    for s in SUFFIXES:
        hit = (F.length(token) > len(s) + 3) & F.endswith(token, F.lit(s))
        cut = F.substring(token, F.lit(1), F.length(token) - len(s))
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(token)


def analyze(c: Column) -> Column:
    """Stemmed tokens of a text, without stop words and single characters."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.transform(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS)), stem)


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(r"\S+")), F.lit(0))


def sentences(c: Column) -> Column:
    return F.split(F.trim(c), r"(?<=[.!?])\s+")


def chunks(c: Column, threshold: int = 300, size: int = 200) -> Column:
    """The text as one chunk, or, over `threshold` words, sentences packed greedily up to `size` words."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def pack(a: Column, s: Column) -> Column:
        n = word_count(s)
        full = (a["n"] > 0) & (a["n"] + n > size)
        done = F.when(full, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"])
        text = F.when(full | (a["n"] == 0), s).otherwise(F.concat_ws(" ", a["open"], s))
        return F.struct(done.alias("done"), text.alias("open"), F.when(full, n).otherwise(a["n"] + n).alias("n"))

    packed = F.aggregate(sentences(c), empty, pack, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))
    return F.when(word_count(c) > threshold, packed).otherwise(F.array(F.trim(c)))


def header(**parts: Column) -> Column:
    """'Name: value | Name: value', leaving out nulls and Unknown."""
    return F.concat_ws(" | ", *[F.when(v != "Unknown", F.concat(F.lit(f"{k}: "), v)) for k, v in parts.items()])


def mask_codes(c: Column) -> Column:
    return F.regexp_replace(c, r"\b[A-Z]{2,4}\d{5,6}\b", "the system")


def citations(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\[([A-Z]{2,4}-?\d{4,7})\]"), F.lit(1))


#: Where a resolution note is cut into clauses; the last part takes the stop at the end.
_CLAUSES = r"(?<=[.;:])\s+|,\s+(?:and\s+)?|\s+by\s+|\s+(?:and|then)\s+(?=\w+(?:ed|ing)\b)|\.\s*$"
_OBSERVED = r"(?<=[.;])\s+|,\s+(?:and\s+)?|;\s*"


def _stripped(parts: Column, edge: str) -> Column:
    cut = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, f"^[{edge}]+", ""), f"[{edge}]+$", ""))
    return F.filter(cut, lambda p: p != "")


def action_clauses(note: Column, action: str) -> Column:
    """The clauses of a note that say what was done; clauses of causes are dropped."""
    parts = _stripped(F.split(F.coalesce(note, F.lit("")), _CLAUSES), " .;,:")
    return F.filter(parts, lambda p: p.rlike(f"(?i){action}"))


def action_summary(note: Column, action: str, size: int = 160) -> Column:
    """The first action clause, capitalised; without one the first sentence; cut to size."""
    acts = action_clauses(note, action)
    first = F.get(acts, 0)
    sentence = F.get(F.filter(F.transform(F.split(F.replace(note, F.lit(";"), F.lit(".")), r"\."), F.trim), lambda s: s != ""), 0)
    return F.substring(F.coalesce(F.concat(F.upper(F.substring(first, 1, 1)), F.substring(first, 2, size)), sentence, note), 1, size)


def observation(note: Column, observe: str) -> Column:
    """The last clause that says what was seen afterwards, capitalised; null if none does."""
    parts = _stripped(F.split(F.coalesce(note, F.lit("")), _OBSERVED), " .;,")
    last = F.try_element_at(F.filter(parts, lambda p: p.rlike(f"(?i){observe}")), F.lit(-1))
    return F.concat(F.upper(F.substring(last, 1, 1)), F.substring(last, 2, 1_000_000))


def mask_entities(c: Column, ci_name: Column | None, services: list[str]) -> Column:
    """The configuration item's name becomes 'the system', names of services, the longest first, 'the service'."""
    import re

    c = F.coalesce(c, F.lit(""))
    if ci_name is not None:
        c = F.when(ci_name.isNotNull() & (ci_name != ""), F.replace(c, ci_name, F.lit("the system"))).otherwise(c)
    if services:
        c = F.regexp_replace(c, "(?i)(?:" + "|".join(re.escape(s) for s in sorted(services, key=lambda s: (-len(s), s))) + ")", "the service")
    return c


def paraphrase(c: Column, replacements: list[tuple[str, str]], style: Column, words: int = 10) -> Column:
    """The first sentence of a text with codes masked; lay and vague styles have words replaced in order, vague ones are cut to some words."""
    first = F.get(F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"\b[A-Z]{2,4}\d{5,6}\b", "the server"), r"(?<=[.!?])\s+"), F.trim), lambda s: s != ""), 0)
    plain = F.coalesce(first, F.lit(""))
    lay = plain
    for pattern, word in replacements:
        lay = F.regexp_replace(lay, f"(?i){pattern}", word)
    short = F.array_join(F.slice(F.filter(F.split(lay, r"\s+"), lambda w: w != ""), 1, words), " ")
    return F.when(style == "vague", short).when(style == "lay", lay).otherwise(plain)


def render(template: str, **values: Column) -> Column:
    """A template whose {names} are replaced; the words of a name that is null are left out with their space."""
    import re

    words = []
    for word in template.split(" "):
        m = re.fullmatch(r"([^{]*)\{(\w+)\}(.*)", word)
        words.append(F.concat(F.lit(m[1]), values[m[2]], F.lit(m[3])) if m else F.lit(word))
    return F.concat_ws(" ", *words)


def json_in_prose(c: Column) -> Column:
    """The JSON object in a reply, from its first opening brace to its last closing one, else the array likewise; null if neither parses.

    A reply that begins with a code fence is read inside it.
    """
    s = F.trim(c)
    inside = F.regexp_replace(F.regexp_replace(s, r"^[^\n]*\n", ""), r"(?s)```(?!.*```).*$", "")
    s = F.when(s.startswith("```"), inside).otherwise(s)

    def between(opener: str, closer: str) -> Column:
        first = F.instr(s, opener)
        last = F.length(s) - F.instr(F.reverse(s), closer) + 1
        part = F.when((first > 0) & F.contains(s, F.lit(closer)) & (last > first), F.substring(s, first, last - first + 1))
        return F.when(F.try_parse_json(part).isNotNull(), part)

    return F.coalesce(between("{", "}"), between("[", "]"))


def clip(c: Column, size: int) -> Column:
    """One line of at most so many characters: white space is one space; what is longer ends in three dots. Null is the empty line."""
    line = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(F.length(line) <= size, line).otherwise(F.concat(F.rtrim(F.substring(line, 1, size - 3)), F.lit("...")))


def looks_like_key(c: Column) -> Column:
    """Whether a setting could be an access key: one word of visible ASCII that doesn't start as a comment."""
    return F.coalesce(F.trim(c).rlike(r"^[\x21\x22\x24-\x7E][\x21-\x7E]*$"), F.lit(False))
