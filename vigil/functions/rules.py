"""Rule tables as data, compiled to column expressions: first match, all matches, keyword categories, safety, fingerprints."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache, reduce
from operator import or_
from re import _parser as _regex

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    pattern: str  # case-insensitive
    label: str
    group: str = ""  # a coarser class of the label
    concepts: tuple[str, ...] = ()  # terms that the label stands for


def _better(a: list[str] | None, b: list[str] | None) -> list[str] | None:
    """The set of literals that a text is less likely to contain: the one whose shortest is longer, then the smaller one."""
    if not a or not b:
        return a or b
    return max(a, b, key=lambda x: (min(map(len, x)), -len(x)))


def _needed(nodes) -> list[str] | None:
    best, run = None, ""
    for op, arg in [*nodes, (None, None)]:
        if op == _regex.LITERAL:
            run += chr(arg).lower()
            continue
        best, run = _better(best, [run] if run else None), ""
        if op == _regex.SUBPATTERN:
            best = _better(best, _needed(arg[-1]))
        elif op in (_regex.MAX_REPEAT, _regex.MIN_REPEAT) and arg[0] > 0:
            best = _better(best, _needed(arg[2]))
        elif op == _regex.BRANCH:
            each = [_needed(b) for b in arg[1]]
            if all(each):
                best = _better(best, sorted({x for e in each for x in e}))
    return best


@cache
def needed(pattern: str) -> tuple[str, ...]:
    """Lower-case literals of which every text that the pattern matches, in any case, contains one; none if there is no such set."""
    return tuple(_needed(_regex.parse(pattern)) or ())


def found(c: Column, pattern: str, low: Column | None = None) -> Column:
    """Whether a pattern matches in any case. low: the text in lower case, in which the pattern's literals are looked for first, as that costs far less."""
    hit = c.rlike(f"(?i){pattern}")
    words = needed(pattern)
    if low is None or not words:
        return hit
    return reduce(or_, [F.contains(low, F.lit(w)) for w in words]) & hit


def _hits(c: Column, rule: Rule, low: Column | None = None) -> Column:
    return found(c, rule.pattern, low)


def first_match(c: Column, rules: list[Rule], default: str | None = "Unknown", low: Column | None = None) -> Column:
    out = None
    for r in rules:
        out = F.when(_hits(c, r, low), r.label) if out is None else out.when(_hits(c, r, low), r.label)
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def all_matches(c: Column, rules: list[Rule], low: Column | None = None) -> Column:
    """Labels of all rules that match, in rule order, each once."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(_hits(c, r, low), r.label) for r in rules])))


def evidence(c: Column, rules: list[Rule]) -> Column:
    """The words that the first matching rule matched, or null."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        out = F.when(_hits(c, r), F.regexp_extract(c, f"(?i)({r.pattern})", 1)).otherwise(out)
    return out


def first_hit(c: Column, rules: list[Rule], low: Column | None = None) -> Column:
    """label, group and phrase (the words matched) of the first rule that matches; null if none does."""
    out = None
    for r in rules:
        group = F.lit(r.group or None).cast("string")
        hit = F.struct(F.lit(r.label).alias("label"), group.alias("group"), F.regexp_extract(c, f"(?i){r.pattern}", 0).alias("phrase"))
        out = F.when(_hits(c, r, low), hit) if out is None else out.when(_hits(c, r, low), hit)
    return out


def concepts(c: Column, rules: list[Rule], low: Column | None = None) -> Column:
    """The concepts of all rules that match, in rule order, each once."""
    return F.array_distinct(F.flatten(F.array_compact(F.array(*[F.when(_hits(c, r, low), F.array(*map(F.lit, r.concepts))) for r in rules if r.concepts]))))


def matches(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(f"(?i){pattern}"), F.lit(False))


def category_conflict(c: Column, original: Column, lexicon: dict[str, list[str]]) -> Column:
    """Whether the text speaks for another category and not at all for the original one."""
    padded = F.concat(F.lit(" "), F.lower(c), F.lit(" "))
    inferred = keyword_category(c, lexicon)
    own = F.lit(0)
    for k, words in lexicon.items():
        own = F.when(original == k, sum((F.contains(padded, F.lit(w)).cast("int") for w in words), F.lit(0))).otherwise(own)
    return F.coalesce(inferred.isNotNull() & (inferred != original) & (own == 0), F.lit(False))


def parse_answer(field: Column, answer: Column, choices: dict[str, str], tables: dict[str, list[Rule]]) -> Column:
    """An answer to a clarifying question as a value of its field: a listed choice, else a rule's label, else 'no ...' for triggers; else null."""
    a = F.trim(answer)
    out = F.try_element_at(F.create_map(*[F.lit(x) for kv in choices.items() for x in kv]), F.lower(a))
    by_rule = F.lit(None).cast("string")
    for name, rules in tables.items():
        by_rule = F.when(field == name, first_match(a, rules, None)).otherwise(by_rule)
    nothing = F.when((field == "trigger") & F.lower(a).startswith("no"), F.lit("no recent change"))
    return F.when(a != "", F.coalesce(out, by_rule, nothing))


def keyword_category(c: Column, lexicon: dict[str, list[str]]) -> Column:
    """The category with the most keywords in ' text '; the first of equals; null if no keyword occurs."""
    padded = F.concat(F.lit(" "), F.lower(c), F.lit(" "))
    counts = {k: sum((F.contains(padded, F.lit(w)).cast("int") for w in words), F.lit(0)) for k, words in lexicon.items()}
    best = F.greatest(*counts.values())
    out = F.when(best == 0, F.lit(None).cast("string"))
    for k, n in counts.items():
        out = out.when(n == best, k)
    return out


def keyword_level(c: Column, levels: list[tuple[str, list[str]]]) -> Column:
    low, out = F.lower(c), None
    for label, words in levels:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def fingerprint(c: Column, tables: dict[str, list[Rule]], fallback: dict[str, Column] | None = None, taint: Column | None = None) -> Column:
    """One struct per field with value, provenance and evidence: from the text by rules, else from a fall-back column.

    A value from synthetic text is synthetic itself; a fall-back is derived; else the field is Unknown and missing.
    """
    fields = []
    for name, rules in tables.items():
        value = first_match(c, rules, None)
        other = (fallback or {}).get(name, F.lit(None).cast("string"))
        origin = F.when(value.isNotNull(), F.when(taint, "synthetic").otherwise("derived") if taint is not None else F.lit("derived")).when(other.isNotNull(), "derived").otherwise("missing")
        fields.append(F.struct(F.coalesce(value, other, F.lit("Unknown")).alias("value"), origin.alias("provenance"), evidence(c, rules).alias("evidence")).alias(name))
    return F.struct(*fields)


def safety(c: Column, destructive: str, disruptive: str, sources: Column, needed: int = 2) -> Column:
    """kind, allowed, confirm and notes: destructive actions need several independent sources, and nothing is allowed on none."""
    bad, rough = matches(c, destructive), matches(c, disruptive)
    kind = F.when(bad, "destructive").when(rough, "disruptive").otherwise("routine")
    allowed = (sources > 0) & (~bad | (sources >= needed))
    notes = F.array_compact(
        F.array(
            F.when(bad & (sources < needed), "too few sources for a destructive action"), F.when(bad & (sources >= needed), "confirm and back up before a destructive action"),
            F.when(rough, "agree on a window for a disruptive action"), F.when(sources == 0, "no historical grounding"),
        )
    )
    return F.struct(kind.alias("kind"), allowed.alias("allowed"), (bad | rough).alias("confirm"), notes.alias("notes"))


def specificity(known_fields: Column, n_tokens: Column) -> Column:
    return F.least(F.lit(1.0), known_fields / 5 + F.least(n_tokens, F.lit(20)) / 40)
