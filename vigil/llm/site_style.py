"""Operator 4, HTML extraction with a site style tree.

Method: every page becomes a DOM whose nodes are named by their style path, the tags, classes and ids from the root.
The DOMs of a host are merged into one style tree: for each style node, on how many pages it stands, how evenly
its presentations (the sequences of child styles) spread over those pages, and how evenly each content feature (a text
block) spreads. Presentation importance is the entropy of the presentations to the base of the number of pages;
content importance is one minus the mean entropy of the features: text that stands on all pages alike has entropy 1
and importance 0, text of a single page entropy 0 and importance 1. A node's importance is the larger of
the two for inner nodes and the content's for leaves. It is low if it is under LOW on MIN_PAGES different pages or more, or if, on
a host of MANY different pages or more, the node's texts stand on REPEATED pages each or more in the geometric mean. The text that
stands directly in a node of low importance is removed from each page; what stands in nodes below it is judged by those
nodes, so a branch goes only if all of its nodes are low. Inline elements without class or id belong to the text around them.

Tags and names are the prior for what no entropy can tell, as comments and adverts differ from page to page. Tags of menus,
footers, asides and forms, and names of adverts, comments, consent and navigation remove a branch. Weak names (notice, side, related,
meta and the like) remove it unless the tree overrules them: on a host of MANY pages or more, a branch whose whole text
stands on less than OVERRULED pages in the geometric mean is content and stays. If a page has an article or main element outside
removed branches, its text is what is inside, and there the tree judges as elsewhere; articles named as comments, replies or adverts
are removed branches themselves. Pages of a host with the same text before the tree is applied count as one, so copies
don't remove each other.

Each page's features are packed into one value, and one page of each (host, text) stays, combined before the shuffle.
The tree is then aggregated with map-side partial sums per (host, path, feature), so a host with a third of all
pages reaches no task as a group; low-importance nodes of a host, bounded by its templates, not its pages, go
into one row that joins back by host, where both sides are shuffled and a hot host is split by adaptive execution.

Defined cases: null or empty html gives an empty text; broken markup is read leniently, with unclosed elements
closed by their parents; a null url is a host of its own; repeated rows give equal texts; pages of any length are
read whole; an empty table gives an empty result; columns stay, and one with an output's name is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from math import log2

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.shared import Work

LOW, MIN_PAGES, MANY, REPEATED, OVERRULED = 0.2, 3, 20, 2.0, 1.1
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp")
_NO_TEXT = frozenset(("script", "style", "noscript", "template", "iframe", "head", "title", "svg", "canvas", "object", "math"))
_NOISE = frozenset("nav footer aside form menu dialog button select option input textarea label fieldset".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split()
)
#: Open elements that a tag closes before it opens.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_LIMITS = frozenset("article body div section main ul ol table dl select td th nav aside header footer form".split())
_ENDS_P = _BLOCK - {"br", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "body", "html"}
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|popup|modal|newsletter|subscribe|subscription"
    r"|nav\w*|menu\w*|breadcrumbs?|sidebar|footer|topbar|toolbar|share|sharing|social|comments?|disqus"
    r"|replies|respond|login|signup|search|pagination|pager|copyright)(?:$|[\s_-])",
    re.I,
)
#: Names that content has, too, now and then.
_WEAK = re.compile(r"(?:^|[\s_-])(?:notices?|alert|side|widget\w*|foot|header|masthead|related|recommend\w*|legal|disclaimer|skip|tags?|byline|meta)(?:$|[\s_-])", re.I)
#: Classes and ids of articles that aren't the page's.
_LESSER = re.compile(
    r"(?:^|\s)(?:(?:user|blog|post)?[_-]?comments?(?:[_-]?(?:item|body|content|entry|text|list|wrapper|\d+))?|repl(?:y|ies)|responses?|disqus\w*|related(?:[_-](?:posts?|articles?|stor(?:y|ies)|items?))?"
    r"|recommend\w*|teaser|sponsor\w*|promo\w*|ads?|advert\w*)(?:$|\s)",
    re.I,
)
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.S)
_SPACES = re.compile(r"\s+")


class Node:
    __slots__ = ("children", "noise", "parent", "path", "style", "tag", "unit", "weak")

    def __init__(self, tag: str, style: str, parent: Node | None, noise: bool, weak: bool = False):
        self.tag, self.style, self.parent, self.noise, self.weak, self.children = tag, style, parent, noise, weak, []
        self.path = xxhash.xxh3_64_intdigest(style.encode("utf-8", "replace"), parent.path if parent else 0)
        # The node that its text is judged with.
        self.unit = self if parent is None or tag in _BLOCK or style != tag else parent.unit


def parse(html: str) -> Node:
    """The DOM: children are nodes and strings."""
    root = Node("", "", None, False)
    here, at, n = root, 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        text = html[at : m.start() if m else n]
        if text:
            here.children.append(unescape(text))
        if not m:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            node = here
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root:
                here = node.parent
            continue
        if tag in _ENDS_P or tag in _CLOSES:
            node, wanted = here, _CLOSES.get(tag, ()) + (("p",) if tag in _ENDS_P else ())
            while node is not root and node.tag not in _LIMITS.difference(wanted):
                if node.tag in wanted:
                    here = node.parent
                    break
                node = node.parent
        attrs = {a.lower(): x or y or z for a, x, y, z in _ATTR.findall(m[3])} if m[3] and "=" in m[3] else {}
        names = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip()
        role = attrs.get("role", "")
        named = names != "" and tag not in ("html", "body", "article", "main")
        noise = tag in _NOISE or (named and bool(_NAMES.search(names))) or role in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert")
        if tag in ("article", "main") and names and _LESSER.search(names):
            noise = True
        if tag == "header" and not noise:
            node = here
            while node is not root and node.tag not in ("article", "main"):
                node = node.parent
            noise = node is root
        hidden = "hidden" in (m[3] or "").lower().split() or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
        node = Node(tag, f"{tag}.{names}" if names else tag, here, noise or hidden, named and bool(_WEAK.search(names)))
        here.children.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{tag}[\s>/]", re.I).search(html, at)
            if tag == "textarea" or tag == "title" or tag == "xmp":
                node.children.append(unescape(html[at : end.start() if end else n]))
            at = end.start() if end else n
            here = node
        elif tag not in _VOID and not (m[3] or "").endswith("/"):
            here = node
    return root


def _features(node: Node, out: list[tuple[int, int, int]]) -> None:
    """Per style node of a page: (path, 0 for its presentation, 1 for a text, 2 for the whole text of a branch with a weak name; hash)."""
    stack: list = [(node, node)]
    texts: dict[Node, list[str]] = {}
    while stack:
        x, unit = stack.pop()
        if isinstance(x, str):
            texts.setdefault(unit, []).append(x)
            continue
        if x.noise or x.tag in _NO_TEXT:
            continue
        if x.weak:
            text = "\0".join(_blocks(x, everything=True))
            if text:
                out.append((x.path, 2, xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"))))
        if x.unit is x:
            styles = [c.style for c in x.children if isinstance(c, Node)]
            out.append((x.path, 0, xxhash.xxh3_64_intdigest("\0".join(dict.fromkeys(styles)).encode("utf-8", "replace"))))
        stack += [(c, x.unit) for c in reversed(x.children)]
    for x, parts in texts.items():
        text = _SPACES.sub(" ", "".join(parts)).strip()
        if text:
            out.append((x.path, 1, xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"))))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


_FEATURE = np.dtype([("path", "<u8"), ("kind", "u1"), ("feature", "<u8")])


def _pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per page: host, digest of its text and packed features."""
    for f in frames:
        rows = []
        for host, html in zip(f["host"], f["html"]):
            root, found = parse(html or ""), []
            _features(root, found)
            text = "\0".join(_blocks(root))
            rows.append((host, xxhash.xxh3_128_digest(text.encode("utf-8", "replace")), np.array(sorted(set(found)), _FEATURE).tobytes()))
        yield pd.DataFrame(rows, columns=["host", "digest", "features"])


def _merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial style trees: per host, path, kind and feature, on how many pages it stands."""
    for f in frames:
        tree: Counter = Counter()
        for host, packed in zip(f["host"], f["features"]):
            for path, kind, feature in np.frombuffer(packed, _FEATURE).tolist():
                tree[host, path, kind, feature] += 1
        if tree:
            yield pd.DataFrame([(h, _signed(p), k, _signed(v), n) for (h, p, k, v), n in tree.items()], columns=["host", "path", "kind", "feature", "pages"])


def importance(pages: DataFrame, once: bool = False) -> DataFrame:
    """pages: host, html. Per host and path: m (pages; with once, those of different text), presentation and content importance.

    A feature stands on each of its k pages once, so its entropy to the base m is log(k) / log(m); presentations are
    one of several on each page, so theirs is that of their shares.
    """
    schema = "host string, path long, kind int, feature long, pages long"
    packed = pages.mapInPandas(_pack, "host string, digest binary, features binary")
    if once:
        packed = packed.groupBy("host", "digest").agg(F.min("features").alias("features"))
    each = packed.select("host", "features").mapInPandas(_merge, schema).groupBy("host", "path", "kind", "feature").agg(F.sum("pages").alias("k"))
    node = each.groupBy("host", "path").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("k"))).alias("m"),
        F.sum(F.when(F.col("kind") == 0, F.col("k") * F.log2(F.col("k").cast("double")))).alias("klogk"),
        F.avg(F.when(F.col("kind") == 1, F.log2(F.col("k").cast("double")))).alias("logk"),
        F.avg(F.when(F.col("kind") == 2, F.log2(F.col("k").cast("double")))).alias("branch"),
    )
    log_m = F.log2(F.col("m").cast("double"))
    presentation = F.when(F.col("m") > 1, 1 - F.col("klogk") / (F.col("m") * log_m)).otherwise(F.lit(1.0))
    content = F.when(F.col("m") > 1, 1 - F.col("logk") / log_m).otherwise(F.lit(1.0))
    return node.select("host", "path", "m", presentation.alias("presentation"), content.alias("content"), "logk", "branch")


def style_trees(pages: DataFrame) -> DataFrame:
    """pages: host, html. host; low: the style paths whose importance is low; high: those with a weak name that are content."""
    tree = importance(pages, once=True)
    value = F.when(F.col("content").isNull(), F.lit(1.0)).otherwise(F.greatest("content", "presentation"))
    low = ((F.col("m") >= MIN_PAGES) & (value < LOW)) | ((F.col("m") >= MANY) & (F.col("logk") >= log2(REPEATED)))
    high = (F.col("m") >= MANY) & (F.col("branch") < log2(OVERRULED))
    paths = lambda c: F.sort_array(F.collect_set(F.when(c, F.col("path"))))
    return tree.filter(low | high).groupBy("host").agg(paths(low).alias("low"), paths(high).alias("high"))


def blocks(html: str | None, low: frozenset[int] = frozenset(), high: frozenset[int] = frozenset()) -> list[str]:
    """The texts of a page's blocks in page order, without the branches that are noise, those of weak names not in high, and the texts of nodes whose paths are in low."""
    return _blocks(parse(html), low, high) if html else []


def _blocks(root: Node, low: frozenset[int] = frozenset(), high: frozenset[int] = frozenset(), everything: bool = False) -> list[str]:
    """With everything, as if root were the page's article and no name were weak."""

    def out_of(x: Node) -> bool:
        return x.noise or x.tag in _NO_TEXT or (x.weak and not everything and _signed(x.path) not in high)

    articles, stack = False, [] if everything else [root]
    while stack and not articles:
        x = stack.pop()
        if not out_of(x):
            articles = x.tag in ("article", "main")
            stack += [c for c in x.children if isinstance(c, Node)]
    out: list[str] = []
    part: list[str] = []

    def close():
        text = _SPACES.sub(" ", "".join(part)).strip()
        if text:
            out.append(text)
        part.clear()

    work: list = [(root, False, False)]
    while work:
        x, inside, gone = work.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            if not gone and (inside or not articles):
                part.append(x)
        elif not out_of(x):
            inside = inside or x.tag in ("article", "main")
            gone = _signed(x.unit.path) in low
            if x.tag in _BLOCK:
                close()
                work.append((None, False, False))
            work += [(c, inside, gone) for c in reversed(x.children)]
    close()
    return out


def host_of(url: str):
    """The host in lower case, without user and port; null stays null."""
    return F.lower(F.regexp_extract(F.col(f"`{url}`").cast("string"), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extract(pages: DataFrame, url: str = "url", html: str = "html", out: str = "text") -> DataFrame:
    """pages with the main text."""
    # The page travels in a struct, so that none of its columns can clash.
    doc = F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("doc")
    rows = pages.select(doc, F.coalesce(host_of(url), F.lit("")).alias("host"), F.col(f"`{html}`").cast("string").alias("html"))
    trees = Work(pages.sparkSession, "pages").write(style_trees(rows.select("host", "html")), "style-trees")

    @F.pandas_udf("string")
    def main_text(texts: pd.Series, lows: pd.Series, highs: pd.Series) -> pd.Series:
        of = lambda paths: frozenset(paths) if paths is not None else frozenset()
        return pd.Series([" ".join(blocks(t if isinstance(t, str) else None, of(low), of(high))) for t, low, high in zip(texts, lows, highs)], dtype="object")

    joined = rows.join(trees, "host", "left")
    return joined.select(*[F.col(f"doc.`{c}`").alias(c) for c in pages.columns if c != out], main_text("html", "low", "high").alias(out))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
