import html as h
import re

from vigil.llm import site_style as op


def plain_article(page):
    """The text of the one article, by regular expressions that fit the test pages only."""
    inner = re.search(r"<article>(.*?)(?:</article>|<footer|$)", page or "", re.S)
    parts = re.split(r"</?(?:p|h\d|br|li|ul|ol|div|table|tr|td)\b[^>]*>", inner[1]) if inner else []
    return " ".join(x for x in (re.sub(r"\s+", " ", h.unescape(re.sub(r"<[^>]*>", "", p))).strip() for p in parts) if x)


def test_query_on_whole_table(spark, sf):
    rows = op.op4_html_text(spark, sf).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == plain_article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_markup():
    page = """<html><head><title>t</title></head><body><header>top</header><nav><a>x</a></nav><article><header><h1>A &amp;
    B</h1></header><p>one<b> two</b>&nbsp;x<p>three <script>if (a < b) "</p>"</script>four<ul><li>f<li>g</ul><div class="share-bar">s</div>
    <div class="col shadow">kept</div><aside>no</aside><form>no</form><div id="comments"><p>me too</p></div></article><footer>f</footer></body>"""
    assert op.blocks(page) == ["A & B", "one two x", "three four", "f", "g", "kept"]
    assert op.blocks("a<br>b <!-- c --> d<p hidden>e</p><div style='display: none'>f</div>") == ["a", "b d"]
    assert op.blocks("<p>1 < 2 and <b>bold") == ["1 < 2 and bold"] and op.blocks(None) == [] and op.blocks("<") == ["<"]


SITE = "<body><div class=x><p>same on every page</p></div><div class=main><p>{}</p></div><div class=y>all alike</div></body>"


def test_tree_removes_what_a_site_repeats(spark):
    rows = [(i, "http://U@Site.example:80/p", SITE.format(f"story number {i} is its own")) for i in range(40)] + [(99, "http://lone.example/", SITE.format("lone")), (98, None, None), (97, "x", "")]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], "page_id long, url string, html string, text int, host int, low int, __host int, doc int")
    out = op.extract(df)
    assert set(out.columns) == set(df.columns) and {(r.host, r.low, r["__host"], r.doc) for r in out.collect()} == {(2, 3, 4, 5)}
    got = {r.page_id: r.text for r in out.collect()}
    assert all(got[i] == f"story number {i} is its own" for i in range(40))
    assert got[99] == "same on every page lone all alike" and got[98] == got[97] == ""


def test_repeated_loose_text_in_a_wrapper_leaves_what_is_below(spark):
    forms = {
        "a": ("<body>You are here: <div><p>{}</p></div></body>", "story {}"),
        "b": ("<body><div class=content>Welcome<article><p>{}</p></article></div></body>", "story {}"),
        "c": ("<body><div>Home <a>About</a></div><p>It costs <b>{}</b> a piece</p></body>", "It costs story {} a piece"),
    }
    rows = [(f"http://{h}.example/{i}", page.format(f"story {i}"), want.format(i)) for h, (page, want) in forms.items() for i in range(5)]
    df = spark.createDataFrame(rows, "url string, html string, want string")
    assert [(r.url, r.text) for r in op.extract(df).collect() if r.text != r.want] == []


def test_tree_works_inside_articles_and_copies_count_once(spark):
    page = "<body><nav>n{0}</nav><article><h1>Title {0}</h1><p>story {0}</p><div class=box>the same on all pages</div></article></body>"
    copies = "<body><nav>menu {0}</nav><article><p>one story</p><div class=box>in all copies</div></article></body>"
    rows = [("http://a.example/", page.format(i), f"Title {i} story {i}") for i in range(6)] * 3 + [("http://b.example/", copies.format(i), "one story in all copies") for i in range(20)]
    df = spark.createDataFrame(rows, "url string, html string, want string").repartition(4)
    assert [(r.url, r.text, r.want) for r in op.extract(df).collect() if r.text != r.want] == []


def test_articles_in_noise_or_for_comments_are_not_the_page():
    assert op.blocks("<aside><article>teaser</article></aside><div><p>story</p></div>") == ["story"]
    assert op.blocks("<div><p>story</p></div><article class='comment'>me too</article><article id=comment-7>yes</article>") == ["story"]
    assert op.blocks("<article class='post tag-news no-comments'>story</article><p>x</p>") == ["story"]


def test_importance_by_hand(spark):
    pages = spark.createDataFrame([("a", f"<p>{t}</p>") for t in ("x", "x", "y", "z")], "host string, html string")
    leaf = [r for r in op.importance(pages).collect() if r.presentation == 0.0 and r.content is not None]
    assert [(r.m, round(r.content, 6)) for r in leaf] == [(4, round(1 - (0.5 + 0 + 0) / 3, 6))]


def test_copies_of_an_article_keep_it(spark):
    page = "<body><nav>n</nav><article><p>one and the same story</p></article></body>"
    df = spark.createDataFrame([(i, "http://s.example/", page) for i in range(30)], "page_id long, url string, html string")
    assert {r.text for r in op.extract(df).collect()} == {"one and the same story"}
    assert op.extract(df.limit(0)).count() == 0


def test_very_long_and_deep_pages():
    assert op.blocks("<div>" * 50_000 + "x" + "</div>" * 50_000) == ["x"]
    assert len(op.blocks("<p>w</p>" * 100_000)) == 100_000


def test_repeated_rows_with_one_page_id(spark):
    df = spark.createDataFrame([(7, "http://a.example/", "<p>x</p>"), (7, "http://a.example/", "<p>x</p>"), (7, "http://a.example/", "<p>y</p>")], "page_id long, url string, html string")
    assert sorted(r.text for r in op.extract(df).collect()) == ["x", "x", "y"]


def pool(n):
    """Pages of one host whose strip and box texts come from a pool of seven; notes are each page's own."""
    page = "<body><div class=strip><ul><li>strip {1}</li></ul></div><article><p>story {0}</p><div class=box>box {1}</div><div class=related>note {0}</div><div class=legal>legal {1}</div></article></body>"
    return [("http://pool.example/", page.format(i, i % 7), f"story {i} note {i}") for i in range(n)]


def test_the_tree_decides_against_names_and_pools_of_templates(spark):
    rows = pool(60)
    df = spark.createDataFrame(rows, "url string, html string, want string")
    assert [(r.text, r.want) for r in op.extract(df).collect() if r.text != r.want] == []
    # Without the tree the texts are others: the box stays and the note goes.
    assert " ".join(op.blocks(rows[8][1])) == "story 8 box 1"
    few = spark.createDataFrame(rows[:2], "url string, html string, want string")
    assert {r.text for r in op.extract(few).collect()} == {"story 0 box 0", "story 1 box 1"}


def test_importance_equals_a_style_tree_by_brute_force(spark):
    from collections import Counter, defaultdict
    from html.parser import HTMLParser
    from math import log

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__()
            self.stack, self.nodes = [()], defaultdict(lambda: ([], []))  # path -> child styles, texts
            self.nodes[()] = ([], [])

        def handle_starttag(self, tag, attrs):
            style = ".".join([tag, *(v for k, v in attrs if k in ("class", "id"))])
            self.nodes[self.stack[-1]][0].append(style)
            self.stack.append((*self.stack[-1], style))
            self.nodes[self.stack[-1]]

        def handle_endtag(self, tag):
            self.stack.pop()

        def handle_data(self, data):
            self.nodes[self.stack[-1]][1].append(data)

    import random

    rng = random.Random(4)
    pages = []
    for i in range(9):
        pages.append(f"<body><div class='a'>top {rng.randrange(3)}</div><div class='b'><p>p {i}</p></div>{'<ul><li>x</li></ul>' if i % 2 else ''}<section>{rng.choice('uvw')}</section></body>")
    presented, texts = defaultdict(Counter), defaultdict(Counter)
    for page in pages:
        t = Tree()
        t.feed(page)
        for path, (styles, parts) in t.nodes.items():
            presented[path][tuple(dict.fromkeys(styles))] += 1
            if "".join(parts).strip():
                texts[path]["".join(parts)] += 1
    want = []
    for path, seen in presented.items():
        m = sum(seen.values())
        entropy = -sum(k / m * log(k / m, m) for k in seen.values())
        content = 1 - sum(log(k, m) for k in texts[path].values()) / len(texts[path]) if texts[path] else None
        want.append((m, round(entropy, 9), None if content is None else round(content, 9)))
    df = spark.createDataFrame([("h", p) for p in pages], "host string, html string")
    got = [(r.m, round(r.presentation, 9), None if r.content is None else round(r.content, 9)) for r in op.importance(df).collect()]
    key = lambda x: str(x)
    assert sorted((tuple(0.0 if v == 0 else v for v in x) for x in got), key=key) == sorted((tuple(0.0 if v == 0 else v for v in x) for x in want), key=key)
