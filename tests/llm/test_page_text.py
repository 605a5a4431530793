"""Main text of pages: parsing, what markup declares, what the style tree finds."""

import math
import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stagewise.llm import page_text as op

COLUMNS = "page_id long, url string, html string, text string, host long, node long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, 2) for r in rows], COLUMNS).repartition(3)


def texts(spark, rows, **kind):
    out = op.extract_text(frame(spark, rows), **kind).collect()
    assert all(r.n_chars == len(r.text) for r in out)
    return {r.page_id: r.text for r in out}


def alone(source):
    return op.main_text(op.Page(source), op.nothing)


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<p>one<br>two <b>three</b>four<p>five", "one two threefour\n\nfive"),
        ("<article><h1>T</h1><ul><li>a<li>b</ul></article><div>else</div>", "T\n\na\n\nb"),
        ("<main><header><h1>T</h1></header><p>x</p></main><header>site</header>", "T\n\nx"),
        ("<body class='has-sidebar'><nav>n</nav><div id=content><p>x</p></div><footer>f</footer>", "x"),
        ("<article><p>x</p><div class='comments'><p>c</p></div><article>reply</article><p>y", "x\n\ny"),
        ("<div class='post-header'><h1>T</h1></div><div class=site-header>s</div><p>x &lt;b&gt; &amp;amp; &eacute;&#233;&nbsp;&#x41;", "T\n\nx <b> &amp; éé A"),
        ("a &am b &amp c", "a &am b & c"),
        ("<p>x <span class=ad>buy</span> y</p><div role=search>s</div>", "x y"),
        ("<p>1 < 2 and 3 > 2</p><!-- <p>no</p> --><!doctype x><?php y ?></3>z", "1 < 2 and 3 > 2\n\nz"),
        ("<script>var a='</p><p>';</script><style>p{}</style><title>t</title><p title='a>b' it's>x</p><p alt=\"x>y>text", "x\n\ny>text"),
        ("<table><tr><td>a<td>b<tr><td>c</table><form>q</form>d", "a\n\nb\n\nc\n\nd"),
        ("<div class=cookie-notice>c</div><div class=adverb>kept</div><p class='x sharing'>s</p>", "kept"),
        ("<div><p>a</div>b</p>c", "a\n\nb\n\nc"),
        ("\t<p> a \n\f b c </p> \n", "a b c"),
        ("<script>never closed <p>x", ""),
        ("<article class=teaser>t</article><p>x", "x"),
        ("<nav>only</nav>", ""),
        ("<article><nav>n</nav></article><p>x</p>", "x"),
        ("<svg><text>s</text></svg><noscript>n</noscript><button>b</button>x<select><option>1<option>2</select>y", "xy"),
        ("plain", "plain"),
    ],
)
def test_parsing_and_declared_parts(source, want):
    assert alone(source) == want


def site(host, n, seed=0, article=True, notice="Read our other pages, they are good"):
    """Pages of a host with unnamed furniture around unique paragraphs."""
    chance, rows = random.Random(f"{host}{seed}"), []
    prose = lambda: " ".join(f"w{chance.randrange(900)}" for _ in range(30))
    for i in range(n):
        paragraphs = [prose() for _ in range(chance.randint(1, 5))]
        inner = f"<div class=k{i}>{notice}</div>" + "".join(f"<p>{x}</p>" for x in paragraphs)
        inner = f"<article>{inner}</article>" if article else f"<div class=c>{inner}</div>"
        furniture = "<div class=top><i>Home News Sport</i></div>", f"<section class=q><p>Page {i} of {n}</p></section>"
        rows.append((f"https://{host}/p/{i}?x=1", f"<body>{furniture[0]}{inner}{furniture[1]}</body>", "\n\n".join(paragraphs)))
    return rows


def numbered(pages):
    return [(i, url, source) for i, (url, source, _) in enumerate(pages)], {i: want for i, (_, _, want) in enumerate(pages)}


@pytest.mark.parametrize("small", [op.SMALL_ROWS, 0])
@pytest.mark.parametrize("article", [True, False])
def test_tree_removes_what_a_host_repeats(spark, article, small):
    rows, want = numbered(site("a.org", 20, article=article) + site("B.org", 9, article=article, notice="Write to us"))
    assert texts(spark, rows, small=small) == want


def test_small_hosts_are_judged_by_all_pages(spark):
    pages = [page for i in range(12) for page in site(f"h{i}.org", 1)]
    rows, want = numbered(pages)
    assert texts(spark, rows) == want
    lone, _ = numbered(site("h.org", 1))
    assert texts(spark, lone)[0].startswith("Read our other pages")


def test_copies_of_an_article_are_no_template(spark):
    same = site("a.org", 1)[0]
    rows = [(i, f"http://a.org/{i}", same[1].replace("Home", f"Home{i}")) for i in range(30)]
    got = texts(spark, rows)
    assert all(same[2] in text for text in got.values())


def test_importance_by_hand(spark):
    rows, _ = numbered(site("a.org", 12) + site("b.org", 10, article=False))
    seen, styles, pages = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for i, url, source in rows:
        for node, kind, value, n in op.marks_of(op.Page(source))[1]:
            key = op.signed(op.host_of(url)), node
            if kind:
                seen[key].setdefault(value, [])
                seen[key][value].append(n)
            else:
                styles[key][value] += 1
                pages[key].add(i)
    want = {}
    for key, found in seen.items():
        m = len(pages[key])
        entropy = lambda ps: -sum(p * math.log(p, m) for p in ps)  # noqa: E731, B023
        shown = entropy([n / m for n in styles[key].values()])
        said = 1 - sum(entropy([n / sum(ns) for n in ns]) for ns in found.values()) / len(found)
        weight = op.GAMMA ** len(styles[key])
        want[key] = (m, (1 - weight) * shown + weight * said)
    got = {(r.host, r.node): (r.m, r.importance) for r in op.importance(op.tree(frame(spark, rows)), "host", "node").collect()}
    assert got.keys() == want.keys()
    for key, (m, value) in want.items():
        assert got[key][0] == m and got[key][1] == pytest.approx(value, abs=1e-9)


def test_tree_alone_finds_named_furniture_too(spark):
    pages = site("a.org", 20)
    rows = [(i, u, h.replace("<body>", "<body><nav><ul><li>Start</li><li>End</li></ul></nav>")) for i, (u, h, _) in enumerate(pages)]
    rows = [(i, u, h.replace("</body>", "<footer>All rights</footer></body>")) for i, u, h in rows]
    got = texts(spark, rows, declared=False)
    assert got == {i: want for i, (_, _, want) in enumerate(pages)}


def test_nulls_empty_pages_repeated_ids_and_an_empty_table(spark):
    rows = [(1, None, "<p>a"), (1, None, "<p>a"), (None, "", "<p>b"), (2**60 + 1, "x", None), (3, "http://a.org", ""), (4, "http://a.org", "<")]
    got = op.extract_text(frame(spark, rows))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in got.collect()), key=repr)
    assert found == sorted([(1, None, "a", 1), (1, None, "a", 1), (None, "", "b", 1), (2**60 + 1, "x", "", 0), (3, "http://a.org", "", 0), (4, "http://a.org", "<", 1)], key=repr)
    assert op.extract_text(frame(spark, [])).collect() == []
    assert texts(spark, rows[:1], small=0) == {1: "a"}


@pytest.mark.parametrize(
    "source",
    ["<div>" * 150_000, "<a '" * 200_000, "<p title=\"" * 100_000, "<b" * 300_000, "</div><td>" * 100_000, "&" * 500_000, "<!--" * 200_000, "x " * 1_500_000],
)
def test_long_pages_take_time_in_proportion(source):
    start = time.process_time()
    alone(source)
    assert time.process_time() - start < 8


def test_hosts():
    same = ["http://a.org/x", "https://A.ORG:80/y", "//a.org", "http://u:p@a.org?z", " http://a.org#b"]
    assert len({op.host_of(x) for x in same}) == 1
    assert op.host_of("https://b.org") != op.host_of("http://a.org")
    assert op.host_of(None) == op.host_of("") == op.host_of("mailto") == 0


def test_host_column(spark):
    urls = ["http://a.org/x", None, "", "x"]
    table = spark.createDataFrame([(x,) for x in urls], "url string")
    assert [r[0] for r in table.select(op._host_column(F.col("url"))).collect()] == [op.signed(op.host_of(x)) for x in urls]
