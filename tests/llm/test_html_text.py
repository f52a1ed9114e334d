"""Blocks, alignment and extraction of pages."""

import random
import time

import pytest

from lodestrata.llm import html_text


def text(page, other=None):
    return html_text.main_text(html_text.blocks(page), html_text.blocks(other) if other is not None else None)


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/x">Home</a></li></ul></nav><!-- <p>gone</p> --><div class="ad">Buy</div>
<div id="cookieNotice">We use cookies</div><article><h1>Head &lt;line&gt;</h1><p><b>One
 two<br>three<p>Fo<i>ur</i> &eacute;&#33;</p><aside>Side</aside><form><p>Mail</p></form><div class="reader-comments"><p>First!</p></div></article>
<footer>&copy; site</footer></body></html>"""


def test_article_of_a_page():
    assert text(PAGE) == "Head <line>\nOne two\nthree\nFour é!"


def test_edges():
    assert text(None) == text("") == text("<p> </p>") == text("<script>x") == ""
    assert text("plain a < b & c") == "plain a < b & c"
    assert text("<div class=ad>Buy<article><p>Kept</p></article>") == "Kept"
    assert text("<nav>Menu<p>x</nav><p>Kept</p><footer>end") == "Kept"
    assert text("<article><p>A<b>B</p><p>C</article>tail") == "AB\nC"
    assert text('<p title="a > b">Kept</p><p hidden>no</p><div role="navigation">no</div>') == "Kept"
    assert text("<p " + "x" * 50_000 + " 'unclosed>Kept</p>").endswith("Kept")
    assert text("<div>" * 30_000 + "deep") == "deep"


def test_differencing_removes_the_template_only():
    one = "<div>Home</div><div>About us</div><p>First story with many words of its own.</p><div>Imprint</div>"
    two = "<div>Home</div><div>About us</div><p>Second story, longer than all the rest of the page together.</p><div>Imprint</div>"
    assert text(one, two) == "First story with many words of its own."
    assert text(one, one) == text(one)
    art = "<article><p>Shared</p><p>Own text of this one page here.</p></article>"
    assert text(art, "<article><p>Shared</p><p>Other words, and more of them.</p></article>") == "Shared\nOwn text of this one page here."


def test_alignment_is_a_longest_common_subsequence():
    rnd = random.Random(7)
    for _ in range(300):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        got = html_text.common_subsequence(a, b)
        assert len(got) == best[-1][-1] and all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))


def test_nearest_pages_of_a_host(spark):
    body = lambda i: f"<div>Home</div><p>{' '.join(f'w{i}x{k}' for k in range(20))}</p><div>Imprint</div>"
    rows = [(i, f"http://{'abc'[i % 3]}.example/en/{i}?q=1", body(i), "z") for i in range(30)] + [(99, None, "<p>Alone</p>", "z"), (None, "http://d/", None, "z"), (3, "http://a.example/en/3?q=1", body(3), "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").coalesce(1)
    got = html_text.with_main_text(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert by[99] == "Alone" and by[None] == ""
    assert sum(by[i] == " ".join(f"w{i}x{k}" for k in range(20)) for i in range(30)) >= 27
    assert html_text.with_main_text(df.where("false")).count() == 0


def test_depth_has_no_limit():
    for n in (9_990, 10_010, 50_000):
        page = "<article>" + "<div>" * n + "<nav>menu</nav><p>deep</p>" + "</div>" * n + "<p>tail</p>"
        assert text(page) == "deep\ntail"
        assert text("<article>" + "<p>x" * n + "<aside>no</aside><p>last</article>").endswith("x\nlast")
        assert text("<article>" + "<div>" * n + "</span></p></i>" * n + "end") == "end"


def test_elements_that_end_by_themselves():
    assert text("<ul><li class=ad>buy<li>one<li class=promo>two<li>three</ul>") == "one\nthree"
    assert text("<table><tr><td class=ad>x<td>y<tr><td>z</table>") == "y\nz"
    assert text("<p class=notice>cookies<p>kept<div>more</div>") == "kept\nmore"
    assert text("<ul><li>a<ul><li class=ad>b</ul>c</ul>") == "a\nc"
    assert text("a<!-- b") == text("a<!-- <p>b</p>") == "a"
    assert text("a<p>b<script>var x = 1 > 0") == "a\nb"


def test_template_without_article_elements():
    """A short article in a long template: what the pages on both sides have goes, however much it is."""
    frame = lambda x: "".join(f"<div>Line {i} of the template</div>" for i in range(8)) + f"<p>{x}</p><div>Last line</div>"
    one, two, three = frame("Just a few words of this page."), frame("The other page says something else."), frame("And a third has its own text too.")
    assert text_of(two, one, three) == "The other page says something else."
    assert text_of(two, two, two) == text_of(two)


def text_of(*pages):
    return html_text.main_text(*map(html_text.blocks, pages))


def test_lines_inside_articles():
    """They go if all of four pages around have them, and not on the word of two."""
    art = lambda x: f"<article><p>Read our newsletter</p><p>{x}</p><p>Shared passage</p></article>"
    one, two = art("The first has its own long text, as articles do."), art("Another, with words of another kind and length.")
    three, four, five = (f"<article><p>Read our newsletter</p><p>{x} is alone with its words here.</p></article>" for x in "xyz")
    assert text_of(two, one, three, four, five) == "Another, with words of another kind and length.\nShared passage"
    assert text_of(two, one, three, four) == text_of(two, one) == text_of(two) == text_of(two, *[two] * 5)


@pytest.mark.parametrize("n", [300, 700])
def test_rows_are_made_again_on_the_way_back(n):
    rnd = random.Random(n)
    a, b = ([rnd.choice("ab") + "x" * rnd.randrange(3) for _ in range(n)] for _ in range(2))
    best = [0] * (n + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(best[j] + 1 if x == y else max(best[j + 1], row[j]))
        best = row
    got = html_text.common_subsequence(a, b)
    assert len(got) == best[-1] and all(a[i] == b[j] for i, j in got)


def test_repeated_lines_cost_no_more():
    rnd = random.Random(1)
    a, b = ([rnd.choice("ab") for _ in range(n)] for n in (8_000, 12_000))
    start = time.perf_counter()
    assert len(html_text.common_subsequence(a, b)) > 6_000
    assert time.perf_counter() - start < 5


def site(rnd, n=60):
    """(page_id, url, html, text): hosts with and without article elements, copies, equal URLs, nulls and repeated rows."""
    rows = []
    for i in range(n):
        host = rnd.choice("ab")
        mine = "".join(f"<p>{' '.join(rnd.choice('abcdefgh') * 3 for _ in range(rnd.randrange(1, 9)))}</p>" for _ in range(rnd.randrange(6)))
        frame = f"<div>Home {host}</div>{mine}<div>About</div><div>Contact</div>"
        page = rnd.choice([frame, f"<article><p>Subscribe</p>{mine}</article>", None, "", frame * 2])
        rows.append((rnd.choice([i, i, i, None]), rnd.choice([f"http://{host}.example/x/{rnd.randrange(12)}{rnd.choice(['', '.html', '/', '?q=1'])}", None]), page, "z"))
    return rows + rnd.sample(rows, 9)


@pytest.mark.parametrize("seed", [1, 2])
def test_result_does_not_depend_on_partitions(spark, seed):
    import re

    import xxhash

    rows = site(random.Random(seed))

    def place(r):
        url = (r[1] or "").lower()
        host = re.match(r"^[a-z]+://([^/?#]*)", url)
        path = re.match(r"^(?:[a-z]+://[^/?#]*)?([^?#]*)", url)
        tie = xxhash.xxh64_intdigest(r[2].encode(), 42) if r[2] is not None else 42
        return host[1] if host else "", re.sub(r"(?:\.html?|/)+$", "", path[1]), (r[0] is not None, r[0] or 0), tie - (tie >> 63 << 64)

    ordered = sorted(rows, key=place)
    want = []
    for k, r in enumerate(ordered):
        around = [(j, x) for j, x in enumerate(ordered) if 0 < abs(j - k) <= 4 and place(x)[0] == place(r)[0]]
        beside = sorted((y for y in around if abs(y[0] - k) == 1), key=lambda y: -html_text.common_prefix(place(y[1])[1], place(r)[1]))
        own, *others = ([b for b in html_text.blocks(x[2]) if not b.away] for x in (r, *(y[1] for y in beside)))
        shared = [{i for i, _ in html_text.common_subsequence([b.text for b in own], [b.text for b in o])} for o in others]
        lines = [frozenset(b.text for b in html_text.blocks(y[1][2]) if not b.away) for y in around]
        want.append((r[0], r[1], html_text._text(own, shared, lines)))
    want.sort(key=repr)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 3, 8, 40):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = spark.createDataFrame(rows, "page_id int, url string, html string, text string").repartition(n)
            got = [tuple(r) for r in html_text.with_main_text(df).collect()]
            assert sorted(got, key=repr) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_ids_of_other_types(spark):
    df = spark.createDataFrame([(1, "http://a/", "<p>x</p>")], "page_id int, url string, html string")
    for kind in ("decimal(10,2)", "smallint", "string"):
        out = html_text.with_main_text(df.withColumn("page_id", df.page_id.cast(kind)))
        assert out.count() == 1 and dict(out.dtypes)["page_id"] == kind
