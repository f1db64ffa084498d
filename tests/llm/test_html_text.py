"""Main text: broken markup, linear cost, and hosts of many layouts."""

import html
import random
import re
import time
import tracemalloc

import pytest

from lamina.llm import html_text
from lamina.llm.html_text import parsed


def text(source):
    page = parsed(source)
    return page.text(page.path(page.top) or None)


WORDS = "The article goes on with words of its own. " * 4


@pytest.mark.parametrize("shell", [
    "<body class='single has-sidebar'><article>{}</article>", "<body class=\"no-sidebar\">{}", "<article class='post related-topic'>{}</article>",
    "<nav><ul><li><a href=/>Home</a><article>{}</article>", "<nav><a href=/>Home</a><div class=post>{}</div>", "<header><h1>Site</h1><main>{}</main>",
    "<form><input><div>{}</div>", "<footer>legal<article>{}</article>", "<head><title>t</title><meta><body>{}", "<div data-id=\"comments\">{}</div>", "<div data-class='nav'>{}</div>",
    "<div title='x class=\"nav\"'>{}</div>", "<div class>{}</div>", "<svg><div>{}</div>", "<a name=top><div>{}</div>", "<div>{}</div><nav><a href=/>next</a>",
    "<script>if (a < b) '</p>'</script><div>{}</div>", "<div>{}</div><script>cut short <p>no</p>", "<div>{}</div><!-- <p>no</p>", "<div>{}</div><p class='x", "<div>{}</div></section></b>",
])
def test_shells_keep_the_article(shell):
    assert text(shell.format(f"<p>{WORDS}</p>")) == WORDS.strip()


@pytest.mark.parametrize(("source", "want"), [
    ("<p title=\"a>b\">good</p>", "good"), ("<p title='a>b' class=x>good<p>two", "good two"), ("<p>don't <b class=x'y>it's</b> ok</p>", "don't it's ok"),
    ("a < b and c > d <b>x</b>", "a < b and c > d x"), ("1 < 2", "1 < 2"), ("<div>a<!-- c > d --> b</div>", "a b"), ("</ foo>bar", "bar"), ("<nav><a href=/>x</a><div><a href=/y>y</a>", ""),
    ("<p t=\"x>left open</p>", "left open"), ("<a href='x", ""), ("<", ""), ("", ""), ("&lt;b&gt; &#233;", "<b> é"),
])
def test_broken_markup(source, want):
    assert text(source) == want


@pytest.mark.parametrize("source", [
    "<a " * 20_000, "<a " * 20_000 + ">x", "<div>" * 50_000 + "x", "<div class='abc def'>x" * 50_000, "<b>" * 30_000 + "<p>" * 30_000 + "</i>" * 30_000, "<svg>" * 30_000,
    "<p t=\"x>" * 30_001, "<ul><li>x" * 30_000, "<!-" * 50_000, "<nav>" * 30_000 + "<div>x", "<div>x</p>" * 30_000, "<p class='" + "nav " * 50_000 + "'>x", "<" * 50_000,
])
def test_cost_is_linear(source):
    began = time.perf_counter()
    text(source)
    assert time.perf_counter() - began < 5  # a second or less, on an idle machine
    tracemalloc.start()
    text(source[: len(source) // 5])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20


#: A layout: what stands before, between and after the article's blocks.
LAYOUTS = [
    ("<body class='home'><header><h1>Site</h1><a href=/>Home</a></header><nav><ul><li><a href=/a>A</a></ul></nav><main><article class='post-{n}'>", "</article></main><aside>Ads</aside><footer>(c)</footer>"),
    ("<body><div id=wrap class='has-sidebar'><div class='menu'><a href=/>x</a></div><div class='entry e{n}'>", "</div><div class='sidebar'><p>About this site</p></div></div><div class='comments'><p>Nice post</p></div>"),
    ("<table><tr><td class=left><a href=/>Home</a><br><a href=/b>B</a><td class=body>", "<td class=ad><p class='ad'>buy</p></table>"),
    ("<body><section class=hero><h1 class=title>", "</h1></section><form><input><label>Mail</label></form>"),
    ("<div class=cookie-consent><p>We use cookies</p></div><div><div><div class=content>", "</div></div></div><script>var x = '<p>';</script>"),
]


def test_hosts_of_many_layouts(make):
    """Five hosts, each of one layout, against the blocks that the pages were made of."""
    rng = random.Random(4)
    pages, want = [], {}
    for i in range(200):
        h = i % len(LAYOUTS)
        said = [" ".join(f"w{rng.randrange(500)}{rng.choice(['', ' & co', ' é', ' <b>'])}" for _ in range(rng.randrange(8, 40))) for _ in range(rng.randrange(1, 6))]
        spelt = [html.escape(s).replace(" ", rng.choice([" ", "\n ", "&nbsp;", " \t"])) for s in said]
        blocks = "".join(rng.choice(["<p>{}</p>", "<p>{}", "<div class='p{n}'>{}</div>", "<h2 id=x>{}</h2>", "<ul><li>{}</li></ul>", "<blockquote>{}</blockquote>"]).replace("{}", s).replace("{n}", str(i)) for s in spelt)
        if h == 3:
            blocks = spelt[0]
            said = said[:1]
        pages.append((i, f"http://h{h}.example/{i}", LAYOUTS[h][0].replace("{n}", str(i)) + blocks + LAYOUTS[h][1]))
        want[i] = " ".join(said)
    got = {r.page_id: r.text for r in html_text.extracted(make(pages, "page_id long, url string, html string")).collect()}
    assert got == want


def test_html_of_a_larger_table(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in html_text.op6_html_text(spark, sf).collect():
        inner = re.search(r"(?s)<article>(.*?)(?:</article>|\Z)", pages[r.page_id])[1]
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
