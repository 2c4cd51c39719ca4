import html
import re

import numpy as np
import pytest

from tablelens.llm import blocklabeller as B
from tablelens.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def article(page):
    """The tables' pages hold one article element; its text, blocks apart."""
    inner = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)
    return " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?!b>)[a-z0-9]+[^>]*>", " ", inner[1]))).split()) if inner else ""


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet").collect()


@pytest.fixture(scope="module")
def model(pages):
    return B.fit([p.html for p in pages[:150]])


def test_article_of_every_page(spark, pages):
    got = {r.page_id: r for r in QUERIES["op10_html_block_labeller"](spark, SF).collect()}
    assert set(got) == {p.page_id for p in pages}
    wrong = [p.page_id for p in pages if got[p.page_id].text != article(p.html)]
    assert len(wrong) <= 0.01 * len(pages), wrong[:5]
    assert all(r.n_chars == len(r.text) for r in got.values())


LONG = "This paragraph of the story says what happened, and then it goes on for a while. "
PAGE = """<html><head><title>No</title><style>x</style></head><body><header class="site-header"><p>Site name</p></header>
<div class="cookie-consent">We use cookies on this site.</div><div id="sidebar"><p>Popular stories here</p></div>
{open}<h1>Head &amp; line</h1><p>{long}One<b>two</b> three<br>four.</p><div class="ad">Buy this now.</div><p>{long}</p>{close}
<section class="comments"><p>I disagree with all of this.</p><p>Me too, thanks.</p></section>
<form class="newsletter"><label>Your address</label></form><footer>&copy; 2020</footer><script>var a = "<p>no</p>";</script></body></html>"""


@pytest.mark.parametrize("wrap", ["<article>|</article>", "<main>|</main>", '<div class="post-body">|</div>', '<div id="content">|</div>'])
def test_other_layouts(model, wrap):
    start, end = wrap.split("|")
    cut = B.blocks(PAGE.format(open=start, close=end, long=LONG))
    scores = B.label(model, [B.Vectors()(cut)])[0]
    text = " ".join(t for (_, t, _), s in zip(cut, scores) if s >= 0.5)
    assert text == f"Head & line {LONG}Onetwo three four. {LONG.strip()}"


def test_gradient():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in B.initial(1).items()}
    x = [rng.normal(0, 1, (n, B.INPUT)).astype(np.float32) for n in (3, 5)]
    a, b = B.padded(x)
    one = B.forward(p, a, b)[0]
    alone = [B.forward(p, *B.padded([v]))[0][0] for v in x]
    assert np.allclose(one[0, :3], alone[0], atol=1e-5) and np.allclose(one[1], alone[1], atol=1e-5)  # padding has no effect


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p"), (4, "u", "a < b &lt; <!-- <p>x</p>"), (None, "u", "<article><p>" + "w " * 50_000),
            (5, "u", "<article><p>same text here.</p></article>"), (5, "u", "<article><p>same text here.</p></article>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = B.main_text(df).collect()
    assert len(got) == 7 and [r.text for r in got if r.page_id in (1, 2)] == ["", ""]
    assert next(len(r.text) for r in got if r.page_id is None) == 99_999
    assert B.main_text(df.limit(0)).count() == 0


def test_heavy_heads_and_rare_marks(spark):
    """Marked pages whose scripts fill the first 20,000 characters, one in 600 pages."""
    page = PAGE.format(open="<article>", close="</article>", long=LONG).replace("<style>x", "<style>" + "x {} " * 6_000)
    bare = "<html><body><p>{}</p></body></html>"
    rows = [(i, "u", page if i == 301 else bare.format(f"Short note {i}")) for i in range(600)]
    got = {r.page_id: r.text for r in B.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), sample=25).collect()}
    assert len(got) == 600 and got[301] == f"Head & line {LONG}Onetwo three four. {LONG.strip()}"


def test_training_reads_whole_pages(spark):
    page = "<article>" + "<p>Words of the story, again.</p>" * 1_500 + "</article><footer>The very end</footer>"
    (cut,) = B.drawn_pages(spark.createDataFrame([(page,), (page,), ("<p>none</p>",), (None,)], "html string"), 250)
    assert cut == B.blocks(page) and cut[-1][1] == "The very end"
    x = B.Vectors()(cut)
    assert np.array_equal(B.unpacked(*B.packed(x)), x)
    assert [len(y) for _, y in B.windows(np.zeros((4_500, 2)), [0] * 4_500)] == [2_000, 2_000, 500]


def test_table_without_marks(spark):
    page = PAGE.format(open='<div class="post-body">', close="</div>", long=LONG)
    rows = [(i, "u", page.replace("Head", f"Head {i}")) for i in range(40)]
    got = B.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 40 and all(r.text == f"Head {r.page_id} & line {LONG}Onetwo three four. {LONG.strip()}" for r in got)


def test_text_in_formulas_and_fallbacks():
    page = """<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding="tex">\\x</annotation></math> hold<svg><title>no</title><path d="m"/>
</svg>.</p><object data="f"><p>A chart of sales.</p></object><canvas>Sales by year.</canvas><noscript><p>Late text.</p></noscript>
<svg><g><text>Label</text></g></svg><template><p>no</p></template><iframe>no</iframe><style>no</style><script>no</script><p>End.</p></article>"""
    cut = B.blocks(page)
    assert [t for _, t, _ in cut] == ["Let x=2 hold .", "A chart of sales.", "Sales by year.", "Late text.", "Label", "End."]
    assert B.marked(cut) == [1] * 6 and "noscript" in cut[3][0]
