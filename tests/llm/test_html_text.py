"""HTML extraction: the parser, the decoder, and held-out pages."""

import re
import time
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq
import pytest

from sedgewren.llm import html_text as H


@pytest.fixture(scope="module")
def model():
    return H.train()


def text_of(model, page):
    tree = H.blocks(H.parse(page))
    return " ".join(tree[i].text for i in H.decode(tree, model.margin(H.features(tree))))


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">one</a></li><li><a href="/b">two</a></li><li><a href="/c">three</a></li></ul></nav><!-- ad --><div class="ad">Buy this thing now.</div>
<article><h1>A  title &amp; more</h1><p><b>First part<br>and on.<p>Second&nbsp;part &#233;&eacute;, long enough to read as a sentence of prose.</p><p>x<i>y</i>z and several further words.</p></article><footer>&copy; somebody, all rights.</footer></body></html>"""


def test_a_page_of_each_thing(model):
    assert text_of(model, PAGE) == "A title & more First part and on. Second part éé, long enough to read as a sentence of prose. xyz and several further words."


def test_cut_off_pages(model):
    at = PAGE.index("several")
    assert text_of(model, PAGE[:at]).endswith("xyz and")
    assert text_of(model, PAGE[: PAGE.index("<i>") + 2]).endswith("prose. x")


def test_held_out_made_pages(model):
    maker, right = H.PageMaker(1234), 0
    for _ in range(120):
        tree = H.blocks(H.parse(maker.page()))
        wanted = [i for i, b in enumerate(tree) if maker.MAIN in b.text]
        for b in tree:
            b.text = b.text.replace(maker.MAIN, "")
        right += H.decode(tree, model.margin(H.features(tree))) == wanted
    assert right >= 108  # some of these pages have blocks without any telling name


def test_decoder_never_keeps_below_what_it_drops():
    tree = [H.Block("#root", -1, frozenset(), 0, 0), H.Block("div", 0, frozenset(), 1, 0), H.Block("#text", 1, frozenset(), 2, 0, "a"), H.Block("div", 0, frozenset(), 1, 1), H.Block("#text", 3, frozenset(), 2, 0, "b")]
    assert H.decode(tree, np.array([0, -3.0, 1.0, -1.0, 2.0])) == [4]


def test_odd_inputs(model):
    for page in ("", "<", "<>", "</", "<p", "<!--", "<script>x", "a < b", "<div " * 50, "<b>" * 3000 + "x", "<div>" * 3000 + "x", "</p></div>", "<p class='" + "y" * 100_000, "<title>t"):
        text_of(model, page)
    assert text_of(model, "") == ""


def test_extract_keeps_rows(spark, model):
    rows = [(1, "u", PAGE, "t"), (2, None, None, "t"), (None, "v", "", "t"), (1, "u", PAGE, "t"), (3, "w", "<article>" + "<p>word after word here.</p>" * 20_000 + "</article>", "t")]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), model).collect()
    assert len(got) == 5 and sorted(r.n_chars for r in got)[:2] == [0, 0] and all(r.n_chars == len(r.text) for r in got)
    assert max(got, key=lambda r: r.n_chars).text == " ".join(["word after word here."] * 20_000)
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0


@pytest.mark.parametrize("page", ["<!-- -->" * 400_000, "<!-- -->" * 400_000 + "--!>", "<a " * 400_000, "<!x " * 400_000, "<div>" * 100_000 + "x", "<b>" * 100_000 + "x", "<p><button>" + "<b>" * 50_000 + "<h1></h1>" * 50_000, "<a '" * 300_001 + ">", "<div>" * 100_000 + "</b>" * 100_000, "<!--" * 300_000], ids=lambda p: p[:12])
def test_odd_pages_take_no_square_time(page):
    began = time.time()
    H.features(H.blocks(H.parse(page)))
    assert time.time() - began < 15


class Article(HTMLParser):
    """An extractor of another make: the text of <article> by the standard library's parser, without its named boilerplate."""

    BLOCKS = {"p", "div", "h1", "h2", "h3", "ul", "ol", "li", "section", "article", "table", "tr", "td", "blockquote", "pre"}
    OUT = {"nav", "header", "footer", "aside", "form", "script", "style"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.skip, self.parts = 0, [], []

    def handle_starttag(self, tag, attrs):
        named = " ".join(v or "" for k, v in attrs if k in ("class", "id"))
        self.inside += tag == "article"
        if self.skip or tag in self.OUT or re.search(r"\b(ads?|comments?|cookie|share|related|sidebar)\b", named):
            self.skip.append(tag)
        if tag in self.BLOCKS or tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if self.skip and self.skip[-1] == tag:
            self.skip.pop()
        self.inside -= tag == "article"
        if tag in self.BLOCKS:
            self.parts.append(" ")

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.parts.append(data)


def test_equal_to_an_independent_extractor(model):
    rows = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist()
    assert len(rows) > 100
    for page in rows:
        other = Article()
        other.feed(page)
        assert text_of(model, page) == " ".join("".join(other.parts).split())


def test_the_model_is_fitted_once():
    assert H.train() is H.train()
