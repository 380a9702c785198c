"""Blocks, labels and training of the text extractor."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.llm import html_text, html_train

PAGE = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad --><div class="ad">Buy &amp; save now.</div><article><h1>Title here</h1><p><b>First  line &lt;x&gt;.<br><p>Second\n line.</p></article><footer>&copy; me &middot; words</footer>'


def blocks(page):
    return [b.text for b in html_text.leaf_blocks(page)]


def test_blocks_of_a_page():
    assert blocks(PAGE) == ["Home", "News", "Buy & save now.", "Title here", "First line <x>.", "Second line.", "© me · words"]


@pytest.mark.parametrize(("page", "wanted"), [
    ("", []), ("plain text", ["plain text"]), ("<p>a<p>b", ["a", "b"]), ("<div>a<span>b</span> c<i>d</i></div>e", ["ab cd", "e"]),
    ("a<!-- x", ["a"]), ("a<script>x", ["a"]), ("a <b", ["a"]), ("1 < 2 <3", ["1 < 2 <3"]), ("<td>a</td><td>b</td>", ["a", "b"]),
    ("<p title='a>b'>x</p>", ["x"]), ("a&am b&lt c", ["a&am b< c"]), ("</p></div>x", ["x"]), ("<li>a<ul><li>b</ul>c", ["a", "b", "c"]),
    ("<p>a</p><!--><p>b</p>", ["a", "b"]), ("a<!--->b", ["ab"]), ("a<!-- x --!>b<!-- - -- > -->c", ["abc"]), ("a</>b</ x>c", ["abc"]),
    ("<p it's>a</p><p it's>b</p>", ["a", "b"]), ("<p title = 'a>b' x=\"c>d\">x", ["x"]), ("a<svg><text>no</text></svg>b<svg/>c", ["abc"]),
    ("<P CLASS=x>a</P>", ["a"]), ("<p>\n \t</p>", []), ("<title>t</title>x<textarea>y</textarea>", ["x"]),
])
def test_odd_markup(page, wanted):
    assert blocks(page) == wanted


def test_paths_close():
    def tags(element):
        return [*tags(element.parent), element.tag] if element else []

    path = {b.text: tags(b.element) for b in html_text.leaf_blocks(PAGE)}
    assert path["Second line."] == ["html", "body", "article", "p"]
    assert path["© me · words"] == ["html", "body", "footer"]


def test_held_out_accuracy():
    weights = html_text.load_weights()
    assert html_train.accuracy(weights, *html_train.examples(html_train.Maker(12345), 400)) > 0.99


#: Written by hand, unlike the pages that the trainer makes up: what is to be found, line by line, and the page.
SITES = [
    (["A day at the river", "We set out at dawn, and the fog had not yet lifted from the water.", "By noon the boats were back."],
     "<body><div id=top class='site-header'><a href=/>River Notes</a></div><ul class=menu><li><a href=1>Trips</a><li><a href=2>Maps</a></ul>"
     "<main><h1>A day at the river</h1><p>We set out at dawn, and the fog had not yet lifted from the water.<p>By noon the boats were back.</main>"
     "<div class='comments'><h3>2 comments</h3><p>Lovely trip, thank you!</p><p>I was there too.</p></div><footer><p>&copy; 2021 River Notes</p></footer>"),
    (["Council votes on budget", "The council met on Tuesday evening and voted nine to two.", "Members had argued over it for weeks.", "“It is what we could get,” the mayor said."],
     "<header><h2>Town Post</h2><nav><a href=a>News</a> <a href=b>Sport</a></nav></header><div class=cookie-notice>We use cookies. <button>Accept</button></div>"
     "<article class=post><h1>Council votes on budget</h1><p>The council met on Tuesday evening and voted nine to two.</p><p>Members had argued over it for weeks.</p>"
     "<blockquote>&ldquo;It is what we could get,&rdquo; the mayor said.</blockquote></article><aside class=sidebar><h3>Most read</h3><ul><li><a href=c>Fire in the old mill</a></ul></aside>"
     "<form class=newsletter><label>E-mail</label><input><button>Subscribe</button></form><footer>All rights reserved. <a href=d>Imprint</a></footer>"),
]


def test_pages_written_by_hand():
    labeller = html_text.Labeller(html_text.load_weights())
    for wanted, page in SITES:
        assert labeller.texts([page])[0].split("\n") == wanted


def test_long_pages_in_segments(monkeypatch):
    labeller = html_text.Labeller(html_text.load_weights())
    pages = [PAGE, "<main>" + "".join(f"<p>Some words {i} here.</p>" for i in range(57)) + "</main>" + PAGE, SITES[1][1]]
    whole = labeller.texts(pages)
    for size in (1, 7, 20):
        monkeypatch.setattr(html_text, "SEGMENT", size)
        assert labeller.texts(pages) == whole
    blocks = html_text.leaf_blocks(pages[1])
    first = np.array([0, len(blocks)])
    assert np.allclose(labeller.long_chances(blocks), labeller.chances(html_text.vectors(blocks, html_text.shares(first)), first), atol=1e-5)


def test_deep_pages_take_linear_time_and_memory():
    page = "<div>x<b>" * 30_000 + "</i>" * 30_000 + "<p>y</p>" * 100
    found = html_text.leaf_blocks(page)
    assert len(found) == 30_100 and found[-101].element.depth == 59_999
    assert html_text.vectors(found[-10:], np.ones(10)).shape[0] == 10


def test_extraction(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "<script>x</script>"), (5, "x", "<article>" + "<p>Some words here.</p>" * 3000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_text.extract_text(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[1].text == "Title here\nFirst line <x>.\nSecond line." and by[1].n_chars == len(by[1].text)
    assert all(by[i].text == "" and by[i].n_chars == 0 for i in (2, 3, 4))
    assert by[5].text.count("\n") == 2999
    assert html_text.extract_text(df.limit(0)).collect() == []


def test_gradients():
    """Back-propagation against differences, in a small network."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2, 3, 4 * html_text.HIDDEN)).astype(np.float32) * 0.3
    wh = rng.normal(size=(html_text.HIDDEN, 4 * html_text.HIDDEN)).astype(np.float32) * 0.1
    out, kept = html_train._steps(x, wh)
    assert np.allclose(out, html_text.lstm(x, wh)[0], atol=1e-6)
    up = rng.normal(size=out.shape).astype(np.float32)
    dx, dwh = html_train._back(up, kept, wh)
    for array, grad in ((x, dx), (wh, dwh)):
        for _ in range(5):
            at = tuple(rng.integers(0, n) for n in array.shape)
            old = array[at]
            array[at] = old + 0.01
            high = (html_text.lstm(x.astype(np.float64), wh.astype(np.float64))[0] * up).sum()
            array[at] = old - 0.01
            low = (html_text.lstm(x.astype(np.float64), wh.astype(np.float64))[0] * up).sum()
            array[at] = old
            assert grad[at] == pytest.approx((high - low) / 0.02, rel=0.05, abs=1e-3)
