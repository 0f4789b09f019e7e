import itertools
import re
from html import unescape

import pytest

from tidemark.llm import html_text as h


@pytest.fixture(scope="module")
def field():
    return h.trained()


def test_held_out_accuracy(field):
    right = total = pages = 0
    held = h.as_training(h.labelled_pages(150, seed=99))
    for blocks, gold in held:
        got = field.decode(blocks)
        right += sum(a == b for a, b in zip(got, gold))
        total += len(gold)
        pages += got == gold
    assert right / total > 0.97 and pages / len(held) > 0.75


def test_viterbi_is_the_best_labelling(field):
    for blocks, _ in h.as_training(h.labelled_pages(30, seed=3)):
        blocks = blocks[:9]
        scores = field.scores(blocks)
        value = lambda y: field.start[y[0]] + sum(s for s, k in zip(scores, y) if k) + sum(field.step[a][b] for a, b in zip(y, y[1:]))
        best = max(itertools.product((0, 1), repeat=len(blocks)), key=value)
        assert value(field.decode(blocks)) == pytest.approx(value(best))


def plain(html):
    inner = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    inner = re.sub(r"<(/?)(p|h1|br|li|ul)[^>]*>", " ", inner)
    return " ".join(unescape(re.sub(r"<[^>]*>", "", inner)).split())


def test_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: (r.url, plain(r.html)) for r in df.collect()}
    got = h.main_text(df).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.url, r.text) == want[r.page_id] and r.n_chars == len(r.text)


def test_layouts(field):
    page = (
        '<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><a href="/">Home</a></nav>'
        '<div class="cookie-notice"><p>We use cookies on this site, please accept them.</p></div>'
        "<main><article><h1>Caf&eacute;&nbsp;&amp; bar</h1><p>One <b>b</b>old\n  line, with more words to read.<br>Next.<p>Second paragraph &lt;here&gt;.</p>"
        '<div class="ad"><p>Buy this now, it is very cheap today.</p></div><p>Third one ends the story.</p></article>'
        '<section class="comments"><p>I liked this story a lot, thanks for writing it.</p></section></main>'
        '<aside><p>Other stories you may want to read.</p></aside><form><label>Mail</label><button>Send</button></form>'
        "<script>if (1 < 2) x('<p>no</p>')</script><footer>&copy; 2020 Site</footer></body></html>"
    )
    assert field.extract(page) == "Café & bar One bold line, with more words to read. Next. Second paragraph <here>. Third one ends the story."


STORY = "<h1>Title here</h1><p>First paragraph of the story, with some words.</p><p>Second one ends it, after a while.</p>"
SHOWN = "Title here First paragraph of the story, with some words. Second one ends it, after a while."
AROUND = '<html><body><nav><a href="/">Home</a></nav>{}<footer><p>&copy; 2020 Site</p></footer></body></html>'


@pytest.mark.parametrize("name", ["reader-view", "content warning", "top-story content", "post bottom", "story thread", "more-content"])
def test_names_of_articles(field, name):
    assert field.extract(AROUND.format(f'<article class="{name}">{STORY}</article>')) == SHOWN


@pytest.mark.parametrize("tag", ["video", "select", "object", "svg", "math", "audio", "canvas", "iframe", "textarea", "template", "noscript"])
def test_elements_without_an_end(field, tag):
    first, rest = STORY.split("</p>", 1)
    got = field.extract(AROUND.format(f"<article>{first}</p><{tag} id=x>{rest}</article>"))
    assert got == SHOWN


def test_formulas_and_titles(field):
    page = AROUND.format("<article><header><h1>On sums</h1><p>By A. Writer</p></header><p>We know that <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds for all of these, as shown.</p><p>So the proof ends with this line.</p></article>")
    assert field.extract(page) == "On sums We know that x=2 holds for all of these, as shown. So the proof ends with this line."


def test_pages_without_article_elements(field):
    right = total = pages = n = 0
    for html, gold in h.labelled_pages(500, seed=77):
        if "<article" in html or "<main" in html:
            continue
        n += 1
        got = field.decode(h.leaf_blocks(html))
        right, total, pages = right + sum(a == b for a, (_, b) in zip(got, gold)), total + len(gold), pages + (got == [b for _, b in gold])
    assert n > 100 and right / total > 0.95 and pages / n > 0.6, (n, right / total, pages / n)


def test_odd_pages(spark, field):
    odd = [None, "", "   ", "<p", "<script>x", "<!-- a", "<div" * 2000, "a &lt; b", "<article><p>" + "word, " * 50000 + "</p>"]
    df = spark.createDataFrame([(i, None, x, "t") for i, x in enumerate(odd)], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in h.main_text(df).collect()}
    assert [got[i] for i in range(3)] == ["", "", ""] and len(got[8]) > 250000
    assert h.main_text(df.filter("false")).count() == 0
    twice = h.main_text(df.unionByName(df)).groupBy("page_id", "text").count().collect()
    assert len(twice) == len(odd) and all(r["count"] == 2 for r in twice)
