import itertools

import numpy as np
import pytest

from fmlattice.llm.html_extract import Chain, extract, features, leaf_blocks, main_text, trained
from fmlattice.llm.page_samples import labelled_pages
from tests.llm.frames import frame  # noqa: F401


def texts(html):
    return [b.text for b in leaf_blocks(html)]


def test_blocks():
    assert texts("<p>a <b>b</b>\n c</p><p>d") == ["a b c", "d"]
    assert texts("<p><b>one<br><p>two</p>x") == ["one", "two", "x"]
    assert texts("<style>p{}</style><script>var t='</p>';</script><!-- <p>no</p> --><p>&lt;b&gt; &amp;&eacute;&#33;&amp</p>") == ["<b> &é!&"]
    assert texts("<ul><li>a<li>b</ul>c<div title='>'>d</div>") == ["a", "b", "c", "d"]
    assert texts("<p>cut <a href='x") == ["cut"] and texts("") == [] and texts("plain") == ["plain"]
    assert texts("<script>never closed <p>a") == [] and texts("a < b <p>2 > 1") == ["a < b", "2 > 1"]
    assert texts("a<br>b<hr>c") == ["a b", "c"]


def test_only_raw_text_is_left_out():
    assert texts("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>") == ["so x=1 holds"]
    assert texts("<p>a</p><xmp>1 < 2 &amp; <b></xmp><p>b") == ["a", "1 < 2 &amp; <b>", "b"]
    for tag in "select noscript svg math template".split():
        assert "the article" in " ".join(texts(f"<div><{tag}></div><article><p>the article</p></article>")), tag
    assert texts("<p>go <svg><title>no</title><path d='M0'/></svg> on</p>") == ["go on"]
    assert texts("<p>pick <select><option>a<option>b</select> now</p>") == ["pick", "a", "b", "now"]
    assert texts("<p title=it's>one</p><p don't>two</p><p>it's") == ["one", "two", "it's"]
    assert texts("""<p a='>' b = ">">x</p><p c="d>y""") == ["x", "y"]
    assert texts("<p " + 'x="1" ' * 50_000) == []


def test_viterbi_and_marginals_against_all_paths():
    r = np.random.default_rng(1)
    c = Chain()
    c.weights[:, :20] = r.normal(size=(2, 20))
    c.step = r.normal(size=(2, 2))
    c.freeze()
    feats = [tuple(r.choice(20, 4, replace=False).tolist()) for _ in range(6)]
    emit = c.scores(feats)

    def score(path):
        return sum(emit[i, s] for i, s in enumerate(path)) + sum(c.step[a, b] for a, b in zip(path, path[1:]))

    paths = list(itertools.product((0, 1), repeat=6))
    assert c.decode(feats) == list(max(paths, key=score))
    z = sum(np.exp(score(p)) for p in paths)
    state, pairs = c.marginals(emit)
    for t in range(6):
        assert np.isclose(state[t, 1], sum(np.exp(score(p)) for p in paths if p[t]) / z)
    assert np.isclose(pairs.sum(), 5)


@pytest.fixture(scope="module")
def chain():
    return trained()


def test_held_out_pages(chain):
    right = n = 0
    for html, main in labelled_pages(80, seed=1234):
        blocks = leaf_blocks(html)
        for b, s in zip(blocks, chain.decode(features(blocks))):
            right += s == (b.text in main)
            n += 1
    assert right / n > 0.97, right / n


def test_tables_pages(spark, chain):
    """On the given layout the article is what is extracted, all of it."""
    import re
    from html import unescape
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r for r in extract(pages, chain).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S).group(1)
        parts = [" ".join(unescape(re.sub("<br>|</?b>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert got[r["page_id"]]["text"] == "\n\n".join(p for p in parts if p)


def block_by_hand(html):
    """Leaf blocks of well-formed pages of divs, paragraphs and spans, by another reader."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.text = [], ""

        def cut(self):
            if self.text.strip():
                self.out.append(" ".join(self.text.split()))
            self.text = ""

        def handle_starttag(self, tag, attrs):
            if tag not in ("span", "b", "a"):
                self.cut()

        def handle_endtag(self, tag):
            if tag not in ("span", "b", "a"):
                self.cut()

        def handle_data(self, data):
            self.text += data

    r = Reader()
    r.feed(html)
    r.close()
    r.cut()
    return r.out


def test_blocks_against_another_reader():
    import random
    r = random.Random(8)

    def node(depth):
        if depth == 0 or r.random() < 0.3:
            return r.choice(["a", " b\n", "&amp;", "c &lt; d", "é", " "])
        tag = r.choice(["div", "section", "span", "b", "a", "ul"])
        return f"<{tag}>" + "".join(node(depth - 1) for _ in range(r.randint(0, 3))) + f"</{tag}>"

    for _ in range(300):
        html = "".join(node(4) for _ in range(3))
        if not any(f"<{i}>" in html and f"<{b}" in html for i in ("span", "b", "a") for b in ("div", "section", "ul")):
            assert texts(html) == block_by_hand(html), html


def test_decoding_by_elements_is_decoding_by_features(chain):
    for html, _ in labelled_pages(30, seed=77):
        blocks = leaf_blocks(html)
        assert chain.decode_blocks(blocks) == chain.decode(features(blocks))


def test_deep_pages_take_linear_memory(chain):
    import time
    import tracemalloc
    for page in ("<div>a" * 100_000, "".join(f"<div class=c{i}x>a" for i in range(20_000)),
                 "<b>" * 50_000 + "<div></div>" * 50_000 + "a", "<b>" + "<div></b>" * 50_000 + "a", "<ul><li>" * 30_000 + "a"):
        tracemalloc.start()
        began = time.time()
        main_text(chain, page)
        took, peak = time.time() - began, tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 200 << 20 and took < 60, (page[:30], peak, took)


def test_layouts_unlike_the_samples(chain):
    """Hand-written pages in layouts that no sample has."""
    story = ["The council met on Monday, and it decided to close the bridge for a year.",
             "Repairs will cost two million, the mayor said. Traffic goes by the old road.",
             "Nobody was hurt. The river, high since March, has begun to fall."]
    link = f'<p><a href="/s">{story[0]}</a></p>'
    menu = '<div class="nav"><a href=/>Home</a> <a href=/n>News</a> <a href=/s>Sport</a></div>'
    foot = '<div class="footer">Copyright 2020 The Paper. All rights reserved.</div>'
    p = "".join(f"<p>{x}</p>" for x in story)
    linked = main_text(chain, f"<body>{menu}<article>{link}<p>{story[1]}</p><p>{story[2]}</p></article>{foot}")
    assert all(x in linked for x in story) and "Home" not in linked and "Copyright" not in linked
    bare = main_text(chain, f"<html><body>{'<br>'.join(story)}</body></html>")
    assert all(x in bare for x in story)
    side = main_text(chain, f"<body>{menu}<article><h1>The bridge</h1>{p}<aside><p>More news: the fair opens on Friday.</p></aside>"
                            f"<p>{story[0]} Again.</p></article>{foot}")
    assert all(x in side for x in story) and "fair" not in side
    table = main_text(chain, f"<table><tr><td class=menu><a href=/>Home</a></td><td><h1>The bridge</h1>{p}</td></tr></table>{foot}")
    assert all(x in table for x in story) and "Home" not in table


def test_marks_are_looked_for_in_the_whole_block():
    from fmlattice.llm.html_extract import hashed
    late = "word " * 200 + "we use cookies here"
    assert hashed(("mark", "cookie")) in features(leaf_blocks(f"<p>{late}</p>"))[0]


def test_unclosed_elements_keep_the_article(chain):
    story = "Some words, of a story. And more of it."
    for tag in "select noscript svg math template".split():
        page = f"<nav><a href=x>Home</a></nav><{tag}><article><h1>A title</h1><p>{story}</p><p>{story}</p></article>"
        assert main_text(chain, page).count(story) == 2, tag


def test_odd_pages(frame, chain):
    long = "<article>" + "<p>Some words, of a story. And more of it.</p>" * 20_000 + "</article>"
    rows = [(1, None, None, "x"), (2, "u", "", "x"), (2, "u", "", "x"), (3, "u", "<nav><a href=x>Home</a></nav>", "x"),
            (None, "u", long, "x")]
    got = {r["page_id"]: r for r in extract(frame(rows, "page_id long, url string, html string, text string"), chain).collect()}
    assert got[1]["text"] == got[2]["text"] == got[3]["text"] == "" and got[1]["n_chars"] == 0
    assert got[None]["text"].count("\n\n") == 19_999
    assert extract(frame([], "page_id long, url string, html string"), chain).count() == 0
    assert main_text(chain, "<div class=ad>Buy now</div><footer>&copy; x</footer>") == ""
