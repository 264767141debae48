"""The decoder against enumeration, malformed pages, and elements whose text is dropped."""

import itertools
import re
import time

import numpy as np
import pyarrow.parquet as pq

from notelake.llm import html_layouts
from notelake.llm.html_blocks import Block, blocks
from notelake.llm.html_extract import Crf, default_model, main_text


def test_viterbi_is_the_best_of_all_labelings():
    rng = np.random.default_rng(4)
    for n in range(1, 9):
        model = Crf({f"f{i}": i for i in range(5)}, rng.normal(size=(5, 2)), rng.normal(size=(3, 2)))
        page = [Block("x", "p", (), (), features=[f"f{i}" for i in rng.integers(0, 6, 3)]) for _ in range(n)]
        e = model.emissions(page)
        score = lambda y: model.pairs[2][y[0]] + sum(e[i][y[i]] for i in range(n)) + sum(model.pairs[a][b] for a, b in itertools.pairwise(y))  # noqa: B023, E731
        assert np.isclose(score(model.decode(page)), max(map(score, itertools.product((0, 1), repeat=n))))


def test_malformed_pages_take_time_like_their_length():
    for piece in ('<a "x ', "<svg>", '<a ="x', "</", "<!--", "<p>", '<a =">', "<button>", "<"):
        began = time.time()
        blocks(piece * 30_000)
        assert time.time() - began < 20


def test_dropped_and_kept_elements():
    text = lambda page: [b.text for b in blocks(page)]
    assert text('<p>a <svg/>b</p><p title="x>y">c</p>') == ["a b", "c"]
    assert text("<p>one <button>two</p><p>three</p>") == ["one two", "three"]
    assert text("<p>x <math><mi>e</mi></math> y</p>") == ["x e y"]
    assert text("<p>a</p><script>if (x < 1) '<p>'</script><p>b</p><style>p {") == ["a", "b"]
    assert text("<p>1 < 2 and 3 > 2</p><!-- <p>no</p> --><p>yes") == ["1 < 2 and 3 > 2", "yes"]
    assert text("") == text("<!-- ") == text("<p") == [] or text("<p") == ["<p"]
    assert len(text("<div>x" * 2000)) == 2000


# Layouts that no training page has: names that say nothing, comments under other names, a wiki, an old page.
UNSEEN = (
    '<body><div class="x1"><a href="/">{s}</a> <a href="/a">{s}</a> <a href="/b">{s}</a></div><div class="x2"><p>§{p}</p><p>§{t}</p><p>§{p}</p></div><div class="x3">&copy; {s}</div></body>',
    '<body><nav><a href="/">{s}</a></nav><article><h1>§{s}</h1><p>§{p}</p><p>§{p}</p><div class="responses"><h4>Responses</h4><div><p>{t}</p></div><div><p>{p}</p></div></div></article><footer>{s}</footer></body>',
    '<body><div class="k9f"><div class="k9g"><a href="#">{s}</a><a href="#">{s}</a></div></div><div class="q1"><div class="q2"><h2>§{s}</h2><div>§{p}</div><div>§{t}</div><div>§{p}</div></div></div></body>',
    '<body><div id="page"><div id="topnav"><ul><li><a href="#">{s}</a></li><li><a href="#">{s}</a></li></ul></div><div id="wikitext"><h1>§{s}</h1><p>§{p}</p><div class="toc"><ul><li><a href="#a">{s}</a></li><li><a href="#b">{s}</a></li></ul></div><h2>§{s}</h2><p>§{p}</p><ul><li>§{t}</li><li>§{t}</li></ul></div>'
    '<div class="categories"><a href="#">{s}</a></div></div></body>',
    '<body><main><h1>§{s}</h1><p>§{p}</p><section class="feedback"><h3>12 reactions</h3><ul><li><p>{t}</p></li><li><p>{t}</p></li></ul></section></main></body>',
    '<body><center><font><a href="#">{s}</a> | <a href="#">{s}</a></font></center><h1>§{s}</h1><p>§{p}<p>§{p}<p>§{t}<hr><address>{s} <a href="#">{s}</a></address></body>',
)


def test_unseen_layouts(monkeypatch):
    model = default_model()
    monkeypatch.setattr(html_layouts, "LAYOUTS", UNSEEN)
    hit = missed = false = 0
    for page in html_layouts.labelled_pages(60 * len(UNSEEN), seed=99):
        found = blocks(page, html_layouts.MARK)
        for b, kept in zip(found, model.decode(found), strict=True):
            hit, missed, false = hit + (b.marked and kept), missed + (b.marked and not kept), false + (kept and not b.marked)
    assert hit / (hit + missed) > 0.7 and hit / (hit + false) > 0.98, (hit, missed, false)


def test_given_pages_are_their_articles():
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column(0).to_pylist()
    model = default_model()
    article = re.compile(r"(?is)<article\b[^>]*>(.*?)</article>")
    assert all(main_text(p, model) == "\n".join(b.text for b in blocks(article.search(p)[1])) for p in pages)
