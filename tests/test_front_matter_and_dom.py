"""Front matter in all its forms, and main text against a tree built with the standard parser."""

import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from notelake.operators import dom, extract

VOID = dom.VOID


def notes(spark, *contents):
    return spark.createDataFrame([(str(i), c) for i, c in enumerate(contents)], "path string, content string")


def test_tags_by_key(spark):
    df = notes(
        spark,
        "---\naliases:\n  - other name\ntags:\n- loose\n- a/b_c\n---\nbody",
        "---\ntags:\n  - \"q, r\"\n  - 12\n  - key: value\n  - #none\n  # - comment\n  - yes it is # comment\nmore: x\n---\n",
        "---\ntags: [one,\n  'two', three]\ntag: \"#four\"\n---\n",
        "---\ntags:\n  sub:\n    - deep\ntag: null\n---\n#Inline text #tipo/x",
        "no front\n---\ntags: [a]\n---\n",
        "---\ntags: [open\n---\n",
        None,
    )
    got = {}
    for r in extract.extract_tags(df).collect():
        got.setdefault(r.path, set()).add(r.term)
    assert got == {"0": {"loose", "a", "b c"}, "1": {"q", "r", "none", "yes it is"}, "2": {"one", "two", "three", "four"}, "3": {"Inline", "x"}, "5": {"open"}}


def test_front_matter_fields(spark):
    df = notes(
        spark,
        "---\nsummary: >-\n  a\n  b\nauthor:\n  - X\n  - 'Y, Z'\ntags: [a, b]\n---\n",
        "---\nresumen: ''\nsummary: 12\ndescription: \"say \\\"so\\\" # no comment\" # comment\nautor: []\nAuthor: Q\n---\n",
        "---\nsummary:\n  nested: x\nabstract: two\n  lines\n---\n",
        "---\ntitle: x\n---\n",
        "text only",
    )
    got = {r.path: tuple(r)[1:] for r in extract.front_matter(df).collect()}
    assert got == {"0": ("a b", "[a, b]", "X, Y, Z"), "1": ('say "so" # no comment', None, "Q"), "2": ("two lines", None, None), "3": (None, None, None), "4": (None, None, None)}


class Tree(HTMLParser):
    """A plain tree of well-formed pages: nodes [name, attributes, children], texts as strings."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ["#", {}, []]
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = [tag, {k: v or "" for k, v in attrs}, []]
        self.open[-1][2].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        if tag not in VOID:
            assert self.open.pop()[0] == tag

    def handle_data(self, data):
        self.open[-1][2].append(data)


def walk(node):
    for c in node[2]:
        if not isinstance(c, str):
            yield c
            yield from walk(c)


def content(node):
    return "".join(c if isinstance(c, str) else content(c) for c in node[2])


def prune(node):
    noisy = lambda c: not isinstance(c, str) and (c[0] in dom.NOISE or set(c[1].get("class", "").split()) & set(dom.NOISE_CLASSES))
    node[2] = [c for c in node[2] if not noisy(c)]
    for c in node[2]:
        if not isinstance(c, str):
            prune(c)


def by_tree(page, least=15):
    parser = Tree()
    parser.feed(page)
    parser.close()
    prune(parser.root)
    root = parser.root
    for kind, value in dom.ROOTS:
        hit = next((n for n in walk(parser.root) if (n[0] == value if kind == "tag" else n[1].get("id") == value if kind == "id" else value in n[1].get("class", "").split())), None)
        if hit:
            root = hit
            break
    lines = [(n[0] != "p", content(n).strip()) for n in walk(root) if n[0] in dom.KEPT]
    return "\n\n".join(f"\n### {t}\n" if h else t for h, t in lines if len(t) > least).strip()[:8000]


def random_page(rng, depth=0, inline=False):
    """Well-formed HTML: a paragraph holds inline elements only."""
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        if inline or kind < 0.2:
            out.append(rng.choice(["some words &amp; more ", "short", "a <br> b", "<!-- <p>no</p> -->", "&lt;p&gt; escaped "]) if depth > 4 or rng.random() < 0.6 else f"<{(t := rng.choice('b i a span em'.split()))} href='x>y'>{random_page(rng, depth + 1, True)}</{t}>")
        elif kind < 0.5:
            t = rng.choice(["p", "p", "h1", "h2", "h3", "h4"])
            out.append(f"<{t}>{random_page(rng, depth + 1, True)} and enough text</{t}>")
        elif depth < 6:
            t = rng.choice("div div div section article main aside nav ul blockquote header footer".split())
            mark = rng.choice(["", "", "", ' id="content"', ' class="a comments"', ' class="story-body x"', " class=article-body", ' class="advertisement"'])
            out.append(f"<{t}{mark}>{random_page(rng, depth + 1)}</{t}>")
        else:
            out.append("<script>var a = '<p>script paragraph text</p>';</script>")
    return "".join(out)


def test_main_text_against_a_tree(spark):
    rng = random.Random(11)
    pages = [f"<html><body>{random_page(rng)}</body></html>" for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    got = {r.page_id: r.text for r in dom.main_text(df).collect()}
    want = {i: by_tree(p) for i, p in enumerate(pages)}
    assert got == want
    assert sum(map(bool, want.values())) > 200


def test_main_text_odd_pages(spark):
    pages = [None, "", "<p>", "<p>just a paragraph of text", "<<p>>less than a paragraph</p>", "<p>one paragraph of text<div>not in it</div>", "<article><p>kept paragraph text</p></div></article>", "<p>unclosed comment text <!-- never ends", "<div>" * 3000 + "<p>very deep paragraph text</p>", "<p title='a>b' class=\"comments\">a commented paragraph</p><p>the other paragraph text</p>"]
    got = [r.text for r in dom.main_text(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")).orderBy("page_id").collect()]
    assert got == ["", "", "", "just a paragraph of text", ">less than a paragraph", "one paragraph of text", "kept paragraph text", "unclosed comment text", "very deep paragraph text", "the other paragraph text"]
    long = dom.main_text(spark.range(1).select(F.col("id").alias("page_id"), F.concat(F.lit("<p>"), F.repeat(F.lit("word "), 100_000)).alias("html"))).first().text
    assert len(long) == 8000
