"""Main text of web pages by a walk over their tags that keeps a stack of open elements."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements and classes that hold no article text.
NOISE = ("script", "style", "noscript", "iframe", "nav", "footer", "header", "aside", "head", "ytd-engagement-panel-section-list-renderer")
NOISE_CLASSES = ("advertisement", "comments")
# Where the article is looked for, in order of preference: elements, an id, classes.
ROOTS = (("tag", "article"), ("tag", "main"), ("id", "content"), ("class", "article-body"), ("class", "story-body"))
# Fixed values, from the HTML standard: elements without content, with text only, and those whose start ends an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript iframe textarea title xmp noembed noframes".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
KEPT = frozenset(("h1", "h2", "h3", "p"))

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"\b(id|class)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def texts(page: str) -> list[tuple[bool, str]]:
    """(is heading, text) of the headings and paragraphs of the page's article, in order.

    An element's text is all text below it, nested elements included. A paragraph ends where the standard ends it without a tag of its own; an end tag
    closes all that is open inside its element, and one without an open element has no effect. What is inside noise is neither text nor a root.
    """
    stack: list[tuple[str, bool, list[int], int]] = []  # name, noise, roots opened here, place in found
    taking: list[list[str]] = []  # texts of the open headings and paragraphs
    found: list[tuple[bool, list[str], frozenset[int]]] = []
    opened, active, noise, at, end = set(), set(), 0, 0, len(page)

    def close(depth: int) -> None:
        nonlocal noise
        while len(stack) > depth:
            _, noisy, roots, place = stack.pop()
            noise -= noisy
            active.difference_update(roots)
            if place >= 0:
                taking.pop()

    def text(until: int) -> None:
        if taking and not noise and until > at:
            piece = html.unescape(page[at:until])
            for parts in taking:
                parts.append(piece)

    while at < end:
        token = _TOKEN.search(page, at)
        text(token.start() if token else end)
        if token is None:
            break
        at, name = token.end(), (token[2] or "").lower()
        if not name:
            continue
        if token[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                close(depth)
            continue
        if name in ENDS_PARAGRAPH:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p"), None)
            if depth is not None:
                close(depth)
        if name == "body" and stack and any(s[0] == "head" for s in stack):
            close(next(i for i, s in enumerate(stack) if s[0] == "head"))
        if name in RAW:
            closing = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if name not in NOISE and not noise:
                text_end = closing.start() if closing else end
                text(text_end)
            at = closing.end() if closing else end
            continue
        if name in VOID or token[3].endswith("/") and name not in KEPT and name not in ENDS_PARAGRAPH:
            continue
        attributes: dict[str, str] = {}
        for m in _ATTRIBUTE.finditer(token[3]):
            attributes.setdefault(m[1].lower(), html.unescape(m[2] if m[2] is not None else m[3] if m[3] is not None else m[4]))
        classes = attributes.get("class", "").split()
        noisy = name in NOISE or any(c in NOISE_CLASSES for c in classes)
        noise += noisy
        roots = []
        if not noise:
            own = {("tag", name), ("id", attributes.get("id")), *(("class", c) for c in classes)}
            roots = [k for k, root in enumerate(ROOTS) if root in own and k not in opened]
            opened.update(roots)
        place = -1
        if name in KEPT and not noise:
            place = len(found)
            taking.append([])
            found.append((name != "p", taking[-1], frozenset(active)))
        active.update(roots)
        stack.append((name, noisy, roots, place))
    root = min(opened, default=None)
    return [(heading, "".join(parts).strip()) for heading, parts, inside in found if root is None or root in inside]


def article(page: str | None, max_chars: int, least: int) -> str:
    """Headings (marked) and paragraphs over `least` characters, joined and cut."""
    lines = [f"\n### {t}\n" if heading else t for heading, t in texts(page or "") if len(t) > least]
    return "\n\n".join(lines).strip()[:max_chars]


def main_text(pages: DataFrame, max_chars: int = 8000, least: int = 15, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text): headings (marked) and paragraphs over `least` characters of the first article, main or content element outside noise, else of the page; a null page is empty."""

    def run(batches):
        for batch in batches:
            out = [article(p, max_chars, least) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[id_col, "text"])

    return pages.select(id_col, html_col).mapInArrow(run, f"`{id_col}` {dict(pages.dtypes)[id_col]}, text string")
