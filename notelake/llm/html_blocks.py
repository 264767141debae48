"""Leaf blocks of HTML pages with what the model sees of them."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

_TAG = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_PLAIN = re.compile(r"[^>\"']*")
_NAME = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"\shidden(?=[\s>=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z]+")

# Elements whose content is no text, elements without content, and elements that begin and end a block.
RAW = frozenset("script style noscript template textarea title iframe svg select button canvas".split())
#: Of these, an element whose closing tag is missing takes the rest of the page; another one is taken as empty.
TO_THE_END = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements nested deeper than this count as part of the one at this depth, as in browsers.
DEEPEST = 256
_CLOSING = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
#: Elements that an opening one of the same group ends.
ENDED_BY = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Elements past which nothing is ended implicitly.
SCOPE = frozenset("article aside body div footer form header main nav ol section table ul".split())


@dataclass
class Block:
    text: str
    tag: str
    names: tuple[str, ...]
    path: tuple[str, ...]
    linked: int = 0
    marked: bool = False
    features: list[str] = field(default_factory=list)


def _tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name in lower case, attributes) of tags in order; comments and declarations have an empty name.

    A ">" in quotes after "=" belongs to the tag. Where such quotes run to the end of the page they are taken as they
    stand, from there on for all tags, so no part of a page is read again and again. The caller may move on in between:
    what it sends is where to go on.
    """
    at, last, quotes = 0, page.rfind(">"), True
    while True:
        start = page.find("<", at)
        if start < 0:
            return
        at = start + 1
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = (yield start, len(page) if end < 0 else end + 3, False, "", "") or (len(page) if end < 0 else end + 3)
            continue
        if start > last:
            return
        if page[at] in "!?":
            end = page.find(">", at) + 1
            at = (yield start, end, False, "", "") or end
            continue
        name = _TAG.match(page, at)
        if not name:
            continue
        end = _tag_end(page, name.end()) if quotes else -1
        if end < 0:
            quotes, end = False, page.find(">", name.end())
        at = (yield start, end + 1, bool(name[1]), name[2].lower(), page[name.end() : end]) or end + 1


def _tag_end(page: str, at: int) -> int:
    """Place of the tag's ">" outside quoted values, -1 if there is none."""
    while True:
        at = _PLAIN.match(page, at).end()  # type: ignore[union-attr]
        if at >= len(page):
            return -1
        if page[at] == ">":
            return at
        if page[at - 1] == "=" or (page[at - 1] in " \t\n" and page[at - 2] == "="):
            at = page.find(page[at], at + 1)
            if at < 0:
                return -1
        at += 1


def blocks(page: str, mark: str | None = None) -> list[Block]:
    """Runs of text between block borders, references decoded and white space made single blanks; mark tags labelled ones."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked, links
        body = " ".join("".join(text).split())
        if body:
            marked = mark is not None and body.startswith(mark)
            body = body[len(mark) :].strip() if marked else body  # type: ignore[arg-type]
            path = tuple(t for t, _ in stack)
            out.append(Block(body, path[-1] if path else "body", tuple(n for _, names in stack for n in names), path, min(linked, len(body)), marked))
        text.clear()
        linked = links = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            value = html.unescape(raw)
            text.append(value)
            if links:
                linked += len(value.strip())

    at, tags, go_on, unclosed = 0, _tags(page), None, set()
    while True:
        try:
            start, end, closing, tag, attributes = tags.send(go_on)
        except StopIteration:
            add(page[at:])
            break
        add(page[at:start])
        at, go_on = end, None
        if not tag:
            continue
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK:
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
                flush()
                if depth is not None:
                    del stack[depth:]
            continue
        if tag in RAW:
            if not attributes.endswith("/") and tag not in unclosed:
                found = _CLOSING[tag].search(page, at)
                if found:
                    at = go_on = found.end()
                elif tag in TO_THE_END:
                    at = go_on = len(page)
                else:
                    unclosed.add(tag)
            text.append(" ")
        elif tag == "br":
            text.append(" ")
        elif tag == "a":
            links += 1
        elif tag in BLOCK:
            flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ENDED_BY.get(tag, ()):
                    del stack[i:]
                    break
                if stack[i][0] in SCOPE or (tag not in ENDED_BY and stack[i][0] != "p"):
                    break
            if stack and stack[-1][0] == "p" and tag != "p":
                stack.pop()
            if tag not in VOID and len(stack) < DEEPEST:
                names = tuple(w for m in _NAME.finditer(attributes) for w in _WORD.findall(m[1].lower())) if attributes else ()
                if attributes and _HIDDEN.search(attributes):
                    names += ("hidden",)
                stack.append((tag, names))
    flush()
    for i, b in enumerate(out):
        b.features = features(b, i, len(out))
    return out


_CUES = re.compile(r"cookie|subscri|newsletter|sign up|log in|advert|sponsor|copyright|all rights|©|privacy|share|follow us|repl(?:y|ies)|comment|read more|related", re.I)


def features(b: Block, i: int, n: int) -> list[str]:
    """Ancestor tags, words of their classes and ids, and shape of the text, as names."""
    words = b.text.split()
    size = next(s for s, most in (("1", 1), ("4", 4), ("9", 9), ("19", 19), ("49", 49), ("more", 10**9)) if len(words) <= most)
    share = b.linked / max(1, len(b.text))
    out = ["bias", f"tag={b.tag}", f"size={size}", f"links={0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3}", f"place={min(9, 10 * i // n)}"]
    out += [f"in={t}" for t in set(b.path)] + [f"name={w}" for w in set(b.names)]
    if b.text[-1] in ".!?…。":
        out.append("sentence")
    out += [f"cue={w.lower()}" for w in set(_CUES.findall(b.text))] if len(words) < 20 else []
    if "article" not in b.path and "main" not in b.path:
        out += ["loose", f"loose,size={size}"]
    return out
