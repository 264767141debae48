"""Hashes of words and shingles, computed with NumPy over whole batches of texts inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_FACTORS = tuple(_U((_BASE * (2 * i + 3)) & (2**64 - 1) | 1) for i in range(16))
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, _U(base))
    out[:1] = _U(1)
    return np.multiply.accumulate(out)


class WordHasher:
    """Splits texts at ASCII white space, A-Z as a-z, and hashes each word with a polynomial over its bytes.

    plain: a table of 256 bytes put in for a text's bytes before that (to make punctuation blank).
    """

    def __init__(self, plain: bytes | None = None) -> None:
        self.plain = plain
        self.up = self.down = np.zeros(0, _U)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word hashes of all texts in order, each word's text, the bytes, and where the words start and end in them."""
        lowered = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        if self.plain:
            lowered = [t.translate(self.plain) for t in lowered]
        raw = b"\n".join([*lowered, b""])
        data = np.frombuffer(raw, np.uint8)
        if len(data) > len(self.up):
            self.up, self.down = _powers(_BASE, 2 * len(data)), _powers(pow(_BASE, -1, 2**64), 2 * len(data))
        blank = _BLANK[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        sums = np.zeros(len(data) + 1, _U)
        np.cumsum((data.astype(_U) + _U(1)) * self.up[: len(data)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(_U) * _FACTORS[0])
        bounds = np.cumsum([len(x) + 1 for x in lowered])
        return hashes, np.searchsorted(bounds, starts, side="right"), data, starts, ends


def shingle_sets(hashes: np.ndarray, owner: np.ndarray, n_texts: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all texts, one text after the other, and where each text's begin (and the end).

    A text with fewer words than size, but not none, has one shingle.
    """
    counts = np.bincount(owner, minlength=n_texts)
    wide = max(0, len(hashes) - size + 1)
    total = np.zeros(wide, _U)
    for j in range(size):
        total += hashes[j : j + wide] * _FACTORS[j + 1]
    whole = owner[:wide] == owner[len(owner) - wide :]
    tokens, own = mix(total[whole]), owner[:wide][whole]
    few = np.flatnonzero((counts > 0) & (counts < size))
    if len(few):
        first = np.concatenate([[0], np.cumsum(counts)])
        own = np.concatenate([own, few])
        tokens = np.concatenate([tokens, np.array([_short(hashes[first[i] : first[i] + counts[i]]) for i in few], _U)])
        order = np.argsort(own, kind="stable")
        tokens, own = tokens[order], own[order]
    places = np.arange(n_texts + 1)
    starts = np.searchsorted(own, places)
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a > 1:
            tokens[a:b].sort()
    if len(tokens):
        new = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (own[1:] != own[:-1])])
        tokens, own = tokens[new], own[new]
    return tokens, np.searchsorted(own, places)


def _short(hashes: np.ndarray) -> np.uint64:
    value = _U(len(hashes))
    for h in hashes:
        value = mix(np.array([value]) * _FACTORS[7] + h)[0]
    return value


def set_ids(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit names (signed) of the sets that shingle_sets gives; 0 for an empty one."""
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(tokens))])
    n = np.diff(starts)
    named = mix(mix(sums[starts[1:]] - sums[starts[:-1]] + n.astype(_U)))
    return np.where(n > 0, named, _U(0)).view(np.int64)


def by_bytes(texts: list[str], limit: int = 1 << 20, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Consecutive texts [start, end) of about limit characters and at most `rows` texts each; a longer text is a part of its own."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and (total + len(t) > limit or i - start >= rows):
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)
