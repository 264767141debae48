"""Operator 2: license notices found by winnowed fingerprints and banded alignment."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.common import table
from notelake.llm.license_templates import TEMPLATES
from notelake.llm.shingles import WordHasher, by_bytes, mix

#: Punctuation becomes blanks before words are split, so that "License," and "license" are one word.
_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    n = max(0, len(words) - size + 1)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total += words[j : j + n] * np.uint64(2 * j + 0x9E3779B1)
    return mix(total)


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of each window's smallest value (the last of equal ones); of all values if there are fewer than window."""
    if not len(grams):
        return np.zeros(0, np.int64)
    width = min(window, len(grams))
    views = np.lib.stride_tricks.sliding_window_view(grams, width)[:, ::-1]
    return np.unique(np.arange(len(views)) + width - 1 - views.argmin(axis=1))


@dataclass
class Index:
    """Inverted index of the templates' fingerprints: sorted hashes with the template and place of each."""

    names: list[str]
    words: list[np.ndarray]
    hashes: np.ndarray
    template: np.ndarray
    place: np.ndarray


def build_index(templates: dict[str, str], gram: int = 3, window: int = 4) -> Index:
    hasher = WordHasher(_PLAIN)
    names, words, rows = sorted(templates), [], []
    for i, name in enumerate(names):
        hashes = hasher([templates[name]])[0]
        words.append(hashes)
        size = min(gram, len(hashes))
        grams = _grams(hashes, size) if size == gram else np.zeros(0, np.uint64)
        rows += [(int(grams[p]), i, int(p)) for p in winnow(grams, window)]
    rows.sort()
    column = lambda j, kind: np.array([r[j] for r in rows], kind)
    return Index(names, words, column(0, np.uint64), column(1, np.int64), column(2, np.int64))


def align(template: np.ndarray, text: np.ndarray, band: int) -> tuple[int, int, int]:
    """Matched words, first and end place in text of the best alignment of the template within the band.

    text[i + band] is the word on the diagonal of template word i. A match counts 2, a gap or mismatch costs 1; the ends of
    text are free. Paths may leave the diagonal by up to band words.
    """
    a, b = template.tolist(), text.tolist()
    width = 2 * band + 1
    low = -(10**9)
    # Per offset from the diagonal: score, matched, first matched place, end of the last match.
    last = [(0, 0, -1, -1)] * width
    for i, word in enumerate(a):
        now: list[tuple[int, int, int, int]] = [(low, 0, -1, -1)] * width
        for j in range(width):
            at = i + j
            s, m, first, end = last[j]
            if at < len(b) and b[at] == word:
                cell = (s + 2, m + 1, at if first < 0 else first, at + 1)
            else:
                cell = (s - 1, m, first, end)
            if j + 1 < width and last[j + 1][0] - 1 > cell[0]:
                cell = (last[j + 1][0] - 1, *last[j + 1][1:])
            if j and now[j - 1][0] - 1 > cell[0]:
                cell = (now[j - 1][0] - 1, *now[j - 1][1:])
            now[j] = cell
        last = now
    top = max(last, key=lambda x: (x[1], x[0]))
    return top[1], top[2], top[3]


def scan_words(words: np.ndarray, index: Index, gram: int, band: int, least: float) -> list[tuple[int, int, int, int]]:
    """(template, matched, first word, end word) of the matches in one text: best coverage first, none overlapping another."""
    grams = _grams(words, gram)
    if not len(grams) or not len(index.hashes):
        return []
    low = np.searchsorted(index.hashes, grams, side="left")
    high = np.searchsorted(index.hashes, grams, side="right")
    candidates: set[tuple[int, int]] = set()
    for p in np.flatnonzero(high > low):
        for k in range(low[p], high[p]):
            candidates.add((int(index.template[k]), int(p - index.place[k]) // (band + 1)))
    found = []
    for t, cell in sorted(candidates):
        start = cell * (band + 1)
        wide = 2 * band
        lead = start - wide
        text = words[max(0, lead) : start + len(index.words[t]) + 2 * wide]
        if lead < 0:
            text = np.concatenate([np.zeros(-lead, np.uint64), text])
        matched, first, end = align(index.words[t], text, wide)
        if matched and matched >= least * len(index.words[t]):
            found.append((t, matched, first + lead, end + lead))
    found.sort(key=lambda f: (-f[1] / len(index.words[f[0]]), -f[1], f[2], f[0]))
    kept: list[tuple[int, int, int, int]] = []
    for f in found:
        if all(f[3] <= k[2] or k[3] <= f[2] for k in kept):
            kept.append(f)
    return sorted(kept, key=lambda f: f[2])


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, *, id_col: str = "doc_id", text_col: str = "text", gram: int = 3, window: int = 4, band: int = 4, least: float = 0.8) -> DataFrame:
    """One row a match: id, template, start, end (code points), matched_words, template_words, coverage.

    Templates are kept as winnowed fingerprints (the smallest hash of each window of word n-grams) in an inverted index; a
    text's n-grams that are in it name a template and a diagonal, and the template is aligned with the words around that
    diagonal, at most 2 * band words off it. Matches that cover `least` of the template's words are reported, the best
    first where they overlap. The set of templates is an argument of fixed size and goes to the tasks with the function.
    A template with fewer words than gram has no fingerprint and is never found. Of overlapping matches with equal coverage
    the longer, then the earlier one stays. A null text has no words, a null id stays null, repeated rows are scanned each,
    a very long text costs about its length, other columns are left out, whatever their names, an empty table gives no row.
    """
    index = build_index(TEMPLATES if templates is None else templates, gram, window)
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        hasher = WordHasher(_PLAIN)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            rows: list[tuple] = []
            for start, end in by_bytes(texts):
                hashes, owner, _, starts, ends = hasher(texts[start:end])
                sizes = np.bincount(owner, minlength=end - start)
                first = np.concatenate([[0], np.cumsum(sizes)])
                grams = _grams(hashes, gram)
                known = np.flatnonzero(np.isin(grams, index.hashes))
                raws = [t.encode("utf-8", "surrogatepass") for t in texts[start:end]] if len(known) else []
                offsets = np.cumsum([0, *(len(r) + 1 for r in raws)])
                for i in np.unique(owner[known]) if len(known) else ():
                    a, b = first[i], first[i + 1]
                    raw, offset = raws[i], int(offsets[i])
                    for t, matched, lo, hi in scan_words(hashes[a:b], index, gram, band, least):
                        here = lambda x: len(raw[: int(x) - offset].decode("utf-8", "surrogatepass"))  # noqa: B023, E731
                        rows.append((start + int(i), index.names[t], here(starts[a + lo]), here(ends[a + hi - 1]), matched, len(index.words[t])))
            column = lambda j: [r[j] for r in rows]  # noqa: B023, E731
            take = ids.take(pa.array(column(0), pa.int64()))
            yield pa.RecordBatch.from_arrays([take, pa.array(column(1), pa.string()), *(pa.array(column(j), pa.int64()) for j in (2, 3, 4, 5)), pa.array([r[4] / r[5] for r in rows], pa.float64())], names=[id_col, "template", "start", "end", "matched_words", "template_words", "coverage"])

    return docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).mapInArrow(run, f"{id_col} {kind}, template string, start long, end long, matched_words long, template_words long, coverage double")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
