"""Operator 9: main text of HTML pages by a linear-chain conditional random field over leaf blocks."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.common import table
from notelake.llm.html_blocks import Block, blocks
from notelake.llm.html_layouts import MARK, labelled_pages


@dataclass
class Crf:
    """Weights of feature names for the labels other (0) and main text (1), and of label pairs; row 2 of pairs begins a page."""

    index: dict[str, int]
    weights: np.ndarray
    pairs: np.ndarray

    def emissions(self, page: list[Block]) -> np.ndarray:
        return np.array([self.weights[[self.index[f] for f in b.features if f in self.index]].sum(axis=0) for b in page])

    def decode(self, page: list[Block]) -> list[int]:
        """The likeliest labels of the page's blocks together (Viterbi)."""
        if not page:
            return []
        e = self.emissions(page)
        a, b = (e[0] + self.pairs[2]).tolist()
        (oo, om), (mo, mm) = self.pairs[:2].tolist()
        back = []
        for x, y in e[1:].tolist():
            back.append((int(b + mo > a + oo), int(b + mm > a + om)))
            a, b = x + max(a + oo, b + mo), y + max(a + om, b + mm)
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def train(pages: list[list[Block]], rounds: int = 60, rate: float = 0.5, penalty: float = 1e-3) -> Crf:
    """Maximum likelihood with a small penalty: gradients by forward-backward, adaptive steps, fixed number of rounds."""
    names = sorted({f for p in pages for b in p for f in b.features})
    index = {f: i for i, f in enumerate(names)}
    rows = [[np.array([index[f] for f in b.features]) for b in p] for p in pages]
    labels = [np.array([int(b.marked) for b in p]) for p in pages]
    w, t = np.zeros((len(names), 2)), np.zeros((3, 2))
    seen_w, seen_t = np.full_like(w, 1e-6), np.full_like(t, 1e-6)
    for _ in range(rounds):
        gw, gt = -penalty * w * len(pages), -penalty * t * len(pages)
        for page, y in zip(rows, labels, strict=True):
            n = len(page)
            e = np.array([w[r].sum(axis=0) for r in page])
            ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
            ahead[0] = e[0] + t[2]
            for i in range(1, n):
                ahead[i] = e[i] + np.logaddexp(ahead[i - 1, 0] + t[0], ahead[i - 1, 1] + t[1])
            for i in range(n - 2, -1, -1):
                nxt = e[i + 1] + behind[i + 1]
                behind[i] = np.logaddexp(t[:2, 0] + nxt[0], t[:2, 1] + nxt[1])
            z = np.logaddexp(*ahead[-1])
            prob = np.exp(ahead + behind - z)
            for i, r in enumerate(page):
                gw[r] -= prob[i]
                gw[r, y[i]] += 1
            gt[2] -= prob[0]
            gt[2, y[0]] += 1
            for i in range(1, n):
                gt[:2] -= np.exp(ahead[i - 1][:, None] + t[:2] + e[i] + behind[i] - z)
                gt[y[i - 1], y[i]] += 1
        seen_w += gw**2
        seen_t += gt**2
        w += rate * gw / np.sqrt(seen_w)
        t += rate * gt / np.sqrt(seen_t)
    return Crf(index, w, t)


@functools.lru_cache(maxsize=4)
def default_model(pages: int = 380, seed: int = 11) -> Crf:
    """Trained on `pages` labelled pages, a fixed bound that does not depend on the corpus."""
    return train([blocks(p, MARK) for p in labelled_pages(pages, seed)])


def main_text(page: str, model: Crf) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, model.decode(found), strict=True) if keep)


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Crf | None = None) -> DataFrame:
    """One row a page: id, url, text (main blocks in page order, joined by newlines; empty if none), n_chars.

    The model is trained on a fixed number of labelled pages and goes to the tasks with the function (some hundred
    weights). A null page is empty, null ids and urls stay, repeated rows are worked on each, an empty table gives no row.
    """
    trained = model or default_model()
    kinds = dict(pages.dtypes)

    def run(batches):
        for batch in batches:
            texts = [main_text(p or "", trained) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return pages.select(id_col, url_col, F.col(html_col)).mapInArrow(run, f"{id_col} {kinds[id_col]}, {url_col} {kinds[url_col]}, text string, n_chars long")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
