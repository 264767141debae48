"""Operator 1: vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.common import table
from notelake.llm.tokenization import encode_batches, encoder

#: A sequence id is the task's partition number, shifted by this many bits, plus the sequence's number in the task.
_SHIFT = 40


class Packer:
    """Packs items as they come, with at most `window` of them open; emits closed pieces through `take()`.

    An item is a run of a document's ids with, for each id, whether it bears loss. Each open item has a demand vector
    (tokens, 1 segment, loss tokens); a sequence has a capacity vector. The item with the largest dot product of demand
    and remaining capacity, both as shares of the full capacity, goes in next. If no whole item fits, the best one is
    cut at the largest prefix that fits. What is left at the end is packed into sequences of a power of two.
    """

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, window: int, first_id: int):
        self.cap = np.array([max_tokens, max_segments, max_loss], float)
        self.tokens, self.segments, self.loss, self.window = max_tokens, max_segments, max_loss, window
        self.meta: list = []  # (row, start, ids, summed loss or None)
        self.need = np.zeros((2 * window + 1, 3))
        self.sequence = first_id
        self.out: list[tuple] = []

    def add(self, row: int, ids: np.ndarray, loss: np.ndarray | None) -> None:
        start = 0
        sums = None if loss is None else np.concatenate([[0], np.cumsum(loss)])
        if sums is None and self.loss >= self.tokens:
            while len(ids) - start >= self.tokens:  # whole sequences need no search
                self.out.append((row, start, ids[start : start + self.tokens], self.sequence, 0))
                self.sequence += 1
                start += self.tokens
        if len(ids) > start:
            self._open(row, start, ids[start:], sums if sums is None else sums[start:] - sums[start])
        if len(self.meta) >= 2 * self.window:
            while len(self.meta) > self.window:
                self._fill(self.tokens)

    def finish(self) -> None:
        while self.meta:
            left = int(self.need[: len(self.meta), 0].sum())
            self._fill(min(self.tokens, 1 << (left.bit_length() - 1)))

    def take(self) -> list[tuple]:
        out, self.out = self.out, []
        return out

    def _open(self, row: int, start: int, ids: np.ndarray, sums: np.ndarray | None) -> None:
        self.need[len(self.meta)] = len(ids), 1, len(ids) if sums is None else sums[-1]
        self.meta.append((row, start, ids, sums))

    def _close(self, i: int) -> tuple:
        """Takes item i out; the last one moves to its place."""
        item, last = self.meta[i], self.meta.pop()
        if i < len(self.meta):
            self.meta[i] = last
            self.need[i] = self.need[len(self.meta)]
        return item

    def _fill(self, size: int) -> None:
        room, offset = np.array([size, self.segments, self.loss], float), 0
        while self.meta and room[0] > 0 and room[1] > 0:
            need = self.need[: len(self.meta)]
            score = need @ (room / self.cap / self.cap)
            fits = (need <= room).all(axis=1)
            if fits.any():
                i = int(np.where(fits, score, -1.0).argmax())
                row, start, ids, sums = self._close(i)
                used = self._used(len(ids), sums)
            else:
                i, keep = self._cut(score, room)
                if not keep:
                    break
                row, start, ids, sums = self._close(i)
                rest = None if sums is None else sums[keep:] - sums[keep]
                self._open(row, start + keep, ids[keep:], rest)
                ids, used = ids[:keep], self._used(keep, sums)
            self.out.append((row, start, ids, self.sequence, offset))
            offset += len(ids)
            room -= used
        self.sequence += 1

    def _used(self, n: int, sums: np.ndarray | None) -> np.ndarray:
        return np.array([n, 1, n if sums is None else sums[n]], float)

    def _cut(self, score: np.ndarray, room: np.ndarray) -> tuple[int, int]:
        """The best item that has a prefix within the remaining tokens and loss, and that prefix's length."""
        for i in np.argsort(-score, kind="stable"):
            _, _, ids, sums = self.meta[i]
            keep = min(len(ids), int(room[0]))
            keep = min(keep, int(room[2])) if sums is None else min(keep, int(np.searchsorted(sums, room[2], side="right")) - 1)
            if keep > 0:
                return int(i), keep
        return 0, 0


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", *, id_col: str = "doc_id", text_col: str = "text", loss_from_col: str | None = None, loss_free: int = 0, end_id: int = 1, max_tokens: int = 2048, max_segments: int = 256, max_loss: int | None = None, window: int = 256) -> DataFrame:
    """One row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    A document is its ids followed by end_id; every id is in exactly one piece, and a sequence's pieces follow each
    other without gaps from offset 0. Each task packs the rows of its own split with a bounded set of open items, so
    nothing is shuffled and a lost task gives the same pieces when it runs again. Sequences hold at most max_tokens ids,
    max_segments pieces and max_loss loss-bearing ids (default max_tokens). The first loss_free ids of a document bear no
    loss (nothing stands before them to predict them from), or as many as loss_from_col says (a prompt). A null text is
    empty (one piece with end_id), a null id stays null, repeated rows are packed each, of items with equal scores the
    one that has waited longest in its place goes first, a very long text is encoded in parts and cut into as many
    sequences as it takes, columns not named are left out, whatever their names, and an empty table gives no row. Only a
    sequence closed by the segment or loss limit can be short of a power of two.
    """
    kind = dict(docs.dtypes)[id_col]
    most_loss = max_tokens if max_loss is None else max_loss
    if most_loss < 1 or max_segments < 1 or max_tokens < 1:
        raise ValueError("limits must be at least 1")
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
    schema = f"{id_col} {kind}, " + ", ".join(f"{n} long" for n in names[1:])

    def rows(pieces: list[tuple], ids: dict, totals: dict, prompts: dict, id_type) -> pa.RecordBatch:
        values: list[list] = [[] for _ in names]
        for row, start, piece, sequence, offset in pieces:
            loss = len(piece) - min(len(piece), max(0, prompts.get(row, 0) - start))
            for column, v in zip(values, (ids[row], start, len(piece), zlib.crc32(piece.tobytes()), totals[row], sequence, offset, loss), strict=True):
                column.append(v)
        return pa.RecordBatch.from_arrays([pa.array(values[0], id_type), *(pa.array(v, pa.int64()) for v in values[1:])], names=names)

    def run(batches) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        packer = Packer(max_tokens, max_segments, most_loss, window, TaskContext.get().partitionId() << _SHIFT)
        ids, totals, prompts, row, id_type = {}, {}, {}, 0, None

        def flush():
            nonlocal ids, totals, prompts
            batch = rows(packer.take(), ids, totals, prompts, id_type)
            open_rows = {m[0] for m in packer.meta}
            ids, totals, prompts = ({k: v for k, v in x.items() if k in open_rows} for x in (ids, totals, prompts))
            return batch

        for batch in batches:
            id_type = batch.column(0).type
            keys, texts, starts = (batch.column(i).to_pylist() for i in range(3))
            for i, lists in encode_batches(encode, texts):
                key, prompt = keys[i], starts[i]
                parts = [np.array(p, "<u4") for p in lists]
                tokens = np.concatenate([*parts, np.array([end_id], "<u4")])
                ids[row], totals[row] = key, len(tokens)
                mask = None
                if prompt:
                    prompts[row] = prompt
                    mask = np.arange(len(tokens)) >= prompt
                packer.add(row, tokens, mask)
                row += 1
                if len(packer.out) >= 4096:
                    yield flush()
        packer.finish()
        if packer.out:
            yield flush()

    prompt = F.lit(loss_free) if loss_from_col is None else F.coalesce(F.col(loss_from_col).cast("int"), F.lit(0))
    return docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), prompt.alias("_prompt")).mapInArrow(run, schema)


def pack_documents(docs: DataFrame) -> DataFrame:
    """pack() as production runs it: 16 leading ids of a document bear no loss, and a sequence has at least 8 such ids if full and at most 64 pieces."""
    return pack(docs, loss_free=16, max_loss=2040, max_segments=64)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
