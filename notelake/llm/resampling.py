"""Operator 12: importance resampling towards a target's distribution of words; exact ranks by parallel sorting by regular sampling."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.common import table, written
from notelake.llm.word_crc import stretches

#: Rows that a range of the order should hold at most, and keys that are looked at for the ranges' bounds.
RANGE_ROWS, SAMPLED = 1 << 20, 4_000_000


def _counts(docs: DataFrame, text_col: str, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket; a task adds up its texts, and one row a task and bucket is moved."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, singles, pairs, first in stretches(batch.column(0)):
                whole = np.ones(len(pairs), bool)
                whole[first[1:][first[1:] > 0] - 1] = False  # a text's last word has no next one
                total += np.bincount(singles[first[0] :] % buckets, minlength=buckets) + np.bincount(pairs[whole] % buckets, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(total)], names=["bucket", "n"])

    rows = docs.select(F.coalesce(F.col(text_col), F.lit(""))).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"]] = rows["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of a bucket's smoothed shares in target and source, in thousandths, floored."""
    n, total, wanted = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (total + n) / ((s + 1) * (wanted + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _scored(docs: DataFrame, id_col: str, text_col: str, gain: np.ndarray, seed: int, kind: str) -> DataFrame:
    """(id, n_words, n_features, weight, score, row) of every document."""
    names = ["id", "n_words", "n_features", "weight", "score"]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            words, sums = np.zeros(m, np.int64), np.zeros(m, np.int64)
            for start, end, singles, pairs, first in stretches(batch.column(1)):
                one, two = gain[singles % len(gain)], gain[pairs % len(gain)]
                two[first[1:][first[1:] > 0] - 1] = 0
                if first[0]:
                    one[0] = 0
                run_ = np.concatenate([[0], np.cumsum(one + two)])
                words[start:end] += np.diff(first)
                sums[start:end] += run_[first[1:]] - run_[np.concatenate([[0], first[1:-1]])]
            features = np.maximum(2 * words - 1, 0)
            weight = np.floor_divide(sums, np.maximum(features, 1))
            noise = [math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, features, weight, weight + np.array(noise, np.int64)))], names=names)

    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.conv(F.substring(drawn, 1, 8), 16, 10).cast("long").alias("h"))
    return source.mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} long" for c in names[1:])).withColumn("row", F.monotonically_increasing_id())


def _sorted(run: pa.Table) -> pa.Table:
    """Rows by falling score, then id (nulls last), then row; runs that are sorted already are merged."""
    return run.take(pc.sort_indices(run, sort_keys=[("score", "descending"), ("id", "ascending"), ("row", "ascending")], null_placement="at_end"))


def _key(score: int, id_, row: int) -> tuple:
    return (-score, id_ is None, id_ if id_ is not None else 0, row)


def ranked(rows: DataFrame) -> DataFrame:
    """rows (a written table with id, score, row) with their exact rank (1, 2, ...) by falling score, then id, then row.

    Parallel sorting by regular sampling: every task sorts the rows of its split and gives keys at regular distances; of all these keys, sorted, regular
    ones bound the ranges. A task then cuts its sorted run at the bounds, the segments of a range are exchanged to one place and merged there, and
    counts of the ranges before give ranks without a further pass. A range holds about RANGE_ROWS rows at most, or its share of the partitions: bounds
    name a row, so equal scores and ids are parted too. The driver sees at most SAMPLED keys and one count a range.
    """
    spark = rows.sparkSession
    keys = rows.select("score", "id", "row")
    n = rows.count()
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE_ROWS))
    gap = max(1, n // min(ranges * ranges, SAMPLED))
    names, schema = rows.columns, ", ".join(f"`{c}` {k}" for c, k in rows.dtypes)

    def run_of(batches) -> pa.Table | None:
        held = [b for b in batches if b.num_rows]
        return _sorted(pa.Table.from_batches(held)) if held else None

    def sample(batches) -> Iterator[pa.RecordBatch]:
        if (run := run_of(batches)) is not None:
            yield from run.take(pa.array(np.arange(min(gap // 2, len(run) - 1), len(run), gap))).to_batches()

    samples = sorted(_key(*r) for r in keys.mapInArrow(sample, ", ".join(f"{c} {k}" for c, k in keys.dtypes)).collect())
    bounds = [samples[i * len(samples) // ranges] for i in range(1, ranges)] if samples else []

    def cut(run: pa.Table) -> np.ndarray:
        """Where each range begins in a sorted run, and its end."""
        score, ids, row = (run.column(c).combine_chunks() for c in ("score", "id", "row"))
        at, places = 0, [0]
        for bound in bounds:
            at = bisect.bisect_left(range(len(run)), bound, lo=at, key=lambda i: _key(score[i].as_py(), ids[i].as_py(), row[i].as_py()))
            places.append(at)
        return np.array([*places, len(run)])

    def count(batches) -> Iterator[pa.RecordBatch]:
        if (run := run_of(batches)) is not None:
            sizes = np.diff(cut(run))
            held = np.flatnonzero(sizes)
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sizes[held])], names=["range", "n"])

    def segments(batches) -> Iterator[pa.RecordBatch]:
        if (run := run_of(batches)) is not None:
            run = run.append_column("range", pa.array(np.repeat(np.arange(len(bounds) + 1), np.diff(cut(run)))))
            yield from run.to_batches(max_chunksize=1 << 16)

    before = np.zeros(len(bounds) + 2, np.int64)
    for k, m in keys.mapInArrow(count, "range long, n long").groupBy("range").agg(F.sum("n")).collect():
        before[k + 1] = m
    before = np.cumsum(before)

    def merge(segment: pa.Table) -> pa.Table:
        first = int(before[segment.column("range")[0].as_py()])
        return _sorted(segment).select(names).append_column("rank", pa.array(np.arange(first + 1, first + 1 + len(segment))))

    return rows.mapInArrow(segments, f"{schema}, range long").groupBy("range").applyInArrow(merge, f"{schema}, rank long")


def importance_resampling(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = 10_000, least_words: int = 20, per_cent: int = 25, seed: int = 7) -> DataFrame:
    """One row a document: id, n_features, weight, score, rank (null if not drawn).

    Features are words (a-z, 0-9 and all beyond ASCII, A-Z in lower case) and pairs of neighbouring words, hashed to buckets. A bucket's gain is the log
    ratio of its shares in the target's and the documents' features, smoothed by one a bucket; a document's weight is the mean gain of its features and
    its score adds Gumbel noise drawn from its id, so that the highest scores are a draw without replacement in proportion to exp(weight / 1000). Of the
    n documents with least_words words, the per_cent * n // 100 highest scores are drawn; ties go to the smaller id.

    Null and empty texts have no feature (weight 0); texts of any length are taken whole, in parts; repeated rows are documents each, in an order that
    their place in the table gives; a null id draws its noise from an empty text and comes after others in ties; other columns of either table are left
    out, whatever their names. An empty target has no feature (all gains come from smoothing); an empty table gives no row.
    """
    kind = dict(docs.dtypes)[id_col]
    gain = gains(_counts(docs, text_col, buckets), _counts(target, text_col, buckets))
    scored = written(_scored(docs, id_col, text_col, gain, seed, kind))
    able = scored.filter(F.col("n_words") >= least_words)
    drawn = per_cent * able.count() // 100
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    columns = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    rest = scored.filter(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked(able).select(*columns, rank.alias("rank")).unionByName(rest)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
