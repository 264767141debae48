"""Operator 13: whitening of embeddings by the principal components that contour integration finds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.common import free, table, written
from notelake.llm.feast import interval, slices

#: Entries are taken as whole multiples of 1 / GRID.
GRID = 256


def _whole(vector: Column) -> Column:
    """A vector's entries as longs; null for a vector that is null or holds null or non-finite entries."""
    fine = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    return F.when(fine & (F.size(vector) > 0), F.transform(vector, lambda c: F.floor(c.cast("double") * GRID)))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _summed(fit: DataFrame, d: int, part, length: int) -> np.ndarray:
    """The sum of part(x) (an array of `length` doubles) over batches x of the fit list; each task adds up its own, so only one row a task and place is moved."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for batch in batches:
            if batch.num_rows:
                total += part(_matrix(batch.column(0), d))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(length)), pa.array(total)], names=["place", "v"])

    rows = fit.select("x").mapInArrow(run, "place long, v double").groupBy("place").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(length)
    out[rows["place"]] = rows["v"]
    return out


def _components(spark: SparkSession, cov: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a covariance, falling, and their vectors as columns; each interval is solved in a task of its own."""
    found = slices(cov, wanted)
    if not found:
        return np.zeros(0), np.zeros((len(cov), 0))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values, vectors = interval(cov, low, high, count)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(vectors.T.tolist(), pa.list_(pa.float64()))], names=["value", "vector"])

    rows = spark.createDataFrame(found, "low double, high double, n int").repartition(len(found)).mapInArrow(run, "value double, vector array<double>").collect()
    # One more Rayleigh-Ritz step over all intervals: components of different tasks become orthogonal to rounding.
    basis, _ = np.linalg.qr(np.array([r.vector for r in sorted(rows, key=lambda r: -r.value)]).T)
    values, turned = np.linalg.eigh(basis.T @ cov @ basis)
    vectors = (basis @ turned)[:, ::-1][:, :wanted]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values[::-1][:wanted], vectors * sign


def whitening(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """One row a vector and component: id, component, n, deviation, whitened, explained, identity_error.

    Entries become longs x = floor(256 * c). The fit list is each distinct x once: n vectors with sums S. The covariance of the fit list (divisor n,
    centred before multiplying) is summed up in tasks, one d x d part each; only the d x d sum comes to the driver, whatever the number of vectors.
    Its components come from contour integration over intervals of its spectrum whose inertia counts say how many must be found. deviation is the sum
    of (n*x - S)^2 as whole numbers (null if a long can't hold it), whitened is (x - S/n) on the component over the root of its eigenvalue, explained
    is the eigenvalue's share of the trace, identity_error the largest entry of whitened's covariance minus the identity over the fit list.

    Vectors that are null, empty or hold null or non-finite entries are left out; so are those of another length than most distinct ones have (of
    equally frequent lengths, the longest counts). Repeated rows give rows each, a null id stays null, components whose eigenvalue is zero to rounding
    aren't given (one distinct vector has none: no rows), components of equal eigenvalues are some orthonormal basis of their space, the same for all
    rows, with the largest entry positive. Other columns are left out, whatever their names; an empty table gives no row.
    """
    spark, kind = rows.sparkSession, dict(rows.dtypes)[id_col]
    names = [free(c, [id_col]) for c in ("component", "n", "deviation", "whitened", "explained", "identity_error")]
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{c} {k}" for c, k in zip(names, ("int", "long", "long", "double", "double", "double"), strict=True))
    whole = rows.select(F.col(id_col).alias("id"), _whole(F.col(vector_col)).alias("x")).filter("x is not null")
    fit = written(whole.select("x").distinct())
    lengths = fit.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    d, n = lengths
    fit = fit.filter(F.size("x") == d)
    # Entries are whole numbers; their sums are exact in doubles up to 2^53.
    sums = _summed(fit, d, lambda x: x.sum(axis=0), d)
    mean = sums / n

    def products(x: np.ndarray) -> np.ndarray:
        y = x - mean
        return (y.T @ y).ravel()

    cov = _summed(fit, d, products, d * d).reshape(d, d) / n
    cov = (cov + cov.T) / 2
    values, vectors = _components(spark, cov, components)
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    scaled = vectors / np.sqrt(values)
    middle = _summed(fit, d, lambda x: ((x - mean) @ scaled).sum(axis=0), k) / n

    def squares(x: np.ndarray) -> np.ndarray:
        y = (x - mean) @ scaled - middle
        return (y.T @ y).ravel()

    error = float(np.abs(_summed(fit, d, squares, k * k).reshape(k, k) / n - np.eye(k)).max())
    explained, whole_sums = values / np.trace(cov), [int(s) for s in sums]

    def deviations(x: np.ndarray) -> pa.Array:
        if (np.abs(x).max() * float(n) + max(map(abs, whole_sums))) ** 2 * d < 2**62:
            return pa.array(((n * x - np.array(whole_sums)) ** 2).sum(axis=1))
        exact = [sum((n * c - s) ** 2 for c, s in zip(row, whole_sums, strict=True)) for row in x.tolist()]
        return pa.array([v if v < 2**63 else None for v in exact], pa.int64())

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = _matrix(batch.column(1), d)
            each = pa.array(np.repeat(np.arange(m), k))
            columns = [batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), deviations(x).take(each)]
            columns += [pa.array(((x - mean) @ scaled).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, *names])

    return whole.filter(F.size("x") == d).mapInArrow(run, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening(table(spark, sf_dir, "embeddings"))
