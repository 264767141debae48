"""Operator 11: near-duplicate embeddings; spherical k-means cells, blocked cosine products inside and between cells that can hold links."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notelake.llm.common import free, small, table, written
from notelake.llm.components import components

#: Vectors that a block should hold; a label with fewer is one block.
BLOCK_ROWS = 1024
#: Cells are fitted on at most so many different vectors (those with the smallest hashes); all vectors are put into them. Only the layout depends on
#: the sample, no link does.
SAMPLE, DEPTH = 1 << 16, 10


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda c: c != 0), F.lit(False))


def units(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length 1, in doubles."""
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    m = m / np.abs(m).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def fit_cells(vectors: np.ndarray, depth: int, rounds: int = 8) -> list[np.ndarray]:
    """Nested spherical 2-means: for each level a pair of centres for each cell above it. A cell's two centres start at its first vector and the one least like it; each round puts vectors to the nearer centre and turns centres to the sum of theirs."""
    at, levels = np.zeros(len(vectors), np.int64), []
    for level in range(depth):
        centres = np.zeros((1 << level, 2, vectors.shape[1]))
        for cell in range(1 << level):
            rows = np.flatnonzero(at == cell)
            if not len(rows):
                continue
            own = vectors[rows]
            pair = own[[0, int((own @ own[0]).argmin())]]
            for _ in range(rounds):
                second = own @ (pair[1] - pair[0]) > 0
                for k, mine in enumerate((own[~second], own[second])):
                    total = mine.sum(axis=0)
                    if (size := np.sqrt(total @ total)) > 0:
                        pair[k] = total / size
            centres[cell] = pair
        levels.append(centres)
        at = _below(vectors, at, centres)
    return levels


def _below(vectors: np.ndarray, at: np.ndarray, centres: np.ndarray) -> np.ndarray:
    pair = centres[at]
    return 2 * at + (np.einsum("ij,ij->i", vectors, pair[:, 1] - pair[:, 0]) > 0)


def _paths(classes: DataFrame, levels: list[np.ndarray]) -> DataFrame:
    """classes with `path`, the finest cell of each vector; 0 for vectors of another length than the sample's."""
    columns = [f"`{c}` {k}" for c, k in classes.dtypes]
    place = classes.columns.index("vector")
    d = levels[0].shape[2] if levels else -1

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path = np.zeros(batch.num_rows, np.int64)
            rows = np.flatnonzero(batch.column(place).value_lengths().to_numpy(zero_copy_only=False) == d)
            if len(rows):
                vectors = units(batch.column(place).take(pa.array(rows)))
                for centres in levels:
                    path[rows] = _below(vectors, path[rows], centres)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(path)], names=[*batch.schema.names, "path"])

    return classes.mapInArrow(run, ", ".join([*columns, "path long"]))


def _block(rows: pa.Table) -> pa.Table:
    """A block in one row: its vectors, ids and counts as bytes, the direction of their mean, and the largest angle to it."""
    vectors = units(rows.column("vector").combine_chunks())
    centre = vectors.sum(axis=0)
    size = np.sqrt(centre @ centre)
    centre = centre / size if size > 0 else vectors[0]
    wide = float(np.arccos(np.clip(vectors @ centre, -1, 1)).max())
    packed = [vectors.tobytes(), rows.column("cid").to_numpy().tobytes(), rows.column("n").to_numpy().tobytes()]
    own = [rows.column(c).slice(0, 1) for c in ("label", "d", "block")]
    return pa.table([*own, pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([wide]), *(pa.array([p], pa.binary()) for p in packed)], names=["label", "d", "block", "centre", "wide", "vectors", "cids", "ns"])


def _blocks(classes: DataFrame, kind: str, levels: list[np.ndarray], block_rows: int) -> DataFrame:
    """Blocks of about block_rows vectors of one label: a label takes as many levels of cells as its size asks for, and cells that are still larger are dealt out."""
    placed = written(_paths(classes.withColumn("d", F.size("vector")), levels))
    counts = placed.groupBy("label", "d", "path").agg(F.count(F.lit(1)).alias("m"))
    all_of, cell_of = Window.partitionBy("label", "d"), Window.partitionBy("label", "d", "cell")
    depth = F.least(F.lit(len(levels)), F.ceil(F.greatest(F.lit(0.0), F.log2(F.sum("m").over(all_of) / block_rows))).cast("int"))
    layout = counts.withColumn("cell", F.floor(F.col("path") / F.pow(F.lit(2.0), len(levels) - depth)).cast("long"))
    layout = layout.withColumn("dealt", F.ceil(F.sum("m").over(cell_of) / block_rows)).select("label", "d", "path", "cell", "dealt")
    chunk = F.pmod(F.col("h2"), F.col("dealt"))
    dealt = placed.join(small(written(layout)), ["label", "d", "path"]).select("label", "d", (F.col("cell") * (1 << 32) + chunk).alias("block"), "cid", "n", "vector")
    return dealt.groupBy("label", "d", "block").applyInArrow(_block, f"label {kind}, d int, block long, centre array<double>, wide double, vectors binary, cids binary, ns binary")


def linked(a: tuple, b: tuple, same: bool, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cid, n, peer) of the vectors of two blocks (or one) that have links there: the rows behind their links, and the smallest cid that links here lead to. Blocks are (vectors, cids, counts)."""
    near = a[0] @ b[0].T >= least
    if same:
        np.fill_diagonal(near, False)
    i, j = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    near = near[np.ix_(i, j)]
    left, right, high = a[1][i], b[1][j], np.iinfo(np.int64).max
    while len(i):
        other = np.minimum(right, np.where(near, left[:, None], high).min(axis=0))
        if same:
            other = np.minimum(other, left)
        mine = np.minimum(left, np.where(near, other[None, :], high).min(axis=1))
        if (mine == left).all() and (other == right).all():
            break
        left, right = mine, mine if same else other
    counts = near @ b[2][j]
    if same:
        return a[1][i], counts, left
    return np.concatenate([a[1][i], b[1][j]]), np.concatenate([counts, a[2][i] @ near]), np.concatenate([left, right])


def _compared(blocks: DataFrame, least: float) -> DataFrame:
    """(cid, n, peer) for every block pair of a label that can hold a link, as linked() has it.

    Unit vectors of two blocks that are within acos(least) of each other leave the blocks' centres no further apart than that angle and both blocks'
    widths; pairs of blocks beyond it are left out, which loses nothing.
    """
    names = ["label", "d", "block"]
    rim = blocks.select(*names, "centre", "wide")
    a, b = (rim.select("label", "d", *(F.col(c).alias(f"{c}_{side}") for c in ("block", "centre", "wide"))) for side in "ab")
    cosine = F.aggregate(F.zip_with("centre_a", "centre_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    reach = F.col("wide_a") + F.col("wide_b") + (math.acos(least) + 1e-6)
    near = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) <= reach
    pairs = a.join(b, ["label", "d"]).filter((F.col("block_a") <= F.col("block_b")) & near).select("label", "d", "block_a", "block_b")
    for side in "ab":
        pairs = pairs.join(blocks.select("label", "d", F.col("block").alias(f"block_{side}"), F.struct("vectors", "cids", "ns").alias(side)), ["label", "d", f"block_{side}"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        def side(column: pa.Array, k: int, d: int) -> tuple:
            value = column[k]
            return np.frombuffer(value["vectors"].as_py()).reshape(-1, d), *(np.frombuffer(value[c].as_py(), np.int64) for c in ("cids", "ns"))

        for batch in batches:
            same, ds = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k in range(batch.num_rows):
                out = linked(side(batch.column(2), k, ds[k]), side(batch.column(3), k, ds[k]), same[k], least)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in out], names=["cid", "n", "peer"])

    return pairs.select(F.col("block_a") == F.col("block_b"), "d", "a", "b").mapInArrow(run, "cid long, n long, peer long")


def embedding_dedup(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, block_rows: int = BLOCK_ROWS, sample: int = SAMPLE) -> DataFrame:
    """One row a vector: id, n_links, component_id, kept.

    Vectors of one label link at a cosine of `least` or more, in doubles. Equal vectors of a label are one class from the start (counted in tasks before
    they are moved), so copies are never paired. Spherical k-means, nested, fitted on a bounded sample, lays a label's classes out in cells; cells are
    compared in blocks, with themselves and with all other cells of the label that their widths leave in reach, so no link is lost at a border. A block
    pair gives out a sum of links and one tie a vector, never the links themselves. The work is the square of a label's different vectors over the
    blocks that are in reach of each other: little where vectors lie in clusters, all block pairs where they lie evenly in many dimensions.

    n_links counts the other rows linked directly, copies included; component_id is the smallest id reached; kept says whether the row's id is that.
    A null label or a vector that is null, empty, zero, or holds null or non-finite entries links with nothing (no link, its own id, kept); vectors of
    different lengths don't link. Repeated rows are rows each; null ids are larger than all others, and kept is true for a null id whose component has
    no other. Other columns are left out, whatever their names; an empty table gives no row.
    """
    names = [free(c, [id_col]) for c in ("n_links", "component_id", "kept")]
    label_kind = dict(rows.dtypes)[label_col]
    base = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    fine = F.col("label").isNotNull() & _usable(F.col("vector"))
    # Two hashes of 64 bits name a vector.
    keyed = base.filter(fine).withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(1), "vector")})
    classes = written(keyed.groupBy("label", "h1", "h2", "vector").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).withColumn("cid", F.monotonically_increasing_id()))
    largest = classes.groupBy("label").agg(F.count(F.lit(1)).alias("m")).agg(F.max("m")).first()[0] or 0
    levels = _cells(classes, min(DEPTH, max(0, math.ceil(math.log2(max(1, largest) / block_rows)))), sample)
    blocks = written(_blocks(classes, label_kind, levels, block_rows))
    found = written(_compared(blocks, least))
    links = found.groupBy("cid").agg(F.sum("n").alias("links"))
    ties = components(found.filter("cid <> peer").select(F.col("cid").alias("a"), F.col("peer").alias("b")))
    joined = classes.select("cid", "label", "h1", "h2", "n", "first").join(links, "cid", "left").join(ties.select(F.col("node").alias("cid"), F.col("label").alias("root")), "cid", "left")
    joined = written(joined.select("label", "h1", "h2", "first", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "cid").alias("root")))
    least_id = joined.groupBy("root").agg(F.min("first").alias("component"))
    result = joined.join(least_id, "root").select("label", "h1", "h2", "n_links", "component")
    kept = F.col("id").eqNullSafe(F.col("component"))
    out = keyed.select("id", "label", "h1", "h2").join(result, ["label", "h1", "h2"]).select("id", "n_links", "component", kept.alias("kept"))
    alone = base.filter(~fine).select("id", F.lit(0).cast("long"), "id", F.lit(True))
    return out.union(alone).toDF(id_col, *names)


def _cells(classes: DataFrame, depth: int, sample: int) -> list[np.ndarray]:
    """Centres of the nested cells, fitted on the sample's vectors of its most frequent length."""
    if not depth:
        return []
    vectors = classes.orderBy("h1", "h2", "cid").limit(sample).select("vector").toArrow().column(0).combine_chunks()
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    return fit_cells(units(vectors.take(pa.array(np.flatnonzero(lengths == np.bincount(lengths).argmax())))), depth)


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))
