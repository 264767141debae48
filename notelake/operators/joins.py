"""Joins of entries, notes, headings, dictionaries and ranked lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from notelake.functions.text import STOP_WORDS, fold
from notelake.operators.blocks import BLOCK_BYTES, all_pairs, cosines, in_blocks, near_block_pairs, past, strips

#: A side is broadcast if it was counted to have at most so many rows.
BROADCAST_ROWS = 20_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has few rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def hydrate(entries: DataFrame, notes: DataFrame) -> DataFrame:
    """entries with the text they point to; entries of vanished notes drop out. Join after ranking: only chosen rows need text."""
    text = notes.select("path", F.col("content").alias("_content"))
    return entries.join(text, "path").withColumn("text", F.expr("substring(_content, chunk_start + 1, chunk_end - chunk_start)")).drop("_content")


def score(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """(query_id, entry_id, score): the better cosine of a query's one or two vectors with every entry.

    Scores every pair by definition: a task holds a block of queries, and a share of the entries streams past; the searches keep the best of each
    block only. For all entries against all entries use similar_pairs().
    """
    kind = dict(queries.dtypes)["query_id"], dict(entries.dtypes)["entry_id"]

    def start(held: pa.StructArray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, cut in strips(batches, held):
                for _, l in cut:
                    s = np.maximum(cosines(l.field("v1"), part.column("embedding")), cosines(l.field("v2"), part.column("embedding")))
                    yield all_pairs(l.field("query_id"), part.column("entry_id"), s, ["query_id", "entry_id", "score"])

        return run

    columns = {c: F.col(f"l.{c}") for c in ("entry_id", "embedding")}
    return past(entries.select(*columns), queries.select("query_id", "v1", "v2"), columns, start, f"query_id {kind[0]}, entry_id {kind[1]}, score double", BLOCK_BYTES)


def similar_pairs(left: DataFrame, right: DataFrame, least: float, block: int = 2048) -> DataFrame:
    """(l, r, score) with cosine >= least between two tables (id, vec), exact.

    Rows are dealt into blocks of about `block` that lie near each other; pairs of blocks that are too far apart for the bound are left out, each other
    pair is one matrix product in a task, and only pairs over the bound come out. A task holds two blocks, whatever the tables' sizes.
    """
    kind = dict(left.dtypes)["id"], dict(right.dtypes)["id"]

    def run(l: pa.StructArray, r: pa.StructArray) -> pa.RecordBatch:
        s = cosines(l.field("vec"), r.field("vec"))
        i, j = np.nonzero(s >= least)
        return pa.RecordBatch.from_arrays([l.field("id").take(pa.array(i)), r.field("id").take(pa.array(j)), pa.array(s[i, j])], names=["l", "r", "score"])

    pairs, _, _ = near_block_pairs(left.select("id", "vec"), right.select("id", "vec"), least, block)
    return in_blocks(left, right, run, f"l {kind[0]}, r {kind[1]}, score double", pairs=pairs)


def purge_orphans(entries: DataFrame, notes: DataFrame) -> DataFrame:
    return entries.join(notes.select("path").distinct(), "path", "left_semi")


def new_only(candidates: DataFrame, existing: DataFrame, key: str = "path") -> DataFrame:
    return candidates.join(existing.select(key), key, "left_anti")


def reuse_vectors(new: DataFrame, old: DataFrame) -> DataFrame:
    """new with the stored vector of the same note and hash (null: to be embedded)."""
    kept = old.groupBy("path", "chunk_hash").agg(F.first("embedding").alias("embedding"))
    return new.join(kept, ["path", "chunk_hash"], "left").withColumn("reused", F.col("embedding").isNotNull())


def rrf(vector_ranked: DataFrame, keyword_ranked: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, entry_id, vrank, krank, score): reciprocal rank fusion of two ranked lists (rank column)."""
    v = vector_ranked.select("query_id", "entry_id", F.col("rank").alias("vrank"))
    w = keyword_ranked.select("query_id", "entry_id", F.col("rank").alias("krank"))
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return v.join(w, ["query_id", "entry_id"], "full_outer").withColumn("score", part("vrank") + part("krank"))


def translate_terms(tags: DataFrame, dictionary: DataFrame, enabled: bool = True) -> DataFrame:
    """tags (term) with their dictionary entry, themselves if unknown."""
    if not enabled:
        return tags.withColumn("shown", F.col("term"))
    d = small(dictionary.select("term", "translation"))
    return tags.join(d, "term", "left").withColumn("shown", F.coalesce("translation", "term")).drop("translation")


def asof_heading(chunks: DataFrame, stack: DataFrame) -> DataFrame:
    """chunks (path, start, ..) with the heading path open at their start."""
    valid = stack.withColumn("_to", F.lead("offset").over(W.partitionBy("path").orderBy("offset"))).withColumnRenamed("path", "_path")
    fits = (F.col("path") == F.col("_path")) & (F.col("start") >= F.col("offset")) & (F.col("_to").isNull() | (F.col("start") < F.col("_to")))
    return chunks.join(valid, fits, "left").drop("_path", "_to", "offset")


FIELDS = ("path", "summary_text", "tags_text", "highlights_text", "heading_path")


def _grams(text: Column, lengths: list[int]) -> Column:
    """The distinct substrings of some lengths, cut from the array of characters."""
    chars = F.split(text, "")

    def of(n: int) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.size(chars) - n), lambda i: F.concat(*(F.get(chars, i + k) for k in range(n))))
        return F.when(F.length(text) >= n, cut).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.array(*map(of, lengths))))


def term_hits(entries: DataFrame, terms: DataFrame, q: int = 3) -> DataFrame:
    """(term, entry_id, field): query terms found in the folded metadata of entries.

    Each field is cut into its q-grams; a term probes the rarest of its own, and only fields that hold that gram are searched for the whole term. A term
    of fewer than q characters probes itself. Null and empty terms hit nothing.
    """
    t = terms.select("term").distinct().filter("term <> ''").withColumn("_n", F.least(F.length("term"), F.lit(q)))
    lengths = sorted(r[0] for r in t.select("_n").distinct().collect())
    hits = entries.select("entry_id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), fold(F.coalesce(F.col(f), F.lit(""))).alias("v")) for f in FIELDS))).alias("x"))
    if not lengths:
        return hits.select(F.lit(None).cast("string").alias("term"), "entry_id", "x.field").limit(0)
    fields = hits.select("entry_id", "x.field", "x.v").filter("v <> ''")
    probes = t.select("term", F.explode(F.when(F.col("_n") < q, F.array("term")).otherwise(_grams(F.col("term"), [q]))).alias("gram"))
    postings = fields.select("entry_id", "field", "v", F.explode(_grams(F.col("v"), lengths)).alias("gram"))
    wanted = small(probes.select("gram").distinct())
    counts = postings.select("gram").join(wanted, "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # A gram that no field has keeps its term from any hit.
    rarest = probes.join(counts, "gram", "left").groupBy("term").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return postings.join(small(rarest), "gram").filter(F.col("v").contains(F.col("term"))).select("term", "entry_id", "field")


def drop_stop_words(terms: DataFrame, col: str = "term") -> DataFrame:
    return terms.filter(~F.col(col).isin(STOP_WORDS))
