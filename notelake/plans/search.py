"""Hybrid retrieval: many queries at once against an entry table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from notelake.functions.text import quoted_terms, search_terms
from notelake.operators.aggregates import POINTS, QUOTED, content_bonus, with_folded
from notelake.operators.blocks import BLOCK_BYTES, Terms, all_pairs, best, cosines, in_blocks, past, strips
from notelake.operators.joins import hydrate, rrf
from notelake.operators.ranking import cap_per_note, fused_order, inject_siblings, representative, top_k


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.withColumns({"terms": search_terms(F.col("text")), "quoted": quoted_terms(F.col("text"))})


META = ("entry_id", "path", "entry_type", "chunk_start", "chunk_end", "summary_text", "tags_text", "highlights_text")


def _kept(lists: dict[str, Callable], n: int, most: int, step: int = 1 << 20) -> tuple[Callable, Callable]:
    """(add, best) of the `most` best entries of n rows in each list, while scores come in parts; of equal scores the least ids stay.

    A score counts only if it reaches the last one kept so far; what came in is merged with what is kept when it is `step` rows.
    """
    bound = {name: np.full(n, -np.inf) for name in lists}
    found: dict[str, list] = {name: [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))] for name in lists}

    def best_of(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, entry, score = map(np.concatenate, zip(*found[name], strict=True))
        order = np.lexsort((entry, -score, row))
        row, entry, score = row[order], entry[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        full = place == most - 1
        bound[name][row[full]] = score[full]
        found[name] = [(row[place < most], entry[place < most], score[place < most])]
        return found[name][0]

    def add(name: str, at: int, score: np.ndarray, wanted: np.ndarray, ids: np.ndarray) -> None:
        i, j = np.nonzero(wanted & (score >= bound[name][at : at + len(score), None]))
        if len(i):
            found[name].append((at + i, ids[j], score[i, j]))
            if sum(len(x[0]) for x in found[name][1:]) >= step:
                best_of(name)

    return add, best_of


def _best(queries: DataFrame, entries: DataFrame, highlight_boost: float, lists: dict[str, Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]], most: int, vectors: bool = True, terms: bool = True) -> DataFrame:
    """(query_id, list, entry_id, score, rank): each query's `most` best entries in each list.

    A task holds a block of queries, and a share of the entries streams past: vectors are scored by matrix products, and the block's terms are looked up
    once in each entry's folded metadata. Only the best of the whole share come out, so what is sent grows with the queries, not with queries times
    entries. A list is a function of the vectors' and the metadata's scores (0 where not asked for) and the boosts to (score, wanted).
    """
    kind = dict(queries.dtypes)["query_id"], dict(entries.dtypes)["entry_id"]
    boost = F.when(F.col("entry_type") == "highlights", 1 + highlight_boost).otherwise(1.0).alias("boost")
    held = (query_terms(queries) if terms else queries).select("query_id", *(("terms", "quoted") if terms else ()), *(("v1", "v2") if vectors else ()))
    fields = [f"f_{f}" for f in POINTS] if terms else []
    rows = (with_folded(entries) if terms else entries).select("entry_id", *fields, boost, *(["embedding"] if vectors else []))

    def start(l: pa.StructArray):
        if terms:
            words, quoted = (Terms(l.field(c).to_pylist()) for c in ("terms", "quoted"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            add, best_of = _kept(lists, len(l), most)
            for part, cut in strips(batches, l):
                ids, more = part.column("entry_id").to_numpy(zero_copy_only=False), part.column("boost").to_numpy(zero_copy_only=False)
                if terms:
                    texts = [part.column(f).to_pylist() for f in fields]
                    some, whole = words.found(texts, list(POINTS.values())), quoted.found([["\0".join(x) for x in zip(*texts, strict=True)]], [1])
                for at, q in cut:
                    meta = np.minimum((words.sums(some, at, len(q)) + QUOTED * quoted.sums(whole, at, len(q))) / 100.0, 0.25) if terms else np.zeros((len(q), part.num_rows))
                    near = np.maximum(cosines(q.field("v1"), part.column("embedding")), cosines(q.field("v2"), part.column("embedding"))) if vectors else np.zeros(meta.shape)
                    for name, by in lists.items():
                        add(name, at, *by(near, meta, more), ids)
            for name in lists:
                row, entry, score = best_of(name)
                for first in range(0, len(row), 1 << 16):
                    i, e, s = (x[first : first + (1 << 16)] for x in (row, entry, score))
                    yield pa.RecordBatch.from_arrays([l.field("query_id").take(pa.array(i)), pa.array([name] * len(i), pa.string()), pa.array(e), pa.array(s)], names=["query_id", "list", "entry_id", "score"])

        return run

    columns = {c: F.col(f"l.{c}") for c in rows.columns}
    # A block's automaton, its terms' hits and the best of its queries take many times its bytes.
    found = past(rows, held, columns, start, f"query_id {kind[0]}, list string, entry_id {kind[1]}, score double", BLOCK_BYTES // 8)
    return top_k(found, most, ("query_id", "list"))


def scan_text(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """rows with scan: highlights; else summary and tags; else the note's first 800 characters; for content entries, the slice."""
    text = notes.select("path", "content")
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    level = (F.col("chunk_start") == 0) & (F.col("chunk_end") == 0)
    body = F.expr("substring(content, chunk_start + 1, chunk_end - chunk_start)")
    scan = (
        F.when((F.col("entry_type") == "highlights") & some("highlights_text"), F.col("highlights_text"))
        .when((F.col("entry_type") == "summary") & (some("summary_text") | some("tags_text")), F.concat_ws(" ", "summary_text", "tags_text"))
        .when(level, F.substring(F.coalesce("content", F.lit("")), 1, 800))
        .otherwise(body)
    )
    return rows.join(text, "path", "left").withColumn("scan", F.coalesce(scan, F.lit(""))).drop("content")


def _deep(found: DataFrame, queries: DataFrame, entries: DataFrame, notes: DataFrame) -> DataFrame:
    """found (query_id, entry_id, score) with what the terms add in the entries' texts; metadata and text are read for found entries only."""
    terms = query_terms(queries).select("query_id", "terms", "quoted")
    # An entry's text is cut out once, not for each query that found it.
    texts = scan_text(entries.select(*META), notes).select("entry_id", "path", "chunk_start", "chunk_end", "scan")
    rows = found.select("query_id", "entry_id", "score").join(texts, "entry_id").join(terms, "query_id")
    return rows.withColumn("score", F.col("score") + content_bonus(F.col("scan"), F.col("terms"), F.col("quoted")))


def search_rrf(queries: DataFrame, entries: DataFrame, notes: DataFrame, k: int = 20, rrf_k: int = 60, highlight_boost: float = 0.0) -> DataFrame:
    """(query_id, place, entry_id, path, score): fused vector and keyword ranks, siblings injected, notes capped."""
    pool = max(50, min(250, 10 * k))
    # Each list is worked out by itself, from what it needs: of one table with both, Spark would make all rows once for each.
    vector = _best(queries, entries, highlight_boost, {"vector": lambda v, m, boost: (v * boost, v * boost > 0)}, pool, terms=False).select("query_id", "entry_id", "rank")
    keyword = _best(queries, entries, highlight_boost, {"keyword": lambda v, m, boost: (m * boost, m * boost > 0)}, pool, vectors=False)
    deep = _deep(keyword, queries, entries, notes)
    deep = deep.select("query_id", "entry_id", "score").withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "entry_id")))
    fused = rrf(vector, deep, rrf_k).join(entries.select("entry_id", "path", "chunk_start", "chunk_end"), "entry_id")
    ordered = fused.withColumn("pos", F.row_number().over(W.partitionBy("query_id").orderBy(*fused_order())))
    return _finish(ordered, k, True)


def _finish(ordered: DataFrame, k: int, count_again: bool) -> DataFrame:
    rows = ordered.withColumn("is_note", (F.col("chunk_start") == 0) & (F.col("chunk_end") == 0))
    placed = inject_siblings(rows, k, count_again)
    return cap_per_note(placed, k, pos=F.col("order")).select("query_id", "place", "entry_id", "path", F.round("score", 9).alias("score"))


def search_weighted(queries: DataFrame, entries: DataFrame, notes: DataFrame, k: int = 20, least: float = 0.1, deep: int = 50, highlight_boost: float = 0.2, highlights: bool = False) -> DataFrame:
    """(query_id, place, entry_id, path, score): best cosine plus metadata bonus, the top ones with a content bonus, sorted again."""
    lists = {"all": lambda v, m, boost: ((v + m) * boost, (v + m) * boost >= least)}
    ranked = _best(queries, entries, max(0.0, min(1.0, highlight_boost)) if highlights else 0.0, lists, max(deep, 10 * k)).drop("list")
    top = _deep(ranked.filter(F.col("rank") <= deep), queries, entries, notes)
    rest = ranked.filter(F.col("rank") > deep).join(entries.select("entry_id", "path", "chunk_start", "chunk_end"), "entry_id")
    top, rest = (df.select("query_id", "entry_id", "path", "chunk_start", "chunk_end", "score") for df in (top, rest))
    ordered = top.unionByName(rest).withColumn("pos", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "entry_id")))
    return _finish(ordered, k, False)


def search_keyword(queries: DataFrame, entries: DataFrame, notes: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, entry_id, score): metadata and content bonuses alone."""
    lists = {"keyword": lambda v, m, boost: (m, m > 0)}
    found = _best(queries, entries, 0.0, lists, max(50, min(250, 10 * k)), vectors=False)
    return top_k(_deep(found, queries, entries, notes), k).select("query_id", "rank", "entry_id", F.round("score", 9).alias("score"))


def search_vector(queries: DataFrame, entries: DataFrame, k: int = 20) -> DataFrame:
    found = _best(queries, entries, 0.0, {"vector": lambda v, m, boost: (v, v > 0)}, k, terms=False)
    return found.select("query_id", "rank", "entry_id", F.round("score", 9).alias("score"))


def nearest(queries: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """(query_id, entry_id, score, rank): each query's k entries with the best cosines; a task gives out its two blocks' best only."""
    left, right = queries.select("query_id", "v1", "v2"), entries.select("entry_id", "embedding")
    kind = dict(left.dtypes)["query_id"], dict(right.dtypes)["entry_id"]

    def run(l: pa.StructArray, r: pa.StructArray) -> pa.RecordBatch:
        s, ids = np.maximum(cosines(l.field("v1"), r.field("embedding")), cosines(l.field("v2"), r.field("embedding"))), r.field("entry_id")
        i, j = best(s, ids.to_numpy(zero_copy_only=False), k, np.ones(s.shape, bool))
        return pa.RecordBatch.from_arrays([l.field("query_id").take(pa.array(i)), ids.take(pa.array(j)), pa.array(s[i, j])], names=["query_id", "entry_id", "score"])

    return top_k(in_blocks(left, right, run, f"query_id {kind[0]}, entry_id {kind[1]}, score double", strip=512), k)


def bonuses(queries: DataFrame, rows: DataFrame, points: dict[str, int], cap: float) -> DataFrame:
    """(query_id, entry_id, bonus) of every query (query_id, terms, quoted) with every row (entry_id and the folded fields of `points`): points for terms in fields and QUOTED for quoted terms in any, in hundredths, up to cap."""
    kind = dict(queries.dtypes)["query_id"], dict(rows.dtypes)["entry_id"]

    def start(held: pa.StructArray):
        terms, quoted = (Terms(held.field(c).to_pylist()) for c in ("terms", "quoted"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, cut in strips(batches, held):
                fields = [part.column(f).to_pylist() for f in points]
                some, whole = terms.found(fields, list(points.values())), quoted.found([["\0".join(x) for x in zip(*fields, strict=True)]], [1])
                for at, l in cut:
                    s = np.minimum((terms.sums(some, at, len(l)) + QUOTED * quoted.sums(whole, at, len(l))) / 100.0, cap)
                    yield all_pairs(l.field("query_id"), part.column("entry_id"), s, ["query_id", "entry_id", "bonus"])

        return run

    columns = {c: F.col(f"l.{c}") for c in ("entry_id", *points)}
    # A block's automaton, and its terms' hits in a part, take many times its terms' bytes.
    return past(rows.select(*columns), queries.select("query_id", "terms", "quoted"), columns, start, f"query_id {kind[0]}, entry_id {kind[1]}, bonus double", BLOCK_BYTES // 8)


def search_manuals(queries: DataFrame, chunks: DataFrame, k: int = 3, most: int = 2500) -> DataFrame:
    """(query_id, rank, entry_id, relevance, text): nearest manual chunks, relevance at two digits, texts cut."""
    found = nearest(queries, chunks, k).join(chunks.select("entry_id", "content"), "entry_id")
    return found.select("query_id", "rank", "entry_id", F.round("score", 2).alias("relevance"), F.substring("content", 1, most).alias("text"))


def _closest(held: pa.StructArray, least: float, k: int, most: int = 1 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of entries (path, vec) in order of their paths, the k other notes with the best scores for each of those held, by each note's best entry.

    A score counts only if it reaches the bound, and is over that of the k-th note kept so far: of equal ones the smaller path, which came before, stays.
    What is found is merged with what is kept when it is `most` rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.field("path").to_numpy(zero_copy_only=False)
        bound = np.full(len(held), max(least, np.nextafter(0.0, 1.0)))
        names, found = [], [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

        def merge() -> None:
            row, note, score = map(np.concatenate, zip(*found, strict=True))
            order = np.lexsort((-score, note, row))
            row, note, score = row[order], note[order], score[order]
            first = np.append(True, (row[1:] != row[:-1]) | (note[1:] != note[:-1]))[: len(row)]
            row, note, score = row[first], note[first], score[first]
            order = np.lexsort((note, -score, row))
            row, note, score = row[order], note[order], score[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            full = place == k - 1
            bound[row[full]] = np.nextafter(score[full], np.inf)
            found[:] = [(row[place < k], note[place < k], score[place < k])]

        for part, cut in strips(batches, held, 2048):
            paths, number = part.column("path").to_numpy(zero_copy_only=False), []
            for path in paths:
                if not names or names[-1] != path:
                    names.append(path)
                number.append(len(names) - 1)
            number = np.array(number)
            for at, l in cut:
                s = cosines(l.field("vec"), part.column("vec"))
                i, j = np.nonzero(s >= bound[at : at + len(l), None])
                other = own[at + i] != paths[j]
                i, j = i[other], j[other]
                if len(i):
                    found.append((at + i, number[j], s[i, j]))
                    if sum(len(x[0]) for x in found[1:]) >= most:
                        merge()
        merge()
        for first in range(0, len(found[0][0]), 8192):
            row, note, score = (x[first : first + 8192] for x in found[0])
            yield pa.RecordBatch.from_arrays([pa.array(own[row], pa.string()), pa.array([names[n] for n in note], pa.string()), pa.array(score)], names=["path", "related", "score"])

    return run


def related_notes(entries: DataFrame, least: float = 0.45, k: int = 15) -> DataFrame:
    """(path, rank, related, percent, score) for every note: the best score of its representative entry with each other note.

    A task holds a block of representatives and gives out their k best notes of a share of the entries, so what is sent grows with the notes, not with
    the pairs over the bound.
    """
    rows = entries.filter("path is not null").select("path", "entry_id", "entry_type", "chunk_start", "chunk_end", F.col("embedding").alias("vec"))
    columns = {c: F.col(f"l.{c}") for c in ("path", "vec")}
    best = past(rows.select(*columns), representative(rows).select(*columns), columns, lambda held: _closest(held, least, k), "path string, related string, score double", BLOCK_BYTES, ("path",))
    # A note's entries are in one share, so no pair comes twice.
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("path").orderBy(F.desc("score"), "related"))).filter(F.col("rank") <= k)
    return ranked.select("path", "rank", "related", F.floor(F.col("score") * 100 + 0.5).cast("int").alias("percent"), F.round("score", 9).alias("score"))


def passages(found: DataFrame, entries: DataFrame, notes: DataFrame) -> DataFrame:
    """found with the text of each entry and its citation head; note text is read for the found rows only."""
    meta = entries.select("entry_id", "chunk_start", "chunk_end", "heading_path")
    rows = hydrate(found.join(meta, "entry_id"), notes)
    head = F.when(F.coalesce("heading_path", F.lit("")) != "", F.concat(F.lit(" ("), "heading_path", F.lit(")"))).otherwise("")
    return rows.withColumn("passage", F.concat(F.lit("[From "), "path", head, F.lit("]:\n"), "text"))
