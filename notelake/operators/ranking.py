"""Ranked lists: order, limits, diversity per note, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def top_k(scored: DataFrame, k: int, keys: tuple[str, ...] = ("query_id",), tie: str = "entry_id") -> DataFrame:
    """The k best rows of each key by score, ties by `tie`, with their rank."""
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), tie)))
    return ranked.filter(F.col("rank") <= k)


def rank_list(scored: DataFrame) -> DataFrame:
    """(query_id, entry_id, rank): 1-based rank of each entry's first place."""
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "entry_id")))
    return ranked.groupBy("query_id", "entry_id").agg(F.min("rank").alias("rank"))


def cap_per_note(df: DataFrame, k: int, then: int = 3, keys: tuple[str, ...] = ("query_id",), pos: Column | None = None) -> DataFrame:
    """Rows by position, first one of each note, then up to `then` of each, until k; column place is the new order."""
    order = F.col("pos") if pos is None else pos
    rows = df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys, "path").orderBy(order))).filter(F.col("_rn") <= then)
    rows = rows.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy((F.col("_rn") > 1).cast("int"), order)))
    return rows.filter(F.col("place") <= k).drop("_rn")


def inject_siblings(df: DataFrame, k: int, count_again: bool = True, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Rows (.., path, pos, is_note) with column order: after each note-level row stands the best later content row of its note.

    A step for each pos places a row and the one that it pulls; steps run while fewer than 2 * k are placed. A pulled row
    that is met again counts as placed once more if count_again. At most two note-level rows a note.
    """
    note = W.partitionBy(*keys, "path")
    s1 = F.min(F.when(F.col("is_note"), F.col("pos"))).over(note)
    s2 = F.max(F.when(F.col("is_note"), F.col("pos"))).over(note)
    rows = df.withColumns({"_s1": s1, "_s2": F.when(s1 != s2, s2)})
    rows = rows.withColumn("_p1", F.min(F.when(~F.col("is_note") & (F.col("pos") > F.col("_s1")), F.col("pos"))).over(note))
    rows = rows.withColumn("_p2", F.min(F.when(~F.col("is_note") & (F.col("pos") > F.col("_s2")) & (F.col("pos") != F.coalesce("_p1", F.lit(-1))), F.col("pos"))).over(note))
    puller = F.when(~F.col("is_note") & (F.col("pos") == F.col("_p1")), F.col("_s1")).when(~F.col("is_note") & (F.col("pos") == F.col("_p2")), F.col("_s2"))
    pulls = F.col("is_note") & (((F.col("pos") == F.col("_s1")) & F.col("_p1").isNotNull()) | ((F.col("pos") == F.col("_s2")) & F.col("_p2").isNotNull()))
    rows = rows.withColumn("_by", puller).withColumn("_n", F.when(pulls, 2).when(F.col("_by").isNotNull(), 1 if count_again else 0).otherwise(1))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_ran", before < 2 * k)
    # A row is there if its own step ran or the step of the row that pulled it did.
    last = F.max(F.when(F.col("_ran"), F.col("pos"))).over(W.partitionBy(*keys))
    rows = rows.withColumn("_last", last).filter(F.col("_ran") | (F.col("_by") <= F.col("_last")))
    at = F.coalesce("_by", "pos")
    rows = rows.withColumn("order", F.row_number().over(W.partitionBy(*keys).orderBy(at, F.col("_by").isNotNull().cast("int"))))
    return rows.drop("_s1", "_s2", "_p1", "_p2", "_by", "_n", "_ran", "_last")


def pack_budget(notes: DataFrame, limit: int = 40_000, keys: tuple[str, ...] = ()) -> DataFrame:
    """Notes by path whose pieces fit the limit one after the other until the first that doesn't; (path, piece, chars_before).

    If not even the first fits, its cut excerpt. A marker in what is left is truncation_note()'s work.
    """
    piece = F.concat(F.lit("--- Note: "), "path", F.lit(" ---\n"), F.coalesce("content", F.lit("")), F.lit("\n\n"))
    if not keys:  # a piece has 20 characters at least, so no more notes can fit
        notes = notes.select("path", "content").orderBy("path").limit(limit // 20 + 1)
    rows = notes.select(*keys, "path", "content", piece.alias("piece"))
    w = W.partitionBy(*keys).orderBy("path") if keys else W.partitionBy(F.lit(0)).orderBy("path")
    rows = rows.withColumns({"_upto": F.sum(F.length("piece")).over(w.rowsBetween(W.unboundedPreceding, 0)), "_no": F.row_number().over(w)})
    cut = F.substring(F.concat(F.lit("--- Note: "), "path", F.lit(" (truncated) ---\n"), F.coalesce("content", F.lit(""))), 1, limit)
    fits = F.col("_upto") <= limit
    rows = rows.filter(fits | (F.col("_no") == 1))
    return rows.select(*keys, "path", F.when(fits, F.col("piece")).otherwise(cut).alias("piece"), F.when(fits, F.col("_upto") - F.length("piece")).otherwise(0).alias("chars_before"))


def representative(entries: DataFrame) -> DataFrame:
    """One entry a note: its summary, else its highlights, else any note-level one, else the first."""
    level = F.when(F.col("entry_type") == "summary", 0).when(F.col("entry_type") == "highlights", 1).when((F.col("chunk_start") == 0) & (F.col("chunk_end") == 0), 2).otherwise(3)
    # min_by with a struct combines on the map side, so a note of any size costs one row a task.
    best = entries.groupBy("path").agg(F.min_by(F.struct(*[c for c in entries.columns if c != "path"]), F.struct(level, F.col("entry_id"))).alias("e"))
    return best.select("path", "e.*")


def last_n(df: DataFrame, n: int, order: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The newest n rows (of each key), newest first."""
    if not keys:
        return df.orderBy(F.desc(order)).limit(n)
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).filter(F.col("_n") <= n).drop("_n")


def upsert_latest(stored: DataFrame, updates: DataFrame, deletes: DataFrame | None = None, key: str = "id", version: str = "ts", pos: str = "pos") -> DataFrame:
    """Latest row of each key: replaced in its place, or put in front if new; deleted keys go."""
    new = updates.groupBy(key).agg(F.max_by(F.struct(*[c for c in updates.columns if c != key]), version).alias("u"))
    j = stored.join(new, key, "full_outer")
    columns = [c for c in stored.columns if c not in (key, pos)]
    picked = [F.when(F.col("u").isNotNull(), F.col(f"u.{c}")).otherwise(F.col(c)).alias(c) for c in columns]
    out = j.select(key, *picked, F.coalesce(F.col(pos), -F.lit(1)).alias(pos))
    return out.join(deletes.select(key), key, "left_anti") if deletes is not None else out


def order_by_score(df: DataFrame, score: str = "score", tie: str = "entry_id") -> DataFrame:
    return df.orderBy(F.desc(score), tie)


def limit_k(df: DataFrame, k: int, *order: str | Column) -> DataFrame:
    """The first k rows in order; tasks send on k rows each."""
    return df.orderBy(*order).limit(k)


def fused_order() -> list[Column]:
    """Sort keys of a fused list: score, in both lists first, vector rank, keyword rank, path."""
    both = F.col("vrank").isNotNull() & F.col("krank").isNotNull()
    return [F.desc("score"), F.desc(both.cast("int")), F.asc_nulls_last("vrank"), F.asc_nulls_last("krank"), F.asc("path"), F.asc("entry_id")]


def order_locale(df: DataFrame, col: str, strength: str = "UNICODE") -> DataFrame:
    """df in locale order; UNICODE_CI_AI for tags."""
    return df.orderBy(F.collate(F.col(col), strength), col)


def sample_terms(terms: DataFrame, n_path: int = 20, n_leaf: int = 15) -> DataFrame:
    """The first path terms and leaf terms, path terms first."""
    rows = terms.withColumn("rn", F.row_number().over(W.partitionBy("type").orderBy("term")))
    return rows.filter(((F.col("type") == "path") & (F.col("rn") <= n_path)) | ((F.col("type") == "leaf") & (F.col("rn") <= n_leaf))).orderBy(F.desc("type"), "rn")
