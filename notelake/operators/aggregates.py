"""Aggregations over entries, notes, tags and logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from notelake.functions.text import fold


def best_per_note(scored: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Best positive score of each note."""
    return scored.groupBy(*keys).agg(F.max("score").alias("score")).filter("score > 0")


def _hits(column: Column, terms: Column) -> Column:
    return F.size(F.filter(terms, lambda t: column.contains(t)))


#: Metadata fields and the hundredths that a term in them is worth; a quoted term in any of them is worth QUOTED.
POINTS = {"path": 5, "summary_text": 4, "tags_text": 3, "highlights_text": 4, "heading_path": 4}
QUOTED = 15


def with_folded(entries: DataFrame) -> DataFrame:
    """entries with their metadata fields folded, as columns f_path and so on; fold once here, not for each query."""
    return entries.withColumns({f"f_{f}": fold(F.coalesce(F.col(f), F.lit(""))) for f in POINTS})


def metadata_bonus(terms: Column, quoted: Column, cap: float = 0.25) -> Column:
    """0.15 for each quoted term in any metadata field of with_folded(); for other terms 0.05 (path), 0.04 (summary, highlights, heading), 0.03 (tags).

    Hits are counted and then weighted, so that sums don't depend on order.
    """
    anywhere = F.size(F.filter(quoted, lambda q: reduce(Column.__or__, (F.col(f"f_{f}").contains(q) for f in POINTS))))
    hundredths = reduce(Column.__add__, (p * _hits(F.col(f"f_{f}"), terms) for f, p in POINTS.items()), QUOTED * anywhere)
    return F.least(hundredths / 100.0, F.lit(cap))


def content_bonus(text: Column, terms: Column, quoted: Column, cap: float = 0.20) -> Column:
    """0.05 for each term and 0.15 for each quoted term in the text."""
    body = fold(text)
    return F.least((5 * _hits(body, terms) + 15 * _hits(body, quoted)) / 100.0, F.lit(cap))


def distinct_tags(notes: DataFrame, col: str = "tags") -> DataFrame:
    """(tag): distinct tags of comma-separated lists, # off, case kept."""
    tag = F.regexp_replace(F.trim("tag"), "^#+", "")
    return notes.select(F.explode(F.split(F.regexp_replace(col, r"[\[\]]", ""), ",")).alias("tag")).select(tag.alias("tag")).filter("tag <> ''").distinct()


def batched(df: DataFrame, order_col: str, size: int) -> DataFrame:
    """df with batch and idx: rows numbered in order over range partitions, without bringing all to one task."""
    parts = df.repartitionByRange(F.col(order_col)).sortWithinPartitions(order_col).withColumn("_p", F.spark_partition_id())
    local = parts.withColumn("_n", F.row_number().over(W.partitionBy("_p").orderBy(order_col)))
    counts = local.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.alias("a").join(counts.alias("b"), F.col("b._p") < F.col("a._p"), "left").groupBy("a._p").agg(F.coalesce(F.sum("b._c"), F.lit(0)).alias("_before"))
    n = F.col("_n") + F.col("_before") - 1
    return local.join(F.broadcast(before), "_p").withColumns({"batch": F.floor(n / size).cast("int"), "idx": (n % size).cast("int")}).drop("_p", "_n", "_before")


def untranslated_terms(tags: DataFrame, dictionary: DataFrame, size: int = 8) -> DataFrame:
    """(batch, idx, term): distinct terms that the dictionary lacks, in batches."""
    return batched(tags.select("term").distinct().join(dictionary.select("term"), "term", "left_anti"), "term", size).select("batch", "idx", "term")


def folder_stats(notes: DataFrame, folders: DataFrame, limit: int = 40_000) -> DataFrame:
    """(folder, notes, chars, over): notes below each folder and their size against the limit (1000 at least)."""
    # A note counts for each of its ancestor folders; sums combine on the map side, so folders join on one row each and no text is shuffled.
    path = F.coalesce("path", F.lit(""))
    depth = F.size(F.split(path, "/"))
    ups = F.transform(F.sequence(F.lit(1), depth), lambda k: F.array_join(F.slice(F.split(path, "/"), F.lit(1), k - 1), "/"))
    below = notes.select("path", F.length("content").alias("_chars"), F.explode(ups).alias("folder")).groupBy("folder").agg(F.count("path").alias("notes"), F.sum("_chars").alias("chars"))
    none = F.lit(0).cast("long")
    out = folders.select("folder").distinct().join(below, "folder", "left").select("folder", F.coalesce("notes", none).alias("notes"), F.coalesce("chars", none).alias("chars"))
    return out.withColumn("over", F.col("chars") > max(1000, limit))


def log_summary(log: DataFrame) -> DataFrame:
    return log.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("type") == "error").alias("errors"), F.count_if(F.col("type") == "warning").alias("warnings"))


def index_health(files: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, status, last_update, entry_count) from (name, mtime, loading, error) files and (name, n) entry counts."""
    f = files.groupBy("name").agg(F.max("mtime").alias("last_update"), F.bool_or("loading").alias("loading"), F.bool_or("error").alias("error"))
    j = f.join(counts.groupBy("name").agg(F.sum("n").alias("n")), "name", "full_outer")
    n = F.coalesce("n", F.lit(0))
    status = F.when(F.coalesce("error", F.lit(False)), "error").when(F.coalesce("loading", F.lit(False)), "loading").when(F.col("last_update").isNull(), "missing").when(n == 0, "stale").otherwise("healthy")
    return j.select("name", status.alias("status"), "last_update", n.alias("entry_count"))


def translation_report(rows: DataFrame) -> DataFrame:
    """Totals of translation rows (type, original, translated, warning, provider)."""
    warned = F.coalesce(F.col("warning"), F.lit("")) != ""
    who = lambda p: F.count_if(F.col("provider") == p)
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(~warned).alias("clean"), F.count_if(warned).alias("warnings"), who("primary").alias("primary_ok"), who("fallback").alias("fallback_used"), who("failed").alias("failed"))


def join_passages(passages: DataFrame, keys: list[str], order: list[str], text: str = "text", sep: str = "\n\n") -> DataFrame:
    """Texts of each key joined in order."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return passages.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["_t"]), sep).alias(text))


def index_stats(entries: DataFrame) -> DataFrame:
    return entries.groupBy("path", "entry_type").agg(F.count(F.lit(1)).alias("n"))
