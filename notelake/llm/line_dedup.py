"""Operator 3: repeated runs of lines, found by winnowed line fingerprints, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.common import BLANK, free, let, small, table, written


def _windows(hashes: Column, counts: Column, least_words: int) -> Column:
    """Structs kind, lo, hi, at (places in the arrays), low, body: of windows, the first and last line, the place and hash of the smallest line hash (the last of equal ones), the hash of all.

    For every line, the shortest window from it on with least_words words, and the shortest one that ends with it. Each
    line has a word, so no window is longer than least_words lines.
    """

    def reach(part: Column) -> Column:
        """Number of leading lines that have least_words words together; 0 if all have fewer."""
        grow = lambda acc, n: F.when(acc["n"] >= least_words, acc).otherwise(F.struct((acc["n"] + n).alias("n"), (acc["k"] + 1).alias("k")))
        return F.aggregate(part, F.struct(F.lit(0).alias("n"), F.lit(0).alias("k")), grow, lambda acc: F.when(acc["n"] >= least_words, acc["k"]).otherwise(0))

    def window(kind: int, lo: Column, k: Column) -> Column:
        def of(h: Column) -> Column:
            least = F.array_min(h)
            return F.struct(F.lit(kind).alias("kind"), lo.alias("lo"), (lo + k - 1).cast("int").alias("hi"), (lo + k - F.array_position(F.reverse(h), least)).cast("int").alias("at"), least.alias("low"), F.xxhash64(h, F.size(h)).alias("body"))

        return F.when(k > 0, let(F.slice(hashes, lo + 1, k), of))

    def both(i: Column) -> Column:
        from_here = let(reach(F.slice(counts, i + 1, least_words)), lambda k: window(0, i, k))
        first = F.greatest(i - least_words + 1, F.lit(0))
        to_here = let(reach(F.reverse(F.slice(counts, first + 1, i - first + 1))), lambda k: window(1, i - k + 1, k))
        return F.array(from_here, to_here)

    every = F.flatten(F.transform(F.sequence(F.lit(0), F.size(hashes) - 1), both))
    return F.when(F.size(hashes) > 0, F.filter(every, lambda x: x.isNotNull()))


def _word_count(line: Column) -> Column:
    """Words of a line: where single blanks stand between them, one more than blanks; else counted by pattern."""
    t = F.trim(line)
    odd = t.contains("  ") | t.contains("\t") | t.contains("\r") | t.contains("\x0b") | t.contains("\x0c")
    single = F.when(t == "", 0).otherwise(F.octet_length(t) - F.octet_length(F.replace(t, F.lit(" "), F.lit(""))) + 1)
    return F.when(odd, F.regexp_count(line, F.lit(f"[^{BLANK}]+"))).otherwise(single)


def line_hashes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, hs, ns, at): of each document's lines with a word, the hash (ends trimmed), the number of words, and the place among all lines."""
    counted = F.transform(F.split("t", "\n", -1), lambda x, i: F.struct(F.xxhash64(F.trim(x)).alias("h"), _word_count(x).alias("n"), i.alias("i")))
    held = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    held = held.select("id", F.xxhash64("id", "t").alias("key"), F.filter(counted, lambda x: x["n"] > 0).alias("l")).filter(F.size("l") > 0)
    return held.select("id", "key", F.col("l.h").alias("hs"), F.col("l.n").alias("ns"), F.col("l.i").alias("at")).dropDuplicates(["key"])


def repeated_windows(held: DataFrame, least_words: int) -> DataFrame:
    """(key, kind, lo, hi): of each document, the windows that stand earlier, in other documents or before in its own; kind 0 are those from a line on, 1 those up to a line.

    Winnowing selects each window's smallest line hash as a fingerprint. Fingerprints are joined by hash over all positions; only windows whose
    fingerprint stands in several places are looked at further, and those with equal contents are matched with the first of them.
    """
    # An outer generator keeps the optimizer from testing the windows' array in a filter of its own, which computes it again.
    rows = held.select("id", "key", F.explode_outer(_windows(F.col("hs"), F.col("ns"), least_words)).alias("w")).filter("w is not null")
    rows = written(rows.select("w.low", "w.body", F.struct("id", "key", "w.lo").alias("place"), "w.at", "w.kind", "w.hi"))
    at = F.struct("place.key", "at")
    repeated = rows.groupBy("low").agg(F.min(at).alias("first"), F.max(at).alias("last")).filter("first <> last").select("low")
    seeds = rows.join(repeated, "low", "left_semi")
    first = seeds.groupBy("low", "body").agg(F.min("place").alias("first"), F.max("place").alias("last")).filter("first <> last").select("low", "body", "first")
    return seeds.join(first, ["low", "body"]).filter(F.col("place") != F.col("first")).select("place.key", "kind", "place.lo", "hi")


def repeated_lines(held: DataFrame, windows: DataFrame) -> DataFrame:
    """(key, gone): of documents with later repeated runs, the places of the runs' lines.

    A match is extended forwards by the windows that begin in it and backwards by those that end in it, each of which stands earlier too. Windows of one
    kind begin and end in the same order, so each adds its lines up to the next one's begin: a run costs its length, however often it repeats itself.
    """
    runs = windows.groupBy("key", "kind").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("w"))
    none = F.array().cast("array<int>")
    until = lambda x, i: F.least(x["hi"], F.coalesce(F.get("w", i + 1)["lo"] - 1, x["hi"]))  # noqa: E731  before the begin where the next window begins there too
    lines = F.flatten(F.transform("w", lambda x, i: F.when(until(x, i) >= x["lo"], F.sequence(x["lo"], until(x, i))).otherwise(none)))
    covered = runs.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list(lines))).alias("lines"))
    return covered.join(held.select("key", "at"), "key").select("key", F.transform("lines", lambda i: F.get("at", i)).alias("gone"))


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_words: int = 50) -> DataFrame:
    """docs with text_col cut and two more columns: n_lines and n_deleted (with underscores behind, if docs has such columns itself).

    A run of consecutive lines (blank ones skipped, ends trimmed) with least_words words or more that stands earlier,
    by id and then by place, is deleted from every later document or place; the first stays. Every repeated run holds a
    window of the shortest kind from each of its lines on, or up to it, so fingerprints find all runs, and extending
    finds them whole. Other texts stay as they are, blank lines included; a text may become empty, and no document is
    dropped. A null text stays null. Rows equal in id and text are one document: their texts stay alike. Documents with
    a null id come first; of different texts under one id, the one with the smaller hash comes first. Columns of docs
    keep their values, whatever their names. A text of many lines costs about its length. An empty table gives no row.
    """
    held = written(line_hashes(docs, id_col, text_col))
    gone = small(written(repeated_lines(held, repeated_windows(held, least_words))))
    n_lines, n_deleted = (free(name, docs.columns) for name in ("n_lines", "n_deleted"))
    text = F.col("row")[text_col]
    df = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).alias("key")).join(gone, "key", "left")
    lines = F.split(text, "\n", -1)
    left = let(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone")), lambda i: F.get(x, i)), "\n"))
    new = F.when(F.col("gone").isNull(), text).otherwise(left)
    kept = [new.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    return df.select(*kept, F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(n_lines), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(n_deleted))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_deleted", "text")


OP3_SQL = r"""
WITH ln AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
real AS (
  SELECT doc_id, i, trim(line, ' ') AS line, len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
run AS (SELECT *, row_number() OVER w AS r, sum(n) OVER w AS s FROM real WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
ends AS (
  SELECT a.doc_id, a.r AS lo, min(b.r) AS hi FROM run a JOIN run b ON a.doc_id = b.doc_id AND b.r BETWEEN a.r AND a.r + 49 AND b.s - a.s + a.n >= 50 GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.r) AS lo, b.r AS hi FROM run a JOIN run b ON a.doc_id = b.doc_id AND a.r BETWEEN b.r - 49 AND b.r AND b.s - a.s + a.n >= 50 GROUP BY b.doc_id, b.r),
win AS (
  SELECT e.doc_id, lo, hi, string_agg(line, chr(10) ORDER BY r) AS body FROM ends e JOIN run ON run.doc_id = e.doc_id AND run.r BETWEEN lo AND hi GROUP BY e.doc_id, lo, hi),
later AS (SELECT doc_id, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, lo) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT run.doc_id, run.i FROM later l JOIN run ON run.doc_id = l.doc_id AND run.r BETWEEN l.lo AND l.hi),
kept AS (
  SELECT ln.doc_id, count(*) AS n_lines, count(gone.i) AS n_deleted, coalesce(string_agg(line, chr(10) ORDER BY ln.i) FILTER (gone.i IS NULL), '') AS text
  FROM ln LEFT JOIN gone ON gone.doc_id = ln.doc_id AND gone.i = ln.i GROUP BY ln.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted, k.text FROM documents d LEFT JOIN kept k USING (doc_id)
"""
