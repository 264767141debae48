"""Operator 8: benchmark phrases found through positional postings, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.common import ascii_lower, cut, small, table

#: What stands between words once A-Z are lower case: ASCII other than digits and a-z. The second form leaves A-Z in words.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAPS_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAPS, -1)


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct items with their words: item_id (string, null as empty), item (hash of both), w."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), F.filter(_words(F.col(text_col)), lambda x: x != "").alias("w"))
    return items.filter(F.size("w") > 0).select("item_id", F.xxhash64("item_id", "w").alias("item"), "w").dropDuplicates(["item"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and the key of a document: a hash of both, so that documents that share an id stay apart."""
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("key", F.xxhash64("id", "t"))


def rarest_terms(keyed: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """For every window of an item its two rarest terms: item, p1, t1, p2, t2 (positions in the item; the same for a one-word item).

    Terms are counted over all documents. A window with a term that no document has can't occur and is left out.
    """
    terms = items.select("item", F.posexplode("w").alias("p", "term"))
    vocabulary = small(terms.select("term").distinct())
    counts = cut(keyed.select(F.explode(_words(F.col("t"))).alias("term")).join(vocabulary, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    windows = items.select("item", F.size("w").alias("size"), F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))).alias("start"))
    in_window = windows.join(terms, "item").filter((F.col("p") >= F.col("start")) & (F.col("p") < F.col("start") + window))
    known = in_window.join(counts, "term")
    rare = known.groupBy("item", "start").agg(F.array_sort(F.collect_list(F.struct("n", "p", "term"))).alias("by"), F.first("size").alias("size"))
    rare = rare.filter(F.size("by") == F.least(F.col("size"), F.lit(window)))
    a, b = F.col("by")[0], F.coalesce(F.get(F.col("by"), F.lit(1)), F.col("by")[0])
    return rare.select("item", a["p"].alias("p1"), a["term"].alias("t1"), b["p"].alias("p2"), b["term"].alias("t2")).distinct()


def alignments(keyed: DataFrame, pairs: DataFrame, slack: int = 0) -> DataFrame:
    """(key, item, delta): places where the postings of a window's two rarest terms meet once shifted by their offsets in the item.

    With slack 0 the shifted positions must be equal (phrases); else they may differ by up to slack words (proximity).
    """
    p1 = pairs.select("item", F.col("p1").alias("p"), F.col("t1").alias("term"))
    terms = small(p1.union(pairs.select("item", F.col("p2").alias("p"), F.col("t2").alias("term"))).distinct())
    postings = keyed.select("key", F.posexplode(_words(F.col("t"))).alias("pos", "term")).join(terms, "term").select("key", "item", (F.col("pos") - F.col("p")).alias("delta"), "p")
    by_item = pairs.groupBy("item").agg(F.collect_set(F.struct("p1", "p2")).alias("pairs"))
    if slack == 0:
        met = postings.groupBy("key", "item", "delta").agg(F.collect_set("p").alias("ps")).join(small(by_item), "item")
        return met.filter(F.exists("pairs", lambda x: F.array_contains(F.col("ps"), x["p1"]) & F.array_contains(F.col("ps"), x["p2"]))).select("key", "item", "delta")
    # Shifts within slack of each other share one of two overlapping cells of twice the slack.
    cell = F.floor(F.col("delta") / (2 * slack)).cast("int")
    shifted = F.floor((F.col("delta") + slack) / (2 * slack)).cast("int")
    cells = postings.select("*", F.explode(F.array(F.struct(F.lit(0).alias("o"), cell.alias("c")), F.struct(F.lit(1).alias("o"), shifted.alias("c")))).alias("cell"))
    met = cells.groupBy("key", "item", "cell").agg(F.collect_set(F.struct("p", "delta")).alias("ps")).join(small(by_item), "item")
    two = lambda x: F.exists("ps", lambda a: (a["p"] == x["p1"]) & F.exists("ps", lambda b: (b["p"] == x["p2"]) & (F.abs(a["delta"] - b["delta"]) <= slack)))
    return met.filter(F.exists("pairs", two)).select("key", "item").distinct()


def phrase_matches(keyed: DataFrame, items: DataFrame, aligned: DataFrame, window: int) -> DataFrame:
    """(key, item_id, delta, starts, size): the item's windows that the document has word for word at an alignment."""
    keys = aligned.select("key").distinct()
    some = keyed.join(small(keys), "key", "left_semi").select("key", _words(F.col("t")).alias("dw")).dropDuplicates(["key"])
    at = some.join(aligned, "key").join(small(items), "item")
    at = at.withColumn("same", F.transform("w", lambda x, j: F.coalesce(F.get(F.col("dw"), F.col("delta") + j) == x, F.lit(False))))
    size = F.least(F.size("w"), F.lit(window))
    starts = F.filter(F.sequence(F.lit(0), F.size("w") - size), lambda s: F.forall(F.slice(F.col("same"), s + 1, size), lambda x: x))
    return at.select("key", "item_id", "delta", starts.alias("starts"), size.alias("size")).filter(F.size("starts") > 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """One row a document: id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is `window` consecutive words of an item (all of a shorter item). The rarest term of each window and the
    next rarest are looked up in the documents' positional postings; their position lists, shifted by the terms' offsets,
    are intersected, and what is left is compared word for word. n_hit counts document words inside occurrences. Null
    texts have no words; a null item id counts as an empty string; items that are repeated count once; repeated documents
    are reported each; empty tables give no hits or no rows.
    """
    keyed = _keyed(docs, id_col, text_col)
    items = cut(_items(benchmark, item_id_col, item_text_col))
    pairs = cut(rarest_terms(keyed, items, window))
    aligned = cut(alignments(keyed, pairs))
    hits = phrase_matches(keyed, items, aligned, window)
    places = F.flatten(F.transform("starts", lambda s: F.sequence(F.col("delta") + s, F.col("delta") + s + F.col("size") - 1)))
    per_doc = hits.select("key", "item_id", places.alias("places")).groupBy("key").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("ids"))
    per_doc = small(cut(per_doc.select("key", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))))
    n_words = F.size(F.filter(F.split("t", _GAPS_ANY_CASE, -1), lambda x: x != "")).cast("long")
    out = keyed.select("id", "key", n_words.alias("n_words")).join(per_doc, "key", "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0))
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce(F.col("n_items"), F.lit(0)).alias("n_items"), F.coalesce(F.col("items_sha256"), F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slack: int = 3, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """(id, item_id) where the two rarest terms of one of the item's windows stand within slack words of their distance in the item."""
    keyed, items = _keyed(docs, id_col, text_col), cut(_items(benchmark, item_id_col, item_text_col))
    near = alignments(keyed, cut(rarest_terms(keyed, items, window)), slack)
    return keyed.select("id", "key").join(near, "key").join(items.select("item", "item_id"), "item").select(F.col("id").alias(id_col), "item_id").distinct()


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP8_SQL = r"""
WITH dw AS (
  SELECT doc_id, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS w,
         generate_subscripts(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> ''), 1) AS p
  FROM documents),
iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[s : s + least(len(ws), 10) - 1], ' ') AS phrase
  FROM iw, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS g(s) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM win),
runs AS (
  SELECT doc_id, p, n, array_to_string(list(w) OVER (PARTITION BY doc_id, n ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)[1 : n], ' ') AS phrase
  FROM dw, sizes),
hit AS (SELECT r.doc_id, r.p, r.n, win.item_id FROM runs r JOIN win ON win.phrase = r.phrase AND win.n = r.n),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM hit, unnest(generate_series(p, p + n - 1)) AS g(q) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(array_to_string(list_sort(list(DISTINCT item_id)), ',')) AS items_sha256 FROM hit GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) AS n_words FROM dw GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n_words, 0) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(f.n_items, 0) AS n_items,
       coalesce(f.items_sha256, sha256('')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM documents d LEFT JOIN counted c USING (doc_id) LEFT JOIN covered h USING (doc_id) LEFT JOIN found f USING (doc_id)
"""
