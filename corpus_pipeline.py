"""A corpus from raw documents to packed sequences; each stage works on all rows that the one before it kept.

Stages tell documents apart by a hash of id and text; rows equal in both are one document (they stay or go together, but
for near duplicates, of which one row stays). Null ids, null, empty and very long texts, null languages and sources are
rows like others: a null text fails the quality rules for its lack of words. Columns of the documents stay as they are,
whatever their names (n_chars follows a text that is cut). An empty table goes through all stages as an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.common import small, table, written
from notelake.llm.decontaminate import decontaminate
from notelake.llm.line_dedup import line_dedup
from notelake.llm.ngram_join import ngram_join
from notelake.llm.packing import pack_documents
from notelake.llm.quality import quality_rules


def _key() -> Column:
    """Names a row by its id and text, as the operators do; rows equal in both are one document."""
    return F.xxhash64(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")))


def _kept(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of docs whose key is (left_semi) or isn't (left_anti) in keys."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), _key().alias("key"))
    return rows.join(small(keys), "key", how).select("row.*")


def _decided(docs: DataFrame) -> DataFrame:
    """docs with the key in the id, so that decisions come back by it."""
    return docs.withColumn("doc_id", F.struct("doc_id", _key().alias("key")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. The rules tell rows apart by id, language and source."""
    rejected = quality_rules(_decided(docs)).filter(~F.col("kept")).select("doc_id.key").distinct()
    return _kept(docs, written(rejected), "left_anti")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines are cut out of the texts; no document goes."""
    cut = line_dedup(docs)
    counted = [F.coalesce(F.char_length("text"), F.lit(0)).cast(kind).alias(c) if c == "n_chars" else F.col(c) for c, kind in docs.dtypes]
    return cut.select(*counted)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays, the one with the smallest id (of equal ids, the smaller key); texts without words stay all."""
    found = written(ngram_join(docs, with_key=True).filter("n_shingles > 0").select("doc_id", "key", "label"))
    groups = found.groupBy("label").agg(F.min(F.struct("doc_id", "key")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = written(found.join(groups, "label").select("key", F.col("first.key").alias("stays")))
    gone = members.filter("key <> stays").select("key").distinct()
    again = members.filter("key = stays").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    gone, again = written(gone), written(again)
    left = _kept(docs, gone, "left_anti")
    rows = left.select(F.struct(*docs.columns).alias("row"), _key().alias("key")).join(small(again), "key", "left_semi").dropDuplicates(["key"])
    return _kept(left, again, "left_anti").unionByName(rows.select("row.*"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with words of a benchmark window go."""
    hit = decontaminate(_decided(docs), table(spark, sf_dir, "benchmark")).filter("contaminated").select("doc_id.key").distinct()
    return _kept(docs, written(hit), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as pieces of token sequences."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("packing", packed)]

#: Robust estimates and a tokenizer can't be put in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
