"""Registration of queries with their SQL, and the entry table that several of them use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.functions.vectors import quantize
from notelake.plans.fixtures import VIEWS, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_INT8 = "list_transform({}, lambda x: CAST(floor(greatest(-1.0, least(1.0, CAST(x AS DOUBLE))) * 127 + 0.5) AS TINYINT))"
SQL_VIEWS = VIEWS | {
    "entries": f"""SELECT v.entry_id, concat(source, '/', lang, '/', doc_id, '.md') AS path, CASE WHEN ord = 0 THEN 'summary' WHEN ord = 1 AND label % 2 = 0 THEN 'highlights' ELSE 'content' END AS entry_type,
        CAST(CASE WHEN ord = 0 OR (ord = 1 AND label % 2 = 0) THEN 0 ELSE 200 * (ord - 1) END AS INT) AS chunk_start, CAST(CASE WHEN ord = 0 OR (ord = 1 AND label % 2 = 0) THEN 0 ELSE 200 * ord END AS INT) AS chunk_end,
        CASE WHEN ord > 1 THEN concat(lang, ' > ', source) END AS heading_path, CASE WHEN ord = 0 THEN substr(text, 1, 60) END AS summary_text, concat(source, ', ', lang) AS tags_text, CASE WHEN ord = 1 AND label % 2 = 0 THEN substr(text, 61, 40) END AS highlights_text,
        {_INT8.format("raw")} AS embedding, concat('h', v.entry_id % 50) AS chunk_hash, doc_id AS mtime, CASE WHEN label % 10 = 0 THEN 'old' ELSE 'new' END AS model
        FROM (SELECT vec_id AS entry_id, CAST(floor(vec_id / 5) AS BIGINT) AS note, vec_id % 5 AS ord, label, embedding AS raw FROM embeddings) v JOIN documents ON doc_id = note""",
    "vqueries": f"""SELECT q.query_id, q.text, {_INT8.format("a.embedding")} AS v1, {_INT8.format("b.embedding")} AS v2
        FROM ({VIEWS["queries"]}) q JOIN embeddings a ON a.vec_id = q.query_id LEFT JOIN embeddings b ON b.vec_id = q.query_id + 1""",
}
#: A cosine of two int8 vectors in DuckDB.
COS = "coalesce(list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / nullif(sqrt(list_inner_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))) * sqrt(list_inner_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[]))), 0), 0)"

#: letter_counts() of a text in DuckDB.
LETTERS = "[" + ", ".join(f"(len({{0}}) - len(replace({{0}}, '{c}', ''))) / 64.0::DOUBLE" for c in "aeinorst") + "]"


def query(name: str, sql: str | None = None, *views: str):
    """Registers a function of (spark, sf_dir); sql is DuckDB SQL over the named views."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = ("WITH " + ", ".join(f"{v} AS ({SQL_VIEWS[v]})" for v in views) + " " if views else "") + sql
        return f

    return put


def entries(spark: SparkSession, d: str) -> DataFrame:
    # Only what an entry takes of a text goes through the join.
    v, docs = view(spark, d, "vectors"), view(spark, d, "documents").select("doc_id", "source", "lang", F.substring("text", 1, 60).alias("first"), F.substring("text", 61, 40).alias("next"))
    j = v.join(docs, docs["doc_id"] == v["note"])
    note = (F.col("ord") == 0) | ((F.col("ord") == 1) & (F.col("label") % 2 == 0))
    marked = (F.col("ord") == 1) & (F.col("label") % 2 == 0)
    at = lambda c: F.when(note, 0).otherwise(c).cast("int")
    return j.select(
        "entry_id", F.concat("source", F.lit("/"), "lang", F.lit("/"), "doc_id", F.lit(".md")).alias("path"), F.when(F.col("ord") == 0, "summary").when(marked, "highlights").otherwise("content").alias("entry_type"),
        at(200 * (F.col("ord") - 1)).alias("chunk_start"), at(200 * F.col("ord")).alias("chunk_end"), F.when(F.col("ord") > 1, F.concat("lang", F.lit(" > "), "source")).alias("heading_path"),
        F.when(F.col("ord") == 0, F.col("first")).alias("summary_text"), F.concat("source", F.lit(", "), "lang").alias("tags_text"), F.when(marked, F.col("next")).alias("highlights_text"),
        quantize(F.col("raw")).alias("embedding"), F.concat(F.lit("h"), F.col("entry_id") % 50).alias("chunk_hash"), F.col("doc_id").alias("mtime"), F.when(F.col("label") % 10 == 0, "old").otherwise("new").alias("model"),
    )


def vqueries(spark: SparkSession, d: str) -> DataFrame:
    q, e = view(spark, d, "queries"), view(spark, d, "embeddings")
    a = e.select(F.col("vec_id").alias("query_id"), quantize(F.col("embedding")).alias("v1"))
    b = e.select((F.col("vec_id") - 1).alias("query_id"), quantize(F.col("embedding")).alias("v2"))
    return q.join(a, "query_id").join(b, "query_id", "left")


def scratch(spark: SparkSession) -> str:
    """A new folder for written tables in the cluster's shared checkpoint folder; where that is unset, on this machine if all tasks run in this process."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="spark-")
    return f"{shared}/notelake-{uuid.uuid4().hex}"
