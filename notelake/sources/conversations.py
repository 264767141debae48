"""Saved conversations as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.operators.predicates import valid_messages

SCHEMA = "id string, title string, timestamp long, messages array<struct<role:string,content:string,reasoning:string,context:string>>"


def load_conversations(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, timestamp, turn, role, content, reasoning, context); broken lines, conversations without id and invalid messages drop out."""
    raw = spark.read.schema(SCHEMA).option("mode", "PERMISSIVE").json(path).filter("id is not null")
    rows = raw.select("id", F.coalesce("title", F.lit("Untitled chat")).alias("title"), F.coalesce("timestamp", F.lit(0)).alias("timestamp"), F.posexplode("messages").alias("turn", "m"))
    return valid_messages(rows.select("id", "title", "timestamp", "turn", "m.*"))


def write_conversations(messages: DataFrame, path: str) -> None:
    """One JSON line a conversation from (id, title, timestamp, turn, role, content, reasoning, context)."""
    m = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "content", "reasoning", "context"))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"), x["reasoning"].alias("reasoning"), x["context"].alias("context")))
    messages.groupBy("id").agg(F.first("title").alias("title"), F.first("timestamp").alias("timestamp"), m.alias("messages")).write.mode("overwrite").json(path)
