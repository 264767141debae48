"""Work on conversation logs (conv_id, turn, role, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def export_markdown(messages: DataFrame, speaker: str = "Assistant") -> DataFrame:
    """(conv_id, markdown): one document a conversation, system messages left out, reasoning as a quoted callout."""
    who = F.when(F.col("role") == "user", "You").otherwise(speaker)
    thought = F.when(F.coalesce("reasoning", F.lit("")) != "", F.concat(F.lit("> [!thought]\n> "), F.replace("reasoning", F.lit("\n"), F.lit("\n> ")), F.lit("\n\n"))).otherwise("")
    block = F.concat(F.lit("**"), who, F.lit("**:\n"), thought, F.coalesce("content", F.lit("")), F.lit("\n"))
    rows = messages.filter(F.col("role") != "system").select("conv_id", "turn", block.alias("b"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "b"))), lambda x: x["b"]), "\n---\n\n").alias("markdown"))


def merge_runs(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, content): neighbours of one role made one message, texts parted by a blank line."""
    w = W.partitionBy("conv_id").orderBy("turn")
    change = F.when(F.lag("role").over(w).eqNullSafe(F.col("role")), 0).otherwise(1)
    rows = messages.withColumn("_c", change).withColumn("_run", F.sum("_c").over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "content"))), lambda x: x["content"]), "\n\n")
    return rows.groupBy("conv_id", "_run").agg(F.min("turn").alias("turn"), F.first("role").alias("role"), joined.alias("content")).drop("_run")


def place_tool_results(messages: DataFrame) -> DataFrame:
    """(conv_id, pos, role, content): tool results joined into one user message before the last assistant message, else at the end."""
    tool = F.col("role") == "tool_result"
    marks = messages.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("last"), F.max("turn").alias("end"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "content"))), lambda x: x["content"]), "\n\n")
    made = messages.filter(tool).groupBy("conv_id").agg(joined.alias("content")).join(marks, "conv_id")
    made = made.select("conv_id", F.coalesce(F.col("last") - 0.5, F.col("end") + 0.5).alias("pos"), F.lit("user").alias("role"), "content")
    return messages.filter(~tool).select("conv_id", F.col("turn").cast("double").alias("pos"), "role", "content").unionByName(made)


def titles(messages: DataFrame, size: int = 60) -> DataFrame:
    """(conv_id, title): the first user message, cut, else a standing title."""
    first = F.min_by(F.when(F.col("role") == "user", F.col("content")), F.when(F.col("role") == "user", F.col("turn")))
    return messages.groupBy("conv_id").agg(F.coalesce(F.substring(first, 1, size), F.lit("Untitled chat")).alias("title"))


def repeated_calls(calls: DataFrame, chain: str = "conv_id", order: str = "turn") -> DataFrame:
    """calls with flag repeated: the same skill with the same parameters (blanks and case aside) stood earlier in the chain."""
    key = F.lower(F.regexp_replace("params", r"\s+", ""))
    return calls.withColumn("_k", key).withColumn("repeated", F.row_number().over(W.partitionBy(chain, "skill", "_k").orderBy(order)) > 1).drop("_k")


def rolling_context(passages: DataFrame, k: int = 20) -> DataFrame:
    """(conv_id, turn, path, rank): a turn's passages by score, then those of earlier turns that aren't repeated, the first k.

    Each turn looks back at the earlier turns of its own conversation.
    """
    turns = passages.select("conv_id", F.col("turn").alias("now")).distinct()
    seen = turns.join(passages, "conv_id").filter("turn <= now")
    last = seen.groupBy("conv_id", "now", "path").agg(F.max(F.struct("turn", "score")).alias("m"))
    ranked = last.withColumn("rank", F.row_number().over(W.partitionBy("conv_id", "now").orderBy(F.desc("m.turn"), F.desc("m.score"), "path")))
    return ranked.filter(F.col("rank") <= k).select("conv_id", F.col("now").alias("turn"), "path", "rank")
