"""Change streams of notes and conversations; each function takes a streaming or a batch DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.window import Window as W

from notelake.functions.embed import Embedder
from notelake.operators.ranking import upsert_latest
from notelake.plans.index_build import refresh
from notelake.sources.index import bucket_numbers, index_buckets, load_buckets, save_buckets


def _watermarked(df: DataFrame, late: str, ts: str = "ts") -> DataFrame:
    return df.withWatermark(ts, late) if df.isStreaming else df


def debounce(changes: DataFrame, gap: str = "2 seconds", late: str = "10 minutes", keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """(keys, ts, n): changes of one key less than gap apart act as one, at the time of the last."""
    rows = _watermarked(changes, late)
    out = rows.groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.max("ts").alias("ts"), F.count(F.lit(1)).alias("n"))
    return out.select(*keys, "ts", "n")


def actions(changes: DataFrame) -> DataFrame:
    """(path, action, ts): creations index at once, modifications wait, deletions drop; a rename drops the old path and indexes the new. Markdown only."""
    steps = (
        F.when(F.col("type") == "create", F.array(F.struct(F.col("path").alias("path"), F.lit("index").alias("action"))))
        .when(F.col("type") == "modify", F.array(F.struct(F.col("path").alias("path"), F.lit("wait").alias("action"))))
        .when(F.col("type") == "delete", F.array(F.struct(F.col("path").alias("path"), F.lit("drop").alias("action"))))
        .when(F.col("type") == "rename", F.array(F.struct(F.col("old_path").alias("path"), F.lit("drop").alias("action")), F.struct(F.col("path").alias("path"), F.lit("index").alias("action"))))
    )
    rows = changes.select("ts", F.explode(steps).alias("s")).select("s.path", "s.action", "ts")
    return rows.filter(F.lower("path").endswith(".md"))


#: Groups that the keys of a routed or settled stream are dealt to; a group's rows are worked off together, and its state goes to Python and back whole. Fixed over a stream's life.
GROUPS = 128


def held_rows(state: GroupState, parts: Iterator[pd.DataFrame], columns: list[str]) -> pd.DataFrame:
    """The rows that a group's state holds, as an array a column, and those that came."""
    got = [pd.DataFrame(dict(zip(columns, state.get, strict=True)))] if state.exists else []
    return pd.concat(got + ([] if state.hasTimedOut else [part[columns] for part in parts]), ignore_index=True)


def hold(state: GroupState, rows: pd.DataFrame, wake: np.ndarray) -> None:
    """Makes rows the group's state, to be looked at when the watermark has passed the first of the times (ms)."""
    if not len(rows):
        return state.remove() if state.exists else None
    state.update(tuple(rows[c].tolist() for c in rows.columns))
    if len(wake):
        state.setTimeoutTimestamp(max(int(wake.min()), state.getCurrentWatermarkMs() + 1))


def following(keys: np.ndarray) -> np.ndarray:
    """Whether the next row has the same key."""
    return np.append(keys[1:] == keys[:-1], False)


def _router(gap: int) -> Callable:
    """Holds actions until the watermark has passed them, then works off each path's by time; a modification waits for the gap, and what comes in between cancels it."""

    def work(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        until, rows = state.getCurrentWatermarkMs(), held_rows(state, parts, ["path", "at", "action"])
        rows = rows.iloc[np.lexsort((pd.factorize(rows["action"], sort=True)[0], rows["at"], pd.factorize(rows["path"])[0]))]
        at, wait = rows["at"].to_numpy(), (rows["action"] == "wait").to_numpy()
        ms, due = at // 1000, at < until * 1000
        # Whether the path's next action is due too; if not, none comes before the watermark.
        met = following(rows["path"].to_numpy()) & np.append(due[1:], False)
        alone = np.where(met, np.append(ms[1:], 0), until) - ms > gap
        out, left = rows[due & (~wait | alone)], ~due | (wait & ~met & ~alone)
        hold(state, rows[left], (ms + np.where(due, gap, 0))[left])
        if len(out):
            yield out.assign(action=out["action"].replace("wait", "index"))[["path", "action", "at"]]

    return work


def route_changes(changes: DataFrame, gap_ms: int = 2000, late: str = "10 minutes", groups: int = GROUPS) -> DataFrame:
    """(path, action, ts) with modifications held back for the gap and cancelled by what comes in between (stateful on a stream)."""
    rows = actions(changes)
    if changes.isStreaming:
        keyed = rows.withColumns({"at": F.unix_micros("ts"), "g": F.pmod(F.xxhash64("path"), F.lit(groups))}).withWatermark("ts", late).groupBy("g")
        out = keyed.applyInPandasWithState(_router(gap_ms), "path string, action string, at long", "path array<string>, at array<long>, action array<string>", "append", "EventTimeTimeout")
        return out.select("path", "action", F.timestamp_micros("at").alias("ts"))
    w = W.partitionBy("path").orderBy("ts")
    nxt = F.lead("ts").over(w)
    alone = nxt.isNull() | (F.unix_millis(nxt) - F.unix_millis("ts") > gap_ms)
    marked = rows.withColumn("_keep", (F.col("action") != "wait") | alone).filter("_keep")
    return marked.select("path", F.when(F.col("action") == "wait", "index").otherwise(F.col("action")).alias("action"), "ts")


def queue_dedup(changes: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The first change of each path; on a stream, of those within the watermark."""
    if changes.isStreaming:
        return changes.withWatermark("ts", late).dropDuplicatesWithinWatermark(["path"])
    return changes.groupBy("path").agg(F.min("ts").alias("ts"))


def late_guard(changes: DataFrame, stored: DataFrame) -> DataFrame:
    """Changes newer than the stored mtime of their note (stored: path, mtime; the static side)."""
    return changes.join(stored.select("path", F.col("mtime").alias("_m")), "path", "left").filter(F.col("_m").isNull() | (F.col("ts") > F.col("_m"))).drop("_m")


def debounced_history(states: DataFrame, gap: str = "2 seconds", late: str = "10 minutes") -> DataFrame:
    """(id, ts, state): the last state of each conversation within the gap."""
    rows = _watermarked(states, late)
    out = rows.groupBy("id", F.session_window("ts", gap).alias("w")).agg(F.max_by("state", "ts").alias("state"), F.max("ts").alias("ts"))
    return out.select("id", "ts", "state")


def incremental_index(changes: DataFrame, notes: Callable[[], DataFrame], index_path: str, model: str, embedder: Embedder, checkpoint: str, include: str = "", exclude: str = ""):
    """Starts a query that refreshes a built index (of write_buckets) with each batch of changes (path, action, ts) and saves it once a batch.

    notes gives the notes as they are now. A batch reads and writes only the buckets of its changes' paths; a batch that runs again after a failure makes
    the same rows. Without a built index of the model the query fails.
    """

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        index = load_buckets(spark, index_path)
        touched = bucket_numbers(df, "path", index_buckets(spark, index_path))
        old = index.filter((F.col("model") == model) & F.col("bucket").isin(touched))
        if not index.filter(F.col("model") == model).limit(1).count():
            raise ValueError(f"no index of {model} at {index_path}")
        save_buckets(refresh(notes(), old.drop("bucket"), df, model, embedder, include, exclude).withColumn("model", F.lit(model)), index_path, touched, {"model": model})

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_guard_stream(changes: DataFrame) -> DataFrame:
    """Changes (path, mtime, event_id) newer than all earlier ones of their note; the newest mtime of each path is the state."""
    return changes.groupBy("path").transformWithStateInPandas(statefulProcessor=_Newest(), outputStructType="path string, mtime long, event_id long", outputMode="Append", timeMode="None")


class _Newest(StatefulProcessor):
    """Lets a change through if its mtime is greater than the greatest one seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "mtime long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        top, out = (self.newest.get()[0] if self.newest.exists() else None), []
        got = pd.concat(list(rows)).sort_values("event_id")
        for mtime, event in zip(got["mtime"], got["event_id"], strict=True):
            if top is None or mtime > top:
                top = int(mtime)
                out.append((key[0], top, int(event)))
        self.newest.update((top,))
        yield pd.DataFrame(out, columns=["path", "mtime", "event_id"])

    def close(self) -> None:
        pass


def save_history(states: DataFrame, stored: str, checkpoint: str, gap: str = "2 seconds", late: str = "10 minutes"):
    """Starts a query that writes the last states (id, ts, state) within the gap over those stored (id, state, pos; of write_buckets), once a batch.

    A batch reads and writes only the buckets of its ids; one that runs again after a failure makes the same rows.
    """

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        touched = bucket_numbers(df, "id", index_buckets(spark, stored))
        before = load_buckets(spark, stored).filter(F.col("bucket").isin(touched)).drop("bucket")
        save_buckets(upsert_latest(before, df.select("id", "state", "ts"), df.select("id").limit(0)), stored, touched)

    return debounced_history(states, gap, late).writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Rolling(StatefulProcessor):
    """The last passages of a conversation: those of the newest turn by score, then earlier ones."""

    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "turn long, score double, path string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.held.get()) if self.held.exists() else []
        got, out = pd.concat(list(rows)), []
        for turn, part in got.groupby("turn"):
            new = sorted(((int(turn), float(s), p) for s, p in zip(part["score"], part["path"], strict=True)), key=lambda x: (-x[1], x[2]))
            names = {x[2] for x in new}
            held = (new + [x for x in held if x[2] not in names])[: self.k]
            out += [(key[0], int(turn), x[2], i + 1) for i, x in enumerate(held)]
        self.held.put([tuple(x) for x in held])
        yield pd.DataFrame(out, columns=["conv_id", "turn", "path", "rank"])

    def close(self) -> None:
        pass


def rolling_context_stream(passages: DataFrame, k: int = 20) -> DataFrame:
    """(conv_id, turn, path, rank) for each turn of a stream of passages, with k rows of state a conversation."""
    return passages.groupBy("conv_id").transformWithStateInPandas(statefulProcessor=_Rolling(k), outputStructType="conv_id long, turn long, path string, rank int", outputMode="Append", timeMode="None")
