"""Related notes while users move from note to note: which note a user has settled on, on a stream by keyed state and timers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.window import Window as W

from notelake.streaming.changes import GROUPS, following, held_rows, hold


def _settled(gap: int) -> Callable:
    """Holds views until the watermark has passed them, and the view by which each user came to the note the user is on, with whether it was shown.

    Views are worked off by time and then event, whatever order they came in. One of the note that the user is on has no effect.
    """

    def work(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        until, rows = state.getCurrentWatermarkMs() * 1000, held_rows(state, parts, ["user", "at", "event", "path", "shown"])
        rows = rows.iloc[np.lexsort((rows["event"], rows["at"], pd.factorize(rows["user"])[0]))]
        user, path = rows["user"].to_numpy(), rows["path"].to_numpy()
        stays = np.append(False, (following(user) & following(path))[:-1])
        rows = rows[(rows["at"].to_numpy() >= until) | ~stays]
        at, shown = rows["at"].to_numpy(), rows["shown"].to_numpy(bool)
        due = at < until
        # Whether the user's next view is due too; if not, none comes before the watermark.
        met = following(rows["user"].to_numpy()) & np.append(due[1:], False)
        out = due & ~shown & (np.where(met, np.append(at[1:], 0), until) - at >= gap)
        left = ~(due & met)
        hold(state, rows.assign(shown=shown | out)[left], (at + np.where(due, gap, 0))[left & ~shown & ~out] // 1000)
        if out.any():
            yield rows[out][["user", "path", "at"]]

    return work


def settled_views(views: DataFrame, gap: str = "400 milliseconds", late: str = "1 minute", groups: int = GROUPS) -> DataFrame:
    """(user, ts, path): views (user, ts, event, path, paused) after which the user stayed on the note for the gap.

    Views while paused, and of the note that the user is on already, have no effect; of views at one time the larger event is the later. On a stream
    the state is a row a user and the views that the watermark (late behind the newest) hasn't passed; views behind it are dropped.
    """
    gap_us = _micros(views, gap)
    rows = views.select("user", "ts", "event", "path", F.coalesce("paused", F.lit(False)).alias("paused"), F.unix_micros("ts").alias("at"))
    if views.isStreaming:
        kind = dict(views.dtypes)["user"]
        seen = rows.withWatermark("ts", late).filter(~F.col("paused")).withColumns({"shown": F.lit(False), "g": F.pmod(F.xxhash64("user"), F.lit(groups))})
        held = f"user array<{kind}>, at array<long>, event array<{dict(views.dtypes)['event']}>, path array<string>, shown array<boolean>"
        out = seen.groupBy("g").applyInPandasWithState(_settled(gap_us), f"user {kind}, path string, at long", held, "append", "EventTimeTimeout")
        return out.select("user", F.timestamp_micros("at").alias("ts"), "path")
    order = W.partitionBy("user").orderBy("at", "event")
    moved = rows.filter(~F.col("paused")).withColumn("_on", F.lag("path").over(order)).filter(F.col("_on").isNull() | (F.col("_on") != F.col("path")))
    following = F.lead("at").over(order)
    return moved.withColumn("_next", following).filter(F.col("_next").isNull() | (F.col("_next") - F.col("at") >= gap_us)).select("user", "ts", "path")


def _micros(df: DataFrame, gap: str) -> int:
    """A duration in microseconds."""
    start = F.lit("1970-01-01T00:00:00Z").cast("timestamp")
    return df.sparkSession.range(1).select(F.unix_micros(start + F.expr(f"INTERVAL {gap}"))).first()[0]


def live_related(views: DataFrame, related: DataFrame, gap: str = "400 milliseconds", late: str = "1 minute") -> DataFrame:
    """(user, ts, path, rank, related): related notes of the note a user settled on; related (path, rank, related) is the static side."""
    return settled_views(views, gap, late).join(related, "path").select("user", "ts", "path", "rank", "related")
