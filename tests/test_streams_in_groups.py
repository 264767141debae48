"""Keyed streams work off many keys at once, in any order of arrival and over restarts, with the rows of the batch."""

import random
from datetime import datetime, timedelta

import pytest

from notelake.streaming import changes, live

START = datetime(2024, 1, 1)


def drained(spark, tmp_path, rows, schema, run):
    """What run(stream) gives for files of 300 rows that are read one after the other by queries started anew, and the most rows of state."""
    parts, most = [rows[i : i + 300] for i in range(0, len(rows), 300)], 0
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in parts:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            out = run(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
            q = out.trigger(availableNow=True).start()
            q.awaitTermination()
            most = max([most, *(p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators)])
    finally:
        spark.conf.set(name, before)
    return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())), most


def arriving(rng, rows, at, end):
    """Rows up to a minute late, and a last one that lets the watermark pass them all."""
    return sorted(rows, key=lambda r: r[at] + timedelta(seconds=rng.randrange(0, 59))) + [end]


def test_routes_of_many_paths_are_few_groups_of_state(spark, tmp_path):
    rng, schema = random.Random(4), "path string, old_path string, type string, ts timestamp"
    times = rng.sample(range(6_000_000), 900)
    rows = [(f"{rng.randrange(200)}.md", f"old {rng.randrange(200)}.md", rng.choice(["create", "modify", "modify", "modify", "delete", "rename", "open"]), START + timedelta(microseconds=100 * t)) for t in times]
    want = sorted(map(tuple, changes.route_changes(spark.createDataFrame(rows, schema), 60_000).collect()))
    end = ("~end.md", None, "modify", START + timedelta(days=1))
    got, most = drained(spark, tmp_path, arriving(rng, rows, 3, end), schema, lambda s: changes.route_changes(s, 60_000, "2 minutes"))
    assert [r for r in got if r[0] != "~end.md"] == want and len(want) > 300
    assert most <= changes.GROUPS


@pytest.mark.parametrize("kind", ["long", "string"])
def test_settled_users_are_few_groups_of_state(spark, tmp_path, kind):
    rng, schema = random.Random(5), f"user {kind}, ts timestamp, event long, path string, paused boolean"
    name = int if kind == "long" else str
    rows = [(name(rng.randrange(250)), START + timedelta(milliseconds=rng.randrange(600_000)), k, rng.choice("abc"), rng.random() < 0.2) for k in range(900)]
    want = sorted(map(tuple, live.settled_views(spark.createDataFrame(rows, schema), "90 seconds").collect()))
    end = (name(-1), START + timedelta(days=1), 0, "end", False)
    got, most = drained(spark, tmp_path, arriving(rng, rows, 1, end), schema, lambda s: live.settled_views(s, "90 seconds", "2 minutes"))
    assert [r for r in got if r[0] != name(-1)] == want and len(want) > 300
    assert most <= changes.GROUPS
