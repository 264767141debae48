"""Bucketed saves touch only their buckets; live notes on a stream in any order and over restarts equal the batch."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from notelake.functions.embed import hashed_words
from notelake.operators.ranking import upsert_latest
from notelake.plans.index_build import build_index
from notelake.sources.index import bucket_numbers, index_buckets, load_buckets, save_buckets, write_buckets
from notelake.streaming import changes, live

START = datetime(2024, 1, 1)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def bucket_of(name):
    return int(name.split("bucket=")[1].split("/")[0])


def notes_table(spark, rows):
    return spark.createDataFrame(rows, "path string, basename string, mtime long, content string")


def test_changes_rewrite_their_buckets_only(spark, tmp_path):
    index, embedder = str(tmp_path / "index"), hashed_words(4)
    first = [(f"a/{i}.md", str(i), 1, f"# Head {i}\nText number {i} of the notes.\n") for i in range(60)]
    write_buckets(build_index(notes_table(spark, first), None, "m", embedder), index, buckets=16, by=("model",))
    before, rows_before = files(index), load_buckets(spark, index).count()
    assert {bucket_of(f) for f in before} == set(range(16)) and index_buckets(spark, index) == 16
    later = [(p, b, 2, c + "More.\n") if b in ("3", "7") else (p, b, m, c) for p, b, m, c in first if b != "9"]
    what = spark.createDataFrame([("a/3.md", "index", START), ("a/7.md", "index", START), ("a/9.md", "drop", START), ("a/11.md", "index", START), ("new.txt", "drop", START)], "path string, action string, ts timestamp")
    what.write.parquet(str(tmp_path / "changes"))
    run = lambda state: changes.incremental_index(spark.readStream.schema(what.schema).parquet(str(tmp_path / "changes")), lambda: notes_table(spark, later), index, "m", embedder, str(tmp_path / state)).awaitTermination()
    run("state")
    after, touched = files(index), set(bucket_numbers(what, "path", 16))
    assert len(touched) < 16
    assert {f: t for f, t in before.items() if bucket_of(f) not in touched} == {f: t for f, t in after.items() if bucket_of(f) not in touched}
    assert not {f for f in before if bucket_of(f) in touched} & set(after)
    columns = ["path", "entry_type", "chunk_start", "chunk_end", "mtime", "chunk_hash", "embedding", "bucket"]
    got = sorted(map(str, load_buckets(spark, index).select(columns).collect()))
    want = build_index(notes_table(spark, later), None, "m", embedder).withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(16)).cast("int"))
    assert got == sorted(map(str, want.select(columns).collect())) and len(got) != rows_before - 100
    run("another state")  # the batch runs again, as after a failure
    assert sorted(map(str, load_buckets(spark, index).select(columns).collect())) == got


def test_emptied_bucket_and_history(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = spark.createDataFrame([(i, i * 10, i) for i in range(40)], "id long, state long, pos long")
    write_buckets(rows, path, "id", 8)
    assert sorted(map(tuple, load_buckets(spark, path).select("id", "state", "pos").collect())) == [(i, i * 10, i) for i in range(40)]
    gone = spark.createDataFrame([(3,)], "id long")
    bucket = bucket_numbers(gone, "id", 8)
    held = [r.id for r in load_buckets(spark, path).filter(F.col("bucket").isin(bucket)).collect()]
    save_buckets(rows.limit(0), path, bucket)
    assert sorted(r.id for r in load_buckets(spark, path).collect()) == [i for i in range(40) if i not in held]
    assert index_buckets(spark, path) == 8
    new = spark.createDataFrame([(3, 1, 5), (3, 2, 9)], "id long, state long, ts long")
    old = load_buckets(spark, path).filter(F.col("bucket").isin(bucket)).drop("bucket")
    save_buckets(upsert_latest(old, new, gone.limit(0)), path, bucket)
    assert [tuple(r) for r in load_buckets(spark, path).filter("id = 3").select("id", "state", "pos").collect()] == [(3, 2, -1)]
    save_buckets(rows.limit(0), path, [])


VIEW = "user long, ts timestamp, event long, path string, paused boolean"


def at(seconds):
    return START + timedelta(seconds=seconds)


def test_settled_views_by_hand(spark):
    rows = [
        (1, at(0), 1, "a", False), (1, at(0.1), 2, "b", False), (1, at(0.2), 3, "b", False),  # b's gap isn't begun anew
        (1, at(0.5), 4, "b", False), (1, at(3), 5, "c", True), (1, at(4), 6, "b", None), (1, at(5), 7, "a", False), (1, at(5), 8, "c", False),
        (2, at(0), 1, "a", False), (2, at(0.4), 2, "b", False), (2, at(0.7), 3, "a", False),
    ]
    got = sorted(map(tuple, live.settled_views(spark.createDataFrame(rows, VIEW)).collect()))
    assert got == [(1, at(0.1), "b"), (1, at(5), "c"), (2, at(0), "a"), (2, at(0.7), "a")]
    related = spark.createDataFrame([("b", 1, "x"), ("b", 2, "y")], "path string, rank int, related string")
    assert sorted(map(tuple, live.live_related(spark.createDataFrame(rows, VIEW), related).collect())) == [(1, at(0.1), "b", 1, "x"), (1, at(0.1), "b", 2, "y")]
    assert live.settled_views(spark.createDataFrame([], VIEW)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_live_stream_equals_batch_over_restarts(spark, tmp_path, seed):
    """Views come up to a minute late; the query is stopped and started again after each file."""
    rng = random.Random(seed)
    rows = [(u, at(rng.randrange(0, 3000) / 10), k, rng.choice("abc"), rng.random() < 0.2) for u in range(4) for k in range(60)]
    want = sorted(map(tuple, live.settled_views(spark.createDataFrame(rows, VIEW), "3 seconds").collect()))
    arrival = sorted(rows, key=lambda r: r[1] + timedelta(seconds=rng.randrange(0, 59)))
    parts = [arrival[i * 60 : (i + 1) * 60] for i in range(4)] + [[(-1, at(100_000), 0, "end", False)]]
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in parts:
            spark.createDataFrame(part, VIEW).coalesce(1).write.mode("append").parquet(str(tmp_path / "views"))
            stream = spark.readStream.schema(VIEW).parquet(str(tmp_path / "views"))
            out = live.settled_views(stream, "3 seconds", "2 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
            out.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).filter("user >= 0").collect())) == want and len(want) > 20
