from datetime import datetime, timedelta

from pyspark.sql import functions as F

from notelake.functions.embed import hashed_words
from notelake.operators.joins import similar_pairs
from notelake.plans.fixtures import view
from notelake.plans.index_build import build_index
from notelake.plans.queries_rank import _drain, _stream
from notelake.streaming import changes

DATA = "/root/testdata/sf0.001"


def test_second_build_embeds_nothing(spark, tmp_path):
    seen = []
    notes = view(spark, DATA, "notes").limit(20).persist()
    first = build_index(notes, None, "m", hashed_words(8))
    first.write.parquet(str(tmp_path / "i"))
    old = spark.read.parquet(str(tmp_path / "i"))

    def never(texts):
        raise AssertionError(f"asked for {len(texts)} vectors")

    again = build_index(notes, old, "m", never)
    assert again.count() == old.count() and not seen
    touched = notes.withColumn("mtime", F.col("mtime") + 1)
    assert build_index(touched, old, "m", never).agg(F.count_if(F.aggregate("embedding", F.lit(0), lambda a, x: a + F.abs(x)) > 0)).first()[0] == old.filter("cardinality(embedding) > 0").count()


def test_similar_pairs_over_blocks(spark):
    rows = [(i, [float((i * 7 + j * 3) % 11 - 5) for j in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    got = {(r.l, r.r) for r in similar_pairs(df, df, 0.9, block=16).collect()}
    import numpy as np

    m = np.array([v for _, v in rows])
    n = np.sqrt((m * m).sum(axis=1))
    s = m @ m.T / (n[:, None] * n[None, :])
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(s >= 0.9), strict=True)}


def test_stream_equals_batch(spark):
    batch = changes.debounce(view(spark, DATA, "changes").withColumn("ts", F.col("ts").cast("timestamp")).filter("type = 'modify'"), "1 hour")
    stream = _drain(changes.debounce(_stream(spark, DATA, "changes", ["path", "ts", "type"]).filter("type = 'modify'"), "1 hour", "1 hour"))
    want, got = {tuple(r) for r in batch.collect()}, {tuple(r) for r in stream.collect()}
    # The last sessions of a stream stay open until the watermark passes them.
    last = max(r[1] for r in want)
    assert got <= want and all(r[1] > last - timedelta(days=1) for r in want - got)


def test_route_changes(spark):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    rows = [("a.md", None, "modify", at(0)), ("a.md", None, "modify", at(1)), ("b.md", None, "modify", at(0)), ("b.md", None, "delete", at(1)), ("d.md", "c.md", "rename", at(3)), ("x.txt", None, "create", at(3))]
    df = spark.createDataFrame(rows, "path string, old_path string, type string, ts timestamp")
    got = sorted((r.path, r.action, r.ts) for r in changes.route_changes(df).collect())
    assert got == [("a.md", "index", at(1)), ("b.md", "drop", at(1)), ("c.md", "drop", at(3)), ("d.md", "index", at(3))]
