"""Scores in blocks against one pair at a time."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from notelake.functions.embed import hashed_words
from notelake.functions.text import fold
from notelake.functions.vectors import cosine
from notelake.operators.blocks import best, cosines, near_block_pairs, weights
from notelake.operators.joins import FIELDS, score, similar_pairs, term_hits
from notelake.operators.tags import rank_tags, scored_tags, semantic_tags, tag_match_score, text_tokens


def test_best_keeps_ties_by_id():
    s = np.array([[1.0, 2.0, 2.0, 0.0, 2.0]])
    rows, columns = best(s, np.array([5, 9, 3, 1, 4]), 2, s > 0)
    assert rows.tolist() == [0, 0] and columns.tolist() == [2, 4]
    assert best(s, np.arange(5), 3, s > 9)[0].tolist() == []


def test_cosines_over_the_shorter_length():
    a, b = pa.array([[1, 0, 3], None, [], [0, 0]], pa.list_(pa.int8())), pa.array([[2, 0], [1, 0, 0]], pa.list_(pa.int8()))
    assert np.allclose(cosines(a, b), [[1, 1 / np.sqrt(10)], [0, 0], [0, 0], [0, 0]])


def test_score_equals_the_expression(spark):
    q = spark.createDataFrame([(1, [1, 2, -3], [0, 1]), (2, [0, 0, 0], None), (3, [5, 5], [])], "query_id long, v1 array<tinyint>, v2 array<tinyint>")
    e = spark.createDataFrame([(i, [i % 5 - 2, i % 3, 7 - i]) for i in range(9)], "entry_id long, embedding array<tinyint>")
    second = F.when(F.col("v2").isNull(), 0.0).otherwise(cosine(F.col("v2"), F.col("embedding")))
    want = e.crossJoin(q).select("query_id", "entry_id", F.round(F.greatest(cosine(F.col("v1"), F.col("embedding")), second), 12).alias("score"))
    assert sorted(map(tuple, score(q, e).withColumn("score", F.round("score", 12)).collect())) == sorted(map(tuple, want.collect()))


def test_tags_equal_the_expression(spark):
    notes = spark.createDataFrame([("a.md", "A jorge_luis_borges novel, Jorge Luis and Borges; arte/país"), ("b.md", "partly art"), ("c.md", ""), ("d.md", None)], "path string, content string")
    names = ["escritores/jorge_luis_borges", "art", "arte/pais", "x/novel", "luis borges", "zz", "a/", "de/el"]
    tags = spark.createDataFrame([(t, i) for i, t in enumerate(names)], "tag string, ord long")
    n = notes.select("path", fold(F.col("content")).alias("t"), text_tokens(F.col("content")).alias("tokens"))
    want = n.crossJoin(tags).select("path", "tag", tag_match_score(F.col("t"), F.col("tokens"), F.col("tag")).alias("score")).filter("score > 0")
    assert sorted((r.path, r.tag, r.score) for r in scored_tags(notes, tags).collect()) == sorted((r.path, r.tag, r.score) for r in want.collect())
    ranked = rank_tags(notes, tags, 3).filter("path = 'c.md'").orderBy("pos").collect()
    assert [r.tag for r in ranked] == ["a/", "escritores/jorge_luis_borges", "art"]


def test_semantic_tags(spark):
    model = hashed_words(64)
    tags = spark.createDataFrame([(t, model([t])[0]) for t in ("red wine", "old trains", "green tea")], "tag string, embedding array<double>")
    notes = spark.createDataFrame([("a.md", "green tea with red cups"), ("b.md", "trains old and new")], "path string, content string")
    first = {r.path: r.tag for r in semantic_tags(notes, tags, model, 2).filter("pos = 1").collect()}
    assert first == {"a.md": "green tea", "b.md": "old trains"}


def test_near_block_pairs_lose_nothing(spark):
    """Vectors in clusters: same pairs as all against all, with fewer than half of the block pairs looked at; odd vectors stay in."""
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] * 5 + rng.standard_normal(16)).tolist()) for i in range(960)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, rows[0][1][:8]), (1004, (-centres[0]).tolist())]
    df = spark.createDataFrame(rows + odd, "id long, vec array<double>")
    for least in (0.9, 0.5, 0.0, -0.5):
        pairs, looked, every = near_block_pairs(df, df, least, 32)
        held = pairs.select(F.size("l").alias("l"), F.size("r").alias("r")).collect()
        assert every >= 900 and len(held) <= looked
        if least == 0.9:
            assert looked < every / 2, (looked, every)
        got = {(r.l, r.r): r.score for r in similar_pairs(df, df, least, 32).collect()}
        column = pa.array([v for _, v in rows + odd], pa.list_(pa.float64()))
        s = cosines(column, column)
        ids = [i for i, _ in rows + odd]
        assert set(got) == {(ids[i], ids[j]) for i, j in zip(*np.nonzero(s >= least), strict=True)}
    assert similar_pairs(df.limit(0), df, 0.5).count() == similar_pairs(df, df.limit(0), 0.5).count() == 0


def test_term_hits_against_containment(spark):
    rows = [(1, "a/Über Alles.md", "sum ab", "tag, x", None, "Head > Tail"), (2, "ab", None, "", "ababab abc", "日本語の文 😀x"), (3, None, None, None, None, None)]
    entries = spark.createDataFrame(rows, "entry_id long, path string, summary_text string, tags_text string, highlights_text string, heading_path string")
    terms = ["ab", "b", "uber", "abab", "abc", "head > tail", "日本", "語の文", "😀x", "x", "not there", "", None, "ab", "tagx"]
    got = sorted((r.term, r.entry_id, r.field) for r in term_hits(entries, spark.createDataFrame([(t,) for t in terms], "term string")).collect())
    folded = {(i, f): v for i, *vs in rows for f, v in zip(FIELDS, [(v or "").lower().replace("ü", "u") for v in vs], strict=True)}
    assert got == sorted((t, i, f) for t in set(terms) if t for (i, f), v in folded.items() if t in v)
    assert term_hits(entries, spark.createDataFrame([("",)], "term string")).count() == 0


def test_weights_by_automaton():
    terms, fields = [["a", "ab", "a", "zz"], [], ["", "b c"]], [["ab", "x", "", "b c"], ["aab", "zz", "a", "\0"]]
    want = [[sum(p * (t in column[j]) for t in each for column, p in zip(fields, (5, 3), strict=True)) for j in range(4)] for each in terms]
    assert weights(terms, fields, [5, 3]).tolist() == want
    assert weights([[]], [["a"]], [1]).tolist() == [[0]] and weights([[""]], [["a", ""]], [2]).tolist() == [[2, 2]]


def test_tags_streamed_and_in_blocks_agree(spark, monkeypatch):
    """A few huge notes among small ones; tags as one set, or in blocks that are cut by bytes."""
    rows = [(f"n{i}", f"red apple number {i} pie_chart fold é {'blue sky ' * (i % 5)}") for i in range(40)] + [("huge", "word " * 4_000_000 + "blue sky"), ("none", None), ("empty", "")]
    notes = spark.createDataFrame(rows, "path string, content string").repartition(4)
    given = spark.createDataFrame([(t, i) for i, t in enumerate(["fruit/apple", "sky/blue_sky", "pie_chart", "Fold É", "zzz", "word"])], "tag string, ord int")
    streamed = sorted(map(str, scored_tags(notes, given, 3, fill=True).collect()))
    monkeypatch.setattr("notelake.operators.tags.TAG_BYTES", 0)
    monkeypatch.setattr("notelake.operators.blocks.BLOCK_BYTES", 1000)
    assert sorted(map(str, scored_tags(notes.filter("path <> 'huge'"), given, 3, fill=True).collect())) == [r for r in streamed if "huge" not in r]
    huge = [r for r in streamed if "huge" in r and "score=0" not in r]
    assert any("blue_sky" in r for r in huge) and any("'word'" in r for r in huge)
