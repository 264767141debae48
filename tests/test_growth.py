"""Steps that grew faster than their input, and rows that they lost."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from notelake.llm import lm_scoring as scoring
from notelake.llm.lm_scoring import _opener, seat
from notelake.operators.aggregates import folder_stats
from notelake.functions.embed import hashed_words
from notelake.operators.blocks import all_pairs, beside, best, block_pairs, cosines, in_blocks, nearest, past
from notelake.operators.joins import similar_pairs
from notelake.operators.tags import _Patterns, rank_tags, scored_tags, semantic_tags, tag_score_sums
from notelake.operators.extract import headings
from notelake.operators.ranking import top_k
from notelake.plans import base, search
from notelake.plans.index_build import build_index
from notelake.plans.search import _closest, related_notes
from notelake.sources.notes import FOLDER_FILES, scan_notes, write_notes


def test_folders_join_on_sums_not_on_texts(spark):
    notes = spark.createDataFrame([("a/x/1.md", "12345"), ("a/2.md", None), ("b/3.md", "123"), ("4.md", "1")], "path string, content string")
    got = folder_stats(notes, spark.createDataFrame([("a",), ("a/x",), ("",), ("none",)], "folder string"))
    assert sorted(map(tuple, got.collect())) == [("", 4, 9, False), ("a", 2, 5, False), ("a/x", 1, 5, False), ("none", 0, 0, False)]


def test_patterns_are_the_substrings_of_a_text():
    patterns = ["a", "ab", "b/", "aé", "😀b", "", "abc", "zz", "b/😀b"]
    look = _Patterns(pa.array(patterns))
    for text in ("", "ab/😀b", "xaéz", "zzzz", "abc" * 5):
        assert sorted(look(text).tolist()) == [i for i, p in enumerate(patterns) if p and p in text]


def test_nearest_keeps_ties_by_place():
    rng = np.random.default_rng(3)
    held, asked = (pa.array(rng.integers(0, 4, (n, 8)).astype(float).tolist()) for n in (300, 40))
    scores = cosines(asked, held)
    rows, places, near = nearest(held, 10, 64)(asked)
    want = best(scores, np.arange(300), 10, np.ones(scores.shape, bool))
    assert (rows == want[0]).all() and (places == want[1]).all() and (near == scores[want]).all()


def test_tags_past_an_exchange_meet_each_note_once(spark, monkeypatch):
    notes = spark.createDataFrame([(f"n{i}", f"w{i % 7} and long words of {'a b ' * i} en/w{i % 5}") for i in range(40)] + [("none", None)], "path string, content string")
    tags = spark.createDataFrame([(f"{a}/w{i}_{b}", i) for i in range(9) for a, b in (("en", ""), ("de", "long"), ("x", "words_of_long_words_and_more"))] + [("en/words", 3)], "tag string, ord long")
    each = sorted(map(str, scored_tags(notes, tags).collect()))
    sums = {r.path: r.score for r in tag_score_sums(notes, tags).collect()}
    monkeypatch.setattr("notelake.operators.tags.TAG_BYTES", 0)
    assert sorted(map(str, scored_tags(notes, tags).collect())) == each
    assert {r.path: r.score for r in tag_score_sums(notes, tags).collect()} == sums
    want = {r.path: r.s for r in scored_tags(notes, tags).groupBy("path").agg({"score": "sum"}).withColumnRenamed("sum(score)", "s").collect()}
    assert {p: s for p, s in sums.items() if s} == want and sums["none"] == 0


def test_openers_by_their_exact_chance():
    stay, new = 70.3, 9.7
    sits = np.cumprod([(stay + i) / (stay + i + new) for i in range(60)])
    chance = np.concatenate([np.random.default_rng(1).random(3000), [1e-12, 1 - 1e-12]])
    got = _opener(np.full(len(chance), stay), np.full(len(chance), new), chance, np.full(len(chance), 60))
    assert got.tolist() == [int(np.argmax(sits <= u)) + 1 if (sits <= u).any() else 61 for u in chance]


def test_customers_are_seated_one_by_one():
    n = 4000
    args = np.full(n, 1500), np.full(n, 300.0), np.full(n, 0.05), 0.8, 2.0
    fast, slow = seat(*args, np.arange(n, dtype=np.uint64)), seat(*args, np.arange(n, dtype=np.uint64) + np.uint64(77777), alone=1500)
    # Blocks were too even: their numbers of tables varied less than those of single customers.
    assert abs(fast.mean() - slow.mean()) < 0.5 and abs(fast.std() / slow.std() - 1) < 0.06


def test_block_pairs_take_tasks_by_the_right_side(spark):
    left, right = spark.range(60), spark.range(100, 103)
    pairs = block_pairs(left, right, 1)
    assert pairs.rdd.getNumPartitions() <= 12
    got = sorted((x.id, y.id) for p in pairs.collect() for x in p.l for y in p.r)
    assert got == [(i, j) for i in range(60) for j in range(100, 103)]


def test_notes_are_written_by_their_tasks(spark, tmp_path):
    rows = [(i % 1500, f"text {i}\n") for i in range(2300)] + [(None, "no name"), (-7, "one"), (-7, "é")]
    notes = spark.createDataFrame(rows, "id long, content string").coalesce(1)
    for _ in range(2):  # a task that runs again leaves the same files
        assert write_notes(notes, str(tmp_path / "vault"), "id") == len(rows)
    read = scan_notes(spark, str(tmp_path / "vault"))
    assert sorted((r.basename.rsplit("-", 1)[0], r.content, r.size) for r in read.collect()) == sorted(("" if i is None else str(i), t, len(t.encode())) for i, t in rows)
    folders = [d for d in (tmp_path / "vault" / "0").iterdir()]
    assert len(folders) == 3 and all(len(list(d.iterdir())) <= FOLDER_FILES for d in folders)


def test_block_pairs_stream_shares_of_the_left_past_a_block(spark, monkeypatch):
    monkeypatch.setattr("notelake.operators.blocks.STREAM_BYTES", 100)
    pairs = block_pairs(spark.range(60), spark.range(100, 103), 1)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    # The left isn't sorted or held; a task has no more of it than its share.
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    got = sorted((x.id, y.id) for p in pairs.collect() for x in p.l for y in p.r)
    assert got == [(i, j) for i in range(60) for j in range(100, 103)]


def test_blocks_are_scored_in_strips(spark):
    def run(l, r):
        i, j = np.indices((len(l), len(r))).reshape(2, -1)
        return pa.RecordBatch.from_arrays([l.field("id").take(pa.array(i)), r.field("id").take(pa.array(j)), pa.array(np.full(len(i), len(l)))], names=["l", "r", "n"])

    got = in_blocks(spark.range(50), spark.range(7), run, "l long, r long, n long", strip=8).collect()
    assert sorted((x.l, x.r) for x in got) == [(i, j) for i in range(50) for j in range(7)]
    assert max(x.n for x in got) == 8


def test_related_notes_give_out_k_a_block(spark, monkeypatch):
    """Notes with the same vectors tie by path; a task gives out k rows for each note that it holds, and blocks and shares change nothing."""
    rng = np.random.default_rng(5)
    shapes = rng.integers(-3, 4, (12, 4)).tolist()
    rows = [(i, f"n{i * 7 % 40:02d}" if i < 118 else None, "summary" if i < 40 else "content", 0 if i < 40 else i, i, shapes[i % 12]) for i in range(120)]
    entries = spark.createDataFrame(rows, "entry_id long, path string, entry_type string, chunk_start int, chunk_end int, embedding array<tinyint>")
    for least, k in ((0.25, 3), (-1.0, 50)):
        met = similar_pairs(*(df.select(F.col("entry_id").alias("id"), F.col("embedding").alias("vec")) for df in (entries.filter("entry_id < 40"), entries)), least)
        names = entries.select("entry_id", "path")
        met = met.join(names.toDF("l", "path"), "l").join(names.toDF("r", "related"), "r").filter("path <> related").groupBy("path", "related").agg(F.max("score").alias("score")).filter("score > 0")
        want = {}
        for r in sorted(met.collect(), key=lambda r: (r.path, -r.score, r.related)):
            want.setdefault(r.path, []).append((r.related, round(r.score, 9)))
        want = {p: x[:k] for p, x in want.items()}
        for most in (1 << 25, 200):
            monkeypatch.setattr("notelake.plans.search.BLOCK_BYTES", most)
            got = {}
            for r in related_notes(entries, least, k).orderBy("path", "rank").collect():
                got.setdefault(r.path, []).append((r.related, r.score))
            assert got == want
    held = pa.StructArray.from_arrays([pa.array([f"q{i}" for i in range(30)]), pa.array([shapes[i % 12] for i in range(30)], pa.list_(pa.int8()))], ["path", "vec"])
    stream = [pa.RecordBatch.from_arrays([pa.array([f"n{i:04d}" for i in range(at, at + 500)]), pa.array([shapes[i % 12] for i in range(500)], pa.list_(pa.int8()))], names=["path", "vec"]) for at in range(0, 2000, 500)]
    assert sum(b.num_rows for b in _closest(held, 0.25, 5, 100)(iter(stream))) <= 30 * 5


def test_past_sends_each_side_once_a_block_or_share(spark, monkeypatch):
    monkeypatch.setattr("notelake.operators.blocks.STREAM_BYTES", 400)

    def start(held):
        def run(batches):
            for batch in batches:
                yield all_pairs(held.field("id"), batch.column("id"), np.full((len(held), batch.num_rows), len(held)), ["l", "r", "n"])

        return run

    df = past(spark.range(70), spark.range(100, 140), {"id": F.col("l.id")}, start, "l long, r long, n long", 240)
    got = df.collect()
    assert sorted((x.l, x.r) for x in got) == [(i, j) for i in range(100, 140) for j in range(70)]
    assert max(x.n for x in got) < 40
    assert past(spark.range(0), spark.range(3), {"id": F.col("l.id")}, start, "l long, r long, n long").count() == past(spark.range(3), spark.range(0), {"id": F.col("l.id")}, start, "l long, r long, n long", 99).count() == 0


def test_notes_are_read_once_and_texts_embedded_once(spark):
    """The build shuffles texts once, to embed each distinct one once; headings stand where they stood."""
    texts = ["---\nsummary: s\ntags: [a/b_c, x]\n---\n# One\n```\n# no\n```\n####### seven\n## Two \r\nSome ==mark== text. #y/z\n#\tTab", "", None, "no heading", "#x\n# A\n### C\n## B"]
    notes = spark.createDataFrame([(f"n{i}.md", f"n{i % 2}", i, t) for i, t in enumerate(texts * 3)], "path string, basename string, mtime long, content string")
    made = [(r.level, r.text, r.offset) for r in headings(notes.filter("path in ('n0.md', 'n4.md')")).orderBy("path", "offset").collect()]
    at = [texts[0].index(x) for x in ("# One", "## Two", "#\tTab")]
    assert [x[::2] for x in made] == [(1, at[0]), (2, at[1]), (1, at[2]), (1, 3), (3, 7), (2, 13)]
    seen = spark.sparkContext.accumulator(0)

    def model(some):
        seen.add(len(some))
        return [[float(len(t))] for t in some]

    built = build_index(notes, None, "m", model)
    plan = built._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and plan.count("RepartitionByExpression") == 1
    rows = built.collect()
    assert seen.value == len({r.chunk_hash for r in rows}) < len(rows)
    assert len({r.entry_id for r in rows}) == len(rows)
    first = sorted((r.entry_type, r.chunk_start, r.tags_text, r.heading_path) for r in rows if r.path == "n0.md")
    assert first == [("content", 0, "a, b c, x, y, z", None), ("highlights", 0, None, None), ("summary", 0, "a, b c, x, y, z", None)]


def test_scoring_sends_groups_in_small_batches():
    rows = [(i % 2, i, 2, 0, bytes([i]) * (1 << 20)) for i in range(9)]
    got = scoring._table(rows)
    assert [tuple(r.values()) for r in got.to_pylist()] == rows
    assert max(b.nbytes for b in got.to_batches()) <= scoring.BATCH_BYTES + (1 << 20) + 1000
    assert scoring._table([]).num_rows == 0 and scoring._table([]).schema == got.schema
    places = np.array([40_000, 3, 3, 70, 65_535, 0, 9])
    assert scoring._sums(scoring._steps(places)).tolist() == places.tolist() and scoring._steps(places).itemsize == 2


def test_scoring_stores_each_stretch_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 5} w{i % 3} of w{i} and w{i % 7}") for i in range(60)], "doc_id long, text string").repartition(3)
    want = sorted(map(tuple, scoring.lm_scoring(docs).collect()))
    tables, written = [], scoring.written
    monkeypatch.setattr(scoring, "written", lambda df: tables.append(written(df)) or tables[-1])
    assert sorted(map(tuple, scoring.lm_scoring(docs, chunk=150, parts=4).collect())) == want
    kinds = {r.kind for t in tables if "kind" in t.columns for r in t.select("kind").distinct().collect()}
    assert kinds == {1, 2}  # neither the texts' words and tokens (0) nor what they ask (3)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def test_distinct_pairs():
    rng = np.random.default_rng(4)
    for x in (rng.integers(0, 50, 300), np.arange(9)[::-1], np.zeros(0, np.int64), np.array([7, 7])):
        assert scoring._distinct(x).tolist() == np.unique(x).tolist()


def test_tags_in_blocks_rank_and_sum_alike(spark, monkeypatch):
    """More tags than a block holds: notes meet each block, lists and sums are those of one block."""
    notes = spark.createDataFrame([(f"n{i}", f"w{i % 7} and long words of {'a b ' * i} en/w{i % 5}") for i in range(30)] + [("none", None), ("empty", "")], "path string, content string")
    tags = spark.createDataFrame([(f"{a}/w{i}_{b}", 3 * i + j) for i in range(40) for j, (a, b) in enumerate((("en", ""), ("de", "long"), ("é", "words_of_long_words_and_more")))] + [("en/words", -1)], "tag string, ord long")
    model = hashed_words(16)
    index = spark.createDataFrame([(t.tag, model([t.tag.replace("/", " ")])[0]) for t in tags.collect()], "tag string, embedding array<double>")
    runs = []
    for sent, block in ((16 << 20, 64 << 20), (0, 64 << 20), (0, 1000)):
        monkeypatch.setattr("notelake.operators.tags.TAG_BYTES", sent)
        monkeypatch.setattr("notelake.operators.tags.TAG_BLOCK", block)
        runs.append([sorted(map(str, df.collect())) for df in (rank_tags(notes, tags, 4), tag_score_sums(notes, tags), semantic_tags(notes, index, model, 4).drop("score"))])
    assert runs[0] == runs[1] == runs[2] and len(runs[0][0]) == 32 * 4
    look = lambda own: lambda batch: iter([pa.RecordBatch.from_arrays([pa.array([len(own)])], names=["n"])])
    sizes = {r.n for r in beside(notes, tags, {"path": F.col("l.path")}, look, "n long", 1000).collect()}
    assert max(sizes) < 121 / 2


def test_scanned_files_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """The same rows as Spark's reader, which holds all files' names in the driver, and those of files without bytes; at any depth of folders."""
    for at, text in {"a.md": "one", "x/b.md": "zwei é", "x/y/c d.md": "3\n", "x/y/z/e.MD": "no", "_h/f.md": "no", ".g.md": "no", "x/h.txt": "no", "x/k=1/i.md": "4"}.items():
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_text(text)
    rows = lambda df: sorted(map(str, df.collect()))
    for walked in (64, 2, 1):
        monkeypatch.setattr("notelake.sources.notes.WALKED", walked)
        got = rows(scan_notes(spark, str(tmp_path)))
        assert got == rows(scan_notes(spark, f"file://{tmp_path}/")) == rows(scan_notes(spark, f"{tmp_path}/", batch_bytes=1))
        assert [r.size for r in scan_notes(spark, str(tmp_path), with_text=False).orderBy("path").collect()] == [r.size for r in scan_notes(spark, str(tmp_path)).orderBy("path").collect()]
    assert len(got) == 4 and not scan_notes(spark, str(tmp_path)).inputFiles()
    monkeypatch.setattr("notelake.sources.notes._store", lambda *a: None)
    assert rows(scan_notes(spark, str(tmp_path))) == got
    monkeypatch.undo()
    (tmp_path / "x/empty.md").write_text("")
    assert [r.content for r in scan_notes(spark, str(tmp_path)).filter("size = 0").collect()] == [""]


def test_searches_give_out_the_best_of_a_share_not_of_each_block(spark, monkeypatch):
    """Rows that leave the tasks are queries times shares; ties go to the least id. Entries don't send whole texts to be made."""
    rng, k, out = np.random.default_rng(4), 5, []
    e, q = rng.integers(-3, 4, (20_000, 6)).astype(float), rng.integers(-3, 4, (9, 6)).astype(float)
    entries = spark.createDataFrame([(i, "content", v) for i, v in enumerate(e.tolist())], "entry_id long, entry_type string, embedding array<double>")
    queries = spark.createDataFrame([(i, "", v, None) for i, v in enumerate(q.tolist())], "query_id long, text string, v1 array<double>, v2 array<double>")
    monkeypatch.setattr(search, "top_k", lambda found, *a: (out.append(found), top_k(found, *a))[1])
    got = sorted((r.query_id, r["rank"], r.entry_id) for r in search.search_vector(queries, entries, k).collect())
    s = cosines(pa.array(q.tolist()), pa.array(e.tolist()))
    rows, at = best(s, np.arange(len(e)), k, s > 0)
    assert got == [(i, n % k + 1, j) for n, (i, j) in enumerate(zip(rows.tolist(), at.tolist(), strict=True))]
    assert out[0].count() <= len(q) * k * spark.sparkContext.defaultParallelism
    add, best_of = search._kept({"a": None}, len(q), k, 64)
    for first in range(0, len(e), 1000):
        add("a", 0, s[:, first : first + 1000], s[:, first : first + 1000] > 0, np.arange(first, first + 1000))
    assert [x.tolist() for x in best_of("a")[:2]] == [rows.tolist(), at.tolist()]


def test_entries_are_made_of_the_beginnings_of_texts(spark):
    plan = base.entries(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not any("text#" in line for line in plan[plan.index("Join") :].splitlines() if line.lstrip(" +-:").startswith("Join")) and "substring(text" in plan[plan.index("Join") :]
