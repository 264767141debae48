"""The registered queries: those with SQL against DuckDB, the pipeline's stages against brute force."""

from collections import Counter

import duckdb
import pyarrow as pa
import pytest

import corpus_pipeline
from notelake.llm import registry
from notelake.llm.common import table
from notelake.llm.tokenization import encoder
from notelake.plans.fixtures import TABLES
from tests.llm.test_small_cases import jaccard_components

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = con.execute(registry.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(str(r[names.index(c)]) for c in columns) for r in cursor.fetchall())


def test_pipeline(spark):
    docs, sizes = table(spark, DATA, "documents"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        docs = out.persist()
        sizes.append(docs.count())
    assert sizes[0] == sizes[1] >= sizes[2] >= sizes[3] > 0
    got = corpus_pipeline.run(spark, DATA)
    assert got.select("doc_id").distinct().count() == sizes[-1]


def rows_of(con, name):
    cursor = con.execute(registry.ORACLES[name])
    return [dict(zip([c[0] for c in cursor.description], r, strict=True)) for r in cursor.fetchall()]


def test_pipeline_against_brute_force(spark):
    docs = corpus_pipeline.quality(spark, table(spark, DATA, "documents"), DATA).toArrow()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{DATA}/benchmark.parquet'")
    con.register("documents", docs)
    texts = {r["doc_id"]: r["text"] for r in rows_of(con, "op3_line_dedup")}
    assert len(texts) == docs.num_rows
    sets, label = jaccard_components(texts)
    texts = {k: t for k, t in texts.items() if not sets[k] or label[k] == k}
    con.unregister("documents")
    con.register("documents", pa.table({"doc_id": list(texts), "text": list(texts.values())}))
    for r in rows_of(con, "op8_decontaminate"):
        if r["contaminated"]:
            del texts[r["doc_id"]]
    count = encoder("byte_bpe_50k.json")
    got = {r.doc_id: r.doc_tokens for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == {k: len(list(count(t or ""))) + 1 for k, t in texts.items()}


def test_pipeline_repeats_and_nulls(spark):
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words, "en", "s", 1), (1, words, "en", "s", 1), (2, words + " more", "en", "s", 1), (3, None, None, None, None), (3, None, None, None, None), (None, "some other words here", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    kept = corpus_pipeline.near_duplicates(spark, docs, DATA).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "3", "3", "None"]
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), DATA).count() == 0


def test_pipeline_stages_keep_columns(spark):
    text = lambda name, n: "\n".join(" ".join(f"{name}{i}x{j}" for j in range(12)) for i in range(n))
    passage = text("p", 5)
    rows = [(i, f"{text(chr(97 + i), 3)}\n{passage}", "en", "s", 1, f"k{i}", f"r{i}", i * 10, i * 100, f"l{i}", f"g{i}", f"t{i}") for i in range(4)]
    rows += [(9, None, None, None, None, "k9", "r9", 1, 2, "l9", "g9", "t9"), (None, text("z", 4), "en", None, None, "k", "r", 3, 4, "l", "g", "t")]
    schema = "doc_id long, text string, lang string, source string, n_chars int, key string, row string, n_lines int, n_deleted int, label string, _gone string, t string"
    docs = spark.createDataFrame(rows, schema)
    other = {r.doc_id: tuple(r)[5:] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.dtypes == docs.dtypes
        kept = out.collect()
        assert all(tuple(r)[5:] == other[r.doc_id] for r in kept)
        assert {r.doc_id for r in kept} == ({0, 1, 2, 3, None} if name == "quality" else {0, 1, 2, 3, 9, None})
        if name == "lines":
            assert {r.doc_id: passage in (r.text or "") for r in kept} == {0: True, 1: False, 2: False, 3: False, 9: False, None: False} and all(r.n_chars == len(r.text or "") for r in kept)
        assert stage(spark, docs.limit(0), DATA).count() == 0
    assert {r.doc_id for r in corpus_pipeline.packed(spark, docs, DATA).collect()} == {0, 1, 2, 3, 9, None}


def test_pipeline_unlinked_documents_stay(spark):
    alone = [" ".join(f"{name}{i}" for i in range(30)) for name in "abcd"]
    rows = [(None, alone[0]), (None, alone[1]), (7, alone[2]), (7, alone[3]), (8, alone[3] + " more"), (None, alone[0] + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, DATA).collect())
    # A null id is smaller than others; of two null ids, the smaller key stays.
    assert Counter(i for i, _ in kept.elements()) == Counter({None: 2, 7: 2})
    assert {(None, alone[1]), (7, alone[2]), (7, alone[3])} <= set(kept) and len({(None, alone[0]), (None, alone[0] + " more")} & set(kept)) == 1
