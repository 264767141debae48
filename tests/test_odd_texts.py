"""Queries on notes against their SQL, over documents with texts that the given tables don't have."""

import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from notelake.plans import registry
from notelake.plans.fixtures import TABLES
from tests.test_oracles import DATA, plain

TEXTS = [
    "Plain text.", None, "", "  \n ", '"' * 90, "two  blanks   here", "a\tb\tc", "line\r\nline two\r\n", "a # b\x85c", "abc" + " " * 90 + "d", "word." + " " * 3000 + "end.",
    "x  " + "a" * 2500, "Words here\n\n" + "b" * 2500, "Intro\n# My head\ntext\n## Sub\n" + "more words " * 200, "w " * 30 + "\xa0" * 1500 + "z", "\n" * 1500 + "x", "q" * 3000,
]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    for t in TABLES:
        if t != "documents":
            os.symlink(f"{DATA}/{t}.parquet", f"{d}/{t}.parquet")
    n, kinds = len(TEXTS), pq.read_schema(f"{DATA}/documents.parquet")
    rows = pa.table({"doc_id": range(n), "text": TEXTS, "lang": ["en"] * n, "source": [f"src{i % 3}" for i in range(n)], "n_chars": [len(t or "") for t in TEXTS]})
    pq.write_table(rows.select(kinds.names).cast(kinds), f"{d}/documents.parquet")
    return d


@pytest.mark.parametrize("name", ["q1_build_index", "c3_heading_path", "c4_extract_tags", "c6_highlights"])
def test_query(spark, odd, name):
    df = registry.QUERIES[name](spark, odd)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{odd}/{t}.parquet'")
    cursor = con.execute(registry.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
