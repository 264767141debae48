"""Secret scans against Python's regular expressions: sizes at their bounds, thousands of matches, kinds that overlap, a whole table."""

import hashlib
import random
import re

from notelake.llm.common import table
from notelake.llm.secrets import secret_scan

KINDS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
]


def brute(text):
    found, counts = [], []
    for order, (kind, pattern, group, least) in enumerate(KINDS):
        hits = [(m.start(), order, m.end(), kind) for m in pattern.finditer(text or "") if len(m[group]) >= least]
        counts.append(len(hits))
        found += hits
    return (*counts, hashlib.sha256(",".join(f"{k}:{a}:{e}" for a, _, e, k in sorted(found)).encode()).hexdigest())


def same(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in secret_scan(docs).collect()}
    assert {i: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for i, r in rows.items()} == {i: brute(t) for i, t in enumerate(texts)}
    return rows


def test_sizes_at_their_bounds(spark):
    texts = ["password=abc", "token: x", "token=1234567", "token=12345678", "AKIA1", "AKIA" + "1" * 11, "AKIA" + "1" * 12, "a" * 31, "a" * 32, "", None, "😀 secret='" + "x" * 9 + "' 😀"]
    rows = same(spark, texts)
    assert [rows[i].n_assign + rows[i].n_access + rows[i].n_hex for i in range(len(texts))] == [0, 0, 0, 1, 0, 0, 1, 0, 1, 0, 0, 1]


def test_thousands_of_matches(spark):
    rows = same(spark, ["token=abcdefgh1 " * 5000, "token=abc " * 3000 + "token=abcdefghi", ("AKIA" + "Q7" * 8 + " ") * 1025])
    assert [rows[i].n_assign for i in range(3)] == [5000, 1, 0] and rows[2].n_access == 1025


def test_generated_texts(spark):
    rnd = random.Random(3)
    parts = ["password", "TOKEN", "api_key", "ApiKey", "=", ":", " ", "'", '"', "AKIA", "abc123", "0123456789abcdef", "XYZ", "é", "😀", "\n", "."]
    same(spark, ["".join(rnd.choice(parts) for _ in range(rnd.randrange(60))) for _ in range(400)])


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secret_scan(docs).collect()} == want


def test_entropy_spans_are_added(spark):
    key = "q7Rk2Lp9Zx4Vb8Nm3Ty6Wd1Hs5"
    cases = [f"use {key} now", f"sample_{key}", f"x/{key}/y==", f"secret={key} {key}", "EXAMPLE" + key[:14] + "123", "thisisalongidentifierwithoutdigits", "aaaaaaaaaaaaaaaaaaaaaaaa1"]
    rows = same(spark, cases)
    assert rows[0].spans == f"entropy:4:{4 + len(key)}" and rows[3].spans == f"assign:0:33,entropy:34:{34 + len(key)}"
    assert [rows[i].n_entropy for i in range(7)] == [1, 0, 1, 1, 0, 0, 0]


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "token=abcdefgh1", "a", "b", "c", "d")], "doc_id long, text string, t string, id string, p_entropy string, spans string")
    assert [(r.doc_id, r.spans) for r in secret_scan(docs).collect()] == [(1, "assign:0:15")]
