"""Operators 11 to 13: against brute force, and on nulls, odd vectors and texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from notelake.llm import registry, resampling, word_crc
from notelake.llm.embedding_dedup import embedding_dedup, fit_cells
from notelake.llm.feast import above, interval, slices
from notelake.llm.resampling import gains, importance_resampling, ranked
from notelake.llm.whitening import whitening

DATA = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<float>, label int, n long, d int, block string, kept string, component_id string, x string"


def vector_table(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 2, "b", "k", "c", "x") for i, v, label in rows], VECTORS)


def near(rng, v, angle):
    """A vector at some angle to v."""
    v = v / np.linalg.norm(v)
    w = rng.standard_normal(len(v))
    w -= (w @ v) * v
    return np.cos(angle) * v + np.sin(angle) * w / np.linalg.norm(w)


def links(rows, least=0.93):
    """{id: (links, smallest id reached)} of rows (id, vector, label) with different ids, from all pairs."""
    ok = lambda v: v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok(v) and label is not None else None for _, v, label in rows]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                n[i], n[j] = n[i] + 1, n[j] + 1
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return {r[0]: (n[i], low[find(i)]) for i, r in enumerate(rows)}


@pytest.mark.parametrize("block_rows", [8, 1024])
def test_embedding_links_against_all_pairs(spark, block_rows):
    """Chains, groups of copies and of near copies, pairs on both sides of the bound and of cells' borders."""
    rng, rows = np.random.default_rng(3), []
    bound = math.acos(0.93)
    for label in (0, 1):
        for _ in range(12):
            v = rng.standard_normal(6)
            rows += [(v, label), (v, label), (2 * v, label), (near(rng, v, bound - 1e-3), label), (near(rng, v, bound + 1e-3), label)]
            for _ in range(4):
                v = near(rng, v, bound * 0.9)
                rows.append((v, label))
        rows += [(rng.standard_normal(6), label) for _ in range(30)]
    rows = [(i, [float(np.float32(c)) for c in v], label) for (v, label), i in zip(rows, rng.permutation(len(rows)).tolist(), strict=True)]
    got = {r.vec_id: r for r in embedding_dedup(vector_table(spark, rows), block_rows=block_rows, sample=50).collect()}
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == links(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_embedding_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(5, v, 1), (4, v, 1), (4, v, 1), (3, v, None), (2, None, 1), (1, [0.0, 0.0, 0.0], 1), (6, [1.0, None, 3.0], 1), (7, [NAN, 1.0, 1.0], 1), (8, [INF, 1.0, 1.0], 1), (9, [], 1), (10, [1.0, 2.0], 1), (11, [2.0, 4.0, 6.0], 1), (None, v, 1), (None, [-1.0, 0.0, 0.0], 2), (12, v, 2)]
    out = embedding_dedup(vector_table(spark, rows))
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    group = [(5, 4, 4, False), (4, 4, 4, True), (4, 4, 4, True), (11, 4, 4, False), (None, 4, 4, False)]
    alone = [(i, 0, i, True) for i in (3, 2, 1, 6, 7, 8, 9, 10, 12, None)]
    assert Counter(map(tuple, out.collect())) == Counter(group + alone)
    assert embedding_dedup(vector_table(spark, rows).limit(0)).count() == 0
    renamed = vector_table(spark, rows[:2]).withColumnRenamed("vec_id", "n_links_").drop("kept").withColumnRenamed("n_links_", "kept")
    assert embedding_dedup(renamed, id_col="kept").columns == ["kept", "n_links", "component_id", "kept_"]


def test_cells_are_nested():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((4, 8)) * 3
    vectors = np.concatenate([c + rng.standard_normal((50, 8)) * 0.1 for c in centres])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    levels = fit_cells(vectors, 3)
    assert [x.shape for x in levels] == [(1, 2, 8), (2, 2, 8), (4, 2, 8)]
    assert len(fit_cells(vectors[:1], 2)) == 2  # copies of one vector: empty cells


def test_embeddings_query(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in registry.QUERIES["op11_embedding_dedup"](spark, DATA).collect()}
    assert got == links(rows)


# Operator 12

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = WORDS.findall((text or "").translate(UPPER))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def resampled(docs, target, buckets=10_000, least_words=20, per_cent=25, seed=7):
    """[(id, n_features, weight, score, rank)] of docs (id, text), ids without nulls."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = [features(t) for _, t in docs]
    s, t = Counter(bucket(f) for _, x in own for f in x), Counter(bucket(f) for text in target for f in features(text)[1])
    total, wanted = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (wanted + buckets)))) for b in range(buckets)]
    rows = []
    for (i, _), (w, x) in zip(docs, own, strict=True):
        weight = sum(gain[bucket(f)] for f in x) // len(x) if x else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(w)])
    able = sorted((r for r in rows if r[5] >= least_words), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(able[: per_cent * len(able) // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in rows]


ODD = ["", "a", "Hello World! foo-bar é北京x Z", "x" * 200 + " y", "A b " * 50, "…— .", "end " + "q" * 64 + " " + "r" * 65, "İstanbul ÀÉ ß", "7x a\x00b\x7fc"]


@pytest.mark.parametrize("stretch", [1 << 20, 64, 7])
def test_crc_of_words_and_pairs(monkeypatch, stretch):
    monkeypatch.setattr(word_crc, "STRETCH", stretch)
    for kind in (pa.string(), pa.large_string()):
        found = [Counter() for _ in ODD]
        for start, end, singles, pairs, first in word_crc.stretches(pa.array(["cut off", *ODD], kind)[1:]):
            for i in range(start, end):
                a, b = int(first[i - start]), int(first[i - start + 1])
                found[i].update(singles[a:b].tolist())
                found[i].update(pairs[(0 if i == start else a) : max(b - 1, 0)].tolist())
        assert found == [Counter(zlib.crc32(f.encode()) for f in features(t)[1]) for t in ODD]


def test_gains_are_floored():
    source, target = np.array([0, 3, 5, 0]), np.array([2, 0, 1, 0])
    assert gains(source, target).tolist() == [math.floor(1000 * math.log((t + 1) * 12 / ((s + 1) * 7))) for s, t in zip(source, target, strict=True)]


def test_resampling_against_brute_force(spark, monkeypatch):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = Counter(resampled(docs, target))
    assert Counter(map(tuple, registry.QUERIES["op12_importance_resampling"](spark, DATA).collect())) == want
    assert sum(r[4] is not None for r in want) == 25 * sum(len(features(t)[0]) >= 20 for _, t in docs) // 100


def test_resampling_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(word_crc, "STRETCH", 100)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(50, None), (51, "same words " * 20), (52, "same words " * 20), (51, "same words " * 20)]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, "s", "r") for i, t in rows], "doc_id long, text string, n_words int, row int, rank int, score string, id string")
    target = spark.createDataFrame([("x", "same words here"), ("y", None)], "doc_id string, text string")
    got = importance_resampling(docs, target, buckets=50, per_cent=100)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == Counter(resampled(rows, ["same words here"], buckets=50, per_cent=100))
    assert importance_resampling(docs.limit(0), target).count() == 0
    none = importance_resampling(docs, target.limit(0), buckets=50).collect()
    assert Counter((r.doc_id, r.weight) for r in none) == Counter((i, w) for i, _, w, *_ in resampled(rows, [], buckets=50))
    unnamed = importance_resampling(docs.limit(1).withColumn("doc_id", docs["doc_id"] * None), target).collect()
    assert len(unnamed) == 1 and unnamed[0].doc_id is None


@pytest.mark.parametrize("range_rows", [1, 50, 1 << 20])
def test_ranks_by_regular_sampling(spark, monkeypatch, range_rows):
    """Few scores, many ties, one key for a third of all rows, sorted and reversed runs."""
    monkeypatch.setattr(resampling, "RANGE_ROWS", range_rows)
    rng = np.random.default_rng(5)
    rows = [(int(s), int(i), k) for k, (s, i) in enumerate(zip(rng.integers(0, 9, 400), rng.integers(0, 50, 400), strict=True))]
    rows += [(4, 7, k) for k in range(400, 600)] + [(k, k, k) for k in range(600, 700)] + [(-k, None, k) for k in range(700, 720)]
    df = spark.createDataFrame(rows, "score long, id long, row long").repartition(7)
    got = sorted((r["rank"], r.score, r.id, r.row) for r in ranked(df).collect())
    order = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))
    assert got == [(k, *r) for k, r in enumerate(order, 1)]
    assert ranked(df.limit(0)).count() == 0


# Operator 13


def whitened(rows, k=4):
    """{(row, component): (n, deviation, |whitened|, explained)} of rows without odd ones, from a dense eigendecomposition."""
    x = np.floor(256 * np.array([v for _, v in rows], np.float32).astype(float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    y = fit - sums / n
    cov = y.T @ y / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    w = (x - sums / n) @ vectors / np.sqrt(values)
    return {(i, c + 1): (n, int(((n * x[r] - sums) ** 2).sum()), abs(w[r, c]), values[c] / np.trace(cov)) for r, (i, _) in enumerate(rows) for c in range(k)}


def test_whitening_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    want, got = whitened(rows), registry.QUERIES["op13_whitening"](spark, DATA).collect()
    assert len(got) == len(want)
    for r in got:
        n, deviation, w, explained = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation) and abs(abs(r.whitened) - w) < 1e-9 and abs(r.explained - explained) < 1e-12 and r.identity_error < 1e-10


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(2)
    fine = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.standard_normal((30, 3)) * [4, 2, 1])]
    fine += [(40, fine[0][1]), (41, fine[0][1])]
    odd = [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [NAN, 1.0, 1.0]), (54, [1.0, -INF, 1.0]), (55, [1.0, 2.0]), (None, fine[1][1])]
    out = whitening(vector_table(spark, [(i, v, None) for i, v in fine + odd]))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got, want = out.collect(), whitened(fine, 3)
    assert len(got) == 3 * 33 and sum(r.vec_id is None for r in got) == 3
    for r in got:
        n, deviation, w, explained = want[1 if r.vec_id is None else r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation) and abs(abs(r.whitened) - w) < 1e-9 and abs(r.explained - explained) < 1e-12
    assert whitening(vector_table(spark, [(1, [1.0, 2.0], 1)] * 3)).count() == 0  # one distinct vector has no component
    assert whitening(vector_table(spark, [(1, [1.0, 2.0], 1)]).limit(0)).count() == 0
    line = whitening(vector_table(spark, [(i, [float(i), 2.0 * i], 1) for i in range(5)])).collect()
    assert {r.component for r in line} == {1} and all(abs(r.explained - 1) < 1e-12 for r in line)
    huge = whitening(vector_table(spark, [(i, [3e12 * i, 1.0], 1) for i in range(5)])).collect()
    assert {r.deviation for r in huge} == {None} or any(r.deviation is None for r in huge)


def test_inertia_counts():
    rng = np.random.default_rng(4)
    for d in (1, 2, 3, 7, 30):
        a = rng.standard_normal((d, d))
        for m in (a + a.T, a @ a.T, np.diag(np.arange(d) - 1.0), np.fliplr(np.eye(d))):
            values = np.linalg.eigvalsh(m)
            for shift in [*rng.standard_normal(5) * 3, 0.5]:
                assert above(m, float(shift)) == (values > shift).sum()


@pytest.mark.parametrize("values", [[9, 8, 7, 1, 1, 0.5], [5, 5, 5, 1, 1, 1], [3, 3 - 1e-9, 2, 2, 2, 0], [1, 0, 0, 0, 0, 0], [1e6, 1, 1e-3, 1e-6, 0, 0]])
def test_intervals_hold_what_was_counted(values):
    q, _ = np.linalg.qr(np.random.default_rng(6).standard_normal((6, 6)))
    m = q @ np.diag(values) @ q.T
    m = (m + m.T) / 2
    for wanted in (1, 2, 4, 6):
        found = slices(m, wanted, most=2)
        got = []
        for low, high, count in found:
            v, x = interval(m, low, high, count)
            assert len(v) == count and np.abs(m @ x - x * v).max() < 1e-12 * max(values)
            got += sorted(v.tolist(), reverse=True)
        positive = [x for x in values if x > 1e-12 * max(values)]
        assert len(got) >= min(wanted, len(positive))
        assert np.allclose(got, values[: len(got)], rtol=1e-9, atol=1e-12 * max(values))
