"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, and brute force on small fixtures."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from notelake.llm import html_extract, html_layouts
from notelake.llm.components import components
from notelake.llm.decontaminate import decontaminate, proximity_matches
from notelake.llm.html_blocks import blocks
from notelake.llm.license_scan import build_index, license_scan, scan_words, winnow
from notelake.llm.license_templates import TEMPLATES
from notelake.llm.line_dedup import line_dedup
from notelake.llm.lm_scoring import Options, lm_scoring, seat
from notelake.llm.ngram_join import PrefixTree, ngram_join, prefixes
from notelake.llm.packing import pack
from notelake.llm.quality import quality_rules
from notelake.llm.secrets import secret_scan
from notelake.llm.token_counts import token_counts
from notelake.llm.tokenization import encode_batches, encoder, safe_pieces

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, key string, id string, t string, w string, _t string"
LONG = " ".join(f"word{i % 977} of the {i}" for i in range(20_000))
TEXTS = [None, "", " \t\n ", "a", "One two three.\n\nOne two three.", "x" * 5000, LONG, LONG, "naïve Ünïcode 北京 text \U0001f600 end", "api_key: abcd1234efgh <|endoftext|> it's 12  34\r\n\x0b end"]


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "k", "i", "t", "w", "_t") for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(TEXTS)] + [(3, "a", "en", "s"), (None, "a null id here", None, None), (6, "same id, other text", "en", None)]
    return table(spark, rows).persist()


@pytest.fixture(scope="module")
def nothing(spark):
    return table(spark, [(1, "x", "en", "s")]).limit(0).persist()


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def hf():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_tokenizer_agrees():
    ours, theirs = encoder("byte_bpe_50k.json"), hf()
    for t in [x or "" for x in TEXTS[:6] + TEXTS[8:]] + ["  a  b ", "\n\n\nx", "'ll 's'S", "١٢٣ ²³ Ⅷ", "a<|endoftext|>b", "​ zero", "é́"]:
        assert list(ours(t)) == theirs.encode(t, add_special_tokens=False).ids


def test_safe_pieces_keep_ids():
    e = encoder("byte_bpe_50k.json")
    t = LONG[:30_000] + "  two  blanks \n new 'll don't"
    parts = list(safe_pieces(t, 1000))
    assert "".join(parts) == t and len(parts) > 20
    assert [i for p in parts for i in e(p)] == list(e(t))


def test_no_cut_inside_special_strings():
    """Each special string of the vocabulary at every offset around the place where a text is cut, against the file's own library."""
    e, theirs = encoder("byte_bpe_50k.json"), hf()
    assert e.markers and set(e.markers) == {t.content for t in theirs.get_added_tokens_decoder().values()}
    for marker in e.markers:
        for pad in ("word ", "a,b.", "x" * 7 + "|"):
            for offset in range(100 - 2 * len(marker), 101):
                t = (pad * 30)[:offset] + marker + "|" + marker + marker[:-1] + pad * 30
                ids = [i for _, lists in encode_batches(e, [t], piece_chars=100) for part in lists for i in part]
                assert ids == theirs.encode(t, add_special_tokens=False).ids
                assert "".join(safe_pieces(t, 100, e.markers)) == t


def test_token_counts(odd, nothing):
    theirs = hf()
    got = token_counts(odd, limit=10, batch_bytes=1000, piece_chars=5000).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()), len(theirs.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect())
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 10) for r in got)
    assert token_counts(nothing).count() == 0


def test_packing_round_trip(odd, nothing):
    theirs = hf()
    rows = pack(odd, max_tokens=512, max_segments=8).collect()
    want = Counter()
    for r in odd.collect():
        ids = np.array([*theirs.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want[(r.doc_id, len(ids))] += len(ids)
    got = Counter()
    for r in rows:
        got[(r.doc_id, r.doc_tokens)] += r.length
    assert got == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == [sum(p.length for p in pieces[:i]) for i in range(len(pieces))]
        assert sum(r.length for r in pieces) <= 512 and len(pieces) <= 8
    ids = np.array([*theirs.encode(TEXTS[9], add_special_tokens=False).ids, 1], "<u4")
    assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in rows if r.doc_id == 9)
    assert pack(nothing).count() == 0


def test_packing_limits(spark):
    df = spark.createDataFrame([(i, f"word number {i} and {i * 7}" * (1 + i % 9), 5 * (i % 3)) for i in range(300)], "doc_id long, text string, prompt int")
    rows = pack(df, loss_from_col="prompt", max_tokens=128, max_segments=4, max_loss=64).collect()
    tokens, loss, pieces = Counter(), Counter(), Counter()
    for r in rows:
        tokens[r.sequence_id] += r.length
        loss[r.sequence_id] += r.loss_tokens
        pieces[r.sequence_id] += 1
    assert max(tokens.values()) <= 128 and max(loss.values()) <= 64 and max(pieces.values()) <= 4
    by_doc = Counter()
    for r in rows:
        by_doc[r.doc_id] += r.length
    assert all(by_doc[r.doc_id] == r.doc_tokens for r in rows)


def test_secrets(odd, nothing, spark):
    rows = {(r.doc_id, r.n_assign): r for r in secret_scan(odd).collect()}
    start = TEXTS[9].index("api_key")
    assert rows[(9, 1)].base_sha256 == hashlib.sha256(f"assign:{start}:{start + 21}".encode()).hexdigest()
    assert rows[(0, 0)].spans == "" and rows[(0, 0)].base_sha256 == hashlib.sha256(b"").hexdigest()
    cases = ["é AKIA" + "Q7" * 8 + " x", "id 9fK3xQ81vLz0PbT7mWc4RyD2 end", "EXAMPLE9fK3xQ81vLz0PbT7mWc4RyD2", "aaaaaaaaaaaaaaaaaaaaaaaa1", "deadbeef" * 4]
    got = [r.spans for r in secret_scan(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["access:2:22", "entropy:3:27", "", "", "hex:0:32"]
    assert secret_scan(nothing).count() == 0


def test_quality(odd, nothing, spark):
    got = quality_rules(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        if r.doc_id == 7:
            w = words(LONG)
            seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
            cover = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
            assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(cover))
        assert not r.kept or not r.base_failed
    assert quality_rules(nothing).count() == 0
    rng = np.random.default_rng(1)
    clean = [(i, " ".join("abcdefghijkl"[: rng.integers(3, 9)] + str(rng.integers(0, 10**6)) for _ in range(rng.integers(30, 200))), "en", f"s{i % 2}") for i in range(300)]
    junk = [(1000 + i, " ".join(f"w{rng.integers(0, 10**6)}$$$" for _ in range(80)), "en", "s0") for i in range(20)]
    kept = {r.doc_id: r.kept for r in quality_rules(table(spark, clean + junk)).collect()}
    assert all(kept[i] for i, *_ in clean) and not any(kept[i] for i, *_ in junk)


def base_columns(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of a text, one after the other."""
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(grams)
    repeated = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), failed


def test_quality_base_columns(spark, odd):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for docs in (given, odd):
        got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules(docs).collect())
        assert got == Counter((r.doc_id, *base_columns(r.text)) for r in docs.select("doc_id", "text").collect())


def later_runs(texts, least_words):
    """{id: places of lines that are in a window of consecutive lines with words, of least_words words or more, that stands earlier} by trying all windows."""
    held = {}
    for i, t in sorted(texts):
        held[i] = [(k, line.strip(" ")) for k, line in enumerate((t or "").split("\n")) if words(line)]
    seen, gone = set(), {i: set() for i, _ in texts}
    for i, lines in held.items():
        for a in range(len(lines)):
            n = 0
            for b in range(a, len(lines)):
                n += len(words(lines[b][1]))
                if n >= least_words:
                    window = tuple(x for _, x in lines[a : b + 1])
                    if window in seen:
                        gone[i].update(k for k, _ in lines[a : b + 1])
                    else:
                        seen.add(window)
    return gone


def test_line_dedup_against_all_windows(spark):
    """Short texts over few lines of one to six words, so that runs overlap, repeat and share their begins and ends."""
    rng = np.random.default_rng(12)
    pool = [" ".join(f"w{i}" for _ in range(n)) for i, n in enumerate((1, 1, 2, 3, 4, 6))] + ["", "  ", " w0"]
    texts = [(i, "\n".join(pool[k] for k in rng.integers(0, len(pool), rng.integers(1, 25)))) for i in range(120)]
    want = later_runs(texts, 8)
    got = line_dedup(spark.createDataFrame(texts, "doc_id long, text string"), least_words=8).collect()
    for r in got:
        lines = dict(texts)[r.doc_id].split("\n")
        assert r.text == "\n".join(x for k, x in enumerate(lines) if k not in want[r.doc_id]) and r.n_deleted == len(want[r.doc_id])
    assert sum(map(len, want.values())) > 300


def test_line_dedup_repeats_inside_one_text(spark):
    """Texts that repeat themselves: equal lines, periods, a text read backwards; each costs about its length."""
    line = lambda i, n=50: " ".join(f"w{i}x{j}" for j in range(n))
    half = [line(i) for i in range(10, 310)]
    texts = ["\n".join([line(0)] * 1000), "\n".join([line(1)] * 100_000), "\n".join([line(2), line(3), line(4, 20)] * 2000), "\n".join(half + half[::-1]), "\n".join(["a b", "c"] * 30_000)]
    began = time.time()
    got = {r.doc_id: (r.n_lines, r.n_deleted, r.text) for r in line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert time.time() - began < 100
    assert got[0] == (1000, 999, line(0)) and got[1] == (100_000, 99_999, line(1))
    # The last period's short line is in no window of the first kind that is complete there, but ends one that stands earlier.
    assert got[2][:2] == (6000, 5997)
    assert got[3] == (600, 300, "\n".join(half))
    assert got[4][0] == 60_000 and got[4][1] > 59_900


def test_line_dedup(odd, nothing, spark):
    assert line_dedup(nothing).count() == 0
    got = line_dedup(odd).collect()
    assert len(got) == odd.count() and sum(r.text == "" and r.doc_id == 7 for r in got) == 1
    passage = "\n".join(" ".join(f"p{j}{i}" for i in range(20)) for j in range(3))
    rows = [(1, f"head one\n{passage}\ntail one"), (2, f"other\n\n{passage}\nmore"), (3, "\n".join(passage.split("\n")[:2]) + "\nshort"), (4, None), (5, f"{passage}\n{passage}")]
    out = {r.doc_id: (r.text, r.n_deleted) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1] == (rows[0][1], 0) and out[2] == ("other\n\nmore", 3)
    assert out[3][1] == 0 and out[4] == (None, 0) and out[5] == ("", 6)


def jaccard_components(texts):
    sets = {}
    for k, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {k: k for k in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return sets, label


def test_ngram_join(odd, nothing, spark):
    assert ngram_join(nothing).count() == 0
    assert ngram_join(odd).count() == odd.count()
    rng = np.random.default_rng(5)
    base = [[f"w{rng.integers(0, 5000)}" for _ in range(n)] for n in (40, 60, 200)]
    common = [f"c{i}" for i in range(12)]
    texts, k = {}, 0
    for b in base:
        for edits in (0, 0, 1, 1, 2, 3, 4, 6):
            w = list(b)
            for i in rng.integers(0, len(w), edits):
                w[i] = f"e{rng.integers(0, 10**6)}"
            texts[k] = " ".join(w)
            k += 1
    for _ in range(40):
        texts[k] = " ".join(common + [f"u{rng.integers(0, 10**6)}" for _ in range(rng.integers(3, 60))])
        k += 1
    texts |= {k: None, k + 1: "", k + 2: "a b", k + 3: "A  b", k + 4: "b a"}
    sets, label = jaccard_components(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {d: (len(sets[d]), label[d]) for d in texts}


def test_ngram_join_long_lists(spark, monkeypatch):
    from notelake.llm import ngram_join as module

    monkeypatch.setattr(module, "SHORT_LIST", 2)
    monkeypatch.setattr(module, "TREE_SETS", 16)
    rng = np.random.default_rng(8)
    base = [f"w{rng.integers(0, 9000)}" for _ in range(120)]
    texts = {}
    for k in range(60):
        w = list(base)
        for i in rng.integers(0, len(w), k % 8):
            w[i] = f"e{rng.integers(0, 10**6)}"
        texts[k] = " ".join(w)
    sets, label = jaccard_components(texts)
    got = {r.doc_id: r.component_id for r in ngram_join(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == label and len(set(label.values())) > 1


def test_prefix_tree_walk():
    rng = np.random.default_rng(2)
    make = lambda n: np.unique(rng.integers(0, 300, n))
    for _ in range(30):
        probe, members = make(150), [make(rng.integers(20, 300)) for _ in range(12)]
        members += [np.unique(np.concatenate([probe[: rng.integers(100, len(probe))], make(5)])) for _ in range(6)]
        want = {i for i, m in enumerate(members) if 100 * len(np.intersect1d(probe, m)) >= 75 * len(np.union1d(probe, m))}
        inside = np.zeros(300, bool)
        inside[probe] = True
        tree = PrefixTree(members, 75)
        assert set(tree.walk(probe, inside, lambda i: False, block=16)) == want
        assert set(tree.walk(probe, inside, lambda i: i % 2 == 0, block=16)) == {i for i in want if i % 2}


def test_prefixes_hold_common_grams():
    rng = np.random.default_rng(4)
    late = np.sort(rng.integers(0, 900, 60).astype(np.uint64))
    for _ in range(40):
        a = np.unique(rng.integers(0, 900, 120).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.12], rng.integers(0, 900, 9).astype(np.uint64)]))
        both, n = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if 100 * both < 75 * n:
            continue
        pa_, pb = (x[prefixes(x, np.array([0, len(x)]), np.isin(x, late), 75)] for x in (a, b))
        need, rest = -(-75 * (len(a) + len(b)) // 175), max(len(a) - len(pa_), len(b) - len(pb))
        assert len(np.intersect1d(pa_, pb)) >= max(need - rest, 1)


def test_components_of_long_chain(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5, 5)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def test_decontaminate(odd, nothing, spark):
    items = spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(14))), (2, "Tiny item"), (3, None), (2, "Tiny item"), (4, "...")], "item_id long, text string")
    assert decontaminate(nothing, items).count() == 0 and decontaminate(odd, items.limit(0)).filter("contaminated").count() == 0
    docs = spark.createDataFrame([(1, "x " + ", ".join(f"B{i}" for i in range(2, 13)) + " y"), (2, "a TINY-item here tiny item"), (3, " ".join(f"b{i}" for i in range(9))), (4, None), (4, "tiny item"), (5, "b3 b4 b5 z b6 b7 b8 b9 b10 b11 b12")], "doc_id long, text string")
    got = {(r.doc_id, r.n_words): (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate(docs, items).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {(1, 13): (11, 1, digest("1"), True), (2, 6): (4, 1, digest("2"), True), (3, 9): (0, 0, digest(""), False), (4, 0): (0, 0, digest(""), False), (4, 2): (2, 1, digest("2"), True), (5, 11): (0, 0, digest(""), False)}
    near = {(r.doc_id, r.item_id) for r in proximity_matches(docs, items, 2).collect()}
    assert (5, "1") in near and (2, "2") in near


def test_lm(odd, nothing):
    assert lm_scoring(nothing).count() == 0
    rows = lm_scoring(odd).collect()
    assert len(rows) == odd.count()
    train = Counter()
    for r in odd.collect():
        if zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 != 1:
            train.update([*(w.encode().lower() for w in words(r.text)), b""])
    n, v = sum(train.values()), len(train)
    texts = {(r.doc_id, len(words(r.text)) + 1): [*(w.encode().lower() for w in words(r.text)), b""] for r in odd.collect()}
    for r in rows:
        w = texts[(r.doc_id, r.n_tokens)]
        assert (r.train_tokens, r.n_known) == (n, sum(train[x] > 0 for x in w))
        assert math.isclose(r.base_score, sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-6)
        assert r.score < 0 and math.isfinite(r.score)


def one_by_one(train, probes, o, sweeps=40, burn_in=10):
    """Mean predictive probabilities of probes' tokens by a sampler that takes customers out and seats them again one at a time."""
    import random

    rnd, vocabulary = random.Random(5), {w for t in train for w in [*t, "<end>"]}
    tables = {}  # (restaurant, dish): customers of each table; restaurant None is the parent
    totals = Counter()  # customers and tables of restaurants

    def prob(u, w):
        own = tables.get((u, w), [])
        d, s = (o.parent_discount, o.parent_strength) if u is None else (o.discount, o.strength)
        back = 1 / (len(vocabulary) + 1) if u is None else prob(None, w)
        return (sum(own) - d * len(own) + (s + d * totals[u, "t"]) * back) / (s + totals[u, "c"])

    def sit(u, w):
        own = tables.setdefault((u, w), [])
        d, s = (o.parent_discount, o.parent_strength) if u is None else (o.discount, o.strength)
        back = 1 / (len(vocabulary) + 1) if u is None else prob(None, w)
        at = rnd.choices(range(len(own) + 1), [n - d for n in own] + [(s + d * totals[u, "t"]) * back])[0]
        totals[u, "c"] += 1
        if at == len(own):
            own.append(0)
            totals[u, "t"] += 1
            if u is not None:
                sit(None, w)
        own[at] += 1

    def leave(u, w):
        own = tables[u, w]
        at = rnd.choices(range(len(own)), own)[0]
        own[at] -= 1
        totals[u, "c"] -= 1
        if not own[at]:
            del own[at]
            totals[u, "t"] -= 1
            if u is not None:
                leave(None, w)

    pairs = [(u, w) for t in train for u, w in zip(["<start>", *t], [*t, "<end>"], strict=True)]
    asked = {(u, w) for t in probes for u, w in zip(["<start>", *t], [*t, "<end>"], strict=True)}
    mean = Counter()
    for u, w in pairs:
        sit(u, w)
    for sweep in range(sweeps):
        for u, w in pairs:
            leave(u, w)
            sit(u, w)
        if sweep >= burn_in:
            for u, w in asked:
                mean[u, w] += prob(u, w) / (sweeps - burn_in)
    return [sum(math.log10(mean[u, w]) for u, w in zip(["<start>", *t], [*t, "<end>"], strict=True)) for t in probes]


def test_lm_against_a_sequential_sampler(spark):
    rng = np.random.default_rng(6)
    step = lambda w: int(rng.choice([(3 * w + 1) % 12, (5 * w) % 12, rng.zipf(1.6) % 12]))
    texts = []
    for _ in range(150):
        w = [int(rng.integers(0, 12))]
        while len(w) < 9:
            w.append(step(w[-1]))
        texts.append([f"w{x}" for x in w])
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 != 1][:150], [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 == 1]
    probes = [*texts[:20], ["w1", "w3", "unseen"], ["w11"], [], ["w5", "w5", "w5"]]
    rows = [*zip(ids[0], map(" ".join, texts), strict=True), *zip(ids[1], map(" ".join, probes), strict=False)]
    got = {r.doc_id: r.score for r in lm_scoring(spark.createDataFrame(rows, "doc_id long, text string"), options=Options(sweeps=12, burn_in=2)).filter("held_out").collect()}
    want = one_by_one(texts, probes, Options())
    off = [abs(got[i] - score) / (len(t) + 1) for i, t, score in zip(ids[1], probes, want, strict=False)]
    assert max(off) < 0.1 and sum(off) / len(off) < 0.03


def test_lm_is_the_same_for_any_parts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = [sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm_scoring(docs, parts=parts, chunk=chunk).collect()) for parts, chunk in ((1, 12_000_000), (4, 100_000), (32, 50_000))]
    assert got[0] == got[1] == got[2] and len(got[0]) == docs.count()


def test_lm_word_history(spark):
    texts = ["red green blue end"] * 30 + ["blue red", "green end"] * 5 + ["le rouge"]
    rows = [(i, t, "fr" if "le" in t else "en") for i, t in enumerate(texts)]
    probes = [(100, "red green blue end", "en"), (101, "blue end green red", "en"), *((200 + i, f"red {w}", "en") for i, w in enumerate(["red", "green", "blue", "end", "le", "rouge", "unseen", "end red"]))]
    docs = spark.createDataFrame(rows + probes, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in lm_scoring(docs, folds=1, held_fold=0).collect()}
    assert all(r.held_out and r.train_tokens == 0 and math.isfinite(r.score) for r in got.values())
    trained = {r.doc_id: r.score for r in lm_scoring(docs, folds=1, held_fold=7).collect()}
    assert trained[100] > trained[101] + 1
    other = {r.doc_id: r.score for r in lm_scoring(docs.repartition(3), folds=1, held_fold=7, chunk=30).collect()}
    assert other.keys() == trained.keys() and all(math.isclose(other[k], trained[k], rel_tol=1e-5) for k in trained)


def test_lm_probabilities_of_texts(spark):
    train = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 != 1]
    held = [i for i in range(200, 600) if zlib.crc32(str(i).encode()) % 5 == 1]
    vocabulary = ["a", "b", "c", "d"]
    rows = [(i, " ".join(vocabulary[(i * k + k) % 4] for k in range(1, 6)), "xy"[i % 2]) for i in train]
    probes = ["b", "b zz", *(f"b {w}" for w in vocabulary), "zz", *vocabulary]
    docs = spark.createDataFrame(rows + [(i, t, "x") for i, t in zip(held, probes, strict=False)], "doc_id long, text string, lang string")
    score = {p: r.score for r in lm_scoring(docs).filter("held_out").collect() for i, p in zip(held, probes, strict=False) if i == r.doc_id}
    assert len(score) == len(set(probes)) and all(math.isfinite(x) for x in score.values())
    # Different whole texts: their probabilities sum to less than one.
    assert sum(10**x for x in score.values()) < 1.0 + 1e-6


def test_seats():
    c = np.array([0, 1, 2, 50, 5000])
    t = seat(c, np.full(5, 100.0), np.full(5, 0.01), 0.5, 1.0, np.arange(5, dtype=np.uint64))
    assert t[0] == 0 and t[1] == 1 and all(1 <= x <= n for x, n in zip(t[2:], c[2:], strict=True))
    many = seat(np.full(4000, 400), np.full(4000, 100.0), np.full(4000, 0.02), 0.5, 1.0, np.arange(4000, dtype=np.uint64))
    slow = seat(np.full(4000, 400), np.full(4000, 100.0), np.full(4000, 0.02), 0.5, 1.0, np.arange(4000, dtype=np.uint64) + np.uint64(9999), alone=1000)
    assert abs(many.mean() - slow.mean()) < 0.1


def test_licenses(odd, nothing, spark):
    assert license_scan(nothing).count() == 0 and license_scan(odd).count() == 0
    mit = TEMPLATES["mit"]
    changed = mit.replace("free of charge", "FREE of any charge").replace("Software without", "work without")
    rows = [(1, f"É first\n{mit}\nlast"), (2, f"x {changed} y"), (3, "Released under the MIT License, and all rights reserved"), (4, " ".join(mit.split()[:30]))]
    got = {(r.doc_id, r.template): r for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    exact = got[(1, "mit")]
    assert exact.coverage == 1.0 and rows[0][1][exact.start : exact.end] == mit.rstrip(".")
    assert 0.9 < got[(2, "mit")].coverage < 1.0
    assert {t for d, t in got if d == 3} == {"mit-notice", "all-rights-reserved"} and not any(d == 4 for d, _ in got)


def test_winnowing_guarantee():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**60, 80).astype(np.uint64)
    for start in range(70):
        part = a[start : start + 10]
        assert set(a[winnow(a, 4)]) & set(part[winnow(part, 4)])
    assert scan_words(np.zeros(0, np.uint64), build_index({}), 3, 4, 0.8) == []


def test_html_held_out_pages():
    model = html_extract.default_model()
    wrong = total = 0
    for page in html_layouts.labelled_pages(60, seed=77):
        b = blocks(page, html_layouts.MARK)
        wrong += sum(x.marked != bool(y) for x, y in zip(b, model.decode(b), strict=True))
        total += len(b)
    assert wrong <= 0.01 * total


def test_html_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>a &amp; b&nbsp;<br>c</p>" * 1), (4, "u", "<nav><a>x</a></nav><article><h1>T &eacute;</h1><p>One  two\nthree.</p><script>var x='</p>'</script></article><footer>f</footer>"), (4, "u", "<!-- <p>no</p> --><broken <p")]
    got = html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id == 4][0] == "T é\nOne two three." and [r.text for r in got if r.page_id in (1, 2)] == ["", ""]
