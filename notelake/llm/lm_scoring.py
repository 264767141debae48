"""Operator 6: texts scored by a hierarchical Pitman-Yor model of words given the word before, its seating sampled by Gibbs sweeps."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.common import table, written
from notelake.llm.shingles import WordHasher, mix

#: The word before the first of a text; 0 is the end of a text.
START = np.uint64(1)
#: Texts that a part's pairs come from, in bytes; only memory depends on it, no score does.
PART_BYTES = 12 << 20
#: Messages leave a task in batches of about so many bytes.
BATCH_BYTES = 2 << 20


@dataclass(frozen=True)
class Options:
    """Discount and strength of the context restaurants (one for each word before) and of their shared parent; sweeps after burn_in are averaged."""

    discount: float = 0.8
    strength: float = 2.0
    parent_discount: float = 0.6
    parent_strength: float = 10.0
    sweeps: int = 4
    burn_in: int = 1
    seed: int = 7


def _uniform(key: np.ndarray, step: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the key and step alone, so that a task that runs again draws the same."""
    bits = mix(key + np.uint64((step * 0x9E3779B97F4A7C15) & (2**64 - 1)))
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series less its constant, from 10 on; smaller x by the recurrence."""
    if len(x) and x.min() < 10:
        low = np.where(x < 10, x, 10.0)
        return np.where(x < 10, _log_gamma(low + 10) - sum(np.log(low + i) for i in range(10)), _log_gamma(np.maximum(x, 10.0)))
    return (x - 0.5) * np.log(x) - x + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def _opener(stay: np.ndarray, new: np.ndarray, chance: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which of the next customers, from 1 on, is the first to open a table, or most + 1.

    The i-th sits down with weight stay + i - 1 and opens a table with weight new. That m sit down has the chance G(stay + m) G(stay + new) /
    (G(stay) G(stay + m + new)), G the gamma function; the least m at which it isn't over the number drawn is the opener.
    """
    log, base = np.log(chance), _log_gamma(stay + new) - _log_gamma(stay)
    fell = lambda i, m: base[i] + _log_gamma(stay[i] + m) - _log_gamma(stay[i] + m + new[i]) <= log[i]
    with np.errstate(over="ignore"):
        about = np.minimum((stay + np.maximum(new - 1, 0) / 2) * np.expm1(-log / new), most + 1).astype(np.int64)
    every = np.arange(len(stay))
    low, high = np.maximum(about - 2, 0), np.minimum(about + 3, most + 1)
    low[(low > 0) & fell(every, low)] = 0
    missed = (high <= most) & ~fell(every, high)
    high[missed] = most[missed] + 1
    while len(every := np.flatnonzero(high - low > 1)):
        middle = (low[every] + high[every]) // 2
        done = fell(every, middle)
        high[every[done]], low[every[~done]] = middle[done], middle[~done]
    return high


def seat(customers: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, strength: float, key: np.ndarray, alone: int = 64) -> np.ndarray:
    """Tables that the customers of each dish take when all are seated again, given the tables of the other dishes.

    One by one, a customer sits at one of the dish's tables with weight n - discount * t or opens one with weight
    (strength + discount * all tables) * parent. The first customer opens a table. From customer `alone` on, the next
    customer who opens one is drawn by the exact chance that all before sit down, as nothing else changes in between.
    """
    t = (customers > 0).astype(np.float64)
    order = np.argsort(-customers, kind="stable")
    c = customers[order]
    rest, p, k, t = others[order], parent[order], key[order], t[order]

    def opens(m: int, n: float | np.ndarray) -> np.ndarray:
        new = (strength + discount * (rest[:m] + t[:m])) * p[:m]
        return new / (new + np.maximum(n - discount * t[:m], 1e-9))

    top = int(c[0]) if len(c) else 0
    n = 1
    while n < min(top, alone):
        m = int(np.searchsorted(-c, -n, side="left"))  # dishes with more than n customers
        t[:m] += _uniform(k[:m], n) < opens(m, n)
        n += 1
    at, step = np.arange(int(np.searchsorted(-c, -n, side="left"))), 0
    seated = np.full(len(at), n, np.int64)
    while len(at):
        new = (strength + discount * (rest[at] + t[at])) * p[at]
        most = (c[at] - seated[at]).astype(np.int64)
        sits = _opener(np.maximum(seated[at] - discount * t[at], 1e-9), new, _uniform(k[at], (1 << 32) + step), most)
        at, sits = at[sits <= most], sits[sits <= most]
        t[at] += 1
        seated[at] += sits
        at, step = at[seated[at] < c[at]], step + 1
    out = np.empty_like(t)
    out[order] = t
    return out.astype(np.int64)


def _keyed(docs: DataFrame, id_col: str, text_col: str, folds: int, held_fold: int) -> DataFrame:
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), (F.crc32(name) % folds == held_fold).alias("held"))


def _cuts(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive texts [start, end) of about limit bytes; a longer text is a part of its own."""
    sizes = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(sizes, sizes[start] + limit, side="right")) - 1)
        yield start, end
        start = end


def _tokens(texts: pa.Array, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens in order and the text of each; the hash 0 is the end that each text has once, as its last token."""
    parts, owners = [], []
    for start, end in _cuts(texts, 1 << 19):
        hashes, owner, *_ = hasher(texts.slice(start, end - start).to_pylist())
        n = end - start
        every = np.zeros(len(hashes) + n, np.uint64)
        every[np.arange(len(hashes)) + owner] = hashes
        parts.append(every)
        owners.append(np.repeat(np.arange(start, end, dtype=np.int32), np.bincount(owner, minlength=n) + 1))
    return np.concatenate(parts), np.concatenate(owners)


def _before(tokens: np.ndarray, owner: np.ndarray, first: int) -> np.ndarray:
    """The token before each one, `first` at the start of a text."""
    out = np.concatenate([[first], tokens[:-1]]).astype(tokens.dtype)
    out[np.flatnonzero(np.diff(owner)) + 1] = first
    return out


def _distinct(x: np.ndarray) -> np.ndarray:
    """np.unique(x) by a sort: NumPy's hash table takes twenty times as long on pairs that mostly differ."""
    x = np.sort(x)
    return x[np.flatnonzero(np.diff(x, prepend=x[:1] - 1))]


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((mix(hashes) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns, which may differ in length, as one compressed Arrow message; a name is a column's number and type."""
    batch = pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in columns], names=[f"{i}{x.dtype.str}" for i, x in enumerate(columns)])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(body: bytes | pa.Buffer) -> list[np.ndarray]:
    batch = pa.ipc.open_stream(body).read_next_batch()
    return [np.frombuffer(batch.column(i)[0].as_buffer(), name[1:]) for i, name in enumerate(batch.schema.names)]


def _planes(words: np.ndarray) -> np.ndarray:
    """Word hashes, mostly ascending, as the bytes of their differences, all first bytes first: the zeros compress."""
    return np.diff(words, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.ravel()


def _hashes(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def _steps(x: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 on, mostly ascending, as the differences of their narrow forms; those wrap around."""
    x = _narrow(x)
    return np.diff(x, prepend=x.dtype.type(0))


def _sums(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=steps.dtype)


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 on in the fewest bytes that hold them."""
    top = int(x.max()) if len(x) else 0
    return x.astype("|u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def _segments(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, start, end) of a sorted array's runs."""
    own, first = np.unique(part, return_index=True)
    yield from zip(own.tolist(), first.tolist(), [*first[1:].tolist(), len(part)], strict=True)


@dataclass
class Stretch:
    """A stretch of texts: its distinct words (sorted hashes), each token's number among them, and its distinct pairs.

    code is that of each pair, word before * (number of words + 1) + word, the start being the last number; pairs are in
    the order of the parts that they are dealt to. at says where words are in the order of their parts.
    """

    words: np.ndarray
    word: np.ndarray
    code: np.ndarray
    part: np.ndarray
    word_order: np.ndarray
    word_part: np.ndarray

    @classmethod
    def of(cls, words: np.ndarray, word: np.ndarray, owner: np.ndarray, parts: int) -> Stretch:
        v = len(words)
        code = _distinct(_before(word, owner, v) * (v + 1) + word)
        named = np.append(words, START)
        part = _part(mix(named[code // (v + 1)]) + named[code % (v + 1)], parts)
        order = np.argsort(part, kind="stable")
        word_part = _part(named, parts)
        word_order = np.argsort(word_part, kind="stable")
        return cls(words, word, code[order], part[order], word_order, word_part[word_order])


def _stretches(batches, chunk: int) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(name, rows, words, word, owner) of stretches of about `chunk` bytes of the rows (id, t, held)."""
    name, hasher = TaskContext.get().partitionId() << 32, WordHasher()
    for batch in batches:
        for start, end in _cuts(batch.column(1), chunk):
            part = batch.slice(start, end - start)
            hashes, owner = _tokens(part.column(1), hasher)
            words, word = np.unique(hashes, return_inverse=True)
            del hashes
            yield name, part, words, word.astype(np.int64, copy=False), owner
            name += 1


_MESSAGE = "part int, sender long, kind int, seq int, body binary"


def _message(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (part, sender, kind, seq, body)."""
    column = lambda i, t: pa.array([r[i] for r in rows], t)
    return pa.RecordBatch.from_arrays([column(0, pa.int32()), column(1, pa.int64()), column(2, pa.int32()), column(3, pa.int32()), column(4, pa.binary())], names=["part", "sender", "kind", "seq", "body"])


def _batches(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """The rows' messages in batches, as neither Python nor the JVM should hold all of a group at once."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[4])
        if size >= BATCH_BYTES:
            yield _message(held)
            held, size = [], 0
    if held:
        yield _message(held)


def _table(rows: Iterable[tuple]) -> pa.Table:
    return pa.Table.from_batches(list(_batches(rows)) or [_message([])])


def _pair_counts(rows: DataFrame, parts: int, chunk: int) -> DataFrame:
    """Messages to the pairs' parts: for each stretch its pairs there (places in a list of words) and their training counts."""

    def dealt(name: int, batch: pa.RecordBatch, words: np.ndarray, word: np.ndarray, owner: np.ndarray) -> Iterator[tuple]:
        s = Stretch.of(words, word, owner, parts)
        v, named = len(words), np.append(words, START)
        train = ~batch.column(2).to_numpy(zero_copy_only=False)[owner]
        seen, n = np.unique((_before(word, owner, v) * (v + 1) + word)[train], return_counts=True)
        count = np.zeros(len(s.code), np.int64)
        if len(seen):
            at = np.minimum(np.searchsorted(seen, s.code), len(seen) - 1)
            count = np.where(seen[at] == s.code, n[at], 0)
        for part, a, b in _segments(s.part):
            u, w = s.code[a:b] // (v + 1), s.code[a:b] % (v + 1)
            own, place = np.unique(np.concatenate([u, w]), return_inverse=True)
            yield part, name, 0, 0, _pack(_planes(named[own]), _steps(place[: b - a]), _narrow(place[b - a :]), _narrow(count[a:b]))

    def run(batches):
        for stretch in _stretches(batches, chunk):
            yield from _batches(dealt(*stretch))

    return rows.mapInArrow(run, _MESSAGE)


@dataclass
class Part:
    """The pairs of one part: words, distinct pairs (u and w are places in words) with training counts, and each stretch's pairs in its order."""

    words: np.ndarray
    u: np.ndarray
    w: np.ndarray
    n: np.ndarray
    asked: list[tuple[int, np.ndarray]]

    @classmethod
    def of(cls, messages: pa.Table) -> Part:
        senders = messages["sender"].to_pylist()
        order = sorted(range(len(senders)), key=senders.__getitem__)
        bodies = [_unpack(messages["body"][i].as_buffer()) for i in order]
        lists = [_hashes(b[0]) for b in bodies]
        starts = np.cumsum([0, *(len(x) for x in lists)])
        every = np.concatenate(lists)
        del lists
        words, place = np.unique(every, return_inverse=True)
        del every
        code, counts = [], []
        for a, (_, u, w, count) in zip(starts.tolist(), bodies, strict=False):
            here = place[a:]
            code.append(here[_sums(u)] * len(words) + here[w])
            counts.append(count)
        del bodies, place
        ends, code = np.cumsum([len(c) for c in code]), np.concatenate(code)
        pairs, back = np.unique(code, return_inverse=True)
        n = np.bincount(back, weights=np.concatenate(counts), minlength=len(pairs)).astype(np.int64)
        return cls(words, pairs // len(words), pairs % len(words), n, list(zip([senders[i] for i in order], np.split(back, ends[:-1]), strict=True)))

    def by_word(self, places: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.bincount(places, weights=values, minlength=len(self.words))

    def to_words(self, part: int, parts: int, size: float, *values: np.ndarray) -> list[tuple]:
        """Messages to the words' parts: words, the number of all words if known, and what is to be summed for them."""
        to = _part(self.words, parts)
        order = np.argsort(to, kind="stable")
        return [(p, part, 1, 0, _pack(_planes(self.words[order[a:b]]), np.array([size], "<f8"), *(_narrow(x[order[a:b]]) for x in values))) for p, a, b in _segments(to[order])]


def _words_of(messages: pa.Table) -> tuple[np.ndarray, list[np.ndarray], list[tuple[int, np.ndarray]], float]:
    """The distinct words of messages, the sums of their values, for each sender the places of its words, and the number of all words."""
    senders, bodies = messages["sender"].to_pylist(), [_unpack(b.as_buffer()) for b in messages["body"]]
    lists = [_hashes(b[0]) for b in bodies]
    words, place = np.unique(np.concatenate(lists), return_inverse=True)
    sums = [np.bincount(place, weights=np.concatenate([b[j] for b in bodies]), minlength=len(words)) for j in range(2, len(bodies[0]))]
    ends = np.cumsum([len(x) for x in lists])
    return words, sums, list(zip(senders, np.split(place, ends[:-1]), strict=True)), float(bodies[0][1][0])


def _expected(customers: np.ndarray, others: np.ndarray, p: float, discount: float, strength: float) -> np.ndarray:
    """Like seat(), the mean number of tables of dishes with so many customers (rising): each customer adds the chance that a table is opened, at the mean so far."""
    t = np.ones(len(customers))
    n, top = 1, int(customers[-1]) if len(customers) else 0
    while n < top:
        i = int(np.searchsorted(customers, n, side="right"))  # those with more than n customers
        step = 1 if n < 64 else np.minimum(customers[i:] - n, max(1, n // 32))
        new = (strength + discount * (others[i:] + t[i:])) * p
        t[i:] += step * new / (new + np.maximum(n + (step - 1) / 2 - discount * t[i:], 1e-9))
        n += 1 if n < 64 else max(1, n // 32)
    return t


def _totals(sizes: list[tuple[int, int]], o: Options) -> list[float]:
    """The number of tables of all the parent's dishes, before the first sweep and as each sweep leaves it in the mean; sizes: (customers, how many words have so many).

    Words with equally many customers are alike to the parent, so this list is all that it takes, whatever the parts. Its length grows with the root of
    the number of tokens at most.
    """
    customers, words = (np.array(x, float) for x in zip(*sorted(sizes), strict=True)) if sizes else (np.zeros(0), np.zeros(0))
    t, size = np.ones(len(customers)), float(words.sum())
    totals = [size]
    for _ in range(o.sweeps):
        t = _expected(customers, np.maximum(totals[-1] - t, 0.0), 1.0 / (size + 1), o.parent_discount, o.parent_strength)
        totals.append(float((t * words).sum()))
    return totals


def _sizes(customers: np.ndarray) -> list[tuple[int, int]]:
    n, words = np.unique(customers[customers > 0].astype(np.int64), return_counts=True)
    return list(zip(n.tolist(), words.tolist(), strict=True))


def _parent_sweeps(words: np.ndarray, customers: np.ndarray, o: Options, seed: int, totals: list[float]) -> Iterator[np.ndarray]:
    """Tables of the parent's dishes after each sweep, given the tables of all dishes before each; totals begins with the number of all words.

    What a dish draws depends on the word, its customers, the totals and the seed alone, not on the part that the word is dealt to.
    """
    t, n, size = (customers > 0).astype(np.float64), customers.astype(np.int64), totals[0]
    for sweep in range(1, o.sweeps + 1):
        t = seat(n, np.maximum(totals[sweep - 1] - t, 0.0), np.full(len(words), 1.0 / (size + 1)), o.parent_discount, o.parent_strength, mix(words + np.uint64(seed + sweep))).astype(np.float64)
        yield t


def _settled(df: DataFrame) -> DataFrame:
    """written(df), after which the files of its exchanges go at once, not when the driver happens to collect its garbage."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return written(df)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def _if_any(f: Callable[[tuple, pa.Table, pa.Table], pa.Table]) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """f, but no rows for a key that the left side lacks."""
    return lambda key, left, right: f(key, left, right) if left.num_rows else _table([])


def fit(counts: DataFrame, parts: int, o: Options) -> DataFrame:
    """Messages of kind 2 to stretches (part is the pairs' part; customers and summed tables of pairs, in the stretch's order) and of kind 1 to words' parts.

    First, parts of pairs tell parts of words how many pairs a word has as dish and as context: with one table a pair,
    those are the parent's customers and the restaurants' tables. What the words' parts answer is what the Gibbs sweeps of
    the contexts' restaurants go by. A pair with one customer has one table in every seating; only others are sampled.
    All sums are those of the whole corpus, so scores are the same for any number of parts.
    """
    seed = o.seed * 1_000_003

    def started(key: tuple, messages: pa.Table) -> pa.Table:
        p, part = Part.of(messages), key[0].as_py()
        one = (p.n > 0).astype(np.float64)
        return _table(p.to_words(part, parts, 0.0, p.by_word(p.u, one), p.by_word(p.w, one)))

    def counted(key: tuple, messages: pa.Table) -> pa.Table:
        _, (_, customers), *_ = _words_of(messages)
        n, words = zip(*found, strict=True) if (found := _sizes(customers)) else ((), ())
        return pa.table({"customers": pa.array(n, pa.int64()), "words": pa.array(words, pa.int64())})

    def answered(key: tuple, messages: pa.Table, known: pa.Table) -> pa.Table:
        words, (tables, customers), asked, _ = _words_of(messages)
        sizes = [(x["customers"], x["words"]) for x in known["sizes"][0].as_py()]
        totals, total = _totals(sizes, o), float(sum(n * m for n, m in sizes))
        *_, t = _parent_sweeps(words, customers, o, seed, totals)
        size = totals[0]
        p = (customers - o.parent_discount * t + (o.parent_strength + o.parent_discount * totals[-1]) / (size + 1)) / (o.parent_strength + total)
        return _table([(sender, key[0].as_py(), 1, 0, _pack(p[at].astype("<f4"), np.array([size], "<f8"), _narrow(tables[at]))) for sender, at in asked])

    def sampled(key: tuple, messages: pa.Table, answers: pa.Table) -> pa.Table:
        p, part = Part.of(messages), key[0].as_py()
        order = np.argsort(_part(p.words, parts), kind="stable")
        bodies = [_unpack(b) for _, b in sorted(zip(answers["sender"].to_pylist(), answers["body"].to_pylist(), strict=True))]
        parent, tables = np.empty(len(p.words)), np.empty(len(p.words))
        parent[order], tables[order] = (np.concatenate([b[j] for b in bodies]) for j in (0, 2))
        many = np.flatnonzero(p.n > 1)
        u, w, n = p.u[many], p.w[many], p.n[many]
        name = mix(mix(p.words[u]) + p.words[w])
        t, kept = np.ones(len(many), np.int64), np.zeros(len(many))
        for sweep in range(1, o.sweeps + 1):
            # The restaurant's other dishes have the tables that the exchange gave for the whole corpus: a context's pairs are in many parts.
            t = seat(n, tables[u] - 1.0, parent[w], o.discount, o.strength, mix(name + np.uint64(seed + 8191 * sweep)))
            if sweep > o.burn_in:
                kept += t
        one = (p.n > 0).astype(np.float64)
        every, last = one * (o.sweeps - o.burn_in), one
        every[many], last[many] = kept, t
        rows = [(part, sender, 2, 0, _pack(_narrow(p.n[at]), _narrow(every[at]))) for sender, at in p.asked]
        rows += p.to_words(part, parts, float(bodies[0][1][0]), p.by_word(p.w, p.n), p.by_word(p.u, p.n), p.by_word(p.u, every), p.by_word(p.w, last))
        return _table(rows)

    # The pairs' messages are needed before and after; one exchange serves both.
    dealt = counts.repartition(parts, "part")
    first = dealt.groupBy("part").applyInArrow(started, _MESSAGE)
    # How many words have how many customers, over all parts, goes to each of them; the exchange of the messages serves both.
    sizes = first.groupBy("part").applyInArrow(counted, "customers long, words long").groupBy("customers").agg(F.sum("words").alias("words"))
    sizes = sizes.agg(F.collect_list(F.struct("customers", "words")).alias("sizes")).select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "sizes")
    answers = first.groupBy("part").cogroup(sizes.groupBy("part")).applyInArrow(_if_any(answered), _MESSAGE)
    return _settled(dealt.groupBy("part").cogroup(answers.repartition(parts, "part").groupBy("part")).applyInArrow(_if_any(sampled), _MESSAGE))


def _owns(rows: DataFrame, chunk: int) -> DataFrame:
    """A message of kind 0 for each stretch: its rows' ids, folds and lengths, its words and tokens."""

    def run(batches):
        for name, batch, words, word, owner in _stretches(batches, chunk):
            about = pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], names=["id", "held"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, about.schema) as stream:
                stream.write_batch(about)
            # The tokens' numbers go like the words by first, second, third and fourth bytes.
            numbers = word.astype("<u4").view(np.uint8).reshape(-1, 4).T.ravel()
            yield _message([(-1, name, 0, 0, _pack(np.frombuffer(sink.getvalue(), "|u1"), _narrow(np.bincount(owner, minlength=batch.num_rows)), _planes(words), numbers))])

    return rows.mapInArrow(run, _MESSAGE)


def _asks(owns: DataFrame, parts: int) -> DataFrame:
    """Messages of kind 3 from the stretches' own: their words, asked of the words' parts."""

    def asked(sender: int, body: bytes) -> Iterator[tuple]:
        named = np.append(_hashes(_unpack(body)[2]), START)
        to = _part(named, parts)
        order = np.argsort(to, kind="stable")
        for p, a, b in _segments(to[order]):
            yield p, sender, 3, 0, _pack(_planes(named[order[a:b]]))

    def run(batches):
        for batch in batches:
            for sender, body in zip(batch.column(1).to_pylist(), batch.column(4), strict=True):
                yield from _batches(asked(sender, body.as_buffer()))

    return owns.mapInArrow(run, _MESSAGE)


def lm_scoring(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 1, options: Options | None = None, chunk: int = 8_000_000, parts: int | None = None) -> DataFrame:
    """One row a document: id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Tokens are words (A-Z as a-z) and an end for each text. Texts with crc32(id) mod folds other than held_fold train.
    The model has a restaurant for each word before (or a text's start), and all share one parent whose dishes are the
    training tokens and one for all unseen ones. Seatings start with a table a pair and are sampled by Gibbs sweeps, the
    contexts' given the parent's probabilities and then the parent's given the contexts' tables; all customers of a pair
    are seated again in a sweep. Tables are averaged over the sweeps after the burn-in; predictive probabilities are
    linear in them, so theirs are averaged too. score is the log10 probability of the text's tokens, perplexity 10 ** (-score / n_tokens);
    base_score is that of add-a-half counts.

    All pairs of all training texts count, without a cut-off. Stretches of about `chunk` bytes send their pairs,
    packed, to parts by a hash of both words, so a frequent word is spread over all parts, and words' parts get one sum
    from each of them; answers come back in the order asked. The texts are read twice, which must give the same rows in
    the same partitions (a table's scan, a checkpoint); a stretch whose answers don't fit raises an error. Words and pairs
    are told apart by 64-bit hashes. Stretches wait in an exchange while their words are asked for. A null text is empty (one token, the end), a null id counts as empty text, repeated
    rows count and are scored each, equal scores stay equal, a very long text is a stretch of its own, an empty table
    gives no row, other columns are left out, whatever their names.
    """
    o = options or Options()
    rows, kind = _keyed(docs, id_col, text_col, folds, held_fold), dict(docs.dtypes)[id_col]
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts, stretches = parts or max(1, -(-size // PART_BYTES)), max(1, -(-size // chunk))
    fitted = fit(_pair_counts(rows, parts, chunk), parts, o)

    def summed(key: tuple, messages: pa.Table) -> pa.Table:
        words, (count, after, tables, customers), *_ = _words_of(messages)
        values = _pack(count.astype("<i8"), after.astype("<i8"), (tables / (o.sweeps - o.burn_in)).astype("<f4"))
        each = pa.array([[{"customers": n, "words": m} for n, m in _sizes(customers)]], pa.list_(pa.struct([("customers", pa.int64()), ("words", pa.int64())])))
        columns = [pa.array([key[0].as_py()], pa.int32()), *(pa.array([_pack(x)], pa.binary()) for x in (_planes(words), _narrow(customers))), pa.array([values], pa.binary())]
        return pa.Table.from_arrays([*columns, pa.array([int(count.sum())]), each], names=["part", "planes", "customers", "body", "tokens", "sizes"])

    words = _settled(fitted.filter("kind = 1").groupBy("part").applyInArrow(summed, "part int, planes binary, customers binary, body binary, tokens long, sizes array<struct<customers:long,words:long>>"))
    n = float(words.agg(F.sum("tokens")).first()[0] or 0)
    sizes = [tuple(r) for r in words.select(F.explode("sizes").alias("s")).groupBy("s.customers").agg(F.sum("s.words")).collect()]
    seed, totals = o.seed * 1_000_003 + 1_000, _totals(sizes, o)
    size, customers, tables = totals[0], float(sum(c * m for c, m in sizes)), float(np.mean(totals[1 + o.burn_in :]))
    scale, unseen = 1.0 / (o.parent_strength + customers), (o.parent_strength + o.parent_discount * tables) / (size + 1)
    floor = math.log10(n + 0.5 * (size + 1))

    def of_words(batches) -> Iterator[pa.RecordBatch]:
        """The words' parts as messages of kind 4: words, count, after, rooms, and the parent's customers less the discount of the tables, averaged over its sweeps."""
        for batch in batches:
            for part, planes, held, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names, (own,) = _hashes(_unpack(planes)[0]), _unpack(held)
                kept = [t for i, t in enumerate(_parent_sweeps(names, own, o, seed, totals)) if i >= o.burn_in]
                yield _message([(part, 0, 4, 0, _pack(names.astype("<u8"), *_unpack(body), (own - o.parent_discount * np.mean(kept, axis=0)).astype("<f8")))])

    def looked_up(key: tuple, messages: pa.Table) -> pa.Table:
        kinds, senders, bodies = (messages[c].to_pylist() for c in ("kind", "sender", "body"))
        held = [_unpack(b) for k, b in zip(kinds, bodies, strict=True) if k == 4]
        out = []
        for k, sender, body in zip(kinds, senders, bodies, strict=True):
            if k == 3:
                asked = _hashes(_unpack(body)[0])
                values = [np.zeros(len(asked), t) for t in ("<i8", "<i8", "<f4", "<f8")]
                if held:
                    at = np.minimum(np.searchsorted(held[0][0], asked), len(held[0][0]) - 1)
                    known = held[0][0][at] == asked
                    for v, x in zip(values, held[0][1:], strict=True):
                        v[known] = x[at[known]]
                out.append((key[0].as_py(), sender, 1, 0, _pack(*values)))
        return _table(out)

    # A stretch's own message waits in one exchange while its words are asked for from there.
    owns = _owns(rows, chunk).repartition(stretches, "sender")
    answers = words.select("part", "planes", "customers", "body").mapInArrow(of_words, _MESSAGE).union(_asks(owns, parts)).groupBy("part").applyInArrow(looked_up, _MESSAGE)
    told = answers.union(fitted.filter("kind = 2")).repartition(stretches, "sender")

    def scored(key: tuple, own: pa.Table, messages: pa.Table) -> pa.Table:
        if own.num_rows != 1:
            raise ValueError("the texts were read in another order than before; score a written table")
        about, tokens, names, word = _unpack(own["body"][0].as_buffer())
        order = sorted(range(messages.num_rows), key=messages["part"].to_pylist().__getitem__)
        kinds = messages["kind"].to_pylist()
        got = {k: [_unpack(messages["body"][i].as_buffer()) for i in order if kinds[i] == k] for k in (1, 2)}
        about = pa.ipc.open_stream(about.tobytes()).read_next_batch()
        tokens, names = tokens.astype(np.int64), _hashes(names)
        word = np.ascontiguousarray(word.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
        owner = np.repeat(np.arange(len(tokens)), tokens)
        s = Stretch.of(names, word, owner, parts)
        v = len(names)
        own = np.concatenate([b[0] - o.discount / (o.sweeps - o.burn_in) * b[1] for b in got[2]])
        count, after, rooms, weight = (np.concatenate([b[j] for b in got[1]]) for j in range(4))
        if len(own) != len(s.code) or len(count) != v + 1:
            raise ValueError("the texts were read in another order than before; score a written table")
        spread = lambda x: x[np.argsort(s.word_order, kind="stable")]
        count, after, rooms, weight = spread(count), spread(after).astype(np.float64), spread(rooms).astype(np.float64), spread(weight)
        at = np.argsort(s.code, kind="stable")
        code = _before(word, owner, v) * (v + 1) + word
        pair = at[np.unique(code, return_inverse=True)[1]]
        u = code // (v + 1)
        p = (own[pair] + (o.strength + o.discount * rooms[u]) * (weight[word] + unseen) * scale) / (o.strength + after[u])
        total = lambda x: np.bincount(owner, weights=x, minlength=len(tokens))
        c = count[word]
        known, base, lm = total(c > 0), total(np.log10(c + 0.5) - floor), total(np.log10(p))
        flat = [about.column(0), about.column(1), pa.array(tokens), pa.array(known.round().astype(np.int64)), pa.array(base), pa.array(lm)]
        return pa.Table.from_arrays(flat, names=["id", "held", "tokens", "known", "base", "lm"])

    out = owns.groupBy("sender").cogroup(told.groupBy("sender")).applyInArrow(scored, f"id {kind}, held boolean, tokens long, known long, base double, lm double")
    return out.select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), F.col("lm").alias("score"), F.pow(F.lit(10.0), -F.col("lm") / F.col("tokens")).alias("perplexity"),
    )


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring(table(spark, sf_dir, "documents"))
