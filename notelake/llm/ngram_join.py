"""Operator 7: exact n-gram Jaccard join; sets that meet in their prefixes are joined by walking prefix trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.common import cut, small, table, written
from notelake.llm.components import components
from notelake.llm.shingles import WordHasher, mix, set_ids, shingle_sets

#: N-grams whose place at the end of the global order is sure: at most so many, the most frequent ones. Only the order
#: depends on them, no result: whichever they are, sets that link share an n-gram of their prefixes.
ORDER_HINTS = 500_000
#: Linked sets share MEET prefix n-grams and one more for each PER n-grams (or all that they have). One common n-gram would
#: do for shorter prefixes, but then sets that share only a passage would have to be looked at.
MEET, PER = 8, 20
#: Posting lists with more sets than this are joined as a whole, shorter ones give pairs.
SHORT_LIST = 16
#: A prefix tree holds about so many sets, or n-grams; larger groups are dealt over several.
TREE_SETS, TREE_GRAMS = 1024, 1 << 20
#: N-grams that a task counts at a time, postings that it gathers before it deals them out, and those that a bucket should hold.
COUNTED, STRETCH, BUCKET = 2_000_000, 400_000, 4_000_000


def _sets(batch: pa.RecordBatch, hasher: WordHasher, size: int, column: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, end, tokens, starts): the sets of the texts [start, end) of an Arrow batch, about half a megabyte at a time."""
    texts = batch.column(column)
    sizes = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(sizes, sizes[start] + (1 << 19), side="right")) - 1)
        hashes, owner, *_ = hasher(texts.slice(start, end - start).to_pylist())
        yield start, end, *shingle_sets(hashes, owner, end - start, size)
        start = end


def _classes(keyed: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(id, key, sid, n): the name and size of each document's set; and (token, n): n-grams that are frequent somewhere.

    A task counts the n-grams of different sets over stretches and names those found in three texts or more.
    """
    kind = dict(keyed.dtypes)["id"]
    names = ["id", "key", "sid", "n", "token"]

    def frequent(held: list[np.ndarray], kind_arrow: pa.DataType) -> pa.RecordBatch:
        token, n = np.unique(np.concatenate(held), return_counts=True)
        token, n = token[n >= 3], n[n >= 3]
        nothing = lambda t: pa.nulls(len(token), t)
        return pa.RecordBatch.from_arrays([nothing(kind_arrow), nothing(pa.int64()), nothing(pa.int64()), pa.array(n, pa.int64()), pa.array(token.view(np.int64))], names=names)

    def run(batches):
        hasher, held, total, seen, kind_arrow = WordHasher(), [], 0, set(), None
        for batch in batches:
            kind_arrow = batch.column(0).type
            sids, ns = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for start, end, tokens, starts in _sets(batch, hasher, size, 2):
                sids[start:end], ns[start:end] = set_ids(tokens, starts), np.diff(starts)
                fresh = _fresh(sids[start:end], seen)
                held.append(tokens[np.repeat(fresh, ns[start:end])])
                total += len(held[-1])
                if total >= COUNTED:
                    yield frequent(held, kind_arrow)
                    held, total, seen = [], 0, set()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sids), pa.array(ns), pa.nulls(len(sids), pa.int64())], names=names)
        if total:
            yield frequent(held, kind_arrow)

    both = written(keyed.select("id", "key", "t").mapInArrow(run, f"id {kind}, key long, sid long, n long, token long"))
    return both.filter("token is null").drop("token"), both.filter("token is not null").groupBy("token").agg(F.sum("n").alias("n")).filter("n >= 16")


def _fresh(sids: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which of the sets aren't empty and haven't been seen; seen takes them up."""
    out = np.zeros(len(sids), bool)
    for i, sid in enumerate(sids.tolist()):
        if sid and sid not in seen:
            seen.add(sid)
            out[i] = True
    return out


def _order_hints(counts: DataFrame) -> np.ndarray:
    """The most frequent n-grams, as sorted hashes; a bounded list."""
    top = counts.orderBy(F.desc("n"), "token").limit(ORDER_HINTS).select("token")
    return np.sort(top.toPandas()["token"].to_numpy(np.int64).view(np.uint64))


class _Late:
    """Tells which n-grams are at the end of the global order."""

    def __init__(self, last: np.ndarray) -> None:
        self.last, self.table = last, np.zeros(1 << 22, bool)
        self.table[(last >> np.uint64(42)).astype(np.int64)] = True

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        out = self.table[(tokens >> np.uint64(42)).astype(np.int64)]
        maybe = np.flatnonzero(out)
        if len(maybe):
            part = tokens[maybe]
            out[maybe] = self.last[np.minimum(np.searchsorted(self.last, part), len(self.last) - 1)] == part
        return out


def kept(n: np.ndarray, per_cent: int) -> np.ndarray:
    """Length of the prefix of a set with n n-grams."""
    return np.minimum(n, n + (-n * per_cent // 100) + MEET + n // PER)


def prefixes(tokens: np.ndarray, starts: np.ndarray, late: np.ndarray, per_cent: int) -> np.ndarray:
    """Which n-grams are in their set's prefix in the global order: by hash, those in late after all others."""
    n = np.diff(starts)
    own = np.repeat(np.arange(len(n)), n)
    early = np.concatenate([[0], np.cumsum(~late)])
    before = early[:-1] - early[starts[:-1]][own]
    rank = np.where(late, (early[starts[1:]] - early[starts[:-1]])[own] + np.arange(len(tokens)) - starts[:-1][own] - before, before)
    return rank < kept(n, per_cent)[own]


def _postings(keyed: DataFrame, size: int, per_cent: int, last: np.ndarray, parts: int) -> DataFrame:
    """(part, late, token, sid, n): packed postings of the sets' prefixes, dealt out by n-gram; those of late n-grams by set."""
    names = ["part", "late", "token", "sid", "n"]

    def dealt(part: np.ndarray, late: bool, token: np.ndarray, sid: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(part, kind="stable")
        part, token, sid, n = part[order], token[order], sid[order], n[order]
        own, first = np.unique(part, return_index=True)
        ends = np.append(first[1:], len(part))
        packed = [[x[a:b].tobytes() for a, b in zip(first, ends, strict=True)] for x in (token, sid, n)]
        return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array([late] * len(own)), *(pa.array(x, pa.binary()) for x in packed)], names=names)

    def run(batches):
        hasher, seen, held, total = WordHasher(), set(), [], 0
        is_late = _Late(last) if len(last) else lambda tokens: np.zeros(len(tokens), bool)

        def flush():
            token, sid, n, late = (np.concatenate(x) for x in zip(*held, strict=True))
            low = (token & np.uint64(0xFFFFFFFF)) * np.uint64(parts) >> np.uint64(32)
            if not late.all():
                # Within a bucket, half of the hash tells n-grams apart: a mix-up adds a pair to look at, and loses none.
                yield dealt(low[~late], False, (token[~late] >> np.uint64(32)).astype("<u4"), sid[~late], n[~late])
            if late.any():
                yield dealt((mix(sid[late].view(np.uint64)) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), True, token[late], sid[late], n[late])

        for batch in batches:
            for _, _, tokens, starts in _sets(batch, hasher, size):
                sids, n = set_ids(tokens, starts), np.diff(starts)
                late = is_late(tokens)
                chosen = prefixes(tokens, starts, late, per_cent) & np.repeat(_fresh(sids, seen), n)
                held.append((tokens[chosen], np.repeat(sids, n)[chosen], np.repeat(n, n)[chosen].astype("<i4"), late[chosen]))
                total += len(held[-1][0])
                if total >= STRETCH:
                    yield from flush()
                    held, total = [], 0
        if total:
            yield from flush()

    return keyed.select("t").mapInArrow(run, "part int, late boolean, token binary, sid binary, n binary")


def _met(postings: DataFrame, parts: int, per_cent: int) -> DataFrame:
    """(token, a, na, b, nb, k): pairs of sets that share k n-grams with short posting lists in a bucket (token is null), and the
    postings (token, a, na) of long lists and of late n-grams."""
    names = ["token", "a", "na", "b", "nb", "k"]
    rows = lambda *x: pa.RecordBatch.from_arrays([pa.array(v) if isinstance(v, np.ndarray) else v for v in x], names=names)

    def long_rows(token: np.ndarray, sid: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        none = lambda t: pa.nulls(len(token), t)
        return rows(token.view(np.int64), sid, n, none(pa.int64()), none(pa.int32()), none(pa.int32()))

    def run(batches):
        held, part = [], 0
        for batch in batches:
            for p, late, *packed in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                token, sid, n = (np.frombuffer(x, t) for x, t in zip(packed, ("<u8" if late else "<u4", "<i8", "<i4"), strict=True))
                if late:
                    yield long_rows(token, sid, n)
                else:
                    held.append((token, sid, n))
                    part = p
        if not held:
            return
        token, sid, n = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        names_, own = np.unique(sid, return_inverse=True)
        sizes = np.zeros(len(names_), np.int32)
        sizes[own] = n
        each = np.unique((token.astype(np.uint64) << np.uint64(32)) | own.astype(np.uint64))
        del sid, n
        token, own = each >> np.uint64(32), (each & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        df = np.diff(np.append(first, len(token)))
        pairs = []
        for k in range(2, SHORT_LIST + 1):
            lists = own[first[df == k][:, None] + np.arange(k)]
            i, j = np.triu_indices(k, 1)
            a, b = lists[:, i].ravel(), lists[:, j].ravel()
            near = 100 * np.minimum(sizes[a], sizes[b]).astype(np.int64) >= per_cent * np.maximum(sizes[a], sizes[b])
            pairs.append(a[near] << 32 | b[near])
        pair, k = np.unique(np.concatenate(pairs), return_counts=True)
        a, b = pair >> 32, pair & 0xFFFFFFFF
        for at in range(0, len(pair), 100_000):
            x, y, c = a[at : at + 100_000], b[at : at + 100_000], k[at : at + 100_000]
            yield rows(pa.nulls(len(x), pa.int64()), names_[x], sizes[x], names_[y], sizes[y], c.astype(np.int32))
        far = np.repeat(df > SHORT_LIST, df)
        token, own = token[far] | np.uint64(part) << np.uint64(32), own[far]
        for at in range(0, len(token), 100_000):
            yield long_rows(token[at : at + 100_000], names_[own[at : at + 100_000]], sizes[own[at : at + 100_000]])

    return written(postings.repartitionById(parts, "part").mapInArrow(run, "token long, a long, na int, b long, nb int, k int"))


def _shared(met: DataFrame) -> DataFrame:
    """(a, b, k, na, nb): pairs of sets with the number k of prefix n-grams with short lists that they share."""
    return met.filter("token is null").groupBy("a", "b").agg(F.sum("k").alias("k"), F.first("na").alias("na"), F.first("nb").alias("nb"))


def _candidates(pairs: DataFrame, per_cent: int) -> DataFrame:
    """Pairs (a, b) that share as many prefix n-grams as linking asks for, if they share none with a long list.

    Of two sets, the one whose prefix ends first has at most its rest in common with the other behind that end.
    """
    most = F.greatest("na", "nb")
    need = F.ceil(per_cent * (F.col("na") + F.col("nb")) / (100 + per_cent))
    rest = F.greatest(F.ceil(per_cent * most / 100) - MEET - F.floor(most / PER), F.lit(0))
    return pairs.filter(F.col("k") >= need - rest).select("a", "b")


def _stars(met: DataFrame, pairs: DataFrame, per_cent: int) -> DataFrame:
    """(r, sid, n, k): for long posting lists, the sets that share k of them with set r, the least of each such list.

    A set stays out if all its long lists, and the most that it shares of short ones with any one other, don't make up the
    prefix n-grams that it shares with every set it links with.
    """
    longs = met.filter("token is not null").select("token", F.col("a").alias("sid"), F.col("na").alias("n")).distinct()
    ends = pairs.select(F.col("a").alias("sid"), "k").union(pairs.select(F.col("b").alias("sid"), "k")).groupBy("sid").agg(F.max("k").alias("most"))
    lists = longs.groupBy("sid").agg(F.count(F.lit(1)).alias("lists")).join(ends, "sid", "left")
    enough = F.least(MEET + F.floor(F.col("n") / PER), F.ceil(per_cent * F.col("n") / 100))
    longs = longs.join(lists, "sid").filter(F.col("lists") + F.coalesce("most", F.lit(0)) >= enough)
    least = longs.groupBy("token").agg(F.min("sid").alias("r"), F.count(F.lit(1)).alias("sets")).filter("sets > 1").drop("sets")
    return longs.join(least, "token").groupBy("r", "sid").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("k"))


class PrefixTree:
    """Sets of numbers, sorted in the global order, as paths from a root; walks share the overlaps of common beginnings."""

    def __init__(self, sets: list[np.ndarray], per_cent: int) -> None:
        self.per_cent = per_cent
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">i8").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.shared = [0, *(self._common(a, b) for a, b in zip(self.sets, self.sets[1:], strict=False))]
        self.sums = np.zeros(max(map(len, sets), default=0) + 1, np.int64)

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differ = a[:n] != b[:n]
        return int(differ.argmax()) if differ.any() else n

    def walk(self, probe: np.ndarray, inside: np.ndarray, skip, block: int = 64) -> Iterator[int]:
        """Sets for which 100 * |intersection| >= per_cent * |union| with probe; inside tells probe's numbers, skip(i) leaves out set i.

        What a path shares with the last one keeps its overlaps. A subtree is left once what remains of probe can't reach
        the least overlap that any set needs, and a path once what remains of it and of probe can't reach its own.
        """
        size, per_cent, sums = len(probe), self.per_cent, self.sums
        least = -(-per_cent * size // 100)
        same = known = 0  # depth shared with the last path looked at, and how far that was looked at
        pruned = None
        for i, m, shared in zip(self.order, self.sets, self.shared, strict=True):
            same = min(same, shared)
            if pruned is not None and same >= pruned:
                continue
            if 100 * min(size, len(m)) < per_cent * max(size, len(m)) or skip(i):
                continue
            at = min(same, known)
            need = -(-per_cent * (size + len(m)) // (100 + per_cent))
            pruned, enough = None, True
            while at < len(m):
                part = m[at : at + block]
                end = at + len(part)
                np.cumsum(inside[part], out=sums[at + 1 : end + 1])
                sums[at + 1 : end + 1] += sums[at]
                at, now = end, int(sums[end])
                ahead = size - int(np.searchsorted(probe, part[-1], side="right"))
                if now + ahead < least:
                    pruned = at
                if now + min(len(m) - at, ahead) < need:
                    enough = False
                    break
            same, known = len(m), at
            if enough and sums[at] >= need:
                yield i


def cluster_links(sets: list[np.ndarray], members: list[int], probes: list[int], per_cent: int) -> list[tuple[int, int]]:
    """Links between probes and members, as many as it takes to connect what they connect; sets are sorted arrays of hashes.

    The probes with the most common n-grams come first, since they link with most; sets that are already connected with
    a probe aren't looked at again.
    """
    flat = np.concatenate(sets)
    _, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    ends = np.cumsum([len(s) for s in sets])
    local = np.split(place, ends[:-1])
    top = list(range(len(sets)))

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    tree, inside, links = PrefixTree([local[i] for i in members], per_cent), np.zeros(len(count), bool), []
    for p in sorted(probes, key=lambda i: -float(count[local[i]].mean())):
        inside[local[p]] = True
        for i in tree.walk(local[p], inside, lambda i: root(members[i]) == root(p)):  # noqa: B023
            top[root(members[i])] = root(p)
            links.append((p, members[i]))
        inside[local[p]] = False
    return links


def _joined(rows: DataFrame, keyed: DataFrame, first_key: DataFrame, size: int, per_cent: int) -> DataFrame:
    """Links (a, b) of rows (bucket, kind, sid): in each bucket, probes (kind 1 and 2) walk the tree of members (kind 0 and 2).

    Texts travel, not sets: they compress, and their sets are hashed anew. A task holds one bucket at a time.
    """
    rows = cut(rows)
    keys = small(cut(first_key.join(rows.select("sid").distinct(), "sid").select("key", "sid")))
    texts = keyed.select("key", "t").join(keys, "key").dropDuplicates(["sid"]).select("sid", "t")  # repeated rows only give a text twice

    def run(batches):
        hasher, bucket, held, kinds, seen = WordHasher(), None, {}, {}, False

        def flush() -> pa.RecordBatch:
            names = list(held)
            found = cluster_links([held[s] for s in names], [i for i, s in enumerate(names) if kinds[s] != 1], [i for i, s in enumerate(names) if kinds[s] != 0], per_cent)
            return pa.RecordBatch.from_arrays([pa.array([min(names[x], names[y]) for x, y in found], pa.int64()), pa.array([max(names[x], names[y]) for x, y in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            buckets, kind, sids = (batch.column(i).to_pylist() for i in range(3))
            for start, _, tokens, starts in _sets(batch, hasher, size, 3):
                for i, (lo, hi) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True), start):
                    if buckets[i] != bucket or not seen:
                        if held:
                            yield flush()
                        bucket, held, kinds, seen = buckets[i], {}, {}, True
                    sid = sids[i]
                    kinds[sid] = kind[i] if kinds.get(sid, kind[i]) == kind[i] else 2
                    if sid not in held:
                        held[sid] = tokens[lo:hi].copy()
        if held:
            yield flush()

    met = rows.join(texts, "sid").select("bucket", "kind", "sid", "t")
    return written(met.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long"))


def _links(met: DataFrame, keyed: DataFrame, first_key: DataFrame, size: int, per_cent: int) -> DataFrame:
    """Links (a, b), enough to connect what any links connect."""
    shared = written(_shared(met))
    pairs = cut(_candidates(shared, per_cent))
    named = lambda what, *c: F.xxhash64(F.lit(what), *c).alias("bucket")
    probe, member, both = (F.lit(k).alias("kind") for k in (1, 0, 2))
    rows = pairs.select(named("pair", "a"), member, F.col("b").alias("sid")).union(pairs.select(named("pair", "a"), probe, F.col("a").alias("sid")).distinct())
    stars = cut(_stars(met, shared, per_cent))
    sizes = stars.groupBy("r").agg(F.greatest(F.ceil(F.count(F.lit(1)) / TREE_SETS), F.ceil(F.sum("n") / TREE_GRAMS)).cast("int").alias("blocks"))
    dealt = stars.join(sizes, "r").withColumn("mine", F.pmod(F.xxhash64("sid"), "blocks"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("other")
    rows = rows.union(dealt.select(named("star", "r", "mine"), both, "sid"))
    large = cut(dealt.filter("blocks > 1"))
    # A large group's sets with the most shared lists for their size meet all of its trees.
    hub = F.max(F.struct(F.col("k") / F.col("n"), "sid"))
    hubs = large.groupBy("r", F.pmod(F.xxhash64("sid", F.lit(1)), F.lit(8)).alias("salt")).agg(hub["sid"].alias("sid"), F.max("blocks").alias("blocks"))
    rows = rows.union(hubs.select("r", "sid", every).select(named("star", "r", "other"), probe, "sid"))
    links = _joined(rows, keyed, first_key, size, per_cent)
    if large.isEmpty():
        return links
    # What isn't connected with its group's largest part by now meets all of the group's trees.
    labels = components(links).withColumnRenamed("node", "sid")
    known = cut(large.join(labels, "sid", "left").select("r", "sid", "mine", "blocks", F.coalesce("label", "sid").alias("label")))
    main = known.groupBy("r", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("r").agg(F.max_by("label", F.struct("k", "label")).alias("main"))
    outside = known.join(main, "r").filter("label <> main").select("r", "sid", every)
    more = known.select(named("star", "r", "mine"), member, "sid").union(outside.select(named("star", "r", "other"), probe, "sid"))
    return links.union(_joined(more, keyed, first_key, size, per_cent))


def ngram_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, per_cent: int = 75, with_key: bool = False) -> DataFrame:
    """One row a document: id, n_shingles, component_id (the smallest id reachable by links, its own if none).

    A document's set holds its distinct `size`-word shingles (fewer words: the whole sequence is one). Two link when
    100 * intersection >= per_cent * union. Equal sets are one class from the start. Sets are in one global order (by
    hash, frequent n-grams last) and meet in the posting lists of their prefixes: sets of a short list that share as many
    prefix n-grams as linking asks for, and all sets of a long list, come together in buckets. There, each is walked down
    the prefix tree of the others, and components follow from the links; sets inside one component need no second look.
    Hashes have 64 bits. A null text or one without words has the empty set and links with nothing; repeated rows are in
    one component; a null id is never the smallest unless all ids of the component are null; of equal ids it doesn't
    matter which counts; very long texts are sets like others, a tree holds fewer of them; an empty table gives no row;
    other columns are left out, whatever their names. with_key adds the row's key and label, the component's own name,
    which tells components apart where ids are null or repeated.
    """
    keyed = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("key", F.xxhash64("id", "t"))
    classes, frequent = _classes(keyed, size)
    grams = classes.agg(F.sum("n")).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), grams * (100 - per_cent) // 100 // BUCKET)
    met = _met(_postings(keyed, size, per_cent, _order_hints(frequent), parts), parts, per_cent)
    first_key = classes.filter("n > 0").groupBy("sid").agg(F.min_by("key", F.struct("id", "key")).alias("key"))
    labels = components(_links(met, keyed, first_key, size, per_cent))
    named = classes.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    least = named.filter("n > 0").groupBy("label").agg(F.min("id").alias("least"))
    out = named.join(least, "label", "left")
    component = F.when(F.col("n") > 0, F.coalesce("least", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), *([F.col("key"), F.col("label")] if with_key else []), F.col("n").alias("n_shingles"), component.alias("component_id"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))
