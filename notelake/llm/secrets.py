"""Operator 5: secret scans by patterns and by sliding-window entropy, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.common import before, let, table


def _either_case(text: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in text)


_NAMES = "|".join(_either_case(n) for n in ("password", "passwd", "secret", "token"))
#: kind, pattern, group that must have the least size, least size; in the order in which kinds are listed.
BASE = (
    ("assign", rf"""({_NAMES}|{_either_case("api")}_?{_either_case("key")})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
#: The hex pattern with its least size written in finds the same spans (a maximal run is either long enough or not).
_SEARCH = {"hex": r"[0-9a-f]{32,}"}
#: What an entropy candidate looks like, before its character class is known: a run, perhaps with padding at its end.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Character class: pattern of the whole candidate, least bits a character in a window. The first that fits counts.
CLASSES = (
    ("hex", r"^[0-9a-fA-F]+=*$", 3.0),
    ("alnum", r"^[A-Za-z0-9]+=*$", 3.7),
    ("base64", r"^[A-Za-z0-9+/_-]+=*$", 3.8),
)
#: High-entropy spans with one of these (lower case) are placeholders or sequences, no secrets; runs without digits aren't looked at.
ALLOWED = r"example|sample|placeholder|changeme|dummy|redacted|lorem|foobar|x{6,}|0{8,}|(?:0?123456789)|abcdefgh|qwerty"
#: The characters that windows count.
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="

_SPAN = "array<struct<start:int,end:int,size:int>>"


def spans(text: Column, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches whose group has `least` characters, as structs of start, end (code points) and the group's size.

    The pieces between the matches and the matches themselves, both in order, give the offsets by running sums.
    """
    found = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.char_length).alias("gap"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.char_length).alias("hit"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.char_length).alias("part"),
    )

    def placed(pieces: Column) -> Column:
        offsets = before(F.transform(pieces, lambda x: x["gap"] + x["hit"]))
        start = lambda x, at: (at + x["gap"]).alias("start")
        return F.zip_with(pieces, offsets, lambda x, at: F.struct(start(x, at), (at + x["gap"] + x["hit"]).alias("end"), x["part"].alias("size")))

    # The last piece stands after the last match.
    every = let(found, lambda all_: placed(F.filter(all_, lambda x: x["hit"].isNotNull())))
    return F.when(text.rlike(pattern), F.filter(every, lambda s: s["size"] >= least)).otherwise(F.array().cast(_SPAN))


def masked(text: Column, pattern: str, group: int, least: int) -> Column:
    """text with blanks in place of the matches whose group has `least` characters; all else keeps its place."""
    gaps, hits, parts = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    put = F.zip_with(hits, parts, lambda hit, part: F.when(F.char_length(part) >= least, F.repeat(F.lit(" "), F.char_length(hit))).otherwise(hit))
    joined = F.array_join(F.zip_with(gaps, put, lambda gap, hit: F.concat(gap, F.coalesce(hit, F.lit("")))), "")
    return F.when(text.rlike(pattern), joined).otherwise(text)


def _weight(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def entropy_hits(candidate: Column, least: Column, window: int) -> Column:
    """Struct lo, hi: the first and the end of the last character of windows with at least `least` bits a character; lo is -1 if none.

    The counts of the window's characters and the sum of c log2 c are carried along: one character comes in, one goes
    out. A count is one character of a string with a place for each of the alphabet's, so a step overwrites two places.
    """
    zero, letters = 32, F.split(candidate, "", -1)
    place = lambda c: F.position(c, F.lit(_ALPHABET))
    count = lambda counts, at: F.ascii(F.substring(counts, at, 1)) - zero
    put = lambda counts, at, n: F.overlay(counts, F.char(n + zero), at, F.lit(1))

    def scan(code: Column) -> Column:
        def enter(acc: Column, at: Column) -> Column:
            return let(count(acc["counts"], at), lambda c: F.struct(put(acc["counts"], at, c + 1).alias("counts"), (acc["total"] + _weight(c + 1) - _weight(c)).alias("total")))

        def leave(acc: Column, at: Column) -> Column:
            return let(count(acc["counts"], at), lambda c: F.struct(put(acc["counts"], at, c - 1).alias("counts"), (acc["total"] + _weight(c - 1) - _weight(c)).alias("total")))

        def step(acc: Column, i: Column) -> Column:
            held = let(enter(acc["held"], code[i]), lambda h: F.when(i >= window, leave(h, F.get(code, i - window))).otherwise(h))

            def seen(h: Column) -> Column:
                hit = (i >= window - 1) & ((F.log2(F.lit(float(window))) - h["total"] / window) >= least)
                return F.struct(h.alias("held"), F.when(hit & (acc["lo"] < 0), i - window + 1).otherwise(acc["lo"]).alias("lo"), F.when(hit, i + 1).otherwise(acc["hi"]).alias("hi"))

            return let(held, seen)

        start = F.struct(F.struct(F.lit(chr(zero) * len(_ALPHABET)).alias("counts"), F.lit(0.0).alias("total")).alias("held"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"))
        return F.aggregate(F.sequence(F.lit(0), F.size(code) - 1), start, step, lambda acc: F.struct(acc["lo"].alias("lo"), acc["hi"].alias("hi")))

    return let(F.filter(F.transform(letters, lambda c: F.when(c != "", place(c))), lambda at: at > 0), scan)


def entropy_spans(text: Column, window: int) -> Column:
    """Spans of candidates that hold a letter and a digit, from their first to their last window of high entropy, but for those that are allowed."""

    def scan(places: Column) -> Column:
        def one(x: Column) -> Column:
            word = F.substring(text, x["start"] + 1, x["end"] - x["start"])
            least = F.coalesce(*(F.when(word.rlike(p), F.lit(bits)) for _, p, bits in CLASSES))
            mixed = word.rlike("[0-9]") & word.rlike("[A-Za-z]")
            return F.when(mixed, let(entropy_hits(word, least, window), lambda h: F.struct((x["start"] + h["lo"]).alias("start"), (x["start"] + h["hi"]).alias("end"), h["lo"].alias("size"))))

        hits = F.filter(F.transform(places, one), lambda s: s.isNotNull() & (s["size"] >= 0))
        return F.filter(hits, lambda s: ~F.lower(F.substring(text, s["start"] + 1, s["end"] - s["start"])).rlike(ALLOWED))

    return let(spans(text, CANDIDATE, 0, 20), scan)


def secret_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """One row a document: id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans.

    Base spans are the leftmost non-overlapping matches of each kind that are long enough. The entropy method looks at
    the text between them: it adds a span for a candidate string with windows of `window` characters (90 at most) whose
    Shannon entropy reaches its character class's bound, unless the allow-list knows the span. spans lists all as
    kind:start:end by start, then kind; base_sha256 is over the base ones alone. Spans of several kinds may start at one
    place; the kinds' order decides. A null text is empty: no spans and the digest of the empty string. Repeated rows are
    scanned each; an empty table gives no row; columns other than the id and the text, whatever their names, are left
    out. A text's matches are placed by blocks, so the cost of a very long text stays near its length.
    """
    kinds = [k for k, *_ in BASE]
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    places = {f"p_{kind}": spans(F.col("t"), _SEARCH.get(kind, pattern), group, least) for kind, pattern, group, least in BASE}
    rest = F.col("t")
    for kind, pattern, group, least in BASE:
        rest = let(rest, _masker(_SEARCH.get(kind, pattern), group, least))
    df = df.withColumns(places | {"p_entropy": let(rest, lambda t: entropy_spans(t, window))})

    def listed(kind: str) -> Column:
        order = (*kinds, "entropy").index(kind)
        return F.transform(F.col(f"p_{kind}"), lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    def joined(column: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(column), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = [listed(k) for k in kinds]
    count = {f"n_{k}": F.size(f"p_{k}").cast("long") for k in (*kinds, "entropy")}
    return df.select(
        F.col("id").alias(id_col), *(c.alias(n) for n, c in count.items()),
        F.sha2(joined(F.concat(*base)), 256).alias("base_sha256"),
        joined(F.concat(*base, listed("entropy"))).alias("spans"),
    )


def _masker(pattern: str, group: int, least: int) -> Callable[[Column], Column]:
    """One-argument form of masked(): Spark gives a second parameter of a lambda the place in the array."""
    return lambda text: masked(text, pattern, group, least)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))
