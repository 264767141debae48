"""Operator 4: quality rules and robust multivariate outliers (minimum covariance determinant), DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.common import BLANK, cut, let, small, table, words

#: Share of a group that a minimum-covariance-determinant subset holds.
SUBSET = 0.75
#: Chi-squared quantiles for four dimensions and the factors that make the covariance of a trimmed set consistent for
#: normal data: 0.75 / F6(q(0.75)) and 0.975 / F6(q(0.975)), F6 the distribution function for six dimensions.
TRIM_FACTOR, REWEIGHT_AT, REWEIGHT_FACTOR, REJECT_AT = 1.486, 11.143, 1.064, 23.513
#: Least standard deviation of each transformed statistic, so that a statistic that is mostly zero can't reject small departures.
FLOORS = (0.08, 0.10, 0.15, 0.10)
P = len(FLOORS)
_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def _repeated_words(w: Column) -> Column:
    """Words in 5-word windows that are found twice or more."""

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(h[i], h[i + 1], h[i + 2], h[i + 3], h[i + 4]))

    def covered(v: Column) -> Column:
        def places(s: Column) -> Column:
            again = F.filter(s, lambda x, j: F.coalesce(x["h"] == F.get(s, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False)))
            starts = F.array_sort(F.transform(again, lambda x: x["i"]))
            step = lambda acc, i: F.struct((acc["n"] + i + 5 - F.greatest(i, acc["end"])).alias("n"), (i + 5).alias("end"))
            return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda acc: acc["n"])

        ordered = F.array_sort(F.transform(v, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(v)) == F.size(v), F.lit(0)).otherwise(let(ordered, places))

    hashes = let(F.transform(w, lambda x: F.xxhash64(x)), windows)
    return F.when(F.size(w) < 5, F.lit(0)).otherwise(let(hashes, covered))


def statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row a document: id, group columns (null as empty), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(
        F.col(id_col).alias("id"), *(F.coalesce(F.col(g).cast("string"), F.lit("")).alias(f"g{i}") for i, g in enumerate(group_cols)), words(text).alias("w"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{BLANK}]")).alias("l"), F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).alias("n_symbols"),
    )
    return df.select(
        "id", *(f"g{i}" for i in range(len(group_cols))), F.size("w").cast("long").alias("n_words"), F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"), F.col("n_symbols").cast("long"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"), _repeated_words(F.col("w")).cast("long").alias("n_repeat_words"), F.size("l").cast("long").alias("n_lines"),
    )


def _vector() -> dict[str, Column]:
    """The transformed statistics: mean word length (shrunk for short texts), and roots of three rates."""
    n = F.col("n_words")
    return {
        "x0": F.log((F.col("word_chars") + 150.0) / (n + 30.0)),
        "x1": F.sqrt(F.col("n_symbols") / (n + 10.0)),
        "x2": F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 5.0)),
        "x3": F.sqrt(F.col("n_repeat_words") / (n + 20.0)),
    }


def _distance(df: DataFrame, start: int, name: str) -> DataFrame:
    """Squared Mahalanobis distance to the estimate of one start, by forward substitution with its Cholesky factor."""
    y: list[str] = []
    for i in range(P):
        left = F.col(f"x{i}") - F.col(f"m{start}_{i}")
        for j in range(i):
            left = left - F.col(f"l{start}_{i}{j}") * F.col(y[j])
        df = df.withColumn(f"_y{start}_{i}", left / F.col(f"l{start}_{i}{i}"))
        y.append(f"_y{start}_{i}")
    return df.withColumn(name, sum((F.col(c) * F.col(c) for c in y[1:]), F.col(y[0]) * F.col(y[0]))).drop(*y)


def _moments(start: int, inside: Column) -> list[Column]:
    pick = lambda c: F.when(inside, c)
    return [F.count(pick(F.lit(1))).alias(f"n{start}"), *(F.sum(pick(F.col(f"x{i}"))).alias(f"s{start}_{i}") for i in range(P)), *(F.sum(pick(F.col(f"x{i}") * F.col(f"x{j}"))).alias(f"q{start}_{i}{j}") for i, j in _PAIRS)]


def _estimate(sums: DataFrame, starts: range, factor: float) -> DataFrame:
    """Means and Cholesky factors from sums, the covariance scaled and its diagonal held over the floors."""
    keep = ["g"]
    for s in starts:
        n = F.greatest(F.col(f"n{s}"), F.lit(1))
        sums = sums.withColumns({f"m{s}_{i}": F.coalesce(F.col(f"s{s}_{i}"), F.lit(0.0)) / n for i in range(P)})
        cov = {(i, j): F.lit(factor) * (F.coalesce(F.col(f"q{s}_{i}{j}"), F.lit(0.0)) / n - F.col(f"m{s}_{i}") * F.col(f"m{s}_{j}")) + (F.lit(FLOORS[i] ** 2) if i == j else 0.0) for i, j in _PAIRS}
        for i, j in _PAIRS:
            value = cov[i, j]
            for k in range(j):
                value = value - F.col(f"l{s}_{i}{k}") * F.col(f"l{s}_{j}{k}")
            sums = sums.withColumn(f"l{s}_{i}{j}", F.sqrt(F.greatest(value, F.lit(1e-9))) if i == j else value / F.col(f"l{s}_{j}{j}"))
        det = F.col(f"l{s}_00")
        for i in range(1, P):
            det = det * F.col(f"l{s}_{i}{i}")
        sums = sums.withColumn(f"det{s}", det)
        keep += [f"m{s}_{i}" for i in range(P)] + [f"l{s}_{i}{j}" for i, j in _PAIRS] + [f"det{s}"]
    return sums.select(*keep)


def mcd(rows: DataFrame, steps: int = 3) -> DataFrame:
    """Per group g of rows (g, x0..x3): robust mean m0_* and Cholesky factor l0_* of the covariance.

    Two starts (medians with scaled absolute deviations; the half nearest the medians in floor units) each take
    concentration steps: the SUBSET share of the group nearest to the last estimate gives the next. The start with the
    smaller determinant is reweighted once. Each step is two aggregations with partial sums over all rows; only a group's
    few numbers go on, so no group is ever in one task.
    """
    # Ends of the subset are quantile sketches with relative accuracy 1e-4 of the group's size, which merge across tasks.
    near = lambda c, share: F.percentile_approx(c, F.lit(share), F.lit(10_000))
    mid = small(cut(rows.groupBy("g").agg(*(near(f"x{i}", 0.5).alias(f"c{i}") for i in range(P)))))
    off = rows.join(mid, "g").select("g", *(f"x{i}" for i in range(P)), *(f"c{i}" for i in range(P)), *(F.abs(F.col(f"x{i}") - F.col(f"c{i}")).alias(f"a{i}") for i in range(P)))
    off = off.withColumn("e", sum((F.pow(F.col(f"a{i}") / FLOORS[i], 2) for i in range(1, P)), F.pow(F.col("a0") / FLOORS[0], 2)))
    spread = small(cut(off.groupBy("g").agg(*(near(f"a{i}", 0.5).alias(f"d{i}") for i in range(P)), near("e", 0.5).alias("half"))))
    first = off.join(spread, "g")
    scaled = sum((F.pow(F.col(f"a{i}") / F.greatest(1.4826 * F.col(f"d{i}"), F.lit(FLOORS[i])), 2) for i in range(1, P)), F.pow(F.col("a0") / F.greatest(1.4826 * F.col("d0"), F.lit(FLOORS[0])), 2))
    both = range(2)
    est = small(cut(_estimate(first.groupBy("g").agg(*_moments(0, scaled <= REWEIGHT_AT), *_moments(1, F.col("e") <= F.col("half"))), both, TRIM_FACTOR)))
    for _ in range(steps):
        far = rows.join(est, "g")
        for s in both:
            far = _distance(far, s, f"d2_{s}")
        ends = small(cut(far.groupBy("g").agg(*(near(f"d2_{s}", SUBSET).alias(f"h{s}") for s in both))))
        sums = far.join(ends, "g").groupBy("g").agg(*(m for s in both for m in _moments(s, F.col(f"d2_{s}") <= F.col(f"h{s}"))))
        est = small(cut(_estimate(sums, both, TRIM_FACTOR)))
    names = [f"m{{}}_{i}" for i in range(P)] + [f"l{{}}_{i}{j}" for i, j in _PAIRS]
    best = est.select("g", *(F.when(F.col("det0") <= F.col("det1"), F.col(n.format(0))).otherwise(F.col(n.format(1))).alias(n.format(0)) for n in names))
    near_best = _distance(rows.join(small(best), "g"), 0, "d2")
    return cut(_estimate(near_best.groupBy("g").agg(*_moments(0, F.col("d2") <= REWEIGHT_AT)), range(1), REWEIGHT_FACTOR))


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_rows: int = 50, steps: int = 3) -> DataFrame:
    """One row a document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    base_failed: under 10 words, or over a fifth of the words in repeated 5-word windows. Of the others, a document is
    kept if its transformed statistics lie within the 0.9999 quantile of squared Mahalanobis distances, by robust
    estimates for its language and source. Sources with fewer than least_rows such documents share an estimate per
    language, and languages with fewer share one. A null text has no words (so it fails the base rules), a null language
    or source is a group of its own, repeated rows count each, an empty table gives no row.
    """
    stats = cut(statistics(docs, id_col=id_col, text_col=text_col, group_cols=(lang_col, source_col)).withColumns(_vector()))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed)
    sizes = stats.filter(~F.col("base_failed")).groupBy("g0", "g1").agg(F.count(F.lit(1)).alias("n"))
    sizes = cut(sizes)
    by_lang = sizes.filter(F.col("n") < least_rows).groupBy("g0").agg(F.sum("n").alias("rest"))
    own = F.when(F.col("n") >= least_rows, F.to_json(F.array("g0", "g1"))).when(F.col("rest") >= least_rows, F.to_json(F.array("g0"))).otherwise("[]")
    groups = small(sizes.join(by_lang, "g0", "left").select("g0", "g1", own.alias("g")))
    rows = stats.join(groups, ["g0", "g1"], "left")
    est = small(mcd(rows.filter(~F.col("base_failed")).select("g", *(f"x{i}" for i in range(P))), steps))
    out = _distance(rows.join(est, "g", "left"), 0, "d2")
    kept = ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= REJECT_AT)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select(F.col("id").alias(id_col), *counts, "base_failed", kept.alias("kept"), F.sqrt(F.when(~F.col("base_failed"), F.col("d2"))).alias("distance"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
