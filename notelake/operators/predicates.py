"""Filters."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """A path glob (**, *, ?, {a,b}) as an anchored regular expression."""
    out, i, braces = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "{":
            braces, part = braces + 1, "(?:"
        elif c == "}" and braces:
            braces, part = braces - 1, ")"
        elif c == "," and braces:
            part = "|"
        else:
            part = {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        out, i = out + part, i + 1
    return f"^{out}$"


def split_globs(text: str) -> list[str]:
    """Globs in a text, one a line or parted by commas outside braces."""
    return [g.strip() for g in re.split(r"\n|,(?![^{]*\})", text) if g.strip()]


def _any(tests: list[Column], empty: bool) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(empty)


def filter_globs(df: DataFrame, include: str = "", exclude: str = "", path_col: str = "path") -> DataFrame:
    """Rows whose path fits an include glob (all, if none is given) and no exclude glob."""
    fits = lambda text, empty: _any([F.col(path_col).rlike(glob_regex(g)) for g in split_globs(text)], empty)
    return df.filter(fits(include, True) & ~fits(exclude, False))


def filter_scope(df: DataFrame, files: list[str] | None = None, folders: list[str] | None = None, path_col: str = "path") -> DataFrame:
    """Rows with a path in files or below a folder; all rows if neither is given."""
    if not files and not folders:
        return df
    tests = [F.col(path_col).startswith(f.rstrip("/") + "/") for f in folders or []]
    return df.filter(_any(([F.col(path_col).isin(files)] if files else []) + tests, False))


def notes_in_folders(notes: DataFrame, folders: list[str]) -> DataFrame:
    """Notes below any of the folders (the root is all), each once, by path."""
    roots = {"", "/"} & {f.strip() for f in folders}
    found = notes if roots else filter_scope(notes, folders=folders)
    return found.dropDuplicates(["path"]).orderBy("path")


def exclude_prefixes(df: DataFrame, csv: str, path_col: str = "path") -> DataFrame:
    """Rows whose path begins with none of the prefixes; no slash is added, so a prefix may end inside a name."""
    prefixes = [p.strip() for p in csv.split(",") if p.strip()]
    return df.filter(~_any([F.col(path_col).startswith(p) for p in prefixes], False))


def drop_blank(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).rlike(r"\S"))


def needs_reindex(notes: DataFrame, entries: DataFrame) -> DataFrame:
    """Notes without entries or changed after their entries were made (entries of a note share one mtime)."""
    old = entries.groupBy("path").agg(F.min_by("mtime", "entry_id").alias("_old"))
    return notes.join(old, "path", "left").filter(F.col("_old").isNull() | (F.col("_old") < F.col("mtime"))).drop("_old")


def min_score(df: DataFrame, least: float, col: str = "score", strict: bool = False) -> DataFrame:
    return df.filter(F.col(col) > least if strict else F.col(col) >= least)


def model_gate(index: DataFrame, model: str) -> DataFrame:
    """The rows of one embedding model; a partition filter on written indexes."""
    return index.filter(F.col("model") == model)


def valid_messages(df: DataFrame) -> DataFrame:
    some = _any([F.length(F.coalesce(F.col(c), F.lit(""))) > 0 for c in ("content", "reasoning", "context")], False)
    return df.filter(F.col("role").isin("user", "assistant", "system", "tool_result") & some)


def numeric_vectors(df: DataFrame, col: str = "embedding") -> DataFrame:
    from notelake.functions.vectors import is_numeric

    return df.filter(is_numeric(F.col(col)))
