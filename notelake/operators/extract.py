"""Row-to-rows extraction from notes, pages, messages and model answers."""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from notelake.functions.text import fold

# Tag levels that say nothing on their own.
GENERIC_TAG_NODES = ("país", "países", "estilos", "géneros", "períodos", "estructuras", "región", "regiones", "tipo", "tipos", "categoría", "categorías")
# Front matter keys that hold a summary or an author, in order of preference.
SUMMARY_KEYS = ("resumen", "summary", "description", "abstract", "Resumen", "Summary")
AUTHOR_KEYS = ("autor", "Autor", "author", "Author")

FENCES = r"(?s)```.*?```|~~~.*?~~~"
FRONT = r"\A---\r?\n([\s\S]*?)\r?\n---"


def _distinct_in_order(values: Column, key=lambda x: x) -> Column:
    """First of each key, in order: each distinct key's first place, found once in the array of keys."""
    keys = F.transform(values, key)
    # Sorted by key and place, a value counts if the one before it has another key; then the places give the order back.
    placed = F.array_sort(F.zip_with(F.zip_with(keys, F.sequence(F.lit(0), F.greatest(F.size(keys) - 1, F.lit(0))), lambda k, i: F.struct(k.alias("k"), i.alias("i"))), values, lambda p, x: F.struct(p["k"].alias("k"), p["i"].alias("i"), x.alias("x"))))

    def first(rows: Column) -> Column:
        new = F.filter(rows, lambda r, j: (j == 0) | (F.get(rows, j - 1)["k"] != r["k"]))
        return F.transform(F.array_sort(F.transform(new, lambda r: F.struct(r["i"].alias("i"), r["x"].alias("x")))), lambda r: r["x"])

    return F.when(F.size(values) > 0, F.transform(F.array(placed), first)[0]).otherwise(values)


def _ordered_distinct_rows(df: DataFrame, id_cols: list[str], value: str, pos: str) -> DataFrame:
    """Rows with the first place of each value by id, numbered in order."""
    first = df.groupBy(*id_cols, value).agg(F.min(pos).alias("_p"))
    return first.withColumn("ord", F.row_number().over(W.partitionBy(*id_cols).orderBy("_p"))).drop("_p")


_STOP = re.compile(r"[.!?](?=[ \n]|\Z)")


def split_chunks(text: str, size: int, overlap: int) -> Iterator[tuple[int, int, str]]:
    """(start, end, trimmed text): pieces of about size characters that overlap.

    A piece ends after the last sentence end in its second half, else at its last blank, else where it is full. Sentence ends are found once a text; each
    cut looks them up by bisection.
    """
    n, start = len(text), 0
    stops = [m.start() for m in _STOP.finditer(text)] if n > size else []
    while start < n:
        end = min(start + size, n)
        if end < n:
            i = bisect.bisect_right(stops, end) - 1
            if i >= 0 and stops[i] >= start + size // 2:
                end = stops[i] + 1
            elif (gap := max(text.rfind(" ", start + 1, end + 1), text.rfind("\n", start + 1, end + 1))) > start:
                end = gap
        if body := text[start:end].strip():
            yield start, end, body
        if end >= n:
            return
        start = max(start + 1, end - overlap)


def chunk(notes: DataFrame, size: int = 1000, overlap: int = 150, path_col: str = "path", text_col: str = "content") -> DataFrame:
    """(path, ord, start, end, text): overlapping pieces of each note, by code points; a note is worked off in one task at a time."""

    def run(batches):
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = list(split_chunks(text or "", size, overlap))
                for at in range(0, len(rows), 4096):
                    part = rows[at : at + 4096]
                    cols = [pa.array([path] * len(part), pa.string()), pa.array(range(at, at + len(part)), pa.int32()), pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.int32()), pa.array([r[2] for r in part], pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, names=["path", "ord", "start", "end", "text"])

    return notes.select(F.col(path_col).cast("string"), F.col(text_col)).mapInArrow(run, "path string, ord int, start int, end int, text string")


def heading_list(content: Column) -> Column:
    """Structs level, text, offset of the ATX headings outside fenced code, in order.

    The text is cut in front of each heading, and lengths are summed up over the pieces: no line leaves its row.
    """
    parts = F.split(content, FENCES, -1)
    fences = F.regexp_extract_all(content, F.lit(f"({FENCES})"), F.lit(1))
    blank = lambda c: F.regexp_replace(c, r"[^\n]", " ")
    masked = F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(blank(F.get(fences, i)), F.lit("")))), "")
    heading = r"#{1,6}[ \t\x0B\f\r]+\S"
    pieces = F.split(masked, rf"(?:\A|(?<=\n))(?={heading})", -1)

    def step(acc: Column, p: Column) -> Column:
        line = F.substring_index(p, "\n", 1)
        row = F.struct(F.length(F.regexp_extract(line, "^(#+)", 1)).alias("level"), F.trim(F.regexp_extract(line, r"^#+\s+(.*)$", 1)).alias("text"), acc["at"].alias("offset"))
        return F.struct((acc["at"] + F.length(p)).alias("at"), F.when(p.rlike(rf"\A{heading}"), F.concat(acc["out"], F.array(row))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<level:int,text:string,offset:int>>").alias("out"))
    return F.aggregate(pieces, start, step, lambda acc: acc["out"])


def headings(notes: DataFrame) -> DataFrame:
    """(path, level, text, offset): ATX headings outside fenced code, with their offset in the text."""
    return notes.select("path", F.explode_outer(heading_list(F.col("content"))).alias("h")).filter("h is not null").select("path", "h.level", "h.text", "h.offset")


def heading_paths(ordered: Column) -> Column:
    """Structs offset, path of headings (structs level, text, offset, in order): the headings open there, joined by ' > '."""
    kind = "array<struct<offset:int,path:string>>"
    stack = "array<struct<level:int,text:string>>"

    def step(acc: Column, h: Column) -> Column:
        opened = F.concat(F.filter(acc["open"], lambda o: o["level"] < h["level"]), F.array(F.struct(h["level"].alias("level"), h["text"].alias("text"))))
        path = F.array_join(F.transform(opened, lambda o: o["text"]), " > ")
        return F.struct(opened.alias("open"), F.concat(acc["out"], F.array(F.struct(h["offset"].alias("offset"), path.alias("path")))).alias("out"))

    start = F.struct(F.array().cast(stack).alias("open"), F.array().cast(kind).alias("out"))
    return F.aggregate(ordered, start, step, lambda a: a["out"])


def heading_stack(found: DataFrame) -> DataFrame:
    """(path, offset, heading_path): at each heading, the headings open there, joined by ' > '; one closes all as deep or deeper."""
    folded = found.groupBy("path").agg(heading_paths(F.array_sort(F.collect_list(F.struct("offset", "level", "text")))).alias("hs"))
    return folded.select("path", F.explode("hs").alias("h")).select("path", "h.offset", F.col("h.path").alias("heading_path"))


def front_matter_entries(content: Column) -> Column:
    """The front matter's top-level entries in order: structs key, list (is it a list), values (as written, quotes included; none for a map), raw (what stands behind the key, null if nothing).

    The block is cut in front of each unindented key; what follows a key up to the next one is its own: a scalar, also folded, a literal block, a list in
    brackets, or lines with a dash, indented or not. Carriage returns at line ends and comments are left out; a scalar in quotes on one line stays as written.
    """
    block = F.regexp_replace(F.regexp_extract(content, FRONT, 1), r"\r(?=\n|\z)|(?dm)^[ \t]*#.*$\n?", "")
    sections = F.filter(F.split(block, r"\n(?=[^\s#\-][^\n:]*:(?:[ \t\n]|\z))"), lambda s: s.rlike(r"\A[^\s#\-][^\n:]*:(?:[ \t\n]|\z)"))

    def entry(s: Column) -> Column:
        key = F.regexp_replace(F.trim(F.regexp_extract(s, r"\A([^:\n]*):", 1)), r"^[\"']|[\"']$", "")
        first = F.trim(F.regexp_extract(s, r"\A[^:\n]*:([^\n]*)", 1))
        more = F.regexp_extract(s, r"\A[^\n]*\n([\s\S]*)", 1)
        whole = F.regexp_extract(first, r"""(?s)\A("(?:[^"\\]|\\.)*"|'(?:[^']|'')*')\s*(?:#.*)?\z""", 1)
        plain = F.when(whole != "", whole).otherwise(_uncommented(F.trim(F.regexp_replace(F.concat(first, F.lit(" "), more), r"\s+", " "))))
        flow = F.regexp_extract_all(F.regexp_extract(plain, r"\A\[(.*?)\]?\z", 1), F.lit(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,\s][^,]*)"""), F.lit(1))
        dashed = F.transform(F.regexp_extract_all(more, F.lit(r"(?m)^[ \t]*-[ \t]+(.+)$"), F.lit(1)), lambda x: _uncommented(F.trim(x)))
        literal = F.trim(F.regexp_replace(more, r"(?m)^[ \t]+", ""))
        none, one = F.array().cast("array<string>"), lambda x: F.array(x)
        is_block, is_flow, empty = first.rlike(r"\A[|>][0-9+-]*\z"), first.startswith("["), first.rlike(r"\A(?:#.*)?\z")
        is_dashed = empty & more.rlike(r"\A\s*-[ \t]")
        values = F.when(is_block, one(F.when(first.startswith("|"), literal).otherwise(F.replace(literal, F.lit("\n"), F.lit(" "))))).when(is_flow, flow).when(is_dashed, dashed).when(empty, none).otherwise(one(plain))
        return F.struct(key.alias("key"), (is_flow | is_dashed).alias("list"), values.alias("values"), F.when(~is_block & ~empty, first).alias("raw"))

    return F.transform(sections, entry)


def _uncommented(v: Column) -> Column:
    """A trimmed scalar without a comment behind it."""
    quoted = F.regexp_extract(v, r"""(?s)\A("(?:[^"\\]|\\.)*"|'(?:[^']|'')*')""", 1)
    return F.when(quoted != "", quoted).otherwise(F.trim(F.regexp_replace(v, r"(?s)(?:\A|\s)#.*\z", "")))


def _unquoted(value: Column) -> Column:
    """A YAML scalar without its quotes."""
    v = F.trim(value)
    double, single = v.rlike(r"(?s)\A\".*\"\z") & (F.length(v) > 1), v.rlike(r"(?s)\A'.*'\z") & (F.length(v) > 1)
    inner = F.substring(v, F.lit(2), F.length(v) - 2)
    return F.when(double, F.replace(inner, F.lit('\\"'), F.lit('"'))).when(single, F.replace(inner, F.lit("''"), F.lit("'"))).otherwise(v)


def _is_text(value: Column) -> Column:
    """Is a scalar as written text, rather than a number, a truth value, nothing, or a map."""
    v = F.trim(value)
    return v.rlike(r"\A[\"']") | ~v.rlike(r"(?is)\A(?:[+-]?[0-9][0-9_]*(?:\.[0-9]*)?(?:e[+-]?[0-9]+)?|true|false|null|~|)\z|\A[^\"']*:(?:\s.*)?\z")


def _values(entries: Column, key: str) -> Column:
    """The first entry of a key, null if there is none."""
    return F.get(F.filter(entries, lambda e: e["key"] == key), F.lit(0))


def front_matter_tags(entries: Column) -> Column:
    """Tags of the `tags` and `tag` ones of front_matter_entries(): list items or parts between commas that are text, without brackets and quotes."""
    own = F.flatten(F.transform(F.filter(entries, lambda e: e["key"].isin("tags", "tag")), lambda e: F.filter(e["values"], _is_text)))
    parts = F.flatten(F.transform(own, lambda v: F.split(F.regexp_replace(_unquoted(v), r"\A\[|\]\z", ""), ",")))
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(F.trim(p), r"^[\"']|[\"']$", "")), lambda p: p != "")


def tag_terms(content: Column, entries: Column, generic: tuple[str, ...] = GENERIC_TAG_NODES) -> Column:
    """The distinct leaves and path parts of a content's inline #tags and of the tags in its front_matter_entries(), sorted, generic levels left out."""
    inline = F.regexp_extract_all(content, F.lit(r"(?m)(?:^|\s)#([^\s#\[\]{}()<>\"',.!?;]+)"), F.lit(1))
    tags = F.transform(F.concat(inline, front_matter_tags(entries)), lambda t: F.regexp_replace(t, "^#+", ""))
    terms = F.transform(F.flatten(F.transform(tags, lambda t: F.split(t, "/"))), lambda p: F.trim(F.regexp_replace(p, "_", " ")))
    return F.array_sort(F.array_distinct(F.filter(terms, lambda t: (t != "") & ~F.lower(t).isin(*generic))))


def extract_tags(notes: DataFrame, generic: tuple[str, ...] = GENERIC_TAG_NODES) -> DataFrame:
    """(path, term): leaves and path parts of inline #tags and of the front matter's tags, generic levels left out."""
    rows = notes.select("path", "content", front_matter_entries(F.col("content")).alias("e"))
    # An outer generator keeps the optimizer from working out the terms once more to filter by them.
    return rows.select("path", F.explode_outer(tag_terms(F.col("content"), F.col("e"), generic)).alias("term")).filter("term is not null").distinct()


def front_matter_columns(entries: Column) -> dict[str, Column]:
    """summary, tags and author of front_matter_entries(); null where absent."""
    one = lambda key: _values(entries, key)
    first = lambda e: F.get(e["values"], F.lit(0))
    text = lambda e: F.when(~e["list"] & _is_text(first(e)), F.nullif(_unquoted(first(e)), F.lit("")))
    joined = lambda e: F.nullif(F.array_join(F.transform(e["values"], lambda v: F.trim(_unquoted(v))), ", "), F.lit(""))
    tags = one("tags")
    written = F.coalesce(tags["raw"], joined(tags))
    return {"summary": F.coalesce(*(text(one(k)) for k in SUMMARY_KEYS)), "tags": written, "author": F.coalesce(*(joined(one(k)) for k in AUTHOR_KEYS))}


def front_matter(notes: DataFrame) -> DataFrame:
    """(path, summary, tags, author) from the front matter's top level; null where absent.

    summary is the first text among SUMMARY_KEYS, author the first value or list among AUTHOR_KEYS, tags the entry as written (a list's items joined).
    """
    df = notes.select("path", front_matter_entries(F.col("content")).alias("e"))
    return df.select("path", *(c.alias(name) for name, c in front_matter_columns(F.col("e")).items()))


def highlight_row(content: Column, max_n: int = 24, max_chars: int = 2000) -> Column:
    """A struct n, highlights: ==marks==, then <mark> texts, outside front matter and code, distinct by lower case, joined and cut; null, or n 0, if there are none."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(content, r"(?m)\A---[\s\S]*?---\s*", ""), FENCES, "\n"), r"`[^`\n]*`", " ")

    def found(t: Column) -> Column:
        marks = F.regexp_extract_all(t, F.lit(r"==([^=\n].*?[^=\n])=="), F.lit(1))
        tags = F.transform(F.regexp_extract_all(t, F.lit(r"(?is)<mark\b[^>]*>(.*?)</mark>"), F.lit(1)), lambda x: F.regexp_replace(x, "<[^>]+>", ""))
        return F.filter(F.transform(F.concat(marks, tags), lambda x: F.trim(x)), lambda x: x != "")

    def joined(f: Column) -> Column:
        return F.struct(F.least(F.size(f), F.lit(max_n)).alias("n"), F.trim(F.substring(F.array_join(F.slice(f, 1, max_n), "\n"), 1, max_chars)).alias("highlights"))

    once = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  value is worked out once, not at each use
    marked = content.contains("==") | content.rlike("(?i)<mark")
    return F.when(marked, once(once(once(text, found), lambda f: _distinct_in_order(f, F.lower)), joined))


def highlights(notes: DataFrame, max_n: int = 24, max_chars: int = 2000) -> DataFrame:
    """(path, n, highlights): ==marks==, then <mark> texts, outside front matter and code, distinct by lower case, joined and cut."""
    row = highlight_row(F.col("content"), max_n, max_chars)
    # An outer generator keeps the optimizer from working out the row once more to filter by it.
    return notes.select("path", F.explode_outer(F.array(row)).alias("r")).filter("r.n > 0").select("path", "r.n", "r.highlights")


def extract_links(df: DataFrame, id_cols: list[str], text_col: str) -> DataFrame:
    """(id, url, label): targets of Markdown links, then bare URLs; closing punctuation cut; distinct, in order."""
    links = F.regexp_extract_all(text_col, F.lit(r"(?i)\[[^\]]+\]\((https?://[^)\s]+)\)"), F.lit(1))
    bare = F.regexp_extract_all(text_col, F.lit(r"(?i)(https?://[^\s<>\"']+)"), F.lit(1))
    rows = df.select(*id_cols, F.posexplode(F.concat(links, bare)).alias("pos", "raw")).withColumn("url", F.regexp_replace("raw", r"[)\].,;:!?]+$", ""))
    rows = _ordered_distinct_rows(rows.filter(F.col("url").rlike("(?i)^https?://.")), id_cols, "url", "pos")
    return rows.withColumn("label", F.regexp_replace(F.regexp_extract("url", r"(?i)^https?://(?:[^/?#@]*@)?([^/:?#]+)", 1), r"^www\.", ""))


def tool_calls(messages: DataFrame, id_cols: list[str], text_col: str = "content", most: int = 200_000) -> DataFrame:
    """(ids, ord, skill, params, problem): <call:skill>{json}</call> with braces balanced outside strings; problem names a reject.

    Brace balance is no regular language, so this runs in Arrow batches. Texts over `most` characters are refused.
    """
    kinds = dict(messages.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in id_cols) + ", ord int, skill string, params string, problem string"

    def parse(text: str) -> list[tuple]:
        if len(text) > most:
            return [(None, None, "too long")]
        out, at = [], 0
        while (open_ := text.find("<call:", at)) >= 0:
            close = text.find(">", open_)
            if close < 0:
                break
            skill, i = text[open_ + 6 : close].strip(), close + 1
            while i < len(text) and text[i].isspace():
                i += 1
            at = close + 1
            if i >= len(text) or text[i] != "{":
                out.append((skill, None, "no object"))
                continue
            depth, quoted, j = 0, False, i
            while j < len(text):
                c = text[j]
                if quoted:
                    j += c == "\\"
                    quoted = c != '"'
                elif c == '"':
                    quoted = True
                elif c in "{}":
                    depth += 1 if c == "{" else -1
                    if not depth:
                        break
                j += 1
            body = text[i : j + 1]
            if depth or not text[j + 1 :].lstrip().startswith("</call>"):
                out.append((skill, None, "not closed"))
                continue
            at = j + 1
            try:
                json.loads(body)
                out.append((skill, body, None))
            except ValueError:
                out.append((skill, body, "bad json"))
        return out

    def run(batches):
        for batch in batches:
            rows = [(r, i, *call) for r, text in enumerate(batch.column(len(id_cols)).to_pylist()) for i, call in enumerate(parse(text or ""))]
            take = pa.array([r[0] for r in rows], pa.int64())
            cols = [batch.column(i).take(take) for i in range(len(id_cols))]
            cols += [pa.array([r[1] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.string()) for k in (2, 3, 4))]
            yield pa.RecordBatch.from_arrays(cols, names=[*id_cols, "ord", "skill", "params", "problem"])

    return messages.select(*id_cols, text_col).mapInArrow(run, schema)


def tool_params(calls: DataFrame, fields: dict[str, tuple[str, str]], id_cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of tool_calls(): (ids, ord, skill, fields) with typed values of the parameters, and (ids, ord, skill, problem) of the calls that can't be run.

    fields maps a column to a path in the parameters and its type. Parameters are parsed once to a variant; a path that isn't there, or a value that can't
    be cast, is null. Text that is no JSON is a reject, whatever tool_calls() said of it.
    """
    parsed = calls.withColumn("_v", F.try_parse_json("params"))
    fine = F.col("problem").isNull() & F.col("_v").isNotNull()
    values = [F.try_variant_get("_v", path, kind).alias(name) for name, (path, kind) in fields.items()]
    rejects = parsed.filter(~fine).select(*id_cols, "ord", "skill", F.coalesce("problem", F.lit("bad json")).alias("problem"))
    return parsed.filter(fine).select(*id_cols, "ord", "skill", *values), rejects


def claims(reports: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, ord, claim, verdict, source, note, class) of fact-check reports in which each claim has bold section names."""
    blocks = reports.select(id_col, F.posexplode(F.split(text_col, r"(?i)\*\*Claim:\*\*", -1)).alias("ord", "block")).filter("ord > 0").withColumn("block", F.trim("block"))
    part = lambda name, until: F.trim(F.regexp_extract("block", rf"(?is)\*\*{name}:\*\*(.*?)(?=\*\*{until}:\*\*|\z)" if until else rf"(?is)\*\*{name}:\*\*(.*)", 1))
    out = blocks.select(id_col, "ord", F.trim(F.split("block", r"(?i)\*\*Verdict:\*\*", 2)[0]).alias("claim"), part("Verdict", "Source").alias("verdict"), part("Source", "Note").alias("source"), part("Note", None).alias("note"))
    v = F.lower("verdict")
    return out.withColumn("class", F.when(v.contains("inaccurate"), "inaccurate").when(v.contains("accurate"), "accurate").when(v.contains("unverifiable"), "unverifiable"))


def parse_tag_lines(responses: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, ord, tag): one tag a line, bullets, numbers and decoration off; lines with blanks inside are dropped."""
    rows = responses.select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias("ord", "line"))
    tag = F.regexp_replace(F.trim("line"), r"^\s*(?:\d+\.|[-*])\s+", "")
    tag = F.regexp_replace(F.regexp_replace(tag, r"^[\s_*`\"'\[\]()#]+", ""), r"[\s_*`\"'\[\]()]+$", "")
    return rows.select(id_col, "ord", tag.alias("tag")).filter((F.col("tag") != "") & ~F.col("tag").contains(" "))


def parse_anchored(responses: DataFrame, terms: DataFrame) -> DataFrame:
    """(batch, idx, term, translation): lines like `t3 -> text` mapped to the terms of the batch; a term without line stands for itself."""
    lines = responses.select("batch", F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
    rx = r"t\s*(\d+)\s*(?:->|=>|:|=)\s*(.*)"
    got = lines.filter(F.col("line").rlike(rx)).select("batch", "no", F.regexp_extract("line", rx, 1).cast("int").alias("idx"), F.regexp_extract("line", rx, 2).alias("x"))
    x = F.regexp_replace(F.regexp_replace(F.trim("x"), r"^[\s_*`\"'\[\]()]+|[\s_*`\"'\[\]()]+$", ""), "[.,;]+$", "")
    got = got.withColumn("x", x).filter("x <> ''").groupBy("batch", "idx").agg(F.max_by("x", "no").alias("x"))
    return terms.join(got, ["batch", "idx"], "left").select("batch", "idx", "term", F.coalesce("x", "term").alias("translation"))


def cited_paths(passages: DataFrame) -> DataFrame:
    """(turn, ord, path): notes named as `[From path (heading)]:` in passages, distinct, in order."""
    path = F.regexp_extract("text", r"\[From ([^\]]+?)(?: \([^\]]*\))?\]:", 1)
    return _ordered_distinct_rows(passages.select("turn", "rank", path.alias("path")).filter("path <> ''"), ["turn"], "path", "rank")


def decode_stream_chunks(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stream, content, reasoning) joined in order, and (stream, idx, name, arguments) assembled from tool-call fragments."""
    get = lambda *paths: F.coalesce(*(F.get_json_object("chunk", p) for p in paths), F.lit(""))
    content = get("$.message.content", "$.choices[0].delta.content", "$.delta.text", "$.candidates[0].content.parts[0].text")
    reasoning = get("$.choices[0].delta.reasoning_content", "$.choices[0].delta.reasoning", "$.message.reasoning", "$.message.thinking")
    rows = log.select("stream", "seq", content.alias("content"), reasoning.alias("reasoning"))
    in_order = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col(c).alias("v")))), lambda x: x["v"]), "")
    texts = rows.groupBy("stream").agg(in_order("content").alias("content"), in_order("reasoning").alias("reasoning"))
    call = "array<struct<index:int,function:struct<name:string,arguments:string>>>"
    parts = F.coalesce(F.get_json_object("chunk", "$.choices[0].delta.tool_calls"), F.get_json_object("chunk", "$.message.tool_calls"))
    calls = log.select("stream", "seq", F.posexplode(F.from_json(parts, call)).alias("at", "f")).select("stream", "seq", F.coalesce("f.index", "at").alias("idx"), F.coalesce("f.function.name", F.lit("")).alias("name"), F.coalesce("f.function.arguments", F.lit("")).alias("arguments"))
    return texts, calls.groupBy("stream", "idx").agg(in_order("name").alias("name"), in_order("arguments").alias("arguments"))


def relevant_passages(docs: DataFrame, query: str, k: int = 3, id_col: str = "doc_id", text_col: str = "text", border: str = "\n\n+") -> DataFrame:
    """(id, rank, text, hits): paragraphs over 30 characters by the number of query words over 3 characters that they hold."""
    terms = [t for t in query.lower().split() if len(t) > 3]
    rows = docs.select(id_col, F.posexplode(F.split(text_col, border, -1)).alias("pos", "p")).filter(F.length(F.trim("p")) > 30)
    hits = sum((F.lower("p").contains(t).cast("int") for t in terms), F.lit(0))
    rows = rows.select(id_col, "pos", F.trim("p").alias("text"), hits.alias("hits")).filter("hits > 0")
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy(id_col).orderBy(F.desc("hits"), "pos")))
    return ranked.filter(F.col("rank") <= k).select(id_col, "rank", "text", "hits")


def entry_text(entries: DataFrame, prefix: str = "") -> DataFrame:
    """entries (basename, entry_type, heading_path, tags_text, summary_text, author, highlights_text, text) with what is embedded of each."""
    tags = F.when(F.coalesce("tags_text", F.lit("")) != "", F.concat(F.lit("[Tags: "), "tags_text", F.lit("]\n"))).otherwise("")
    head = F.when(F.coalesce("heading_path", F.lit("")) != "", F.concat(F.lit(" > "), "heading_path")).otherwise("")
    content = F.concat(F.lit(prefix), "basename", head, F.lit("\n"), tags, "text")
    named = lambda label, col: F.when(F.coalesce(col, F.lit("")) != "", F.concat(F.lit(label), col))
    summary = F.concat(F.lit(prefix), F.concat_ws("\n", "basename", "summary_text", named("Temas: ", "tags_text"), named("Autor: ", "author")))
    marked = F.concat(F.lit(prefix), F.concat_ws("\n", "basename", F.lit("Highlights:"), "highlights_text"))
    return entries.withColumn("embed_text", F.when(F.col("entry_type") == "summary", summary).when(F.col("entry_type") == "highlights", marked).otherwise(content))


def fold_tags(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(f"{col}_key", fold(F.col(col)))
