"""Queries on sources, predicates, extraction, tags and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelake.functions import dates, text, vectors
from notelake.functions.embed import embed, letter_counts
from notelake.operators import aggregates, dom, extract, predicates, tags
from notelake.plans.base import LETTERS, entries, query, scratch, view
from notelake.sources import conversations, index, notes

W = r"[\s]"
FOLD = "regexp_replace(strip_accents(lower({})), '[̀-ͯ]', '', 'g')"


# --- sources and sinks


@query("a1_scan_notes", "SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, concat(coalesce(text, ''), chr(10)) AS content FROM documents")
def a1(spark, d):
    path = scratch(spark)
    notes.write_notes(view(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("content")), path, "doc_id")
    return notes.scan_notes(spark, path).select(F.regexp_extract("path", r"(-?\d*)-\d+\.md$", 1).try_cast("long").alias("doc_id"), "size", "content")


@query("a2_attach_extracted_text", "SELECT path, mtime, substr(html, 1, 10000) AS content FROM plain_notes JOIN pages ON page_id = mtime", "plain_notes")
def a2(spark, d):
    extracted = view(spark, d, "pages").join(view(spark, d, "plain_notes").select("path", "mtime"), F.col("page_id") == F.col("mtime")).select("path", F.col("html").alias("text"))
    return notes.attach_extracted_text(view(spark, d, "plain_notes").drop("content"), extracted, 5000).select("path", "mtime", "content")


@query("a3_write_index", "SELECT model, count(*) AS n, sum(entry_id) AS ids FROM entries GROUP BY model", "entries")
def a3(spark, d):
    path = scratch(spark)
    index.write_index(entries(spark, d), path)
    return index.load_index(spark, path).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("entry_id").alias("ids"))


@query(
    "a4_load_index",
    "SELECT path, chunk_start AS \"chunkStart\", CASE WHEN chunk_start = 0 AND chunk_end = 0 THEN 'summary' ELSE 'content' END AS \"entryType\", embedding[1] AS first_value FROM entries WHERE entry_id % 7 <> 0",
    "entries",
)
def a4(spark, d):
    raw = F.to_binary(F.array_join(F.transform("embedding", lambda x: F.lpad(F.hex(F.when(x < 0, x.cast("int") + 256).otherwise(x.cast("int"))), 2, "0")), ""), F.lit("hex"))
    e = F.struct(
        F.when(F.col("entry_id") % 7 != 0, F.col("path")).alias("path"), F.col("chunk_start").alias("chunkStart"), F.col("chunk_end").alias("chunkEnd"), F.base64(raw).alias("embedding"), F.col("mtime"), F.col("chunk_hash").alias("chunkHash"),
        F.lit(None).cast("string").alias("entryType"), F.col("summary_text").alias("summaryText"), F.col("tags_text").alias("tagsText"), F.col("highlights_text").alias("highlightsText"), F.col("heading_path").alias("headingPath"),
    )
    path = scratch(spark)
    entries(spark, d).groupBy("model", F.floor(F.col("entry_id") / 5000).cast("int").alias("shard")).agg(F.collect_list(e).alias("entries")).write.json(path)
    return index.load_json_shards(spark, path, one_a_file=False).select("path", "chunkStart", "entryType", F.col("embedding")[0].alias("first_value"))


@query("a5_verify_shards", "SELECT count(*) AS shards, max(n) AS total, count(*) = max(n) AND count(DISTINCT s) = max(n) AND min(s) = 0 AND max(s) = max(n) - 1 AS ok FROM (SELECT DISTINCT CAST(n_nationkey AS INT) AS s, (SELECT CAST(count(*) AS INT) FROM nation) AS n FROM nation)")
def a5(spark, d):
    n = view(spark, d, "nation")
    shards = n.select(F.col("n_nationkey").cast("int").alias("shard"), F.lit("m").alias("model")).crossJoin(n.agg(F.count(F.lit(1)).cast("int").alias("total")))
    return index.verify_shards(shards, "m")


# Sets of three shards by order: whole, one missing, one twice, totals that differ, another model, no number, one too many.
_SETS = """SELECT o_orderkey AS shard_set, CASE WHEN o_orderkey % 7 = 2 AND s = 2 THEN 1 WHEN o_orderkey % 7 = 5 AND s = 1 THEN NULL ELSE s END AS shard, CASE WHEN o_orderkey % 7 = 3 AND s = 1 THEN 4 ELSE 3 END AS total, CASE WHEN o_orderkey % 7 = 4 AND s = 0 THEN 'x' ELSE 'm' END AS model
  FROM orders, (SELECT 0 AS s UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) AS n WHERE (s < 3 OR o_orderkey % 7 = 6) AND NOT (o_orderkey % 7 = 1 AND s = 1)"""


@query("a5_verify_shard_sets", "SELECT o_orderkey AS shard_set, CAST(CASE o_orderkey % 7 WHEN 1 THEN 2 WHEN 6 THEN 4 ELSE 3 END AS BIGINT) AS shards, CASE WHEN o_orderkey % 7 = 3 THEN 4 ELSE 3 END AS total, o_orderkey % 7 = 0 AS ok FROM orders")
def a5_sets(spark, d):
    return index.verify_shards(spark.sql(_SETS.replace("FROM orders", "FROM {orders}"), orders=view(spark, d, "orders")), "m", keys=("shard_set",))


@query("a6_tag_index", "SELECT tag, ord FROM tags", "tags")
def a6(spark, d):
    path = scratch(spark)
    index.write_keyed_index(view(spark, d, "tags"), path, "m1")
    return index.load_index(spark, path, "m1").select("tag", "ord")


@query(
    "a7_manual_index",
    "SELECT path, content, CAST(3 * mtime % 100 AS TINYINT) AS first_value FROM plain_notes WHERE floor(mtime / 100) % 3 <> 2 AND content <> ''",
    "plain_notes",
)
def a7(spark, d):
    # Files of a hundred notes, as bare arrays, as objects of the model and as objects of another.
    path, form = scratch(spark), F.floor(F.col("part") % 3)
    first = (3 * F.col("mtime") % 100).cast("double") / 127
    chunk = F.struct("path", "content", F.when(F.col("mtime") % 2 == 0, F.to_json(F.array(first))).otherwise(F.base64(F.to_binary(F.lpad(F.hex((3 * F.col("mtime") % 100).cast("int")), 2, "0"), F.lit("hex")))).alias("embedding"))
    files = view(spark, d, "plain_notes").groupBy(F.floor(F.col("mtime") / 100).alias("part")).agg(F.collect_list(chunk).alias("chunks"))
    files.select(F.when(form == 0, F.to_json("chunks")).otherwise(F.to_json(F.struct(F.when(form == 1, "m1").otherwise("m0").alias("model"), "chunks"))).alias("value")).write.text(path)
    found, stored = index.load_manual_json(spark, path, "m1", one_a_file=False), scratch(spark)
    index.write_keyed_index(found, stored, "m1")
    return index.load_index(spark, stored, "m1").select("path", "content", F.col("embedding")[0].alias("first_value"))


@query("a8_allowed_tags", "SELECT lower(regexp_replace(trim(line), '^#+', '')) AS tag FROM (SELECT unnest(string_split(concat('## ', source, chr(10), '// no', chr(10), chr(10), '  #', lang, '/', doc_id), chr(10))) AS line FROM documents) WHERE regexp_replace(trim(line), '^#+', '') <> '' AND NOT starts_with(regexp_replace(trim(line), '^#+', ''), '//')")
def a8(spark, d):
    lines = view(spark, d, "documents").select(F.concat(F.lit("## "), "source", F.lit("\n// no\n\n  #"), "lang", F.lit("/"), "doc_id").alias("value"))
    path = scratch(spark)
    lines.write.text(path)
    return notes.load_allowed_tags(spark, path)


@query("a9_load_conversations", "SELECT CAST(conv_id AS VARCHAR) AS id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS turn, role, content FROM messages WHERE content <> '' OR reasoning <> ''", "messages")
def a9(spark, d):
    path = scratch(spark)
    conversations.write_conversations(view(spark, d, "messages").withColumns({"id": F.col("conv_id").cast("string"), "title": F.lit(None).cast("string"), "timestamp": F.lit(0).cast("long")}), path)
    return conversations.load_conversations(spark, path).select("id", "turn", "role", "content")


@query(
    "a10_export_markdown",
    "SELECT conv_id, string_agg(concat('**', CASE role WHEN 'user' THEN 'You' ELSE 'Assistant' END, '**:', chr(10), CASE WHEN reasoning <> '' THEN concat('> [!thought]', chr(10), '> ', replace(reasoning, chr(10), concat(chr(10), '> ')), chr(10), chr(10)) ELSE '' END, content, chr(10)), concat(chr(10), '---', chr(10), chr(10)) ORDER BY turn) AS markdown FROM messages WHERE role <> 'system' GROUP BY conv_id",
    "messages",
)
def a10(spark, d):
    from notelake.operators.conversations import export_markdown

    return export_markdown(view(spark, d, "messages"))


@query("a11_translations", "SELECT p_name AS term, concat(p_name, ', ', min(p_type)) AS translation FROM part GROUP BY p_name")
def a11(spark, d):
    path = scratch(spark)
    notes.write_translations(view(spark, d, "part").groupBy(F.col("p_name").alias("term")).agg(F.concat("p_name", F.lit(", "), F.min("p_type")).alias("translation")), path)
    return notes.load_translations(spark, path)


# --- predicates


@query("b1_filter_globs", "SELECT path FROM plain_notes WHERE (regexp_matches(path, '^src1[^/]*/(.*/)?[^/]*[.]md$') OR regexp_matches(path, '^[^/]*/(de|fr)/[^/]*$')) AND NOT regexp_matches(path, '^.*7[.]md$')", "plain_notes")
def b1(spark, d):
    return predicates.filter_globs(view(spark, d, "plain_notes"), "src1*/**/*.md, */{de,fr}/*", "**7.md").select("path")


@query("b2_filter_scope", "SELECT entry_id, path FROM entries WHERE path LIKE 'src1/%' OR path LIKE 'src2/en/%' OR path = 'src3/en/3.md'", "entries")
def b2(spark, d):
    return predicates.filter_scope(entries(spark, d), ["src3/en/3.md"], ["src1", "src2/en/"]).select("entry_id", "path")


@query("b3_notes_in_folders", "SELECT DISTINCT path FROM plain_notes WHERE path LIKE 'src5/%' OR path LIKE 'src5/en/%' OR path LIKE 'src6/de/%'", "plain_notes")
def b3(spark, d):
    return predicates.notes_in_folders(view(spark, d, "plain_notes"), ["src5", "src5/en", "src6/de"]).select("path")


@query("b4_exclude_prefixes", "SELECT entry_id FROM entries WHERE NOT (path LIKE 'src1%' OR path LIKE 'src2/e%')", "entries")
def b4(spark, d):
    return predicates.exclude_prefixes(entries(spark, d), "src1, src2/e").select("entry_id")


@query("b5_drop_blank", "SELECT doc_id FROM documents WHERE regexp_matches(regexp_replace(text, '[a-z ]', '', 'g'), '[^ \\t\\n\\r\\f\\v]')")
def b5(spark, d):
    return predicates.drop_blank(view(spark, d, "documents").withColumn("rest", F.regexp_replace("text", "[a-z ]", "")), "rest").select("doc_id")


@query("b6_needs_reindex", "SELECT n.path FROM plain_notes n LEFT JOIN (SELECT path, min(mtime) AS m FROM entries GROUP BY path) e USING (path) WHERE m IS NULL OR m < n.mtime + CASE WHEN n.mtime % 3 = 0 THEN 1 ELSE 0 END", "plain_notes", "entries")
def b6(spark, d):
    n = view(spark, d, "plain_notes").withColumn("mtime", F.col("mtime") + F.when(F.col("mtime") % 3 == 0, 1).otherwise(0))
    return predicates.needs_reindex(n, entries(spark, d)).select("path")


@query("b7_min_score", "SELECT event_id FROM events WHERE value >= 5.5")
def b7(spark, d):
    return predicates.min_score(view(spark, d, "events"), 5.5, "value").select("event_id")


@query("b8_model_gate", "SELECT entry_id FROM entries WHERE model = 'new'", "entries")
def b8(spark, d):
    return predicates.model_gate(entries(spark, d), "new").select("entry_id")


@query("b9_valid_messages", "SELECT conv_id, turn FROM tool_messages WHERE role IN ('user', 'assistant', 'system', 'tool_result') AND turn % 5 <> 0 AND content <> ''", "tool_messages")
def b9(spark, d):
    m = view(spark, d, "tool_messages").withColumns({"content": F.when(F.col("turn") % 5 != 0, F.col("content")), "reasoning": F.lit(None).cast("string"), "context": F.lit("")})
    return predicates.valid_messages(m).select("conv_id", "turn")


@query("b10_numeric_vectors", "SELECT vec_id FROM embeddings WHERE vec_id % 6 NOT IN (0, 1)")
def b10(spark, d):
    bad = F.when(F.col("vec_id") % 6 == 0, F.lit(float("nan"))).when(F.col("vec_id") % 6 == 1, F.lit(None)).otherwise(F.lit(1.0))
    e = view(spark, d, "embeddings").withColumn("embedding", F.concat(F.transform("embedding", lambda x: x.cast("double")), F.array(bad)))
    return predicates.numeric_vectors(e).select("vec_id")


# --- extraction


# A step for each chunk: the last sentence end in the second half, else the last blank, else full; ends count from the text's start.
_CHUNKS = r"""SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY s) - 1 AS INT) AS ord, CAST(s AS INT) AS start, CAST(e AS INT) AS "end", body AS text FROM (
  WITH RECURSIVE c AS (
    SELECT path, content, len(content) AS n, CAST(0 AS BIGINT) AS s, CAST(NULL AS BIGINT) AS e FROM plain_notes WHERE len(content) > 0
    UNION ALL
    SELECT path, content, n, CASE WHEN e IS NULL THEN s ELSE greatest(s + 1, e - 150) END, CASE WHEN e IS NOT NULL THEN NULL WHEN s + 1000 >= n THEN n ELSE
      coalesce(s + 500 + nullif(len(regexp_extract(substr(content, s + 501, 502), CASE WHEN s + 1001 >= n THEN '(?s)^(.*[.!?])(?:[ 
]|$)' ELSE '(?s)^(.*[.!?])[ 
]' END, 1)), 0), s + 1 + len(nullif(regexp_extract(substr(content, s + 2, 1000), '(?s)^(.*[ 
])', 1), '')) - 1, s + 1000) END
    FROM c WHERE e IS NULL OR e < n)
  SELECT path, s, e, trim(substr(content, s + 1, e - s), {blank}) AS body FROM c WHERE e IS NOT NULL) WHERE body <> ''"""


CHUNKS = _CHUNKS.format(blank="concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13), chr(28), chr(29), chr(30), chr(31), chr(133), chr(160), chr(5760), chr(8192), chr(8193), chr(8194), chr(8195), chr(8196), chr(8197), chr(8198), chr(8199), chr(8200), chr(8201), chr(8202), chr(8232), chr(8233), chr(8239), chr(8287), chr(12288))")


@query("c1_chunk", CHUNKS, "plain_notes")
def c1(spark, d):
    return extract.chunk(view(spark, d, "plain_notes"))


_LINES = """lines AS (SELECT path, unnest(string_split(m, chr(10))) AS line, generate_subscripts(string_split(m, chr(10)), 1) AS no FROM
  (SELECT path, replace(content, concat('```', chr(10), '# no heading', chr(10), '```'), concat('   ', chr(10), '            ', chr(10), '   ')) AS m FROM notes)),
heads AS (SELECT path, CAST(len(regexp_extract(line, '^(#+)', 1)) AS INT) AS level, trim(regexp_extract(line, '^#+\\s+(.*)$', 1)) AS text, CAST(o AS INT) AS "offset" FROM
  (SELECT *, coalesce(sum(len(line) + 1) OVER (PARTITION BY path ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM lines) WHERE regexp_matches(line, '^#{1,6}\\s+\\S'))"""


@query("c2_headings", f"SELECT * FROM (WITH {_LINES} SELECT * FROM heads)", "notes")
def c2(spark, d):
    return extract.headings(view(spark, d, "notes"))


@query(
    "c3_heading_path",
    f"SELECT * FROM (WITH {_LINES} SELECT h.path, h.\"offset\", (SELECT string_agg(a.text, ' > ' ORDER BY a.\"offset\") FROM heads a WHERE a.path = h.path AND a.\"offset\" <= h.\"offset\" AND (a.\"offset\" = h.\"offset\" OR a.level < (SELECT min(b.level) FROM heads b WHERE b.path = a.path AND b.\"offset\" > a.\"offset\" AND b.\"offset\" <= h.\"offset\"))) AS heading_path FROM heads h)",
    "notes",
)
def c3(spark, d):
    return extract.heading_stack(extract.headings(view(spark, d, "notes")))


@query(
    "c4_extract_tags",
    """SELECT DISTINCT path, trim(replace(part, '_', ' ')) AS term FROM (SELECT path, unnest(string_split(tag, '/')) AS part FROM (SELECT path, unnest(list_concat(
      list_transform(regexp_extract_all(content, '(?m)(?:^|\\s)#([^\\s#\\[\\]{}()<>"'',.!?;]+)', 1), lambda x: x), list_transform(string_split(regexp_replace(regexp_extract(content, '(?m)^tags?:[ \\t]*(.*)$', 1), '[\\[\\]]', '', 'g'), ','), lambda x: trim(x)))) AS tag FROM notes))
      WHERE trim(replace(part, '_', ' ')) <> '' AND lower(trim(replace(part, '_', ' '))) NOT IN ('país', 'países', 'estilos', 'géneros', 'períodos', 'estructuras', 'región', 'regiones', 'tipo', 'tipos', 'categoría', 'categorías')""",
    "notes",
)
def c4(spark, d):
    return extract.extract_tags(view(spark, d, "notes"))


@query("c5_front_matter", "SELECT path, nullif(trim(regexp_extract(content, 'summary: \"([^\"]*)\"', 1)), '') AS summary, regexp_extract(content, '(?m)^tags: (.*)$', 1) AS tags, regexp_extract(content, '(?m)^author: (.*)$', 1) AS author FROM notes", "notes")
def c5(spark, d):
    return extract.front_matter(view(spark, d, "notes")).withColumn("summary", F.nullif(F.trim("summary"), F.lit("")))


@query("c6_highlights", "SELECT path, CAST(2 AS INT) AS n, concat('mark ', mtime % 5, chr(10), 'last one') AS highlights FROM notes", "notes")
def c6(spark, d):
    return extract.highlights(view(spark, d, "notes"))


@query(
    "c7_extract_links",
    "SELECT path, concat('http://www.example.com/', mtime, '?q=1') AS url, CAST(1 AS INT) AS ord, 'example.com' AS label FROM notes UNION ALL SELECT path, concat('http://ex', mtime % 9, '.org/a'), 2, concat('ex', mtime % 9, '.org') FROM notes",
    "notes",
)
def c7(spark, d):
    return extract.extract_links(view(spark, d, "notes"), ["path"], "content")


@query("c8_tool_calls", "SELECT conv_id, turn, CAST(0 AS INT) AS ord, role AS skill, concat('{\"a\": {\"t\": \"}', turn, '\"}}') AS params, CAST(NULL AS VARCHAR) AS problem FROM messages UNION ALL SELECT conv_id, turn, 1, 'open', NULL, 'not closed' FROM messages", "messages")
def c8(spark, d):
    m = view(spark, d, "messages").withColumn("content", F.concat(F.lit("x <call:"), "role", F.lit('> {"a": {"t": "}'), "turn", F.lit('"}} </call> y <call:open>{"b": 1')))
    return extract.tool_calls(m, ["conv_id", "turn"])


def _called(spark, d):
    m = view(spark, d, "messages")
    call = F.concat(F.lit('a <call:find> {"q": "{"'), F.lit(', "n": '), "turn", F.lit(', "in": [{"path": "'), "role", F.lit('.md"}], "half": '), F.col("conv_id") / 2, F.lit('}</call> b <call:x>{"q": bad}</call> <call:last>{'))
    return extract.tool_params(extract.tool_calls(m.withColumn("content", call), ["conv_id", "turn"]), {"q": ("$.q", "string"), "n": ("$.n", "int"), "path": ("$.in[0].path", "string"), "half": ("$.half", "double"), "none": ("$.in[1].path", "string"), "odd": ("$.q", "int")}, ["conv_id", "turn"])


@query("c8_tool_params", "SELECT conv_id, turn, CAST(0 AS INT) AS ord, 'find' AS skill, '{' AS q, CAST(turn AS INT) AS n, concat(role, '.md') AS path, conv_id / 2.0::DOUBLE AS half, CAST(NULL AS VARCHAR) AS none, CAST(NULL AS INT) AS odd FROM messages", "messages")
def c8_params(spark, d):
    return _called(spark, d)[0]


@query("c8_tool_rejects", "SELECT conv_id, turn, CAST(o AS INT) AS ord, s AS skill, p AS problem FROM messages, (SELECT 1 AS o, 'x' AS s, 'bad json' AS p UNION ALL SELECT 2, 'last', 'not closed') AS r", "messages")
def c8_rejects(spark, d):
    return _called(spark, d)[1]


@query(
    "c9_claims",
    "SELECT id, CAST(1 AS INT) AS ord, trim(split_part(split_part(text, '**Claim:**', 2), '**Verdict:**', 1), concat(' ', chr(10))) AS claim, trim(split_part(split_part(text, '**Verdict:**', 2), '**Source:**', 1), concat(' ', chr(10))) AS verdict, trim(split_part(split_part(text, '**Source:**', 2), '**Note:**', 1), concat(' ', chr(10))) AS source, concat('n', id) AS note, CASE id % 3 WHEN 0 THEN 'inaccurate' WHEN 1 THEN 'accurate' ELSE 'unverifiable' END AS class FROM reports UNION ALL SELECT id, 2, trim(split_part(text, '**claim:**', 2)), '', '', '', NULL FROM reports",
    "reports",
)
def c9(spark, d):
    out = extract.claims(view(spark, d, "reports"))
    strip = lambda c: F.regexp_replace(c, r"\A[ \n]+|[ \n]+\z", "")
    return out.withColumns({c: strip(F.col(c)) for c in ("claim", "verdict", "source", "note")})


# A paragraph ends at the next block's start and at the article's end, so an end tag is put in front of each; the given articles hold no other nesting.
_MAIN_TEXT = r"""substr(trim(array_to_string(list_transform(list_filter(list_transform(regexp_extract_all(regexp_replace(concat(regexp_extract(html, '(?is)<article\b[^>]*>(.*?)</article>', 1), '</p>'), '(?i)<(p|h[1-6]|div|ul|ol|table)\b', '</p><\1', 'g'), '(?is)(<(?:h[123]|p)\b[^>]*>.*?)</(?:h[123]|p)>', 1),
      lambda x: {'h': lower(x[1:2]) = '<h', 't': trim(regexp_replace(replace(regexp_replace(x, '<[^>]+>', '', 'g'), '&quot;', chr(34)), '&amp;?', '&', 'g'), concat(' ', chr(10), chr(9), chr(13)))}), lambda x: len(x.t) > 15), lambda x: CASE WHEN x.h THEN concat(chr(10), '### ', x.t, chr(10)) ELSE x.t END), concat(chr(10), chr(10))), concat(' ', chr(10))), 1, 8000)"""


@query("c10_main_text", f"SELECT page_id, {_MAIN_TEXT} AS text FROM pages")
def c10(spark, d):
    return dom.main_text(view(spark, d, "pages"))


@query(
    "c10_main_text_nested",
    """SELECT page_id, CASE page_id % 5
        WHEN 0 THEN concat('Lead paragraph number ', page_id, chr(10), chr(10), 'Outer paragraph behind the inner block')
        WHEN 1 THEN concat('### Heading of page ', page_id, ' with bold', chr(10), chr(10), chr(10), 'Unclosed paragraph one', chr(10), chr(10), 'Unclosed paragraph two')
        WHEN 2 THEN concat('First article, inner story ', page_id, chr(10), chr(10), 'First article, after the inner one')
        WHEN 3 THEN concat('Main part says A & B < ', page_id)
        ELSE concat('No root here, paragraph ', page_id) END AS text FROM nested_pages""",
    "nested_pages",
)
def c10_nested(spark, d):
    return dom.main_text(view(spark, d, "nested_pages"))


@query("c11_parse_tag_lines", "SELECT id, CAST(0 AS INT) AS ord, regexp_extract(text, '#([a-z0-9]+)', 1) AS tag FROM answers UNION ALL SELECT id, 1, regexp_extract(text, '[*]([a-z]+)[*]', 1) FROM answers UNION ALL SELECT id, 4, regexp_extract(text, '\\[([a-z]+_[0-9])\\]', 1) FROM answers", "answers")
def c11(spark, d):
    return extract.parse_tag_lines(view(spark, d, "answers"))


@query("c12_parse_anchored", "SELECT batch, idx, term, CASE idx WHEN 0 THEN concat('x', batch, chr(34)) WHEN 3 THEN concat('drei ', batch) WHEN 5 THEN 'five' ELSE term END AS translation FROM batch_terms", "batch_terms")
def c12(spark, d):
    return extract.parse_anchored(view(spark, d, "batch_answers"), view(spark, d, "batch_terms"))


@query("c13_cited_paths", "SELECT turn, path, CAST(row_number() OVER (PARTITION BY turn ORDER BY p) AS INT) AS ord FROM (SELECT turn, regexp_extract(text, '\\[From ([^\\] ]+)', 1) AS path, min(rank) AS p FROM cited GROUP BY ALL)", "cited")
def c13(spark, d):
    return extract.cited_paths(view(spark, d, "cited"))


@query("c14_decode_stream_chunks", "SELECT stream, string_agg(CASE seq % 3 WHEN 0 THEN regexp_extract(chunk, 'content\":\"([a-z]+)', 1) WHEN 1 THEN concat('c', seq) ELSE '' END, '' ORDER BY seq) AS content, string_agg(CASE seq % 3 WHEN 1 THEN concat('r', stream) ELSE '' END, '' ORDER BY seq) AS reasoning FROM stream_log GROUP BY stream", "stream_log")
def c14(spark, d):
    return extract.decode_stream_chunks(view(spark, d, "stream_log"))[0]


@query("c14_tool_fragments", "SELECT stream, seq % 2 AS idx, string_agg(concat('n', seq), '' ORDER BY seq) AS name, string_agg(concat('a', stream), '' ORDER BY seq) AS arguments FROM stream_log WHERE seq % 3 = 1 GROUP BY stream, seq % 2", "stream_log")
def c14_tools(spark, d):
    return extract.decode_stream_chunks(view(spark, d, "stream_log"))[1]


@query(
    "c15_relevant_passages",
    """SELECT doc_id, CAST(rank AS INT) AS rank, text, hits FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, no) AS rank, p AS text, hits FROM (SELECT doc_id, no, trim(p) AS p, CAST(contains(lower(p), 'thing') AS INT) + CAST(contains(lower(p), 'that') AS INT) AS hits FROM
      (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents) WHERE len(trim(p)) > 30) WHERE hits > 0) WHERE rank <= 3""",
)
def c15(spark, d):
    return extract.relevant_passages(view(spark, d, "documents"), "Thing of THAT kin", border="\n")


@query(
    "c16_entry_text",
    """SELECT entry_id, CASE entry_type WHEN 'summary' THEN concat_ws(chr(10), concat('p:', entry_id), summary_text, concat('Temas: ', tags_text)) WHEN 'highlights' THEN concat_ws(chr(10), concat('p:', entry_id), 'Highlights:', highlights_text)
      ELSE concat('p:', entry_id, CASE WHEN heading_path <> '' THEN concat(' > ', heading_path) ELSE '' END, chr(10), '[Tags: ', tags_text, ']', chr(10), path) END AS embed_text FROM entries""",
    "entries",
)
def c16(spark, d):
    e = entries(spark, d).withColumns({"basename": F.col("entry_id").cast("string"), "author": F.lit(None).cast("string"), "text": F.col("path")})
    return extract.entry_text(e, "p:").select("entry_id", "embed_text")


# --- tags


@query("h1_candidate_tags", "SELECT path, tag, CAST(row_number() OVER (PARTITION BY path ORDER BY p) AS INT) AS pos FROM (SELECT path, tag, min(p) AS p FROM (SELECT path, concat('t', (mtime + k) % 15) AS tag, k AS p FROM plain_notes, generate_series(1, 10) AS g(k) UNION ALL SELECT path, concat('t', (mtime * k) % 15), k + 10 FROM plain_notes, generate_series(1, 10) AS g(k)) GROUP BY ALL)", "plain_notes")
def h1(spark, d):
    n = view(spark, d, "plain_notes").select("path", "mtime", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("pos"))
    tag = lambda c: F.concat(F.lit("t"), (c % 15).cast("string"))
    return tags.candidate_tags(n.select("path", tag(F.col("mtime") + F.col("pos")).alias("tag"), "pos"), n.select("path", tag(F.col("mtime") * F.col("pos")).alias("tag"), "pos"))


SCORE_TAGS = f"""tok AS (SELECT path, {FOLD.format("content")} AS t, list_distinct(list_filter(string_split_regex(regexp_replace({FOLD.format("content")}, '[`~!@%^&*()=+\\[{{\\]}}\\\\|;:''",.<>/?]', ' ', 'g'), '\\s+'), lambda x: len(x) >= 3)) AS toks FROM plain_notes),
tg AS (SELECT tag, ord, {FOLD.format("tag")} AS ftag, {FOLD.format("regexp_extract(tag, '([^/]*)$', 1)")} AS leaf FROM lang_tags),
sc AS (SELECT path, tag, ord, CAST(CASE WHEN list_contains(toks, leaf) THEN 8 ELSE 0 END + CASE WHEN contains(t, ftag) THEN 6 ELSE 0 END + CASE WHEN contains(t, replace(leaf, '_', ' ')) THEN 3 ELSE 0 END
  + CASE WHEN len(list_filter(string_split(replace(leaf, '_', ' '), ' '), lambda x: len(x) >= 3)) > 0 AND len(list_filter(string_split(replace(leaf, '_', ' '), ' '), lambda x: len(x) >= 3 AND NOT list_contains(toks, x))) = 0 THEN 6 ELSE 0 END AS INT) AS score FROM tok, tg)"""


@query("h2_rank_tags", f"SELECT * FROM (WITH {SCORE_TAGS} SELECT path, tag, score, CAST(row_number() OVER (PARTITION BY path ORDER BY score = 0, score DESC, CASE WHEN score > 0 THEN tag END, ord, tag) AS INT) AS pos FROM sc QUALIFY pos <= 10)", "plain_notes", "lang_tags")
def h2(spark, d):
    t = view(spark, d, "lang_tags")
    t = t.withColumn("ord", F.struct("ord", "tag"))
    return tags.rank_tags(view(spark, d, "plain_notes"), t, 10)


@query("h3_merge_tags", "SELECT concat(doc_id, '') AS path, list_concat([source, 'Más_Cosas'], CASE WHEN doc_id % 2 = 0 THEN [lang] ELSE [lang, concat('new ', lang)] END) AS tags FROM documents")
def h3(spark, d):
    docs = view(spark, d, "documents")
    old = docs.select(F.concat("doc_id", F.lit("")).alias("path"), F.array("source", F.lit("Más_Cosas")).alias("tags"))
    more = F.when(F.col("doc_id") % 2 == 0, F.array(F.upper("lang"), "lang", F.lit("mas cosas"))).otherwise(F.array(F.upper("lang"), F.upper("source"), F.concat(F.lit("New "), "lang")))
    return tags.merge_tags(old, docs.select(F.concat("doc_id", F.lit("")).alias("path"), more.alias("tags")))


# --- scalar expressions


@query("i1_fold", f"SELECT doc_id, sha256({FOLD.format('text')}) AS folded FROM documents")
def i1(spark, d):
    return view(spark, d, "documents").select("doc_id", F.sha2(text.fold(F.col("text")), 256).alias("folded"))


@query("i2_tag_key", f"SELECT doc_id, regexp_replace({FOLD.format('text')}, '[_\\s]+', '_', 'g') AS tag_key FROM documents")
def i2(spark, d):
    return view(spark, d, "documents").select("doc_id", text.tag_key(F.col("text")).alias("tag_key"))


_REFINE = "trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '^tell me about\\s+', ''), '\\?+$', ''), '\\s*(is that right|can you confirm)\\s*$', ''))"


@query("i3_refine_query", f"SELECT query_id, {_REFINE} AS refined FROM queries", "queries")
def i3(spark, d):
    return view(spark, d, "queries").select("query_id", text.refine_query(F.col("text")).alias("refined"))


@query("i4_quoted_terms", f"SELECT query_id, regexp_extract_all({FOLD.format('text')}, '\"([^\"]+)\"', 1) AS quoted FROM queries", "queries")
def i4(spark, d):
    return view(spark, d, "queries").select("query_id", text.quoted_terms(F.col("text")).alias("quoted"))


_TERMS = f"list_filter(string_split_regex(regexp_replace({FOLD.format(_REFINE)}, '[.,/#!$%^&*;:{{}}=\\-_`~()]', ' ', 'g'), '\\s+'), lambda x: len(x) > 2)"


@query("i5_search_terms", f"SELECT query_id, {_TERMS} AS terms, array_to_string(list_filter({_TERMS}, lambda x: len(x) > 3), ' ') AS distilled FROM queries", "queries")
def i5(spark, d):
    q = view(spark, d, "queries")
    return q.select("query_id", text.search_terms(F.col("text")).alias("terms"), text.distilled_query(F.col("text")).alias("distilled"))


@query("i6_embed_query", f"SELECT query_id, concat(CASE WHEN query_id % 40 = 0 THEN 'search_query: ' ELSE '' END, substr({_REFINE}, 1, 500)) AS embedded FROM queries", "queries")
def i6(spark, d):
    model = F.when(F.col("query_id") % 40 == 0, "Nomic-embed").otherwise("other")
    return view(spark, d, "queries").select("query_id", text.embed_query(F.col("text"), model).alias("embedded"))


@query("i7_quantize", "SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(greatest(-1.0, least(1.0, CAST(x AS DOUBLE) * 3)) * 127 + 0.5) AS INT)) AS q FROM embeddings")
def i7(spark, d):
    q = vectors.quantize(F.transform("embedding", lambda x: x.cast("double") * 3))
    return view(spark, d, "embeddings").select("vec_id", F.transform(q, lambda x: x.cast("int")).alias("q"))


@query("i7_dequantize", "SELECT vec_id, list_transform(embedding, lambda x: round(CAST(floor(greatest(-1.0, least(1.0, CAST(x AS DOUBLE))) * 127 + 0.5) AS INT) / 127.0::DOUBLE, 9)) AS v FROM embeddings")
def i7_back(spark, d):
    return view(spark, d, "embeddings").select("vec_id", F.transform(vectors.dequantize(vectors.quantize(F.col("embedding"))), lambda x: F.round(x, 9)).alias("v"))


@query("i8_cosine", "SELECT a.vec_id, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_inner_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 9) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def i8(spark, d):
    e = view(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 9).alias("cosine"))


@query("i9_model_prefix", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'search_document: ' ELSE '' END AS prefix FROM part")
def i9(spark, d):
    model = F.when(F.col("p_partkey") % 3 == 0, "nomic-x").when(F.col("p_partkey") % 3 == 1, "mxbai").otherwise("bge")
    return view(spark, d, "part").select("p_partkey", text.model_prefix(model, "document").alias("prefix"))


@query("i10_chunk_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def i10(spark, d):
    return view(spark, d, "documents").select("doc_id", text.chunk_hash(F.col("text")).alias("hash"))


@query("i11_tag_match_score", f"SELECT * FROM (WITH {SCORE_TAGS} SELECT path, sum(score) AS score FROM sc GROUP BY path)", "plain_notes", "lang_tags")
def i11(spark, d):
    n = view(spark, d, "plain_notes")
    sums = tags.tag_score_sums(n, view(spark, d, "lang_tags"))
    return n.select("path").join(sums, "path", "left").select("path", F.coalesce("score", F.lit(0)).alias("score"))


@query("i12_names", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || '! ' || p_brand), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS snake, regexp_replace(p_name || '/' || p_brand || '?', '[\\\\/:*?\"<>|]', '', 'g') AS safe, concat('# ', p_name, ' (', p_brand, ')') AS body FROM part")
def i12(spark, d):
    p = view(spark, d, "part")
    return p.select(
        "p_partkey", text.snake_tag(F.concat("p_name", F.lit("! "), "p_brand")).alias("snake"), text.safe_name(F.concat("p_name", F.lit("/"), "p_brand", F.lit("?"))).alias("safe"), text.render("# ${a} (${b})", {"a": F.col("p_name"), "b": F.col("p_brand")}).alias("body")
    )


@query("i13_json_path", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none[0].x') AS missing FROM events")
def i13(spark, d):
    return view(spark, d, "events").select("event_id", text.json_path(F.col("props"), "k").alias("k"), text.json_path(F.col("props"), "none[0].x").alias("missing"))


@query("i14_truncate_mark", "SELECT doc_id, CASE WHEN len(text) > 300 THEN concat(substr(text, 1, 250), '...') ELSE text END AS text FROM documents")
def i14(spark, d):
    return view(spark, d, "documents").select("doc_id", text.truncate_mark(F.col("text"), 300, 250, "...").alias("text"))


@query("i15_strip_front_matter", "SELECT path, substr(content, strpos(content, concat(chr(10), '---', chr(10))) + 5) AS body FROM notes", "notes")
def i15(spark, d):
    return view(spark, d, "notes").select("path", text.strip_front_matter(F.col("content")).alias("body"))


@query("i16_set_front_matter_field", "SELECT path, regexp_replace(content, '(?m)^author: .*$', concat('author: \"x ', mtime, '\"')) AS content FROM notes", "notes")
def i16(spark, d):
    n = view(spark, d, "notes")
    return n.select("path", text.set_front_matter_field(F.col("content"), "author", F.concat(F.lit("x "), "mtime")).alias("content"))


@query(
    "i17_date_diff_ymd",
    """SELECT id, CAST(y - CASE WHEN mm < 0 THEN 1 ELSE 0 END AS INT) AS years, CAST(CASE WHEN mm < 0 THEN mm + 12 ELSE mm END AS INT) AS months, CAST(dd AS INT) AS days, CAST(total AS INT) AS total_days, round(total / 365.25, 2) AS years_approx FROM (
      SELECT id, year(hi) - year(lo) AS y, month(hi) - month(lo) - CASE WHEN day(hi) < day(lo) THEN 1 ELSE 0 END AS mm, day(hi) - day(lo) + CASE WHEN day(hi) < day(lo) THEN day(CAST(date_trunc('month', hi) AS DATE) - 1) ELSE 0 END AS dd, hi - lo AS total
      FROM (SELECT id, least(a, b) AS lo, greatest(a, b) AS hi FROM dates))""",
    "dates",
)
def i17(spark, d):
    return view(spark, d, "dates").select("id", dates.date_diff_ymd(F.col("a"), F.col("b")).alias("x")).select("id", "x.*")


@query("i18_date_add_unit", "SELECT id, CASE id % 3 WHEN 0 THEN a + CAST(id % 50 AS INT) ELSE CAST(date_trunc('month', a) AS DATE) + to_months(CAST((id % 50) * CASE id % 3 WHEN 2 THEN 12 ELSE 1 END AS INT)) + to_days(CAST(day(a) - 1 AS INT)) END::DATE AS added FROM dates", "dates")
def i18(spark, d):
    unit = F.when(F.col("id") % 3 == 0, "days").when(F.col("id") % 3 == 1, "month").otherwise("Years")
    return view(spark, d, "dates").select("id", dates.date_add_unit(F.col("a"), (F.col("id") % 50).cast("int"), unit).alias("added"))


@query("i19_day_of_week", "SELECT id, dayname(a) AS day, CAST(NULL AS VARCHAR) AS impossible FROM dates", "dates")
def i19(spark, d):
    return view(spark, d, "dates").select("id", dates.day_of_week(F.col("a").cast("string")).alias("day"), dates.day_of_week(F.concat(F.substring(F.col("a").cast("string"), 1, 4), F.lit("-02-30"))).alias("impossible"))


_PLACES = [(f" {c.title()} " if i % 2 else c, z) for i, (c, z) in enumerate(dates.CITY_ZONES.items())] + [("America/New_York", "America/New_York"), ("asia/tokyo", "Asia/Tokyo"), ("nowhere", None)]
_ZONES = " ".join(f"WHEN {i} THEN '{z}'" for i, (_, z) in enumerate(_PLACES) if z)


@query("i20_at_timezone", f"SELECT event_id, strftime(ts AT TIME ZONE 'UTC' AT TIME ZONE z, '%H:%M:%S') AS local_time, strftime(ts AT TIME ZONE 'UTC' AT TIME ZONE z, '%Y-%m-%d') AS local_date FROM (SELECT event_id, ts, CASE event_id % {len(_PLACES)} {_ZONES} END AS z FROM events)")
def i20(spark, d):
    place = F.element_at(F.array(*(F.lit(c) for c, _ in _PLACES)), (F.col("event_id") % len(_PLACES) + 1).cast("int"))
    e = view(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), place.alias("place"))
    return dates.at_timezone(e, "ts", "place").select("event_id", "local_time", "local_date")


@query("k1_embed", f"SELECT doc_id, {LETTERS.format('text')} AS embedding, regexp_matches(text, '[^\\s]') AND NOT regexp_matches(text, '[aeinorst]') AS failed FROM documents")
def k1(spark, d):
    return embed(view(spark, d, "documents").select("doc_id", "text"), "text", letter_counts()).select("doc_id", "embedding", "failed")


@query("e4_distinct_tags", "SELECT DISTINCT tag FROM (SELECT unnest([source, concat(lang, '/', source)]) AS tag FROM documents)")
def e4(spark, d):
    return aggregates.distinct_tags(view(spark, d, "documents").select(F.concat(F.lit("[#"), "source", F.lit(", "), "lang", F.lit("/"), "source", F.lit("]")).alias("tags")))
