"""Views of the given tables in the library's own schemas, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_TITLE = "replace(replace(substr(text, 1, 80), chr(34), ''), chr(10), ' ')"
VIEWS = {
    # Plain notes, with an mtime that follows the id.
    "plain_notes": """SELECT concat(source, '/', lang, '/', doc_id, '.md') AS path, concat('', doc_id) AS basename, 'md' AS ext, doc_id AS mtime, length(text) AS size, text AS content FROM documents""",
    # Notes with front matter, headings, a code fence, marks, tags and links around the text.
    "notes": f"""SELECT concat(source, '/', lang, '/', doc_id, '.md') AS path, concat('', doc_id) AS basename, doc_id AS mtime,
        concat('---', chr(10), 'summary: ', chr(34), {_TITLE}, chr(34), chr(10), 'tags: [', source, '/', lang, '_notes, topic]', chr(10), 'author: A', doc_id % 7, chr(10), '---', chr(10),
               '# ', lang, chr(10), '```', chr(10), '# no heading', chr(10), '```', chr(10), '## ', source, chr(10), text, chr(10), '### Links', chr(10), '==mark ', doc_id % 5, '== and ==Mark ', doc_id % 5, '== <mark class=x>last <b>one</b></mark>', chr(10),
               '#topic/', lang, '_', doc_id % 3, ' #tipo/clase_', doc_id % 3, '/Categoría #general/pais see [site](http://www.example.com/', doc_id, '?q=1). http://ex', doc_id % 9, '.org/a, #', source, chr(10)) AS content FROM documents""",
    # Pages with nested blocks, nested and unclosed noise, unclosed paragraphs, roots inside noise, and none at all.
    "nested_pages": """SELECT page_id, concat('<!DOCTYPE html><html><head><title>A title that is long enough</title><p>lost in the head part</head><body><nav><div><p>Navigation paragraph text</p></div></nav>', CASE page_id % 5
        WHEN 0 THEN concat('<div id="content"><div class="lead"><p>Lead paragraph number ', page_id, '</p></div><aside><aside><p>Inner aside paragraph text</p></aside><p>Outer aside paragraph text</p></aside><p>Outer paragraph behind the inner block</p></div><p>Behind the content element</p>')
        WHEN 1 THEN concat('<main><h2>Heading of page ', page_id, ' <b>with bold</b></h2><div class="x comments y"><p>A comment that is long enough</p></div><p>Unclosed paragraph one<p>Unclosed paragraph two<script>if (a < b) "</p><p>Script text paragraph"</script><ul><li><p>too short</p></ul></main>')
        WHEN 2 THEN concat('<footer><article><p>Article inside of a footer</p></article></footer><article><article><p>First article, inner story ', page_id, '</article><p>First article, after the inner one</p></article><article><p>Second article is not taken</p></article>')
        WHEN 3 THEN concat('<div class="story-body"><p>Story body paragraph text</p></div><MAIN data-x="a>b"><!-- <p>comment paragraph text</p> --><p>Main part says A &amp; B &lt; ', page_id, '</p></MAIN>')
        ELSE concat('</div></p><header><p>Header paragraph text</header><p>No root here, paragraph ', page_id, '</span>') END, '</body></html>') AS html FROM pages""",
    "vectors": """SELECT vec_id AS entry_id, CAST(floor(vec_id / 5) AS BIGINT) AS note, vec_id % 5 AS ord, label, embedding AS raw FROM embeddings""",
    "queries": """SELECT vec_id AS query_id, concat('Tell me about the ', source, ' and ', lang, ' ', substr(text, 1, 40), ' ', chr(34), lang, '/', chr(34), '?') AS text FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 20 = 0""",
    "messages": """SELECT conv_id, turn, role, text AS content, CASE WHEN role = 'assistant' AND turn % 3 = 1 THEN concat('thought ', turn, chr(10), 'more') END AS reasoning, CAST(NULL AS VARCHAR(9)) AS context FROM conversations""",
    "tool_messages": """SELECT conv_id, turn, CASE WHEN role = 'user' AND turn % 4 = 2 THEN 'tool_result' ELSE role END AS role, text AS content FROM conversations""",
    "run_messages": """SELECT conv_id, turn, CASE WHEN role = 'system' OR turn % 5 = 3 THEN 'user' ELSE role END AS role, text AS content FROM conversations""",
    "changes": """SELECT event_id, ts, concat(user_id, '.md') AS path, concat('old-', user_id, '.md') AS old_path, CASE event_type WHEN 'click' THEN 'modify' WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'rename' ELSE 'open' END AS type FROM events""",
    # A user stays near a note for some events, in a block of neighbouring events; errors stand for views while paused.
    "live_views": """SELECT event_id, viewer, ts, concat(source, '/', lang, '/', doc_id, '.md') AS path, paused FROM
        (SELECT event_id, user_id AS viewer, ts, event_type = 'error' AS paused, (user_id * 17 + CAST(floor(event_id / 300) AS BIGINT)) % total AS doc FROM events CROSS JOIN (SELECT count(*) AS total FROM documents) AS c) AS e JOIN documents ON doc_id = doc""",
    "log": """SELECT event_id, ts, concat('user ', user_id) AS source, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warning' ELSE 'info' END AS type, props AS message FROM events""",
    "tags": """SELECT concat(replace(lower(p_brand), '#', ''), '/', replace(p_name, ' ', '_')) AS tag, min(p_partkey) AS ord FROM part GROUP BY 1""",
    "lang_tags": """SELECT tag, min(ord) AS ord FROM (SELECT concat(source, '/', lang) AS tag, doc_id AS ord FROM documents UNION ALL SELECT concat('words/', lower(regexp_replace(substr(text, 1, 12), '[^a-zA-Z]+', '_', 'g'))), doc_id FROM documents) AS x GROUP BY tag""",
    "reports": """SELECT doc_id AS id, concat('Intro', chr(10), '**Claim:** ', substr(text, 1, 30), chr(10), '**Verdict:** ', CASE doc_id % 3 WHEN 0 THEN 'Inaccurate' WHEN 1 THEN 'Accurate' ELSE 'Unverifiable' END, chr(10), '**Source:** ', source, chr(10), '**Note:** n', doc_id, chr(10), '**claim:** second of ', lang) AS text FROM documents""",
    "answers": """SELECT doc_id AS id, concat('1. #', source, chr(10), '- *', lang, '*', chr(10), 'two words', chr(10), chr(10), '  * [', lang, '_', doc_id % 4, ']') AS text FROM documents""",
    "batch_terms": """SELECT CAST(floor(p_partkey / 8) AS INT) AS batch, CAST(p_partkey % 8 AS INT) AS idx, p_name AS term FROM part""",
    "batch_answers": """SELECT batch, concat('Here:', chr(10), 't0 -> ', chr(34), 'x', batch, chr(34), '.', chr(10), 't3: drei ', batch, ',', chr(10), 't 5 => *five*', chr(10), 't77 = out') AS text FROM (SELECT DISTINCT CAST(floor(p_partkey / 8) AS INT) AS batch FROM part) AS b""",
    "cited": """SELECT conv_id * 1000 + turn AS turn, ord AS rank, concat('[From n', (conv_id + ord) % 3, '.md', CASE WHEN ord % 2 = 0 THEN ' (A > B)' ELSE '' END, ']:', chr(10), substr(text, 1, 50)) AS text FROM conversations, (SELECT 1 AS ord UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) AS o""",
    "stream_log": """SELECT conv_id AS stream, turn AS seq, CASE turn % 3 WHEN 0 THEN concat('{"message":{"content":"', role, '"}}') WHEN 1 THEN concat('{"choices":[{"delta":{"content":"c', turn, '","reasoning":"r', conv_id, '","tool_calls":[{"index":', turn % 2, ',"function":{"name":"n', turn, '","arguments":"a', conv_id, '"}}]}}]}') ELSE 'broken {' END AS chunk FROM conversations""",
    "passages": """SELECT conv_id, turn, concat('n', (conv_id * 7 + turn * ord) % 11) AS path, CAST((conv_id * 13 + turn * 5 + ord * 29) % 101 AS DOUBLE) AS score FROM conversations, (SELECT 1 AS ord UNION ALL SELECT 2 UNION ALL SELECT 3) AS o""",
    "calls": """SELECT user_id AS conv_id, event_id AS turn, event_type AS skill, CASE WHEN event_id % 2 = 0 THEN '{"K": 1}' ELSE concat('{"k":', event_id % 3, '}') END AS params FROM events""",
    "concepts": """SELECT concat(p_name, ': ', p_brand) AS title, concat('http://example.com/', min(p_partkey)) AS url, min(p_type) AS body FROM part GROUP BY p_name, p_brand""",
    "dates": """SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS a, CAST(min(l_shipdate) AS DATE) AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or one of the given tables, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name].replace(", '[^a-zA-Z]+', '_', 'g')", ", '[^a-zA-Z]+', '_')").replace("{", "{{").replace("}", "}}")
    # DuckDB's concat() leaves nulls out.
    sql = re.sub(r"\bconcat\(", "concat_ws('', ", sql)
    used = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def oracle(sql: str, *views: str) -> str:
    """DuckDB SQL with the views that it names in front."""
    return "WITH " + ", ".join(f"{v} AS ({VIEWS[v]})" for v in views) + " " + sql if views else sql
