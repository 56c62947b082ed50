from foliomill.oracle.sql import WS, clean, escape, host, slug, sub, tokens, trim, units, WORDS

_LINE = "line"
_TARGET = "(['', 'javascript:', 'java' || chr(9) || 'script:', 'mailto:', 'DATA:', './', 'x+y:'])[page_id % 7 + 1] || url"

SCALARS = {
    "token_estimate": f"SELECT doc_id, cast({units('text')} AS bigint) AS units, {tokens('text')} AS tokens FROM documents",
    "clean_text": f"SELECT doc_id, {clean('text')} AS cleaned FROM documents",
    "slugify_url": f"SELECT page_id, {slug('url')} AS slug, {slug('url', 'page-content')} AS file_name FROM pages",
    "sanitize_title": (
        "SELECT doc_id, coalesce(nullif(" + sub(
            "left(" + sub(sub(trim("text"), r'[/\\?%*:|"<>]', "-"), rf"[{WS}]+", " ") + ", 80)", r"[ .]+\z", "")
        + ", ''), 'untitled') AS file_title FROM documents"),
    "escape_html": f"SELECT page_id, {escape('html')} AS escaped FROM pages",
    "safe_url": (
        f"WITH t AS (SELECT page_id, {_TARGET} AS target FROM pages) SELECT page_id, target, "
        "CASE WHEN page_id % 7 IN (1, 2, 4, 6) THEN '#' ELSE target END AS safe FROM t"),
    "heading_anchor": (
        "SELECT doc_id, cast(line_no AS int) AS line_no, left(" + sub(sub(trim(f"lower({_LINE})"), rf"[^0-9A-Za-z_{WS}\-]", ""), rf"[{WS}]+", "-")
        + ", 80) AS anchor FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no "
        "FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"),
    "wiki_url_parse": """
        SELECT doc_id,
               CASE WHEN known THEN CASE doc_id % 3 WHEN 0 THEN 'https://acme.atlassian.net' ELSE 'https://beta.atlassian.net:8443' END END AS origin,
               CASE WHEN known THEN CASE doc_id % 3 WHEN 0 THEN 'acme' ELSE 'beta' END END AS tenant,
               CASE WHEN known THEN CASE doc_id % 4 WHEN 1 THEN 'folder' ELSE 'page' END END AS content_type,
               CASE WHEN known THEN cast(doc_id AS varchar) END AS id
        FROM (SELECT doc_id, doc_id % 3 <> 2 AND doc_id % 4 <> 2 AS known FROM documents)""",
    "depth_setting": """
        SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 2 THEN 0
            WHEN 3 THEN greatest(0, coalesce(try_cast(nullif(regexp_extract(split_part(text, ' ', 1), '^\\s*([+-]?[0-9]+)', 1), '') AS bigint), 0))
            ELSE doc_id END AS max_depth FROM documents""",
    "md_files": """
        SELECT doc_id, 'file:///docs/' || doc_id || ext AS path
        FROM (SELECT doc_id, (['.md', '.MD', '.markdown', '.mdown', '.mkd', '.html'])[doc_id % 6 + 1] AS ext FROM documents)
        WHERE ext <> '.html'""",
    "md_title": f"""
        WITH {WORDS}
        SELECT doc_id * 2 AS doc_id, 'My Doc ' || (doc_id * 2) || '.md' AS title FROM words
        UNION ALL SELECT doc_id * 2 + 1, a || ' ' || b FROM words""",
    "code_language": """
        SELECT doc_id, CASE WHEN contains(text, '<?php') THEN 'php'
            WHEN contains(text, '<html') OR contains(text, '<!DOCTYPE') THEN 'html'
            WHEN contains(text, 'SELECT ') OR contains(text, 'FROM ') THEN 'sql'
            WHEN contains(text, 'import ') AND contains(text, 'def ') THEN 'python'
            WHEN contains(text, 'function') OR contains(text, 'const ') OR contains(text, 'var ') THEN 'javascript'
            ELSE '' END AS language FROM documents""",
    "model_fit": f"""
        SELECT doc_id, tokens, model, token_limit, tokens <= token_limit AS fits
        FROM (SELECT doc_id, {tokens('text')} AS tokens FROM documents),
             (VALUES ('gpt-4', 8192::bigint), ('gpt-4o', 128000), ('claude', 200000), ('gemini', 1000000)) AS m(model, token_limit)""",
    "filename_dedupe": f"""
        SELECT page_id, slug, ordinal, CASE WHEN ordinal > 1 THEN slug || '-' || ordinal ELSE slug END AS name
        FROM (SELECT page_id, slug, row_number() OVER (PARTITION BY slug ORDER BY page_id) AS ordinal
              FROM (SELECT page_id, {slug('url')} AS slug FROM pages))""",
}
_ENDINGS = "['.md', '.MD', '.markdown', '.mdown', '.mkd', '.html'][doc_id % 6 + 1]"
SCALARS["md_files_written"] = f"""
    SELECT (doc_id % 10) || '/' || doc_id || {_ENDINGS} AS target, cast(strlen(coalesce(text, '')) AS bigint) AS n_bytes, sha256(coalesce(text, '')) AS sha256,
           doc_id % 6 <> 5 AS is_markdown, CASE WHEN doc_id % 6 <> 5 THEN coalesce(text, '') END AS text FROM documents"""
SCALARS["stream_filenames"] = SCALARS["filename_dedupe"]
