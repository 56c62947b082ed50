from foliomill.oracle.html import _ARTICLE
from foliomill.oracle.sql import WORDS, fill, lit

_NODES = """
nodes AS (SELECT cast(doc_id AS varchar) AS id, lang || ' / Part: ' || (doc_id % 2) AS title,
                 CASE WHEN doc_id > 0 THEN cast((doc_id - 1) // 5 AS varchar) END AS parent_id,
                 CASE WHEN doc_id = 0 THEN 'page' WHEN doc_id % 11 = 3 THEN 'folder' WHEN doc_id % 17 = 5 THEN 'whiteboard' ELSE 'page' END AS type,
                 CASE WHEN doc_id % 13 = 7 THEN 403 ELSE 200 END AS status, doc_id AS ord FROM documents)"""


def _tree(roots: str, depth: int | None = None) -> str:
    limit = f" AND t.depth < {depth}" if depth is not None else ""
    return f"""{_NODES},
tree AS (
    SELECT id AS root_id, id, title, cast(NULL AS varchar) AS parent_id, type, status, ord, 0 AS depth, [cast(0 AS bigint)] AS ord_path, [title] AS title_path
    FROM nodes WHERE {roots}
    UNION ALL
    SELECT t.root_id, n.id, n.title, n.parent_id, n.type, n.status, n.ord, t.depth + 1, list_append(t.ord_path, n.ord), list_append(t.title_path, n.title)
    FROM tree t JOIN nodes n ON n.parent_id = t.id WHERE t.status = 200 AND n.type IN ('page', 'folder'){limit})"""


def _with(body: str, roots: str = "id = '0'", depth: int | None = None) -> str:
    return f"WITH RECURSIVE {_tree(roots, depth)}{body}"


_BRANCH = "type IN ('page', 'folder') AND status = 200"
_SAFE = """regexp_replace(regexp_replace({x}, '[/\\\\?%*:|"<>]', '-', 'g'), '[ .]+$', '')"""
_READ = "(type = 'folder' OR status = 200)"
_NAMED = f""",
named AS (SELECT *, {_SAFE.format(x='title')} AS base_name,
                 row_number() OVER (PARTITION BY root_id, coalesce(parent_id, ''), {_SAFE.format(x='title')} ORDER BY depth, ord_path) AS nth FROM {{source}}),
paths AS (SELECT *, CASE WHEN nth = 1 THEN base_name ELSE base_name || '-' || right(id, 6) END AS name FROM named),
placed AS (SELECT *, array_to_string(list_append(list_transform(title_path[1:-2], lambda x: {_SAFE.format(x='x')}), name), '/') || '.md' AS path FROM paths)"""
_ERROR = "'HTTP ' || status || ' for /wiki/api/v2/pages/' || id || '?body-format=export_view'"
_ENTRY = fill("# {title}\n\n# {a} {b}\n\n" + _ARTICLE + "{t}\n\n")


def _export(first: str, source: str, roots: str = "id = '0'") -> str:
    return f"""WITH RECURSIVE {WORDS}, {_tree(roots)}{first},
good AS (SELECT * FROM {source} WHERE {_READ}){_NAMED.format(source='good')}
SELECT path, 0 AS part, CASE WHEN p.type = 'folder' THEN '# ' || title || chr(10) || chr(10) || '_(Confluence folder — no page body)_' || chr(10)
                  ELSE {_ENTRY} END AS content, CASE WHEN p.type = 'folder' THEN 'folder' ELSE 'page' END AS kind
FROM placed p JOIN words w ON w.i = p.id
UNION ALL
SELECT '_skipped.txt', 0, 'Pages skipped during export (permission denied, not found, or fetch failed):' || chr(10) || chr(10)
       || string_agg('- ' || title || ': ' || {_ERROR} || chr(10), '' ORDER BY depth, ord_path), 'report'
FROM {source} WHERE NOT {_READ} HAVING count(*) > 0"""

# Why a broken response is rejected, by the remainder of its number.
_REASON = "CASE k WHEN 4 THEN 'malformed JSON' WHEN 6 THEN 'empty response' WHEN 8 THEN 'no results in response' END"


TREE = {
    "tree_children_ingest": f"""WITH {_NODES},
        r AS (SELECT *, cast(parent_id AS bigint) % 9 AS k, CASE WHEN (ord - 1) % 5 >= 2 THEN cast(((ord - 1) % 5) // 2 AS varchar) END AS cursor FROM nodes WHERE parent_id IS NOT NULL)
        SELECT parent_id, cursor, cast(((ord - 1) % 5) % 2 AS int) AS child_no, id, title, type, cast(NULL AS varchar) AS error FROM r WHERE k NOT IN (4, 6, 8)
        UNION ALL SELECT DISTINCT parent_id, cursor, cast(NULL AS int), NULL, NULL, NULL, {_REASON} FROM r WHERE k IN (4, 6, 8)""",
    "tree_body_ingest": f"""WITH {WORDS}, r AS (SELECT *, doc_id % 9 AS k, doc_id % 9 NOT IN (4, 6, 8) AS good FROM words)
        SELECT doc_id, CASE WHEN good THEN i END AS id, CASE WHEN good THEN CASE WHEN doc_id % 7 = 0 THEN 'Untitled' ELSE lang || ' page ' || i END END AS title,
               CASE WHEN good THEN CASE WHEN doc_id % 5 = 1 THEN '' ELSE '<p>' || t || '</p>' END END AS html_body,
               CASE WHEN good AND doc_id > 0 THEN cast((doc_id - 1) // 5 AS varchar) END AS parent_id, {_REASON.replace('results', 'id')} AS error FROM r""",
    "tree_paginate": f"""WITH {_NODES}
        SELECT parent_id, cast((ord - 1) % 5 + 1 AS int) AS child_ord, id, type FROM nodes WHERE parent_id IS NOT NULL""",
    "tree_discover": _with(" SELECT id, title, parent_id, type, depth, array_to_string(ord_path, '/') AS ord_path FROM tree"),
    "tree_depth": _with(" SELECT id, depth FROM tree", depth=1),
    "tree_cap": _with(""" SELECT root_id, cast(n AS int) AS bfs_no, id, depth FROM (
        SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY depth, ord_path) AS n FROM tree) WHERE n <= 8""", _BRANCH, 2),
    "tree_preview": _with(""" SELECT root_id, least(count(*), 8) AS n_nodes, count(*) > 8 AS truncated, max(CASE WHEN depth = 0 THEN title END) AS root_title,
        'Found ' || least(count(*), 8) || CASE WHEN least(count(*), 8) = 1 THEN ' page' ELSE ' pages' END AS label FROM tree GROUP BY root_id""", _BRANCH, 2),
    "tree_paths": _with(_NAMED.format(source="tree") + " SELECT id, path, count(*) OVER (PARTITION BY path) > 1 AS path_collision FROM placed"),
    "sibling_names": _with(f", good AS (SELECT * FROM tree WHERE {_READ})" + _NAMED.format(source="good")
                           + " SELECT id, parent_id, base_name, name FROM placed"),
    "tree_skipped": _with(f" SELECT id, title, {_ERROR} AS error FROM tree WHERE NOT {_READ}"),
    "tree_skipped_report": _with(f""" SELECT 0 AS part, '_skipped.txt' AS path,
        'Pages skipped during export (permission denied, not found, or fetch failed):' || chr(10) || chr(10)
        || string_agg('- ' || title || ': ' || {_ERROR} || chr(10), '' ORDER BY depth, ord_path) AS content FROM tree WHERE NOT {_READ} HAVING count(*) > 0"""),
    "tree_export_entries": _export("", "tree"),
    "tree_export_capped": _export(
        ", cut AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY depth, ord_path) AS n FROM tree) WHERE n <= 100)", "cut"),
    "tree_export_summary": _with(f""" SELECT root_id, count(*) - count_if(NOT {_READ}) AS n_exported, count_if(NOT {_READ}) AS n_skipped,
        count_if(type = 'page') AS n_pages, cast(floor(100.0 * count_if(type = 'page' AND status = 200) / count_if(type = 'page') + 0.5) AS bigint) AS percent_read,
        {_SAFE.format(x="max(CASE WHEN depth = 0 THEN title END)")} || '.zip' AS bundle_name FROM tree GROUP BY root_id"""),
}
