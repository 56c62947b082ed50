"""The same results in SQL for a second engine, where SQL can express them.

The others are tested against brute force or exact round trips: scores of fitted models, token ids,
XXH64 fingerprints, random rounding, and searches that find most but not all.
"""

from __future__ import annotations

import re

from foliomill.llm.substrings import WINDOW
from foliomill.llm.url_filters import GLOBS, HOST_RULES
from foliomill.llm.words import WORD

_FM_SUBSTRINGS = rf"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
keyed AS (SELECT n, w, list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i + {WINDOW - 1} <= len(w) THEN md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) END) AS k FROM docs),
words AS (SELECT n, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word, unnest(k) AS k FROM keyed),
marked AS (SELECT n, i, word, k IS NOT NULL AND count(*) OVER (PARTITION BY k) > 1 AS again FROM words),
covered AS (SELECT n, i, word, bool_or(again) OVER (PARTITION BY n ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM marked),
kept AS (SELECT n, count_if(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM covered GROUP BY n)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, cast(coalesce(n_removed, 0) AS bigint) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (n)"""



def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _regex(glob: str, one: str) -> str:
    """A glob as a regular expression for a full match."""
    return _text("(?s)" + "".join(".*" if c == "*" else one if c == "?" else re.escape(c) for c in glob))


_HOST_RULES = ",\n".join(f"({_text(r.verdict)}, {_text(r.host)}, {_text(r.path)})" for r in HOST_RULES)
_GLOBS = ",\n".join(f"({i}, {_text(g.verdict)}, {_text(g.host + ' ' + g.path)}, {len((g.host + g.path).replace('*', ''))}, {len(g.host)}, "
                    f"{_regex(g.host, '.')}, {_regex(g.path, re.escape('?'))}, {'?' in g.path})" for i, g in enumerate(GLOBS))
_URL_AUTOMATON = rf"""
WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT row_number() OVER () AS n, page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(r, '^[^?#]*(\?[^#]*)', 1) AS query FROM rest),
host_rules(v, h, p) AS (VALUES {_HOST_RULES}),
globs(i, v, name, signs, wide, h, p, q) AS (VALUES {_GLOBS}),
ruled AS (SELECT n, arg_min(h || p, o) AS rule, arg_min(v, o) AS verdict FROM (
    SELECT n, h, p, v, row(-length(h || p), -length(h), v <> 'block') AS o FROM parts JOIN host_rules
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) GROUP BY n),
globbed AS (SELECT n, arg_min(name, o) AS pattern, arg_min(v, o) AS verdict FROM (
    SELECT n, name, v, row(-signs, -wide, v <> 'block', i) AS o FROM parts JOIN globs
    ON regexp_full_match(host, h) AND regexp_full_match(CASE WHEN q THEN path || query ELSE path END, p)) GROUP BY n)
SELECT page_id, host, path, rule, CASE WHEN rule IS NULL THEN pattern END AS pattern, coalesce(ruled.verdict, globbed.verdict, 'allow') AS verdict
FROM parts LEFT JOIN ruled USING (n) LEFT JOIN globbed USING (n)"""

# CRC-32 bit by bit; edits turn by turn over the grammar's states ('-': nothing kept), with the cheapest audit and its lines.
_TARGET_ALIGNMENT = r"""
WITH RECURSIVE given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(cast(conv_id AS varchar), ' ') || ':' || coalesce(cast(turn AS varchar), ' ') AS k FROM conversations),
keys AS (SELECT DISTINCT k FROM given),
kinds AS (SELECT k, (list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: cast(ascii(k[i]) AS bigint))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, step: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) AS crc FROM keys),
coded AS (SELECT conv_id, turn, role, text, xor(crc, 4294967295) % 20 AS kind FROM given JOIN kinds USING (k)),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM coded, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))),
placed AS (SELECT *, row_number() OVER w AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS signs, lag(role[1]) OVER w || role[1] AS pair
    FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
seen AS (SELECT *, i > min(i) OVER (PARTITION BY conv_id, role, text) AS again FROM placed),
faults AS (SELECT *, signs = '' AS blank, signs <> '' AND again AS duplicate, signs <> '' AND NOT again AND signs[-1] NOT IN ('.', '!', '?') AS truncated FROM seen),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate,
    count_if(truncated) AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM faults GROUP BY conv_id),
steps(before, after) AS (VALUES ('-', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
inserted(before, after, many) AS (SELECT before, before, 0 FROM steps UNION ALL SELECT before, after, 1 FROM steps
    UNION ALL SELECT x.before, y.after, 2 FROM steps x JOIN steps y ON x.after = y.before),
walk AS (SELECT conv_id, n, 0::bigint AS i, '-' AS state, 0::bigint AS cost, '' AS audit, ''::varchar AS lines FROM facts
    UNION ALL
    SELECT conv_id, n, i, state, cost, audit, lines FROM (
        SELECT *, row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) AS best FROM (
            SELECT w.conv_id, w.n, f.i, e.state, w.cost + 5 * s.many + e.price AS cost, w.audit || repeat('I', s.many) || e.edit AS audit,
                w.lines || CASE s.many WHEN 0 THEN '' WHEN 1 THEN chr(10) || CASE s.after WHEN 'u' THEN 'user:' ELSE 'assistant:' END
                    ELSE CASE s.after WHEN 'u' THEN chr(10) || 'assistant:' || chr(10) || 'user:' ELSE chr(10) || 'user:' || chr(10) || 'assistant:' END END || e.line AS lines
            FROM walk w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
            JOIN inserted s ON s.before = w.state,
            LATERAL (SELECT s.after AS state, 2 AS price, 'D' AS edit, '' AS line
                UNION ALL SELECT t.after, CASE WHEN f.truncated THEN 5 ELSE 0 END, 'K', chr(10) || f.role || ':' || f.text
                    FROM (SELECT after FROM steps WHERE before = s.after UNION ALL SELECT 's' WHERE s.after = '-') t WHERE NOT f.blank AND NOT f.duplicate AND f.role[1] = t.after
                UNION ALL SELECT t.after, CASE WHEN f.truncated THEN 6 ELSE 1 END, 'R', chr(10) || CASE t.after WHEN 'u' THEN 'user:' ELSE 'assistant:' END || f.text
                    FROM steps t WHERE t.before = s.after AND NOT f.blank AND NOT f.duplicate AND f.role[1] <> t.after) e)) WHERE best = 1),
done AS (SELECT w.conv_id, w.cost + 5 * s.many AS cost, w.audit || repeat('I', s.many) AS audit, w.lines || CASE s.many WHEN 0 THEN '' WHEN 1 THEN chr(10) || 'assistant:'
    ELSE chr(10) || 'user:' || chr(10) || 'assistant:' END AS lines
    FROM walk w JOIN inserted s ON s.before = w.state WHERE w.i = w.n AND s.after IN ('-', 'a')),
cheapest AS (SELECT conv_id, arg_min(row(cost, audit, lines), row(cost, audit)) AS c FROM done GROUP BY conv_id)
SELECT o.conv_id, cast(coalesce(gaps, 0) AS bigint) AS gaps, cast(coalesce(blank, 0) AS bigint) AS blank, cast(coalesce(duplicate, 0) AS bigint) AS duplicate,
    cast(coalesce(truncated, 0) AS bigint) AS truncated, cast(coalesce(illegal, 0) AS bigint) AS illegal, cast(coalesce(c[1], 0) AS bigint) AS cost,
    coalesce(c[2], '') AS audit, sha256(coalesce(substr(c[3], 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN cheapest ON cheapest.conv_id IS NOT DISTINCT FROM o.conv_id"""

ORACLE: dict[str, str] = {"op6_fm_substrings": _FM_SUBSTRINGS, "op11_url_automaton": _URL_AUTOMATON, "op13_target_alignment": _TARGET_ALIGNMENT}
