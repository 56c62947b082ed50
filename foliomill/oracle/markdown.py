from foliomill.fixtures import MARKDOWN as FIXTURE
from foliomill.oracle.sql import WORDS, WS, escape, fill, lit, sub

# Documents hold no Markdown marks but emphasis and pipes: their paragraphs are the runs of
# lines that are not blank. Generated texts have their results written out.

_LINE_BLANK = f"NOT regexp_matches(line, {lit(f'[^{WS}]')})"
_DOC = f"""
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
runs AS (SELECT *, count_if({_LINE_BLANK}) OVER (PARTITION BY doc_id ORDER BY n) AS g FROM lines),
paras AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) AS k, string_agg(line, chr(10) ORDER BY n) AS p
          FROM runs WHERE NOT ({_LINE_BLANK}) GROUP BY doc_id, g)"""

_N = rf"[^{WS}]"
_BOLD = rf"(?s)\*\*({_N}(?:.*?{_N})??)\*\*|__({_N}(?:.*?{_N})??)__"
_ITALIC = rf"\*((?:[^*_{WS}][^*_]*)?{_N})\*|_((?:[^*_{WS}][^*_]*)?{_N})_"


def _plain(x: str) -> str:
    out = sub(sub(escape(x), _BOLD, r"<strong>\1\2</strong>"), _ITALIC, r"<em>\1\2</em>")
    return sub(out, " {2,}\n", "<br>\n")


_INTRO = "<p>Intro <strong>{a}</strong> and <em>{b}</em> with <code>{c}</code> and <del>{a}</del>.</p>\n"
_LINKS = '<p><a href="https://example.com/{i}">{c}</a> <img src="#" alt="{i}"> <a href="#">y</a></p>\n'
_FIXTURE_HTML = (
    '<h1 id="{anchor}">{a} {b}</h1>\n' + _INTRO
    + '<ul>\n<li>{a}</li>\n<li class="task"><input type="checkbox" disabled checked> {b}<ul>\n<li>{c}</li>\n</ul>\n</li>\n<li>{a}</li>\n<li>{b}</li>\n</ul>\n'
    + '<pre><code class="language-sql">SELECT {a}\n</code></pre>\n'
    + '<table>\n<thead>\n<tr><th style="text-align:left">k</th><th style="text-align:right">v</th></tr>\n</thead>\n<tbody>\n'
    + '<tr><td style="text-align:left">{a}</td><td style="text-align:right">{i}</td></tr>\n</tbody>\n</table>\n'
    + "<blockquote>\n<p>{b}</p>\n</blockquote>\n<hr>\n" + _LINKS)
_ANCHOR = "left(lower(a || '-' || b), 80)"
_MADE = f"made AS (SELECT doc_id * 2 + 1 AS id, a, b, c, i, {_ANCHOR} AS anchor FROM words)"


def _both(doc_select: str, *made: str) -> str:
    tail = "".join(f" UNION ALL SELECT id, {m} FROM made" for m in made)
    return f"WITH {WORDS}, {_MADE}, {_DOC} {doc_select}{tail}"


def _made(first: str, *more: str) -> str:
    return f"WITH {WORDS}, {_MADE} SELECT id AS doc_id, {first} FROM made" + "".join(f" UNION ALL SELECT id, {m} FROM made" for m in more)


_P3 = fill("[{c}](https://example.com/{i}) ![{i}](data:x) [y](javascript:z)")
_P1 = fill("Intro **{a}** and *{b}* with `{c}` and ~~{a}~~.")
_KINDS = (("heading", 1), ("paragraph", 3), ("item", 5), ("fence", 1), ("table", 1), ("rule", 1))

MARKDOWN = {
    "md_lines": f"""WITH {WORDS}, t AS (SELECT doc_id * 2 AS doc_id, text FROM documents UNION ALL SELECT doc_id * 2 + 1, {fill(FIXTURE)} FROM words)
        SELECT doc_id, cast(generate_subscripts(l, 1) - 1 AS int) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM t)""",
    "md_block_profile": _both("SELECT doc_id * 2 AS doc_id, 'paragraph' AS kind, count(*) AS n_blocks FROM paras GROUP BY doc_id",
                              *[f"'{k}', {n}" for k, n in _KINDS]),
    "md_depth_cap": f"""WITH {WORDS}, d AS (SELECT doc_id, a, 98 + doc_id % 6 AS n FROM words)
        SELECT doc_id, repeat('<blockquote>' || chr(10), least(n, 100)) || '<p>' || CASE WHEN n > 101 THEN repeat('&gt;', n - 101) || ' ' ELSE '' END || a
            || '</p>' || chr(10) || repeat('</blockquote>' || chr(10), least(n, 100)) AS html FROM d""",
    "md_headings": _made("1 AS level, a || ' ' || b AS heading, anchor"),
    "md_hr": _made("10 AS block_no"),
    "md_code_blocks": _made("'sql' AS language, 'SELECT ' || a || chr(10) AS code"),
    "md_blockquotes": _made("1 AS depth, 'paragraph' AS kind, b AS quoted"),
    "md_list_items": _made("1 AS item_no, 0 AS depth, false AS ordered, a AS item", "2, 0, false, '[x] ' || b", "3, 1, false, c", "4, 0, false, a", "5, 0, false, b"),
    "md_tasks": _made("true AS done, b AS task"),
    "md_tables": _made("0 AS row_no, 0 AS cell_no, 'k' AS cell", "0, 1, 'v'", "1, 0, ':---'", "1, 1, '---:'", "2, 0, a", "2, 1, i"),
    "md_paragraphs": _both("SELECT doc_id * 2 AS doc_id, cast(k AS int) AS paragraph_no, p AS paragraph FROM paras", f"1, {_P1}", f"2, {_P3}"),
    "md_code_spans": _made("c AS code"),
    "md_images": _made("i AS alt, '#' AS url"),
    "md_links": _made("c AS label, 'https://example.com/' || i AS url", "'y', '#'"),
    "md_inline_html": _both(f"SELECT doc_id * 2 AS doc_id, cast(k AS int) AS paragraph_no, {_plain('p')} AS html FROM paras",
                            f"1, {fill(_INTRO[3:-5])}", f"2, {fill(_LINKS[3:-5])}"),
    "md_to_html": f"""WITH {WORDS}, {_MADE}, {_DOC}
        SELECT doc_id * 2 AS doc_id, coalesce(string_agg('<p>' || {_plain('p')} || '</p>' || chr(10), '' ORDER BY k), '') AS html
        FROM documents LEFT JOIN paras USING (doc_id) GROUP BY doc_id
        UNION ALL SELECT id, {fill(_FIXTURE_HTML)} FROM made""",
}
