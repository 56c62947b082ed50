"""Inline Markdown to safe HTML, as a chain of replacements inside the row.

Code spans are set apart first, then images, links and emphasis are handled in that order.
Noncharacters mark the places that a later step of the chain has to find again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliomill.functions.constants import WS
from foliomill.functions.text import escape_html, let

CODE_START, CODE_END = "﷐", "﷑"
URL_START, URL_END, TITLE_START, TITLE_END = "﷒", "﷓", "﷔", "﷕"
_MARKS = CODE_START + CODE_END + URL_START + URL_END + TITLE_START + TITLE_END

CODE_SPAN = r"(?s)(`+)(.*?)\1"
_TARGET = rf'\(([^){WS}]+)(?:[{WS}]+&quot;([^&]*)&quot;)?\)'
IMAGE = rf"!\[([^\]]*)\]{_TARGET}"
LINK = rf"\[([^\]]+)\]{_TARGET}"
AUTOLINK = rf"&lt;(https?://[^{WS}&]+(?:&amp;[^{WS}&]+)*+)&gt;"
BOLD = rf"(?s)(\*\*|__)(?=[^{WS}])(.*?[^{WS}])\1"
ITALIC = rf"(\*|_)(?=[^{WS}])([^*_]*[^{WS}])\1"
STRIKE = rf"(?s)~~(?=[^{WS}])(.*?[^{WS}])~~"


def _sub(value: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(value, F.lit(pattern), F.lit(replacement))


def _settle_targets(value: Column) -> Column:
    """Make marked URLs safe and write marked titles.

    A URL holds no white space, so only the other control characters are looked for in it.
    """
    inside = rf"(?=[^{URL_START}{URL_END}]*{URL_END})"
    out = _sub(value, rf"[\x00-\x08\x0E-\x1f]{inside}", "")
    out = _sub(out, rf"(?i){URL_START}(?!(?:https?|mailto|file):)[a-z][a-z0-9+.\-]*:[^{URL_END}]*{URL_END}", "#")
    out = F.translate(out, URL_START + URL_END, "")
    out = F.replace(out, F.lit(TITLE_START + TITLE_END), F.lit(""))
    return _sub(out, rf"{TITLE_START}([^{TITLE_END}]*){TITLE_END}", ' title="$1"')


def _where(value: Column, marks: tuple[str, ...], step) -> Column:
    """Apply a step where the text holds one of its marks; most texts hold none and are not searched by pattern."""
    def chosen(out: Column) -> Column:
        found = F.contains(out, F.lit(marks[0]))
        for mark in marks[1:]:
            found = found | F.contains(out, F.lit(mark))
        return F.when(found, step(out)).otherwise(out)

    return let(value, chosen)


def plain_inline(text: Column) -> Column:
    """HTML of a text without code spans."""
    out = escape_html(text)
    out = _where(out, ("![",), lambda o: _settle_targets(
        _sub(o, IMAGE, rf'<img src="{URL_START}$2{URL_END}" alt="$1"{TITLE_START}$3{TITLE_END}>')))
    out = _where(out, ("](",), lambda o: _settle_targets(
        _sub(o, LINK, rf'<a href="{URL_START}$2{URL_END}"{TITLE_START}$3{TITLE_END}>$1</a>')))
    out = _where(out, ("&lt;http",), lambda o: _sub(o, AUTOLINK, r'<a href="$1">$1</a>'))
    out = _where(out, ("**", "__"), lambda o: _sub(o, BOLD, r"<strong>$2</strong>"))
    out = _where(out, ("*", "_"), lambda o: _sub(o, ITALIC, r"<em>$2</em>"))
    out = _where(out, ("~~",), lambda o: _sub(o, STRIKE, r"<del>$1</del>"))
    return _where(out, ("  \n",), lambda o: _sub(o, r" {2,}\n", "<br>\n"))


def inline_parts(text: Column) -> Column:
    """ARRAY<STRUCT<code, text>>: code spans and the text between them, in order."""
    marked = _where(F.translate(text, _MARKS, ""), ("`",), lambda o: _sub(o, CODE_SPAN, f"{CODE_START}$2{CODE_END}"))
    parts = F.regexp_extract_all(marked, F.lit(f"{CODE_START}[^{CODE_END}]*{CODE_END}|[^{CODE_START}]+"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(
        p.startswith(CODE_START).alias("code"), F.translate(p, CODE_START + CODE_END, "").alias("text")))


def render_inline(text: Column) -> Column:
    def part(p: Column) -> Column:
        return F.when(p["code"], F.concat(F.lit("<code>"), escape_html(p["text"]), F.lit("</code>"))).otherwise(
            plain_inline(p["text"]))

    return F.array_join(F.transform(inline_parts(text), part), "")
