"""Small builders for SQL expressions."""

from __future__ import annotations

import re

WS = (r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}")


def lit(text: str) -> str:
    """A string literal; line feeds become chr(10)."""
    return "(" + " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in text.split("\n")) + ")"


def sub(x: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(replacement)}, 'g')"


def fill(template: str) -> str:
    """Concatenation of a template's text and its {columns}."""
    parts = re.split(r"\{(\w+)\}", template)
    return "(" + " || ".join(lit(p) if k % 2 == 0 else p for k, p in enumerate(parts) if p or k % 2) + ")"


def trim(x: str) -> str:
    return sub(x, rf"^[{WS}]+|[{WS}]+\z", "")


def clean(x: str) -> str:
    out = sub(trim(f"coalesce({x}, '')"), rf"[{WS}]+", " ")
    return trim(sub(f"replace({out}, '`', '\\`')", r" ([.,!?;:])", r"\1"))


def units(x: str) -> str:
    return f"(length({x}) + length({sub(x, '[^' + chr(92) + 'x{10000}-' + chr(92) + 'x{10FFFF}]', '')}))"


def tokens(x: str) -> str:
    return f"cast((({units(x)} + 3) // 4) as bigint)"


def escape(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


def decode(x: str) -> str:
    """References that occur in the pages; the ampersand comes last."""
    for name, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, {lit(name)}, {lit(char)})"
    return x


def word(n: int) -> str:
    return f"coalesce(nullif(regexp_replace(split_part(text, ' ', {n}), '[^A-Za-z]', '', 'g'), ''), 'x')"


WHOLE = "coalesce(nullif(trim(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g')), ''), 'x')"
WORDS = (f"words AS (SELECT doc_id, lang, text, {word(1)} AS a, {word(2)} AS b, {word(3)} AS c, {WHOLE} AS t, "
         "cast(doc_id AS varchar) AS i FROM documents)")


def slug(url: str, fallback: str = "page") -> str:
    host = f"lower(regexp_extract({url}, '^[a-z]+://([^/?#:]+)', 1))"
    last = f"coalesce(nullif(regexp_extract(regexp_extract({url}, '^[a-z]+://[^/?#]+([^?#]*)', 1), '([^/]+)/*$', 1), ''), {host})"
    out = sub(sub(f"lower(url_decode({last}))", r"\.[a-z]{2,4}$", ""), "[^a-z0-9]+", "-")
    out = sub(f"left(trim({out}, '-'), 35)", "-+$", "")
    return f"coalesce(nullif({out}, ''), {host}, '{fallback}')"


def host(url: str) -> str:
    return f"lower(regexp_extract({url}, '^[a-z]+://([^/?#:]+)', 1))"
