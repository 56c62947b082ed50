"""Scalar text functions as Column expressions."""

from __future__ import annotations

import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliomill.functions.constants import (
    ANCHOR_MAX, FILE_NAME_FALLBACK, HIGH_CONTROLS, MODE_EXTENSIONS, PUNCTUATION, SLUG_FALLBACK, SLUG_MAX,
    TITLE_FALLBACK, TITLE_ILLEGAL, TITLE_MAX, WIKI_FOLDER_PATH, WIKI_HOST, WIKI_PAGE_PATH, WS, WS_CHARACTERS,
)


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def _sub(value, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(_col(value), F.lit(pattern), F.lit(replacement))


def let(value: Column, use) -> Column:
    """Evaluate ``value`` once per row and hand it to ``use``."""
    return F.element_at(F.transform(F.array(value), use), F.lit(1))


def non_empty(value) -> Column:
    """NULL for the empty string: both count as missing."""
    return F.nullif(_col(value), F.lit(""))


# -- lengths -----------------------------------------------------------------------------

def utf16_length(value) -> Column:
    """Length in UTF-16 code units (a character outside the BMP counts twice)."""
    return F.shiftright(F.octet_length(F.encode(_col(value), "UTF-16BE")), 1)


def utf16_prefix(value, units: int) -> Column:
    """First ``units`` UTF-16 code units; a pair that the cut would split is left out."""
    value = _col(value)
    raw = F.encode(value, "UTF-16BE")
    at_cut = F.hex(F.substring(raw, 2 * units - 1, 2))
    cut = F.when(at_cut.between("D800", "DBFF"), 2 * units - 2).otherwise(2 * units)
    return F.when(F.length(value) <= units // 2, value).when(
        value.rlike(r"[\x{10000}-\x{10FFFF}]"), F.decode(F.substring(raw, F.lit(1), cut), "UTF-16BE")
    ).otherwise(F.substring(value, 1, units))


def estimate_tokens(value) -> Column:
    """A quarter of the UTF-16 length, rounded up."""
    return F.shiftright(utf16_length(value) + 3, 2).cast("bigint")


# -- white space -------------------------------------------------------------------------

def trim_ws(value) -> Column:
    return F.btrim(_col(value), F.lit(WS_CHARACTERS))


def rtrim_ws(value) -> Column:
    return _sub(value, rf"[{WS}]+\z", "")


def ltrim_ws(value) -> Column:
    return _sub(value, rf"^[{WS}]+", "")


def is_blank(value) -> Column:
    return ~_col(value).rlike(rf"[^{WS}]")


def clean_text(value) -> Column:
    """One line of text: collapsed white space, escaped backticks, no space before punctuation."""
    out = _sub(trim_ws(F.coalesce(_col(value), F.lit(""))), rf"[{WS}]+", " ")
    out = F.replace(out, F.lit("`"), F.lit("\\`"))
    return rtrim_ws(_sub(out, rf"[{WS}]+([{PUNCTUATION}])", "$1"))


def tidy_inline(value) -> Column:
    """Trim, collapse blanks and tabs (line feeds stay), drop blanks before punctuation."""
    # One class of characters: with alternatives the pattern takes several times as long, though it matches less often.
    out = _sub(trim_ws(value), r"[ \t]+", " ")
    return _sub(out, rf"[ \t]+([{PUNCTUATION}])", "$1")


# -- entities ----------------------------------------------------------------------------

def _entity_names() -> dict[str, str]:
    """Named characters of HTML 5 from the standard library with their semicolon, those of HTML 4 first."""
    known = html.entities.html5
    first = ["amp;", "lt;", "gt;", "quot;", "nbsp;", "copy;", "apos;"] + [f"{n};" for n in sorted(html.entities.name2codepoint)]
    names = dict.fromkeys([*first, *sorted(n for n in known if n.endswith(";"))])
    return {f"&{n}": known[n] for n in names}


def _bare_names() -> dict[str, str]:
    """Those that also count without a semicolon."""
    return {n: c for n, c in html.entities.html5.items() if not n.endswith(";")}


def _constant_map(entries: dict[str, str]) -> Column:
    """One literal that folds to a constant map; the delimiters are control characters."""
    return F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in entries.items())), F.lit("\x02"), F.lit("\x01"))


def _code_point(value: Column) -> Column:
    """Character for a code point held in a BIGINT; U+FFFD where none exists."""
    bad = (value <= 0) | value.between(0xD800, 0xDFFF) | (value > 0x10FFFF) | value.isNull()
    high = F.try_element_at(F.array(*[F.lit(x) for x in HIGH_CONTROLS]), (value - 127).cast("int"))
    safe = F.when(bad, F.lit(0xFFFD)).when(value.between(128, 159), high).otherwise(value)
    return F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")


def decode_entities(value, in_attribute: bool = False) -> Column:
    """Replace character references in one pass, so ``&amp;lt;`` becomes ``&lt;``.

    A name takes its semicolon; without one the longest name that may stand bare counts, but in an attribute not before
    a letter, a digit or an equals sign. Numbers count with and without a semicolon.
    """
    value = _col(value)
    names, bare = _constant_map(_entity_names()), _bare_names()
    longest = "|".join(sorted(bare, key=lambda n: (-len(n), n)))

    def number(text: Column, base: int) -> Column:
        """Leading zeros do not count; what is longer than any code point has none."""
        short = F.ltrim(text, F.lit("0"))
        return F.when(F.length(short) <= 8, F.conv(F.concat(F.lit("0"), short), base, 10).cast("bigint"))

    def without_semicolon(part: Column) -> Column:
        name = F.regexp_extract(part, rf"^&({longest})", 1)
        rest = F.substring(part, F.length(name) + 2, F.length(part))
        known = name != ""
        if in_attribute:
            known &= ~rest.rlike("^[0-9A-Za-z=]")
        return F.when(known, F.concat(F.try_element_at(_constant_map(bare), name), rest)).otherwise(part)

    def one(part: Column) -> Column:
        digits = F.regexp_extract(part, r"^&#([0-9]+)", 1)
        hexits = F.regexp_extract(part, r"^&#[xX]([0-9a-fA-F]+)", 1)
        rest = F.regexp_extract(part, r"^&#(?:[0-9]+|[xX][0-9a-fA-F]+);?(.*)", 1)
        return (
            F.when(~part.startswith("&") | (F.length(part) == 1), part)
            .when(digits != "", F.concat(_code_point(number(digits, 10)), rest))
            .when(hexits != "", F.concat(_code_point(number(hexits, 16)), rest))
            .otherwise(F.coalesce(F.try_element_at(names, part), without_semicolon(part)))
        )

    parts = F.regexp_extract_all(value, F.lit(r"&#?[a-zA-Z0-9]+[;=]?|[^&]+|&"), F.lit(0))
    return F.when(F.contains(value, F.lit("&")), F.array_join(F.transform(parts, one), "")).otherwise(value)


# -- HTML output -------------------------------------------------------------------------

def escape_html(value) -> Column:
    out = F.coalesce(_col(value), F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def safe_url(value) -> Column:
    """The URL when its scheme cannot run script, else ``#``."""
    url = trim_ws(_sub(F.coalesce(_col(value), F.lit("")), r"[\x00-\x1f]", ""))
    allowed = url.rlike(r"(?i)^(https?:|mailto:|file:|#|/|\.)")
    has_scheme = url.rlike(r"(?i)^[a-z][a-z0-9+.\-]*:")
    return F.when(allowed | ~has_scheme, url).otherwise("#")


def heading_anchor(value) -> Column:
    out = trim_ws(F.lower(F.coalesce(_col(value), F.lit(""))))
    out = _sub(out, rf"[^0-9A-Za-z_{WS}\-]", "")
    return F.substring(_sub(out, rf"[{WS}]+", "-"), 1, ANCHOR_MAX)


# -- names from URLs and titles ----------------------------------------------------------

URL_PATTERN = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)"


def url_parts(url) -> Column:
    """STRUCT<scheme, host, port, path>, NULL when the URL cannot be parsed."""
    def split(u: Column) -> Column:
        authority = _sub(F.regexp_extract(u, URL_PATTERN, 2), r"^.*@", "")
        return F.struct(
            F.lower(F.regexp_extract(u, URL_PATTERN, 1)).alias("scheme"),
            F.lower(_sub(authority, r":[0-9]*\z", "")).alias("host"),
            F.regexp_extract(authority, r":([0-9]+)\z", 1).alias("port"),
            F.regexp_extract(u, URL_PATTERN, 3).alias("path"))

    def valid(p: Column) -> Column:
        needs_host = p["scheme"].isin("http", "https", "ws", "wss", "ftp")
        return (p["scheme"] != "") & (~needs_host | ((p["host"] != "") & ~p["host"].rlike(rf"[{WS}]")))

    return let(let(trim_ws(url), split), lambda p: F.when(valid(p), p))


def _percent_decode(value: Column) -> Column:
    """Percent-decoding that keeps ``+`` and gives NULL for a malformed escape."""
    decoded = F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B")))
    given = F.contains(F.upper(value), F.lit("%EF%BF%BD"))
    return let(decoded, lambda d: F.when(~F.contains(d, F.lit("\uFFFD")) | given, d))


def _slug(text: Column) -> Column:
    out = _sub(_sub(F.lower(text), r"\.[a-z]{2,4}\z", ""), r"[^a-z0-9]+", "-")
    return _sub(F.substring(_sub(out, r"^-+|-+\z", ""), 1, SLUG_MAX), r"-+\z", "")


def slugify_url(url, fallback: str = SLUG_FALLBACK) -> Column:
    """File-name slug from the last path segment, else from the host name."""
    def named(parts: Column) -> Column:
        last = F.coalesce(non_empty(F.regexp_extract(parts["path"], r"([^/]+)/*\z", 1)), parts["host"])
        slug = let(_slug(_percent_decode(last)), lambda s: F.when(s == "", parts["host"]).otherwise(s))
        return F.coalesce(slug, F.lit(fallback))

    return let(url_parts(url), named)


def sanitize_file_name(url) -> Column:
    return slugify_url(url, FILE_NAME_FALLBACK)


def sanitize_title(title) -> Column:
    """File name from a page title: illegal characters replaced, case and blanks kept."""
    out = _sub(trim_ws(F.coalesce(_col(title), F.lit(""))), TITLE_ILLEGAL, "-")
    out = utf16_prefix(_sub(out, rf"[{WS}]+", " "), TITLE_MAX)
    return F.coalesce(non_empty(_sub(out, r"[ .]+\z", "")), F.lit(TITLE_FALLBACK))


def parse_wiki_url(url) -> Column:
    """STRUCT<origin, tenant, content_type, id>; NULL for anything but a wiki page or folder."""
    def parsed(parts: Column) -> Column:
        path, host = parts["path"], parts["host"]
        page, folder = F.regexp_extract(path, WIKI_PAGE_PATH, 1), F.regexp_extract(path, WIKI_FOLDER_PATH, 1)
        default_port = F.concat_ws(":", parts["scheme"], parts["port"]).isin("https:443", "http:80")
        port = F.when((parts["port"] == "") | default_port, "").otherwise(F.concat(F.lit(":"), parts["port"]))
        known = host.rlike(WIKI_HOST) & path.startswith("/wiki/") & ((page != "") | (folder != ""))
        return F.when(known, F.struct(
            F.concat(parts["scheme"], F.lit("://"), host, port).alias("origin"),
            F.substring_index(host, ".", 1).alias("tenant"),
            F.when(page != "", "page").otherwise("folder").alias("content_type"),
            F.coalesce(non_empty(page), folder).alias("id")))

    return let(url_parts(url), parsed)


def normalize_depth(setting) -> Column:
    """Depth limit from a setting: NULL for ``all`` (no limit), else a count of at least 0."""
    setting = _col(setting)
    digits = F.regexp_extract(F.coalesce(setting, F.lit("")), rf"^[{WS}]*([+-]?[0-9]+)", 1)
    return F.when(setting.eqNullSafe("all"), F.lit(None).cast("bigint")).otherwise(
        F.greatest(F.lit(0).cast("bigint"),
                   F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))))


def next_cursor(link) -> Column:
    """Cursor parameter of a next-page link; NULL when there is none."""
    raw = F.try_parse_url(_col(link), F.lit("QUERY"), F.lit("cursor"))
    return F.try_url_decode(raw)


def markdown_title(text, path) -> Column:
    """First level-1 heading of a Markdown text, else its decoded file name."""
    heading = F.regexp_extract(_col(text), rf"(?m)^#[{WS}]+(.+?)[{WS}]*#*[{WS}]*$", 1)
    name = F.coalesce(non_empty(F.regexp_extract(_col(path), r"([^/]*)\z", 1)), F.lit("markdown"))
    return F.coalesce(non_empty(heading), _percent_decode(name))


# -- output formats ----------------------------------------------------------------------

def json_string(value) -> Column:
    """A JSON string literal."""
    listed = F.to_json(F.array(F.coalesce(_col(value), F.lit(""))))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def mode_extension(mode) -> Column:
    mode = _col(mode)
    out = F.lit(MODE_EXTENSIONS["md"])
    for name, ext in MODE_EXTENSIONS.items():
        out = F.when(mode == name, ext).otherwise(out)
    return out


def render_output(mode, url, title, markdown, timestamp: str, escaped: bool = False) -> Column:
    """The converted page in one of the three output formats.

    ``timestamp`` is an ISO-8601 instant given by the caller, so results can be repeated.
    ``escaped`` makes the XML form well-formed; by default its parts are put in as they are.
    """
    mode, url, title, markdown = _col(mode), _col(url), _col(title), _col(markdown)
    fields = [("url", json_string(url)), ("title", json_string(title)), ("markdown", json_string(markdown)),
              ("tokens", estimate_tokens(markdown).cast("string")), ("timestamp", json_string(F.lit(timestamp)))]
    lines = [F.concat(F.lit(f'  "{name}": '), value) for name, value in fields]
    as_json = F.concat(F.lit("{\n"), F.concat_ws(",\n", *lines), F.lit("\n}"))
    body, source = markdown, F.coalesce(url, F.lit(""))
    if escaped:
        body, source = escape_html(body), escape_html(source)
    as_xml = F.concat(F.lit("<document>\n<source>"), source, F.lit("</source>\n<document_content>\n"),
                      body, F.lit("\n</document_content>\n</document>"))
    return F.when(mode == "json", as_json).when(mode == "xml", as_xml).otherwise(markdown)
