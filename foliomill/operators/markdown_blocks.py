"""Markdown text to blocks, inside the row.

One possessive regular expression cuts a document into its blocks: its alternatives are the
block rules in their order, so a line is taken by the first rule that fits. Quotes and lists
are opened level by level with array functions. Nothing here moves rows: a document stays
in its partition until a caller explodes its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.functions.constants import MARKDOWN_MAX_DEPTH
from foliomill.functions.constants import WS_LINE as S
from foliomill.functions.text import let

_MARK = r"(?:[-+*]|[0-9]{1,9}[.)])"
_ITEM = rf"[{S}]*+{_MARK}[{S}][^\n]*+\n"
_FULL = rf"[{S}]*+[^{S}\n][^\n]*+\n"
_DELIMITER = rf"[{S}]*+\|?+[{S}]*+:?+-{{3,}}+:?+[{S}]*+(?:\|[{S}]*+:?+-{{3,}}+:?+[{S}]*+)*+\|?+[{S}]*+\n"
_PARAGRAPH_END = rf"[{S}]*+(?:```|~~~)|\#{{1,6}}[{S}]|[{S}]{{0,3}}>|[{S}]*+{_MARK}[{S}]"

BLANK = rf"(?:[{S}]*+\n)++"
HEADING = rf"\#{{1,6}}[{S}][^\n]*+\n"
RULE = rf"[{S}]{{0,3}}(?:(?:-[{S}]*+){{3,}}+|(?:\*[{S}]*+){{3,}}+|(?:_[{S}]*+){{3,}}+)\n"
# A quote line that is not empty may be followed by plain lines, which belong to the quote.
QUOTE = (rf"(?:[{S}]{{0,3}}>[{S}]*+\n"
         rf"|[{S}]{{0,3}}>{_FULL}(?:(?![{S}]{{0,3}}>){_FULL})*+)++")
LIST = rf"{_ITEM}(?:(?:[{S}]*+\n)?+{_ITEM})*+"
TABLE = rf"[^\n|]*+\|[^\n]*+\n{_DELIMITER}(?:[^\n|]*+\|[^\n]*+\n)*+"
PARAGRAPH = rf"[^\n]*+\n(?:(?!{_PARAGRAPH_END}){_FULL})*+"


def _fence(mark: str) -> str:
    return rf"[{S}]*+{mark}[^\n]*+\n(?:(?![{S}]*+{mark})[^\n]*+\n)*+(?:[^\n]*+\n)?+"


BLOCK_PATTERN = "|".join([BLANK, _fence("```"), _fence("~~~"), HEADING, RULE, QUOTE, LIST, TABLE, PARAGRAPH])

# Lists of one run: a line less indented than the first one starts a new list.
_LIST_PATTERN = r"( *+)[^ \n][^\n]*+\n(?:\1 *+[^ \n][^\n]*+\n)*+"
# An item with the more indented lines below it.
_ITEM_GROUP = r"[^ \n][^\n]*+\n(?: [^\n]*+\n)*+"

BLOCK_TYPE = "struct<kind:string,text:string,depth:int,ordered:boolean>"


def _block(kind, text, depth, ordered=None) -> Column:
    as_col = lambda v, t: (v if isinstance(v, Column) else F.lit(v)).cast(t)
    return F.struct(as_col(kind, "string").alias("kind"), as_col(text, "string").alias("text"),
                    as_col(depth, "int").alias("depth"), as_col(ordered, "boolean").alias("ordered"))


def normalize_lines(text) -> Column:
    """Line feeds only, and one at the end of every line."""
    text = F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit(""))
    return F.concat(F.regexp_replace(text, r"\r\n?", "\n"), F.lit("\n"))


def _kind(text: Column) -> Column:
    return (
        F.when(text.rlike(rf"\A[{S}\n]*+\z"), "blank")
        .when(text.rlike(rf"\A[{S}]*+(?:```|~~~)"), "fence")
        .when(text.rlike(rf"\A\#{{1,6}}[{S}]"), "heading")
        .when(text.rlike(rf"\A{RULE}\z"), "rule")
        .when(text.rlike(rf"\A[{S}]{{0,3}}>"), "quote")
        .when(text.rlike(rf"\A{_ITEM}"), "list")
        .when(text.rlike(rf"\A[^\n|]*+\|[^\n]*+\n{_DELIMITER}"), "table")
        .otherwise("paragraph")
    )


def cut_blocks(lines: Column, depth) -> Column:
    """ARRAY<BLOCK_TYPE> of normalized lines; blank runs are left out."""
    found = F.regexp_extract_all(lines, F.lit(BLOCK_PATTERN), F.lit(0))
    typed = F.transform(found, lambda t: _block(_kind(t), t, depth))
    return F.filter(typed, lambda b: b["kind"] != "blank")


def quoted_lines(text: Column) -> Column:
    """The lines of a quote with one level of marks taken off."""
    return F.regexp_replace(text, F.lit(rf"(?m)^[{S}]{{0,3}}>[{S}]?"), F.lit(""))


# A quote of which every line has so many marks is opened as many levels at once.
LEVELS_AT_ONCE = 8
_MARKS = rf"(?:[{S}]{{0,3}}>[{S}]?){{{LEVELS_AT_ONCE}}}"
_ALL_MARKED = rf"\A(?:{_MARKS}[^\n]*+\n)++\z"
# Text with other ends of lines is left to the single marks: "^" fits behind those too.
_OTHER_ENDS = r"[\x{85}\x{2028}\x{2029}]"


def _open_quote(block: Column) -> Column:
    text, depth = block["text"], block["depth"]

    def levels(n: int, lines: Column) -> Column:
        begin = [_block("markup", "<blockquote>\n", depth + k) for k in range(n)]
        end = [_block("markup", "</blockquote>\n", depth + k) for k in reversed(range(n))]
        return F.concat(F.array(*begin), cut_blocks(lines, depth + n), F.array(*end))

    many = (depth + LEVELS_AT_ONCE <= MARKDOWN_MAX_DEPTH) & text.rlike(_ALL_MARKED) & ~text.rlike(_OTHER_ENDS)
    return F.when(many, levels(LEVELS_AT_ONCE, F.regexp_replace(text, F.lit(rf"(?m)^{_MARKS}"), F.lit("")))).otherwise(levels(1, quoted_lines(text)))


def _even_indent(run: Column) -> Column:
    """A list run without blank lines, indented by plain spaces."""
    return F.regexp_replace(F.regexp_replace(run, F.lit(rf"(?m)^[{S}]*+\n"), F.lit("")), F.lit(rf"(?m)(?:^|\G)[{S}]"), F.lit(" "))


def _open_list(block: Column) -> Column:
    depth = block["depth"]

    def one_list(lines: Column) -> Column:
        indent = F.length(F.regexp_extract(lines, r"\A *", 0))
        width = F.when(depth < MARKDOWN_MAX_DEPTH, F.concat(F.lit("(?m)^ {"), indent.cast("string"), F.lit("}"))).otherwise("(?m)^ +")
        flat = F.regexp_replace(lines, width, F.lit(""))
        ordered = F.regexp_extract(lines, r"\A *([0-9]?)", 1) != ""

        def item(group: Column) -> Column:
            below = F.regexp_replace(group, F.lit(r"\A[^\n]*+\n"), F.lit(""))
            head = F.array(_block("item", F.regexp_extract(group, rf"\A{_MARK}[{S}]+([^\n]*)", 1), depth, ordered))
            nested = F.when(below != "", F.array(_block("list", below, depth + 1))).otherwise(F.array().cast(f"array<{BLOCK_TYPE}>"))
            return F.concat(head, nested, F.array(_block("markup", "</li>\n", depth)))

        items = F.flatten(F.transform(F.regexp_extract_all(flat, F.lit(_ITEM_GROUP), F.lit(0)), item))
        start = F.when(ordered, "<ol>\n").otherwise("<ul>\n")
        end = F.when(ordered, "</ol>\n").otherwise("</ul>\n")
        return F.concat(F.array(_block("markup", start, depth)), items, F.array(_block("markup", end, depth)))

    lists = F.regexp_extract_all(_even_indent(block["text"]), F.lit(_LIST_PATTERN), F.lit(0))
    return F.flatten(F.transform(lists, one_list))


def _open_level(blocks: Column) -> Column:
    def opened(block: Column) -> Column:
        return (F.when((block["kind"] == "quote") & (block["depth"] < MARKDOWN_MAX_DEPTH), _open_quote(block))
                .when(block["kind"] == "list", _open_list(block)).otherwise(F.array(block)))

    return F.flatten(F.transform(blocks, opened))


def with_blocks(documents: DataFrame, text_col: str = "text", out: str = "blocks") -> DataFrame:
    """Add the blocks of a document, with quotes and lists opened into ``markup`` and inner blocks.

    The number of levels to open is bounded by the longest run of quote and item marks at
    the start of a line, so flat documents take no extra pass. Quotes past the depth limit
    stay ``quote`` blocks.
    """
    def longest(pattern: str, measure) -> Column:
        found = F.regexp_extract_all("_lines", F.lit(pattern), F.lit(0))
        return F.coalesce(F.array_max(F.transform(found, measure)), F.lit(0))

    quotes = longest(rf"(?m)^[{S}>]*+(?<=>)|(?m)^[{S}]*+>[{S}>]*", lambda m: F.length(F.regexp_replace(m, F.lit("[^>]"), F.lit(""))))
    lists = longest(rf"(?m)^[{S}>]*+{_MARK}[{S}]", F.length)
    passes = F.least(F.lit(MARKDOWN_MAX_DEPTH + 2), quotes + lists)
    rows = documents.withColumn("_lines", normalize_lines(text_col))
    rows = rows.withColumns({"_passes": passes, "_flat": cut_blocks(F.col("_lines"), F.lit(0))})
    # Passes that find nothing to open cost nothing.
    def state(blocks: Column) -> Column:
        closed = F.exists(blocks, lambda b: (b["kind"] == "list") | ((b["kind"] == "quote") & (b["depth"] < MARKDOWN_MAX_DEPTH)))
        return F.struct(blocks.alias("blocks"), F.coalesce(closed, F.lit(False)).alias("closed"))

    def open_next(acc: Column, _) -> Column:
        return F.when(acc["closed"], let(_open_level(acc["blocks"]), state)).otherwise(acc)

    nested = F.aggregate(F.sequence(F.lit(1), F.greatest("_passes", F.lit(1))), state(F.col("_flat")), open_next)["blocks"]
    return rows.withColumn(out, F.when(F.col("_passes") > 0, nested).otherwise(F.col("_flat"))).drop("_lines", "_passes", "_flat")


def markdown_blocks(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per block: ``block_no`` (document order), ``kind``, ``text``, ``depth``, ``ordered``."""
    rows = with_blocks(documents.select(id_col, *keep, text_col), text_col)
    rows = rows.select(id_col, *keep, F.posexplode(F.filter("blocks", lambda b: b["kind"] != "markup")).alias("block_no", "b"))
    return rows.select(id_col, *keep, "block_no", "b.kind", "b.text", "b.depth", "b.ordered")


# -- parts of single blocks --------------------------------------------------------------

def heading_level(text: Column) -> Column:
    return F.length(F.regexp_extract(text, r"\A#{1,6}", 0))


def heading_text(text: Column) -> Column:
    return F.regexp_extract(text, rf"\A#{{1,6}}[{S}]+([^\n]*?)[{S}]*#*[{S}]*\n\z", 1)


def fence_language(text: Column) -> Column:
    return F.regexp_extract(text, rf"\A[{S}]*(?:`{{3,}}|~{{3,}})[{S}]*([^{S}\n]*)", 1)


def fence_body(text: Column) -> Column:
    """Lines between the fences, each with its line feed; an unclosed fence runs to the end."""
    ticks = rf"(?<=\n)[{S}]*+```[^\n]*+\n\z"
    tildes = rf"(?<=\n)[{S}]*+~~~[^\n]*+\n\z"
    closed = F.when(text.rlike(rf"\A[{S}]*+`"), F.regexp_replace(text, F.lit(ticks), F.lit(""))).otherwise(
        F.regexp_replace(text, F.lit(tildes), F.lit("")))
    return F.regexp_replace(closed, F.lit(r"\A[^\n]*+\n"), F.lit(""))


def without_last_feed(text: Column) -> Column:
    return F.substring(text, F.lit(1), F.length(text) - 1)


def _trim(value: Column) -> Column:
    return F.regexp_replace(value, F.lit(rf"\A[{S}]++|[{S}]++\z"), F.lit(""))


def split_cells(line: Column) -> Column:
    """Cells of a pipe row; an escaped pipe does not separate."""
    row = F.regexp_replace(_trim(line), F.lit(r"\A\||\|\z"), F.lit(""))
    return F.transform(F.split(row, r"(?<!\\)\|", -1), lambda c: F.replace(_trim(c), F.lit("\\|"), F.lit("|")))


def table_lines(text: Column) -> Column:
    return F.split(without_last_feed(text), "\n", -1)


def cell_alignment(cell: Column) -> Column:
    left, right = cell.startswith(":"), cell.endswith(":")
    return F.when(left & right, "center").when(right, "right").when(left, "left").otherwise("")


TASK_PATTERN = rf"\A\[([ xX])\][{S}]+([^\n]*)\z"
