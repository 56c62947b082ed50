"""Element extents, nesting and content selection over the token table.

Tags are not parsed into a tree. Each question about nesting is a running window over the
tokens of a page, so the plan has no self-join and never forms element x token pairs:

* an end tag belongs to the start tag of the same name at the same nesting level;
* "inside an element" is a running count of starts minus ends;
* a property of an element's content (characters, paragraphs, ...) is the difference of a
  running total between its start and its end.

Facts that only travel along are packed in structs, which a window copies as one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill.functions.constants import (
    CODE_LANGUAGE_ATTRIBUTES, CODE_LANGUAGE_CLASS, CONTENT_MIN_CHARS, CONTENT_SELECTORS, DENSITY_MIN_CHARS,
    DENSITY_MIN_PARAGRAPHS, DENSITY_TAGS, FALLBACK_TAGS, HEADING_TAGS, SKIP_CLASSES, SKIP_ROLES, SKIP_TAGS,
)
from foliomill.functions.text import is_blank, ltrim_ws, non_empty, rtrim_ws, utf16_length
from foliomill.operators.html_tokens import RAW_TAGS, VOID_TAGS, attribute, tokenize, with_attributes, with_text

# Tags that end an open paragraph.
PARAGRAPH_BREAKERS = [
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup",
    "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul",
]
# Elements whose end tag may be left out; they end at the next one of their kind.
OPTIONAL_END_TAGS = ["p", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "option", "colgroup"]
CELL_TAGS = ["td", "th"]
LIST_TAGS = ["ul", "ol"]
# They nest in this order; a start tag ends what is open from its own place on. A paragraph comes last.
IMPLIED_ENDS = [["thead", "tbody", "tfoot", "colgroup"], ["tr"], CELL_TAGS, ["li", "dt", "dd", "option"], ["p"]]
SECTION, ROW, CELL, ITEM, PARAGRAPH = range(1, 6)

# Flags of a start tag. The low bits of ``flags`` are the content selectors that it matches.
N_SELECTORS = len(CONTENT_SELECTORS)
CHROME, HIDDEN, BOX, README, MAIN, OG_TITLE, TW_TITLE = (1 << (N_SELECTORS + k) for k in range(7))
SELECTOR_MASK = (1 << N_SELECTORS) - 1


def starts(*tags: str) -> Column:
    return (F.col("kind") == "open") & F.col("tag").isin(*tags)


def ends(*tags: str) -> Column:
    return (F.col("kind") == "close") & F.col("tag").isin(*tags)


def has_flag(flag: int, flags: str = "flags") -> Column:
    return F.col(flags).bitwiseAND(F.lit(flag)) != 0


def _class_in(*names: str) -> Column:
    return F.coalesce(F.arrays_overlap("classes", F.array(*[F.lit(n) for n in names])), F.lit(False))


def _is(name: str, *values: str) -> Column:
    return F.coalesce(F.col(name).isin(*values), F.lit(False))


def _styled(pattern: str) -> Column:
    return F.coalesce(F.col("style").rlike(rf"(?i)(^|;)\s*{pattern}"), F.lit(False))


def _selector_test(selector: str) -> Column:
    """Match by the element itself; an ancestor in the selector is checked by ``with_container``."""
    last = selector.split(" ")[-1]
    if last.startswith("."):
        return _class_in(last[1:])
    if last.startswith("#"):
        return _is("elem_id", last[1:])
    if last == "[data-content]":
        return F.col("has_data_content")
    if last.startswith("["):
        return _is(*last[1:-1].split("="))
    if "." in last:
        tag, cls = last.split(".")
        return (F.col("tag") == tag) & _class_in(cls)
    return F.col("tag") == last


def _flags() -> Column:
    """All flags of a start tag. Visibility is inherited by its content, display is not."""
    content_tag = ~F.col("tag").isin("html", "body", "head")
    chrome = F.col("tag").isin(SKIP_TAGS) | _is("role", *SKIP_ROLES) | _class_in(*SKIP_CLASSES) \
        | _styled(r"visibility\s*:\s*hidden")
    # Selectors whose last part is a bare tag name need no attribute of the element.
    last = [s.split(" ")[-1] for s in CONTENT_SELECTORS]
    by_attribute = [(1 << k, _selector_test(s)) for k, s in enumerate(CONTENT_SELECTORS) if not last[k].isalpha()]
    by_attribute += [
        (CHROME, content_tag & chrome), (HIDDEN, _styled(r"display\s*:\s*none")), (BOX, _class_in("container")),
        (README, _is("elem_id", "readme")), (MAIN, F.col("tag").isin("main", "article") | _is("role", "main")),
        (OG_TITLE, F.col("og_title").isNotNull()), (TW_TITLE, F.col("tw_title").isNotNull()),
    ]
    plain = F.lit(0)
    for tag in ("main", "article", "section", *SKIP_TAGS):
        own = CHROME if tag in SKIP_TAGS else MAIN if tag in ("main", "article") else 0
        value = own | sum(1 << k for k, part in enumerate(last) if part == tag)
        plain = F.when(F.col("tag") == tag, value).otherwise(plain)
    rich = plain
    for bit, test in by_attribute:
        rich = rich.bitwiseOR(F.when(test, bit).otherwise(0))
    # Most tags have no attributes: only the tag name can match then.
    value = F.when(F.col("attrs").isNull(), plain).otherwise(rich)
    return F.when(F.col("kind") == "open", value).otherwise(0).cast("bigint")


def tagged_tokens(pages: DataFrame, id_col: str, html_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Tokens with decoded ``text``, ``flags`` and ``info``.

    ``info`` is the one attribute value a tag is asked for later: the target of a link, the
    declared language of code, or the content of a title meta tag. Columns in ``keep`` stay
    on the first row of a page.
    """
    rows = tokenize(pages, id_col, html_col, keep).where("kind <> 'comment' OR pos <= 0")
    is_meta, is_code = F.col("tag") == "meta", F.col("tag").isin("pre", "code")
    declared = F.coalesce(*[non_empty(attribute(a)) for a in CODE_LANGUAGE_ATTRIBUTES])
    rows = with_attributes(with_text(rows)).select(
        id_col, *keep, "pos", "kind", "tag", "text", "attrs",
        F.filter(F.split(attribute("class"), r"\s+"), lambda c: c != "").alias("classes"),
        attribute("id").alias("elem_id"), attribute("role").alias("role"), attribute("style").alias("style"),
        attribute("itemprop").alias("itemprop"),
        F.coalesce(F.exists("attrs", lambda a: a["name"] == "data-content"), F.lit(False)).alias("has_data_content"),
        F.when(F.col("tag") == "a", attribute("href")).when(is_code, F.lower(F.coalesce(
            non_empty(F.regexp_extract(F.coalesce(attribute("class"), F.lit("")), CODE_LANGUAGE_CLASS, 1)), declared,
        ))).alias("link_or_language"),
        F.when(is_meta & (attribute("property") == "og:title"), attribute("content")).alias("og_title"),
        F.when(is_meta & (attribute("name") == "twitter:title"), attribute("content")).alias("tw_title"),
    )
    return rows.select(
        id_col, *[F.when(F.col("pos") <= 0, F.col(c)).alias(c) for c in keep], "pos", "kind", "tag", "text",
        F.coalesce("link_or_language", "og_title", "tw_title").alias("info"), _flags().alias("flags"))


def _order(id_col: str):
    return Window.partitionBy(id_col).orderBy("pos")


def _running(id_col: str):
    return _order(id_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _page(id_col: str):
    return _order(id_col).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _next_known(expression: str, id_col: str) -> Column:
    """The next value on the page that is not NULL, after the current token."""
    return F.expr(f"lead({expression}, 1) IGNORE NULLS OVER (PARTITION BY `{id_col}` ORDER BY pos)")


SIZES = ["text_end", "n_elements", "n_blocks", "n_p", "p_chars"]


def with_totals(tokens: DataFrame, id_col: str, measure_text: bool = True) -> DataFrame:
    """Running totals over each page.

    ``cur_p`` is the open paragraph, ``at`` holds how many characters, cells, list items and tokens
    with output there have been, ``max_pos`` is the last token. With ``measure_text``, ``sizes`` holds the totals that content selection compares,
    and ``whole`` their values at the end of the page.
    """
    run, page = _running(id_col), _page(id_col)
    is_break = F.col("kind").isin("open", "close") & F.col("tag").isin(PARAGRAPH_BREAKERS)
    first = {
        "_break": F.last(F.when(is_break, F.struct("pos", starts("p").alias("is_p"))), ignorenulls=True).over(run),
        "_points": F.sum(F.coalesce(F.char_length("text"), F.lit(0))).over(run).cast("int"),
        "_cells": F.count_if(starts(*CELL_TAGS)).over(run).cast("int"),
        "_items": F.count_if(starts("li")).over(run).cast("int"),
        "_out": F.count_if((F.coalesce("text", F.lit("")) != "") | starts("br", "code")).over(run).cast("int"),
        "max_pos": F.max("pos").over(page),
    }
    if measure_text:
        first |= {
            "_chars": F.sum("_len").over(run),
            "_elements": F.count_if(F.col("kind").isin("open", "raw")).over(run),
            "_heads": F.count_if(starts(*HEADING_TAGS)).over(run),
            "_n_p": F.count_if(starts("p")).over(run),
        }
        tokens = tokens.withColumn("_len", F.when(F.col("text").isNull(), 0).otherwise(utf16_length("text")))
    rows = tokens.withColumns(first)
    at = F.struct(F.col("_points").alias("chars"), F.col("_cells").alias("n_cells"), F.col("_items").alias("n_items"), F.col("_out").alias("n_out"))
    rows = rows.withColumns({"cur_p": F.when(F.col("_break.is_p"), F.col("_break.pos")), "at": at}).drop("_points", "_cells", "_items", "_out")
    if not measure_text:
        return rows.drop("_break")

    full = F.col("text").isNotNull() & ~is_blank("text")
    before = F.col("_chars") - F.col("_len")
    rows = rows.drop("_break").withColumns({
        "_first": F.when(full, before + F.col("_len") - utf16_length(ltrim_ws("text"))),
        "_last": F.when(full, before + utf16_length(rtrim_ws("text"))),
    }).withColumns({
        "_text_end": F.coalesce(F.max("_last").over(run), F.lit(0).cast("bigint")),
        "_text_start": _next_known("_first", id_col),
        "_all_text": F.coalesce(F.max("_last").over(page), F.lit(0).cast("bigint")),
    })
    rows = rows.drop("_first", "_last").withColumn("_brk_text", F.when(is_break, F.col("_text_end")))
    rows = rows.withColumn("_p_end", F.when(starts("p"), F.coalesce(_next_known("_brk_text", id_col), F.col("_all_text"))))
    p_len = F.coalesce(F.greatest(F.lit(0), F.col("_p_end") - F.col("_text_start")), F.lit(0))
    sizes = F.struct(F.col("_text_end").alias("text_end"), F.col("_elements").alias("n_elements"),
                     (F.col("_heads") + F.col("_n_p")).alias("n_blocks"), F.col("_n_p").alias("n_p"),
                     F.col("_p_chars").alias("p_chars"), F.col("_text_start").alias("text_start"))
    rows = rows.withColumn("_p_chars", F.sum(p_len).over(run)).withColumn("sizes", sizes)
    rows = rows.drop("_len", "_chars", "_elements", "_heads", "_n_p", "_text_end", "_text_start", "_all_text",
                     "_brk_text", "_p_end", "_p_chars")
    return rows.withColumn("whole", F.last("sizes").over(page))


def inside_any(tokens: DataFrame, id_col: str, tags: list[str], name: str) -> DataFrame:
    """Add ``name``: whether an element of one of ``tags`` is open at a token.

    An end tag closes something unless there have never been so few starts less ends, so this needs no pairs, and no other order
    than that of the page.
    """
    run = _running(id_col)
    rows = tokens.withColumns({f"_n{k}": F.sum(F.when(starts(t), 1).when(ends(t), -1).otherwise(0)).over(run) for k, t in enumerate(tags)})
    rows = rows.withColumns({f"_low{k}": F.min(f"_n{k}").over(run) for k in range(len(tags))})
    found = F.lit(False)
    for k in range(len(tags)):
        found |= F.col(f"_n{k}") > F.least(F.lit(0), F.col(f"_low{k}"))
    return rows.withColumn(name, found).drop(*[f"{c}{k}" for c in ("_n", "_low") for k in range(len(tags))])


def element_sizes(at_end: Column) -> dict[str, Column]:
    """Measures of an element's content, on its start tag."""
    def grown(name: str) -> Column:
        return at_end[name] - F.col(f"sizes.{name}")

    return {
        "n_chars": F.coalesce(F.greatest(F.lit(0), at_end["text_end"] - F.col("sizes.text_start")), F.lit(0)),
        "n_blocks": grown("n_blocks"), "n_paragraphs": grown("n_p"), "paragraph_chars": grown("p_chars"),
        "n_descendants": grown("n_elements"),
    }


def end_of_page() -> Column:
    """More than any page has, in the form of ``at``."""
    return F.struct(*[F.lit(2**31 - 1).alias(c) for c in ("chars", "n_cells", "n_items", "n_out")])


def with_extents(tokens: DataFrame, id_col: str, measure_text: bool = True) -> DataFrame:
    """Match start and end tags by name and level.

    Start tags get ``end_pos``, ``is_closed`` and ``end_at``; one without an end tag reaches to
    the end of the page. End tags get ``opener``, the facts of their start tag. With
    ``measure_text`` start tags also get ``measure``: the sizes of their content.
    """
    paired = F.col("tag").isNotNull() & ~F.col("tag").isin(VOID_TAGS + OPTIONAL_END_TAGS + RAW_TAGS)
    delta = F.when(~paired, 0).when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    by_tag = Window.partitionBy(id_col, "tag").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = F.when(paired, F.sum(delta).over(by_tag) + F.when(F.col("kind") == "close", 1).otherwise(0))
    by_level = Window.partitionBy(id_col, "tag", "_level").orderBy("pos")
    rows = tokens.withColumn("_level", level).withColumns({
        "_next": F.lead(F.struct("kind", "pos", "at", *(["sizes"] if measure_text else []))).over(by_level),
        "_prev": F.lag(F.struct("kind", "pos", "info", "flags", "at")).over(by_level),
    })
    starting = paired & (F.col("kind") == "open")
    closed = starting & F.coalesce(F.col("_next.kind") == "close", F.lit(False))
    known = {
        "is_closed": closed,
        "end_pos": F.when(closed, F.col("_next.pos")).when(starting, F.col("max_pos") + 1),
        "end_at": F.when(closed, F.col("_next.at")).when(starting, end_of_page()),
        "opener": F.when(paired & (F.col("kind") == "close") & (F.col("_prev.kind") == "open"), F.col("_prev")),
    }
    if measure_text:
        at_end = F.when(closed, F.col("_next.sizes")).otherwise(F.col("whole"))
        known["measure"] = F.when(starting, F.struct(*[v.alias(k) for k, v in element_sizes(at_end).items()]))
    return rows.withColumns(known).drop("_next", "_prev", "_level", "max_pos", "sizes", "whole")


def _depth(flag: int, window) -> Column:
    """Running number of open elements whose start tag carries ``flag``."""
    up = F.when(has_flag(flag) & F.col("end_pos").isNotNull(), 1)
    return F.sum(F.coalesce(up, F.when(has_flag(flag, "opener.flags"), -1), F.lit(0))).over(window)


def with_nesting(tokens: DataFrame, id_col: str) -> DataFrame:
    """Running nesting state: skipped and main regions, lists, tables and the open leaf blocks."""
    run = _running(id_col)

    def latest(*tags: str) -> Column:
        return F.last(F.when(starts(*tags), F.struct("pos", "end_pos")), ignorenulls=True).over(run)

    def nesting(*tags: str) -> Column:
        return F.sum(F.when(starts(*tags), 1).when(ends(*tags) & F.col("opener").isNotNull(), -1).otherwise(0)).over(run).cast("int")

    level = F.sum(F.when(F.col("is_closed"), 1).when(F.col("opener").isNotNull(), -1).otherwise(0)).over(run)
    rows = tokens.withColumns({
        "_chrome": _depth(CHROME, run), "_main": _depth(MAIN, run), "_readme": _depth(README, run),
        "list_depth": nesting(*LIST_TAGS), "table_depth": nesting("table"),
        "open_after": level.cast("int"),
        "_h": latest(*HEADING_TAGS), "_pre": latest("pre"), "_code": latest("code"),
    })

    def inside(name: str) -> Column:
        return F.when(F.col("pos") <= F.col(f"{name}.end_pos"), F.col(f"{name}.pos"))

    def outermost(depth: str, *tags: str) -> Column:
        return F.last(F.when(starts(*tags) & (F.col(depth) == 1), F.col("pos")), ignorenulls=True).over(run)

    own_readme = F.when(has_flag(README) & (F.col("kind") == "open"), 1).otherwise(0)
    return rows.withColumns({
        "skipped": (F.col("_chrome") > 0) | has_flag(CHROME | HIDDEN),
        "in_main": F.col("_main") > 0, "in_readme": F.col("_readme") - own_readme > 0,
        "cur_h": inside("_h"), "cur_pre": inside("_pre"), "cur_code": inside("_code"),
        "top_list": outermost("list_depth", *LIST_TAGS), "top_table": outermost("table_depth", "table"),
    }).drop("_h", "_pre", "_code", "_chrome", "_main", "_readme")


def with_scopes(tokens: DataFrame, id_col: str) -> DataFrame:
    """Add ``scope``: STRUCT<pos, tag, box, end_at> of the closed element that holds a token, NULL at the top of the page.

    After a token as many elements are open as ``open_after`` says, and the innermost of them is the last one whose start
    tag left that many open. A start tag stands where the token before it left off. The token after a start tag tells of
    it, so a token and a start tag that stand in one element are of one depth and are looked at in one order.
    """
    opened = F.when(F.col("is_closed"), F.struct("pos", "tag", has_flag(BOX).alias("box"), "end_at"))
    # The order of the page is that of the windows before.
    entered = F.lag(F.struct(opened.alias("scope"), "open_after")).over(_order(id_col))
    rows = tokens.withColumns({"_entered": entered, "_depth": F.col("open_after") - F.col("is_closed").cast("int")})
    same = Window.partitionBy(id_col, "_depth").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    innermost = F.last(F.when(F.col("_entered.open_after") == F.col("_depth"), F.col("_entered.scope")), ignorenulls=True).over(same)
    return rows.withColumn("scope", F.when(F.col("_depth") > 0, innermost)).drop("_entered", "_depth")


def with_parents(tokens: DataFrame, id_col: str) -> DataFrame:
    """Add ``parent``: STRUCT<pos, tag> of the element that a token stands in (position -1 at the top of the page).

    End tags that are left out count: within a scope the elements of ``IMPLIED_ENDS`` nest in that order, and a
    start or end tag ends what is open from its place on. A page body, list or table that is never closed holds the rest
    of its scope; any other element without an end tag holds nothing. ``n_open`` counts the elements between scope and token.

    ``is_item`` marks tags of items that stand directly in a list, ``in_item`` tags of lists that stand directly in such an
    item. ``row_start`` marks the first token of a table row, which is a cell where the row's tag is left out;
    ``cell_end`` and ``row_end`` hold ``at`` where the cell or row that starts here ends.
    """
    rank = F.lit(None).cast("int")
    for k, tags in enumerate(IMPLIED_ENDS, 1):
        rank = F.when(F.col("tag").isin(tags), k).otherwise(rank)
    begins = F.col("kind") == "open"
    never_closed = begins & F.col("tag").isin("html", "body", *LIST_TAGS, "table", "dl", "select") & ~F.col("is_closed")
    rows = tokens.withColumns({
        "_rank": F.when(F.col("kind").isin("open", "close"), rank), "_holds": never_closed,
        "_breaks": begins & F.col("tag").isin(PARAGRAPH_BREAKERS), "_in": F.coalesce("scope.pos", F.lit(-1))})
    order = Window.partitionBy(id_col, "_in").orderBy("pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)

    def ends_from(k: int) -> Column:
        return F.coalesce(F.col("_rank") <= k, F.lit(False)) | F.col("_holds")

    def latest(k: int, opened: Column, closed: Column, more: Column = F.lit(False)) -> Column:
        return F.last(F.when(begins & (F.col("_rank") == k), opened).when(ends_from(k) | more, closed), ignorenulls=True).over(before)

    def next_at(k: int) -> Column:
        following = F.expr(f"lead(_stop{k}, 1) IGNORE NULLS OVER (PARTITION BY `{id_col}`, _in ORDER BY pos)")
        return F.coalesce(following, F.col("scope.end_at"), end_of_page())

    here, none = F.struct("pos", "tag"), F.struct(F.lit(-1).alias("pos"), F.lit("").alias("tag"))
    edge = F.when(ends_from(ROW), "row").when(begins & (F.col("_rank") == CELL), "cell")
    rows = rows.withColumns({f"_stop{k}": F.when(ends_from(k), F.col("at")) for k in (ROW, CELL)}).withColumns({
        "_o0": F.last(F.when(F.col("_holds"), here), ignorenulls=True).over(before), "_n0": F.count_if("_holds").over(before),
        **{f"_o{k}": latest(k, here, none) for k in (SECTION, ROW, CELL)},
        "_edge": F.last(edge, ignorenulls=True).over(before), "_row_end": next_at(ROW), "_cell_end": next_at(CELL)})
    holder = F.greatest(F.when(F.col("scope").isNotNull(), F.struct("scope.pos", "scope.tag")).otherwise(none), F.col("_o0"))
    around = F.greatest(holder, *[F.col(f"_o{k}") for k in (SECTION, ROW, CELL)])
    rows = rows.withColumn("_list", (F.col("tag") == "li") & around["tag"].isin(LIST_TAGS))
    rows = rows.withColumns({
        "_o4": latest(ITEM, F.struct("pos", "tag", F.col("_list").alias("in_list")), F.struct(none["pos"], none["tag"], F.lit(False).alias("in_list"))),
        "_o5": latest(PARAGRAPH, here, none, F.col("_breaks"))})
    limit = F.when(begins & F.col("_rank").isNotNull(), F.col("_rank")).when(F.col("_breaks"), PARAGRAPH).otherwise(PARAGRAPH + 1)
    inner = {SECTION: "_o1", ROW: "_o2", CELL: "_o3", ITEM: F.struct("_o4.pos", "_o4.tag"), PARAGRAPH: "_o5"}
    counted = [F.when((limit > k) & (F.col(f"_o{k}.pos") >= 0), 1).otherwise(0) for k in inner]
    parent = F.greatest(holder, *[F.when(limit > k, F.col(c) if isinstance(c, str) else c) for k, c in inner.items()])
    no_row = F.coalesce(F.col("_o2.pos"), F.lit(-1)) < 0
    rows = rows.withColumns({
        "parent": parent, "n_open": sum(counted, F.col("_n0")).cast("int"),
        "row_start": starts("tr") | (starts(*CELL_TAGS) & no_row & ~F.col("_edge").eqNullSafe("cell")),
        "row_end": F.col("_row_end"), "cell_end": F.col("_cell_end")})
    in_listed = F.coalesce(F.col("_o4.in_list"), F.lit(False))
    known = {"is_item": F.when(begins, F.col("_list")).otherwise(ends("li") & in_listed),
             "in_item": F.col("tag").isin(LIST_TAGS) & in_listed & (F.col("parent.pos") == F.col("_o4.pos"))}
    return rows.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in known.items()}).drop(
        "_rank", "_holds", "_breaks", "_in", "_n0", "_edge", "_row_end", "_cell_end", "_list", *[f"_o{k}" for k in range(6)], *[f"_stop{k}" for k in (ROW, CELL)])


def with_child_numbers(tokens: DataFrame, id_col: str) -> DataFrame:
    """Add ``child_no``: the place of an element among the elements of its parent, from 1."""
    same = Window.partitionBy(id_col, "parent.pos").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_element = F.col("kind").isin("open", "raw") & F.col("tag").isNotNull()
    return tokens.withColumn("child_no", F.count_if(is_element).over(same).cast("int"))


def with_levels(tokens: DataFrame, id_col: str) -> DataFrame:
    """Add ``level``: how many elements a token stands in."""
    holds = F.col("n_open") + 1
    change = F.when(F.col("is_closed"), holds).when(F.col("opener").isNotNull(), -holds).otherwise(0)
    inside = F.sum(change).over(_running(id_col)) - F.when(F.col("is_closed"), holds).otherwise(0)
    return tokens.withColumn("level", (inside + F.col("n_open")).cast("int"))


def with_candidates(tokens: DataFrame, id_col: str) -> DataFrame:
    """Mark start tags that may be the content container: ``rank`` (lower wins) and ``density``.

    A selector counts for its first match on the page only. Ranks after the selectors stand
    for the first valid section, the densest element and the body.
    """
    readme, boxed = CONTENT_SELECTORS.index("#readme article"), CONTENT_SELECTORS.index(".container > section")
    in_box = F.coalesce(F.col("scope.box"), F.lit(False))
    off = F.when(F.col("in_readme"), 0).otherwise(1 << readme) + F.when(in_box, 0).otherwise(1 << boxed)
    bits = F.col("flags").bitwiseAND(F.lit(SELECTOR_MASK)).bitwiseAND(F.bitwise_not(off.cast("bigint")))
    before = _order(id_col).rowsBetween(Window.unboundedPreceding, -1)
    rows = tokens.withColumn("_bits", F.when(F.col("end_pos").isNotNull(), bits).otherwise(0))
    rows = rows.withColumn("_seen", F.coalesce(F.bit_or("_bits").over(before), F.lit(0)))
    fresh = F.col("_bits").bitwiseAND(F.bitwise_not(F.col("_seen")))
    valid = F.coalesce((F.col("measure.n_chars") > CONTENT_MIN_CHARS) & (F.col("measure.n_blocks") > 0), F.lit(False))
    dense = starts(*DENSITY_TAGS) & (F.col("measure.n_paragraphs") >= DENSITY_MIN_PARAGRAPHS) & (
        F.col("measure.paragraph_chars") >= DENSITY_MIN_CHARS)
    density = F.when(dense, F.col("measure.paragraph_chars") / F.greatest(F.lit(1), F.col("measure.n_descendants")))
    rank = (
        F.when(valid & (fresh != 0), F.bit_count(fresh.bitwiseAND(-fresh) - 1))
        .when(valid & starts(*FALLBACK_TAGS), N_SELECTORS)
        .when(dense, N_SELECTORS + 1)
        .when(starts("body"), N_SELECTORS + 2)
    ).cast("int")
    return rows.withColumns({"is_valid": valid, "density": density, "rank": rank}).drop("_seen", "_bits")


def with_container(tokens: DataFrame, id_col: str) -> DataFrame:
    """Add ``container``: STRUCT<rank, tie, pos, end_pos, tag> of the page, on every row."""
    rows = with_candidates(tokens, id_col)
    tie = F.when(F.col("rank") == N_SELECTORS + 1, -F.col("density")).otherwise(0.0)
    choice = F.when(F.col("rank").isNotNull(), F.struct("rank", tie.alias("tie"), "pos", "end_pos", "tag"))
    return rows.withColumn("container", F.min(choice).over(_page(id_col)))
