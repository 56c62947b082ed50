"""Token table to Markdown blocks, still one row per block.

Every token goes to the open leaf blocks it belongs to (a heading, paragraph, list item,
cell, code element), whose pieces are put together in order. Cells then form rows, rows form
tables and items form lists. All aggregates are keyed by the page first, so they run on the
partitions that the pages were placed in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill.functions.constants import HEADING_TAGS
from foliomill.functions.text import clean_text, is_blank, let, non_empty, tidy_inline, trim_ws
from foliomill.operators import html_inline
from foliomill.operators.html_structure import (
    CELL_TAGS, LIST_TAGS, OG_TITLE, PARAGRAPH_BREAKERS, TW_TITLE, ends, has_flag, inside_any, starts, tagged_tokens, with_child_numbers,
    with_container, with_extents, with_nesting, with_parents, with_scopes, with_totals,
)


# The members that make up the blocks of each kind.
MEMBERS = {"h": ("h",), "p": ("p",), "pre": ("pre", "code"), "code": ("pre", "code"), "table": ("cells", "table"), "list": ("li", "list"),
           "page": ("page",), "og": ("og",), "tw": ("tw",), "title": ("title",)}
# The elements whose text a member takes.
HOLDERS = {"h": HEADING_TAGS, "pre": ["pre"], "code": ["code"], "cells": ["table"], "li": LIST_TAGS}
# The tags that tell where a member begins and ends, and what it looks like.
SHAPED_BY = {"h": HEADING_TAGS, "p": [*PARAGRAPH_BREAKERS, *html_inline.MARKS, "a", "br"], "pre": ["pre"], "code": ["pre", "code"], "og": ["meta"], "tw": ["meta"]}
# What is known of a block by the elements around it.
AROUND = ("skipped", "nested", "in_main")


def members_of(only: tuple[str, ...] | None) -> set[str] | None:
    return {m for k in only for m in MEMBERS[k]} if only is not None else None


def with_member_tokens(rows: DataFrame, id_col: str, members: set[str]) -> DataFrame:
    """Tokens without the text that lies in no block of the kinds in ``members``.

    Text opens and closes nothing, so the windows after this one give the same without it.
    """
    tags = sorted({t for m in members for t in HOLDERS.get(m, [])})
    needed = (F.col("pos") <= 0) | ~F.col("kind").isin("text", "raw")
    if "p" in members:
        needed |= F.col("cur_p").isNotNull()
    if "title" in members:
        needed |= F.col("tag").eqNullSafe("title")
    return (inside_any(rows, id_col, tags, "_held") if tags else rows.withColumn("_held", F.lit(False))).where(F.col("_held") | needed).drop("_held")


def structured_tokens(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = (),
                      whole_page: bool = True, only: tuple[str, ...] | None = None, around: tuple[str, ...] = AROUND) -> DataFrame:
    """Tokens with extents and nesting; with ``whole_page`` also the page's content container.

    With ``only`` there are the tokens alone that the blocks of these kinds, and what is to be known ``around`` them, are made of.
    """
    rows, members = tagged_tokens(pages, id_col, html_col, keep), members_of(only)
    if members is not None and not whole_page and not around and members <= {*SHAPED_BY, "page", "title"}:
        tags = sorted({t for m in members for t in SHAPED_BY.get(m, [])})
        rows = rows.where(F.col("kind").isin("text", "raw") | F.col("tag").isin(tags) | (F.col("pos") <= 0))
    rows = with_totals(rows, id_col, measure_text=whole_page)
    if members is not None and not whole_page:
        rows = with_member_tokens(rows, id_col, members)
    rows = with_scopes(with_nesting(with_extents(rows, id_col, measure_text=whole_page), id_col), id_col)
    return with_container(rows, id_col) if whole_page else rows


def with_list_items(rows: DataFrame, id_col: str) -> DataFrame:
    """Add the open item of the innermost list, and ``chain``: the outermost list whose Markdown an inner one is part of.

    A list is part of another one's Markdown if it stands directly in an item of it, over any number of steps. Where
    the chain starts, ``chain.outer`` is the item that holds the whole list in some other element, if any. Text that follows
    a nested list belongs to the outer item again, hence the window per list level. ``n_rows`` counts table rows.
    """
    run = Window.partitionBy(id_col, "list_depth").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    item = F.when(F.col("is_item"), F.when(starts("li"), F.col("pos")).otherwise(-1)).when(starts(*LIST_TAGS), -1)
    rows = rows.withColumn("_item", F.last(item, ignorenulls=True).over(run))
    rows = rows.withColumn("cur_li", F.when((F.col("list_depth") > 0) & (F.col("_item") >= 0), F.col("_item"))).drop("_item")
    page = Window.partitionBy(id_col).orderBy("pos")
    so_far = page.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heads = F.when(F.col("in_item"), 0).when(starts(*LIST_TAGS), 1).when(ends(*LIST_TAGS) & F.col("opener").isNotNull(), -1).otherwise(0)
    rows = rows.withColumns({"_heads": F.sum(heads).over(so_far), "_outer": F.lag("cur_li").over(page),
                             "n_rows": F.count_if("row_start").over(so_far).cast("int")})
    head = F.when(starts(*LIST_TAGS) & ~F.col("in_item"), F.struct("pos", "list_depth", F.col("_outer").alias("outer")))
    same = Window.partitionBy(id_col, "_heads").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chain = F.when((F.col("_heads") > 0) & (F.col("list_depth") > 0), F.last(head, ignorenulls=True).over(same))
    return rows.withColumn("chain", chain).drop("_heads", "_outer")


def _memberships(whole_page: bool, members: set[str]) -> Column:
    """The blocks that a token belongs to, of the kinds in ``members``: those it stands in, and those it starts."""
    def member(kind: str, key: str) -> Column:
        return F.when(F.col(key).isNotNull(), F.struct(F.lit(kind).alias("block"), F.col(key).cast("int").alias("key")))

    table_end = ends("table") & F.col("opener").isNotNull()
    named = [("list", starts(*LIST_TAGS)), ("table", starts("table") | table_end), ("li", starts("li") & ~F.col("is_item") & (F.col("list_depth") > 0))]
    if whole_page:
        named += [("og", has_flag(OG_TITLE)), ("tw", has_flag(TW_TITLE)), ("title", (F.col("kind") == "raw") & (F.col("tag") == "title"))]
    own = F.lit(None).cast("string")
    for kind, test in reversed([x for x in named if x[0] in members]):
        own = F.when(test, kind).otherwise(own)
    own_key = F.when(table_end, F.col("opener.pos")).otherwise(F.col("pos")) if "table" in members else F.col("pos")
    found = {
        "page": [F.when(F.col("pos") <= 0, F.struct(F.lit("page").alias("block"), F.col("pos").cast("int").alias("key")))],
        "h": [member("h", "cur_h")], "p": [member("p", "cur_p")], "li": [member("li", "cur_li"), member("li", "chain.outer")],
        "cells": [F.when((F.col("table_depth") > 0) & F.col("top_table").isNotNull(), F.struct(F.lit("cells").alias("block"), F.col("top_table").cast("int").alias("key")))],
        "pre": [member("pre", "cur_pre")], "code": [member("code", "cur_code")]}
    return F.array(F.when(own.isNotNull(), F.struct(own.alias("block"), own_key.cast("int").alias("key"))),
                   *[column for kind, columns in found.items() if kind in members for column in columns])


def leaf_blocks(rows: DataFrame, id_col: str, keep: tuple[str, ...] = (), whole_page: bool = True, members: set[str] | None = None,
                around: tuple[str, ...] = AROUND) -> DataFrame:
    """One row per leaf block: its text or inline Markdown, and ``at``, the facts of its start tag.

    With ``members`` only blocks of these kinds. Facts that none of them needs, and those of ``AROUND`` that are not in ``around``, are
    NULL, so the windows that make them are not planned.
    """
    members = set(sum(MEMBERS.values(), ())) if members is None else members
    in_lists, in_tables, in_code, marked = "li" in members, "cells" in members, "code" in members, bool(members & {"p", "li"})

    def needed(some: bool, value: Column, kind: str) -> Column:
        return value if some else F.lit(None).cast(kind)

    if whole_page and "container" not in rows.columns:
        inside, skipped = F.lit(None).cast("boolean"), F.col("skipped")
    elif whole_page:
        inside = (F.col("pos") > F.coalesce("container.pos", F.lit(-2))) & (
            F.col("pos") < F.coalesce("container.end_pos", F.lit(2**31 - 1)))
        skipped = F.col("skipped")
    else:
        inside, skipped = F.lit(True), F.lit(False)
    nested = (F.col("list_depth") > F.when(starts(*LIST_TAGS), 1).otherwise(0)) \
        | (F.col("table_depth") > F.when(starts("table"), 1).otherwise(0)) \
        | (F.col("cur_p") < F.col("pos")) | (F.col("cur_h") < F.col("pos")) | (F.col("cur_pre") < F.col("pos"))
    at_type = "struct<chars:int,n_cells:int,n_items:int,n_out:int>"
    facts = F.struct(
        "tag", *keep, "info", needed(in_tables, F.col("top_table"), "int").alias("top_table"), needed(in_code, F.col("cur_pre"), "int").alias("cur_pre"),
        *[needed(in_lists, value, kind).alias(name) for name, value, kind in (
            ("top_list", F.col("top_list"), "int"),
            ("child_no", F.col("child_no"), "int"), ("ordered", F.col("parent.tag") == "ol", "boolean"), ("is_item", F.col("is_item"), "boolean"),
            ("chain", F.col("chain.pos"), "int"), ("depth", (F.col("list_depth") - F.col("chain.list_depth")).cast("int"), "int"))],
        *[needed(in_lists or in_tables, F.col(c), at_type).alias(c) for c in ("at", "end_at")], needed(in_tables, F.col("n_rows"), "int").alias("n_rows"),
        needed(in_lists or "skipped" in around, skipped, "boolean").alias("skipped"), inside.alias("inside"),
        needed("nested" in around, F.coalesce(nested, F.lit(False)), "boolean").alias("nested"), needed("in_main" in around, F.col("in_main"), "boolean").alias("in_main"))
    in_row = F.col("at.n_cells") - F.when(starts(*CELL_TAGS), 1).otherwise(0)
    cell = F.struct("pos", (F.col("tag") == "td").alias("is_td"), F.col("at.chars").alias("start"), F.col("cell_end.chars").alias("end"))
    row = F.struct("pos", in_row.alias("start"), F.col("row_end.n_cells").alias("end"))
    cell, row = F.when(starts(*CELL_TAGS), cell), F.when(F.col("row_start"), row)
    inline = ("piece", "opened", "closed", "dropped")
    if not in_lists:
        # An item ends the paragraph it begins in, so an open paragraph is the innermost of the two.
        rows = rows.withColumn("cur_li", F.lit(None).cast("int"))
    rows = html_inline.with_fragments(rows) if marked else rows.withColumns({c: F.lit(None).cast("array<string>" if c == "dropped" else "string") for c in inline})
    rows = rows.select(
        id_col, "pos", "text", "at",
        needed(in_tables, cell, "struct<pos:int,is_td:boolean,start:int,end:int>").alias("cell"), needed(in_tables, row, "struct<pos:int,start:int,end:int>").alias("row"),
        needed(in_tables, F.when(ends("table"), F.col("n_rows")), "int").alias("end_rows"), *inline, "info",
        (F.col("text").isNotNull() & ~is_blank(F.coalesce("text", F.lit("")))).alias("_full"),
        F.when((F.col("kind") != "close") & ((F.col("kind") != "text") | (F.col("pos") <= 0)), facts).alias("facts"),
        _memberships(whole_page, members).alias("_blocks"))
    # The outer form keeps the optimizer from repeating the whole array in a filter below it.
    rows = rows.withColumn("m", F.explode_outer("_blocks")).where("m IS NOT NULL")
    block, inline = F.col("m.block"), F.col("m.block").isin("p", "li")
    rows = rows.select(
        id_col, block.alias("block"), F.col("m.key").alias("key"), "pos", "_full",
        F.when(~inline, F.when(block.isin("og", "tw"), F.col("info")).otherwise(F.col("text"))).alias("raw"),
        *[F.when(inline, F.col(c)).alias(c) for c in ("piece", "opened", "closed", "dropped")], "at.n_out",
        *[F.when(block == "cells", F.col(c)).alias(c) for c in ("cell", "row")], F.when(block == "table", F.col("end_rows")).alias("end_rows"),
        F.when(F.col("pos") == F.col("m.key"), F.col("facts")).alias("facts"))
    leaves = rows.groupBy(id_col, "block", "key").agg(
        F.expr("listagg(raw, '') WITHIN GROUP (ORDER BY pos)").alias("raw"),
        *[F.collect_list(c).alias(c) for c in ("piece", "opened", "closed", "dropped")], F.max("n_out").alias("n_out"),
        F.array_sort(F.collect_list("cell")).alias("cells"), F.array_sort(F.collect_list("row")).alias("rows"), F.max("end_rows").alias("end_rows"),
        F.max("_full").alias("has_text"), F.first("facts", ignorenulls=True).alias("at"))
    # Columns of their own: as one expression the Markdown would be put together once for every place that looks at it.
    inline = F.col("block").isin("p", "li")
    leaves = leaves.withColumn("_left", F.when(inline & (F.size("opened") > 0), F.array_except("opened", "closed")))
    leaves = leaves.withColumn("_marked", F.when(inline, html_inline.finish_inline("piece", "opened", "_left", "dropped", "n_out")))
    text = F.when(inline, tidy_inline(html_inline.plain_marks(F.col("_marked")))).otherwise(F.coalesce("raw", F.lit("")))
    return leaves.select(id_col, "block", "key", text.alias("text"), "has_text", "at", "cells", "rows", "end_rows")


def code_language(declared: Column, text: Column) -> Column:
    """Language of a code block: the declared one (class name or data attribute), else by signs in the text."""
    return F.coalesce(non_empty(declared), sniff_language(text))


def sniff_language(text: Column) -> Column:
    def has(*words: str) -> Column:
        out = F.contains(text, F.lit(words[0]))
        for word in words[1:]:
            out = out | F.contains(text, F.lit(word))
        return out

    return (
        F.when(has("<?php"), "php")
        .when(has("<html", "<!DOCTYPE"), "html")
        .when(has("SELECT ", "FROM "), "sql")
        .when(has("import ") & has("def "), "python")
        .when(has("function", "const ", "var "), "javascript")
        .otherwise("")
    )


def code_fence(language: Column, text: Column) -> Column:
    body = F.replace(trim_ws(text), F.lit("\t"), F.lit("  "))
    return F.concat(F.lit("```"), language, F.lit("\n"), body, F.lit("\n```\n\n"))


# The types of the rows of a table and the items of a list.
ROWS = "array<struct<key:int,cells:string,tds:string,n_cells:bigint,n_td:bigint>>"
ITEMS = "array<struct<key:int,text:string,has_text:boolean,depth:int,child_no:int,ordered:boolean,skipped:boolean,chain:int,is_item:boolean>>"


def _with_code(leaves: DataFrame, id_col: str) -> DataFrame:
    """The code element of a preformatted block joins that block, as ``code``."""
    in_pre = (F.col("block") == "code") & F.col("at.cur_pre").isNotNull()
    unit = F.when(in_pre, F.struct(F.lit("pre").alias("b"), F.col("at.cur_pre").cast("int").alias("k"))).otherwise(F.struct(F.col("block").alias("b"), F.col("key").alias("k")))
    code = F.when(in_pre, F.struct("key", "text", "at.info"))
    whole = F.struct("text", "has_text", "at", "cells", "rows", "end_rows")
    grouped = leaves.withColumns({"_unit": unit, "_code": code}).groupBy(id_col, F.col("_unit.b").alias("block"), F.col("_unit.k").alias("key")).agg(
        F.min_by(whole, "key").alias("_w"), F.max("has_text").alias("has_text"), F.min("_code").alias("code"))
    return grouped.select(id_col, "block", "key", "has_text", "code", *[f"_w.{c}" for c in ("text", "at", "cells", "rows", "end_rows")])


def _tables_and_lists(units: DataFrame, id_col: str) -> DataFrame:
    """All cells of an outermost table and all items of an outermost list, then one row per block.

    A cell is a slice of the outermost table's text, a row a slice of its cells, a table one of its rows and a list one of
    the items, so what is nested counts for every element around it.
    """
    block = F.col("block")
    outer = F.when(block == "cells", "table").when(block == "li", "list").otherwise(block)
    key = (F.when(block.isin("cells", "table"), F.col("at.top_table"))
           .when(block.isin("li", "list"), F.col("at.top_list")).otherwise(F.col("key")))
    members = units.withColumns({"outer": outer, "outer_key": key})
    of_cells, of_owner = block == "cells", block.isin("table", "list")
    grouped = members.groupBy(id_col, F.col("outer").alias("block"), F.col("outer_key").alias("key")).agg(
        F.array_sort(F.collect_list(F.when(block == "li", F.struct(
            "key", "text", "has_text", "at.depth", "at.child_no", "at.ordered", "at.skipped", "at.chain", "at.is_item")))).alias("items"),
        F.first(F.when(of_cells, F.struct("text", "cells", "rows")), ignorenulls=True).alias("grid"),
        F.min(F.when(of_owner, F.struct("key", "at.at", "at.n_rows"))).alias("base"),
        F.collect_list(F.when(of_owner, F.struct("key", "at", "end_rows"))).alias("owners"),
        F.first("text").alias("text"), F.first("has_text").alias("has_text"), F.first("at").alias("at"),
        F.first("code").alias("code"))
    grouped = grouped.withColumn("rows", F.when(block == "table", _table_rows()))
    single = F.array(F.struct("key", "at", F.lit(None).cast("int").alias("end_rows")))
    spread = grouped.withColumn("o", F.explode_outer(F.when(of_owner, F.col("owners")).otherwise(single))).where("o IS NOT NULL")
    n_rows, n_items = F.col("o.at.n_rows"), F.col("o.at.at.n_items")
    many = F.coalesce(F.col("o.end_rows") - n_rows, F.size("rows"))
    items = F.slice("items", n_items - F.col("base.at.n_items") + 1, F.least(F.col("o.at.end_at.n_items") - n_items, F.size("items")))
    return spread.select(
        id_col, "block", F.col("o.key").alias("key"), F.col("o.at").alias("at"), "text", "has_text", "code",
        F.when(block == "table", F.slice("rows", n_rows - F.col("base.n_rows") + 1, many)).alias("rows"),
        F.when(block == "list", F.filter(items, lambda i: i["is_item"] & (i["chain"] == F.col("o.at.chain")))).alias("items"))


def _table_rows() -> Column:
    """The rows of ``grid`` with the text of their cells."""
    chars, before = F.col("base.at.chars"), F.col("base.at.n_cells")
    cells = F.transform("grid.cells", lambda c: F.struct(
        c["is_td"].alias("is_td"), clean_text(F.substring(F.col("grid.text"), c["start"] - chars + 1, c["end"] - c["start"])).alias("text")))

    def row(r: Column, mine: Column) -> Column:
        tds = F.filter(mine, lambda c: c["is_td"])
        return F.struct(r["pos"].alias("key"), F.array_join(mine["text"], " | ").alias("cells"), F.array_join(tds["text"], " | ").alias("tds"),
                        F.size(mine).cast("bigint").alias("n_cells"), F.size(tds).cast("bigint").alias("n_td"))

    # The texts of the cells are made once a table and a row is cut from them once: inside a lambda an expression runs wherever it is used.
    def rows(cells: Column) -> Column:
        def cut(r: Column) -> Column:
            return let(F.slice(cells, r["start"] - before + 1, F.least(r["end"] - r["start"], F.size("grid.cells"))), lambda mine: row(r, mine))

        return F.transform("grid.rows", cut)

    return let(cells, rows)


def _table_markdown(rows: Column) -> Column:
    head = F.try_element_at(rows, F.lit(1))
    body = F.filter(F.slice(rows, F.lit(2), F.greatest(F.size(rows), F.lit(1))), lambda r: r["n_td"] > 0)
    lines = F.array_join(F.transform(body, lambda r: F.concat(F.lit("| "), r["tds"], F.lit(" |\n"))), "")
    rule = F.array_join(F.array_repeat(F.lit("---"), head["n_cells"].cast("int")), " | ")
    return F.when(head["n_cells"] > 0, F.concat(
        F.lit("\n| "), head["cells"], F.lit(" |\n| "), rule, F.lit(" |\n"), lines, F.lit("\n")))


def _list_markdown(items: Column, depth: Column, in_skipped: Column) -> Column:
    """Items as lines. Skipped items are left out of a list that is itself shown."""
    def line(item: Column) -> Column:
        mark = F.when(item["ordered"], F.concat(item["child_no"].cast("string"), F.lit("."))).otherwise("-")
        return F.concat(F.repeat(F.lit("  "), item["depth"] - depth), mark, F.lit(" "),
                        item["text"], F.lit("\n"))

    shown = F.filter(items, lambda i: in_skipped | ~i["skipped"])
    return F.when(F.exists(items, lambda i: i["has_text"]),
                  F.concat(F.array_join(F.transform(shown, line), ""), F.lit("\n")))


def html_blocks(rows: DataFrame, id_col: str = "page_id", keep: tuple[str, ...] = (), whole_page: bool = True, only: tuple[str, ...] | None = None,
                around: tuple[str, ...] = AROUND) -> DataFrame:
    """One row per block element and title source of a page, in ``block_pos`` order.

    Columns: ``block`` (h, p, pre, code, table, list, page, og, tw, title), ``tag``, ``raw``
    text, ``text`` (cleaned), ``md`` ('' for a block that yields nothing), ``language``,
    ``skipped``, ``inside`` (the container), ``nested``, ``in_main`` and ``*keep`` on the
    ``page`` row.

    With ``only`` there are blocks of these kinds alone, each as it would be among all. Tokens without a ``container`` are
    whole pages whose blocks are not told to be ``inside`` or not (NULL). Of ``AROUND`` what is not asked for is NULL.
    """
    rows = with_child_numbers(with_list_items(with_parents(rows, id_col), id_col), id_col)
    members = members_of(only)
    blocks = leaf_blocks(rows, id_col, keep, whole_page, members, around)
    blocks = _with_code(blocks, id_col) if members is None or "code" in members else blocks.withColumn("code", F.lit(None).cast("struct<key:int,text:string,info:string>"))
    if members is None or members & {"cells", "li"}:
        blocks = _tables_and_lists(blocks, id_col)
    else:
        blocks = blocks.withColumns({"rows": F.lit(None).cast(ROWS), "items": F.lit(None).cast(ITEMS)})
    if only is not None:
        blocks = blocks.where(F.col("block").isin(*only))
    block, text = F.col("block"), clean_text("text")
    source = F.coalesce("code.text", "text")
    language = F.when(block == "pre", F.when(F.col("code").isNotNull(), code_language(F.col("code.info"), F.col("code.text")))
                      .otherwise(code_language(F.col("at.info"), F.col("text"))))
    blocks = blocks.select(
        id_col, "block", F.col("key").alias("block_pos"), F.col("at.tag").alias("tag"), F.col("text").alias("raw"),
        F.when(block.isin("h", "code"), text).otherwise(F.col("text")).alias("text"), "has_text",
        language.alias("language"), source.alias("_source"), "rows", "items", F.col("at.depth").alias("depth"),
        F.col("at.skipped").alias("skipped"), F.col("at.inside").alias("inside"), F.col("at.nested").alias("nested"),
        F.col("at.in_main").alias("in_main"), *[F.col(f"at.{c}").alias(c) for c in keep])
    level = F.substring("tag", 2, 1).cast("int")
    md = (
        F.when((block == "h") & (F.col("text") != ""), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.col("text"), F.lit("\n\n")))
        .when((block == "p") & F.col("has_text") & (F.col("text") != ""), F.concat(F.col("text"), F.lit("\n\n")))
        .when(block == "code", F.concat(F.lit(" `"), F.col("text"), F.lit("` ")))
        .when(block == "pre", code_fence(F.col("language"), F.col("_source")))
        .when(block == "table", _table_markdown(F.col("rows")))
        .when(block == "list", _list_markdown(F.col("items"), F.col("depth"), F.col("skipped")))
    )
    return blocks.withColumn("md", F.coalesce(md, F.lit(""))).drop("_source")


def with_title(blocks: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Add ``title``: the first title source of the page that is not empty, cleaned once."""
    page = Window.partitionBy(id_col)

    def first(condition: Column, value: Column) -> Column:
        return non_empty(F.min(F.when(condition, F.struct("block_pos", value.alias("v")))).over(page)["v"])

    h1 = (F.col("block") == "h") & (F.col("tag") == "h1")
    doc_title = F.trim(F.regexp_replace("raw", r"[ \t\n\f\r]+", " "))
    found = F.coalesce(
        first(F.col("block") == "og", F.col("raw")), first(F.col("block") == "tw", F.col("raw")),
        first(h1 & F.col("in_main"), F.col("raw")), first(h1 & ~F.col("skipped"), F.col("raw")),
        first(F.col("block") == "title", doc_title))
    return blocks.withColumn("title", F.when(found.isNotNull(), clean_text(found)))
