"""Markdown documents to safe HTML. No stage of it moves rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.functions.text import escape_html, heading_anchor, let, non_empty
from foliomill.operators.markdown_blocks import (
    TASK_PATTERN, cell_alignment, fence_body, fence_language, heading_level, heading_text, quoted_lines, split_cells,
    table_lines, with_blocks, without_last_feed,
)
from foliomill.operators.markdown_inline import render_inline


def render_heading(text: Column) -> Column:
    level = heading_level(text).cast("string")
    return F.concat(F.lit("<h"), level, F.lit(' id="'), heading_anchor(heading_text(text)), F.lit('">'),
                    render_inline(heading_text(text)), F.lit("</h"), level, F.lit(">\n"))


def render_fence(text: Column) -> Column:
    language = F.concat(F.lit(' class="language-'), escape_html(non_empty(fence_language(text))), F.lit('"'))
    language = F.when(fence_language(text) != "", language).otherwise("")
    body = F.coalesce(non_empty(escape_html(fence_body(text))), F.lit("\n"))
    return F.concat(F.lit("<pre><code"), language, F.lit(">"), body, F.lit("</code></pre>\n"))


def render_item(text: Column) -> Column:
    """A list item without its end tag, which follows the lists inside it."""
    mark = F.regexp_extract(text, TASK_PATTERN, 1)
    box = F.when(F.lower(mark) == "x", ' checked').otherwise("")
    return F.when(mark == "", F.concat(F.lit("<li>"), render_inline(text))).otherwise(F.concat(
        F.lit('<li class="task"><input type="checkbox" disabled'), box, F.lit("> "),
        render_inline(F.regexp_extract(text, TASK_PATTERN, 2))))


def render_table(text: Column) -> Column:
    def style(mark: Column) -> Column:
        side = cell_alignment(mark)
        return F.when(side != "", F.concat(F.lit(' style="text-align:'), side, F.lit('"'))).otherwise("")

    def cells(tag: str, row: Column, head: Column) -> Column:
        """As many cells as the header has; missing ones are empty."""
        return F.array_join(F.transform(head["cells"], lambda _, i: F.concat(
            F.lit(f"<{tag}"), F.coalesce(F.get(head["styles"], i), F.lit("")), F.lit(">"),
            render_inline(F.coalesce(F.get(row, i), F.lit(""))), F.lit(f"</{tag}>"))), "")

    def whole(lines: Column, head: Column) -> Column:
        body = F.transform(F.slice(lines, F.lit(3), F.size(lines)), lambda line: let(
            split_cells(line), lambda row: F.concat(F.lit("<tr>"), cells("td", row, head), F.lit("</tr>\n"))))
        return F.concat(F.lit("<table>\n<thead>\n<tr>"), cells("th", head["cells"], head),
                        F.lit("</tr>\n</thead>\n<tbody>\n"), F.array_join(body, ""), F.lit("</tbody>\n</table>\n"))

    return let(table_lines(text), lambda lines: let(
        F.struct(split_cells(F.element_at(lines, F.lit(1))).alias("cells"),
                 F.transform(split_cells(F.element_at(lines, F.lit(2))), style).alias("styles")),
        lambda head: whole(lines, head)))


def render_paragraph(text: Column) -> Column:
    return F.concat(F.lit("<p>"), render_inline(without_last_feed(text)), F.lit("</p>\n"))


def render_block(kind: Column, text: Column) -> Column:
    return (
        F.when(kind == "markup", text)
        .when(kind == "paragraph", render_paragraph(text))
        .when(kind == "item", render_item(text))
        .when(kind == "heading", render_heading(text))
        .when(kind == "fence", render_fence(text))
        .when(kind == "table", render_table(text))
        .when(kind == "rule", F.lit("<hr>\n"))
        .when(kind == "quote", render_paragraph(quoted_lines(text)))
    )


def markdown_to_html(documents: DataFrame, text_col: str = "text", out: str = "html") -> DataFrame:
    """Add the HTML of each document. Markup in the source is escaped, never passed through."""
    rows = with_blocks(documents, text_col)
    html = F.array_join(F.transform("blocks", lambda b: render_block(b["kind"], b["text"])), "")
    return rows.withColumn(out, html).drop("blocks")
