"""Pages to Markdown, outlines and page-level facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.functions.text import clean_text, estimate_tokens, trim_ws
from foliomill.operators.html_blocks import AROUND, html_blocks, structured_tokens, with_title
from foliomill.operators.html_tokens import co_locate

BLOCKS = ("h", "p", "pre", "code", "table", "list")
TITLE_SOURCES = ("page", "h", "og", "tw", "title")


def page_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = (),
                whole_page: bool = True, only: tuple[str, ...] | None = None, inside: bool = True,
                around: tuple[str, ...] = AROUND) -> DataFrame:
    """All blocks of every page, or those of the kinds in ``only``; see ``html_blocks``.

    Without ``inside`` the content container is not looked for, and what ``around`` does not name of ``AROUND`` is not worked out.
    """
    placed = co_locate(pages.select(id_col, html_col, *keep), id_col)
    rows = structured_tokens(placed, id_col, html_col, keep, whole_page and inside, only, around)
    return html_blocks(rows, id_col, keep, whole_page, only, around)


def _is_block():
    return F.col("block").isin(*BLOCKS)


def convert_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per page: ``title``, ``markdown``, ``outline``, ``tokens`` and the columns in ``keep``."""
    blocks = with_title(page_blocks(pages, id_col, html_col, keep), id_col)
    shown = F.col("inside") & ~F.col("skipped") & _is_block()
    is_title = (F.col("tag") == "h1") & (F.col("block") == "h") & F.col("text").eqNullSafe(F.col("title"))
    heading = (F.col("block") == "h")
    # The outline keeps headings without text and does not drop the title.
    outline_line = F.concat(F.repeat(F.lit("#"), F.substring("tag", 2, 1).cast("int")), F.lit(" "), F.col("text"), F.lit("\n\n"))
    parts = blocks.select(
        id_col, "block_pos", "title", *keep,
        F.when(shown & ~is_title, F.col("md")).alias("md"), F.when(shown & heading, outline_line).alias("line"))
    pages_out = parts.groupBy(id_col).agg(
        F.max("title").alias("title"), *[F.max(c).alias(c) for c in keep],
        F.expr("listagg(md, '') WITHIN GROUP (ORDER BY block_pos)").alias("body"),
        F.expr("listagg(line, '') WITHIN GROUP (ORDER BY block_pos)").alias("outline"))
    head = F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("# "), clean_text("title"), F.lit("\n\n")))
    return pages_out.select(
        id_col, *keep, "title",
        F.concat(F.coalesce(head, F.lit("")), F.coalesce("body", F.lit(""))).alias("markdown"),
        trim_ws(F.coalesce("outline", F.lit(""))).alias("outline"),
    ).withColumn("tokens", estimate_tokens("markdown"))


def convert_fragments(fragments: DataFrame, id_col: str, html_col: str, title_col: str | None = None,
                      keep: tuple[str, ...] = ()) -> DataFrame:
    """HTML fragments to Markdown: every block counts, the title comes from ``title_col``."""
    fields = tuple(dict.fromkeys((*keep, *([title_col] if title_col else []))))
    blocks = page_blocks(fragments, id_col, html_col, fields, whole_page=False, around=())
    title = clean_text(F.max(title_col).over(_page(id_col))) if title_col else F.lit("")
    blocks = blocks.withColumn("_title", title)
    is_title = (F.col("tag") == "h1") & (F.col("block") == "h") & (F.col("text") == F.col("_title"))
    out = blocks.select(id_col, "block_pos", *fields, "_title", F.when(_is_block() & ~F.coalesce(is_title, F.lit(False)), F.col("md")).alias("md"))
    out = out.groupBy(id_col).agg(
        *[F.max(c).alias(c) for c in fields], F.max("_title").alias("_title"),
        F.expr("listagg(md, '') WITHIN GROUP (ORDER BY block_pos)").alias("body"))
    head = F.when(F.coalesce("_title", F.lit("")) != "", F.concat(F.lit("# "), F.col("_title"), F.lit("\n\n")))
    return out.select(id_col, *fields, F.concat(F.coalesce(head, F.lit("")), F.coalesce("body", F.lit(""))).alias("markdown"))


def _page(id_col: str):
    from pyspark.sql import Window

    return Window.partitionBy(id_col)
