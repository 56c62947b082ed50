"""Named files, sessions and budgets of converted pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.functions.constants import MODEL_LIMITS, SESSION_DATE_FORMAT, SESSION_HEADING
from foliomill.functions.text import mode_extension, render_output, slugify_url
from foliomill.operators.naming import PART_BYTES, dedupe_names, totals_within, with_parts
from foliomill.session import checkpoint_folder


def named_outputs(pages: DataFrame, converted: DataFrame, mode: str, timestamp: str, id_col: str = "page_id") -> DataFrame:
    """``filename`` and ``content`` of each page in the chosen output mode.

    Names are numbered on slim rows of ``pages`` (id and slug), which cost no conversion; the
    contents join on the unique id.
    """
    slugs = pages.select(id_col, slugify_url("url").alias("slug"))
    names = dedupe_names(slugs, "slug", id_col).select(id_col, F.concat("name", mode_extension(F.lit(mode))).alias("filename"))
    contents = converted.select(id_col, render_output(F.lit(mode), "url", "title", "markdown", timestamp).alias("content"))
    return contents.join(names, id_col).select(id_col, "filename", "content")


def merge_sessions(pages: DataFrame, converted: DataFrame, group: Column, day: Column, id_col: str = "page_id", part_bytes: int = PART_BYTES) -> DataFrame:
    """The pages of each group as one session document, in order, always as Markdown.

    ``group`` is an expression over ``pages``. A group may hold any number of pages of any size, so the document comes as
    ordered parts: one begins with the first page at or past each multiple of ``part_bytes``. Its text is the parts one after the
    other. The sections are written once; their sizes alone are sorted.
    """
    checkpoint_folder(pages.sparkSession)
    section = F.concat(F.lit("## ["), F.coalesce("title", F.lit("")), F.lit("]("), "url", F.lit(")\n\n"), "markdown", F.lit("\n\n---\n\n"))
    sections = pages.select(id_col, group.alias("session")).join(converted.select(id_col, section.alias("section")), id_col).checkpoint()
    sized = sections.select(id_col, "session", F.octet_length("section").alias("size"))
    placed = with_parts(totals_within(sized, ["session"], id_col, {"_before": "size", "_nth": None}), part_bytes)
    rows = placed.select(id_col, "session", "part", "_nth").join(sections.select(id_col, "section"), id_col)
    parts = rows.groupBy("session", "part").agg(
        F.count("*").alias("n_pages"), F.min("_nth").alias("_nth"), F.expr("listagg(section, '') WITHIN GROUP (ORDER BY _nth)").alias("body"))
    head = F.concat(F.lit(SESSION_HEADING), F.date_format(day, SESSION_DATE_FORMAT), F.lit("\n\n"))
    return parts.select("session", "part", "n_pages", F.concat(F.when(F.col("_nth") == 0, head).otherwise(""), "body").alias("content"))


def model_fit(rows: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """One row per (row, model) with ``fits``. The four models travel as a constant array."""
    limits = F.array(*[F.struct(F.lit(n).alias("model"), F.lit(v).cast("bigint").alias("token_limit")) for n, v in MODEL_LIMITS])
    spread = rows.withColumn("_m", F.explode(limits))
    return spread.withColumns({"model": F.col("_m.model"), "token_limit": F.col("_m.token_limit"),
                               "fits": F.col(tokens_col) <= F.col("_m.token_limit")}).drop("_m")


def outcomes(converted: DataFrame, empty: str = "no content") -> DataFrame:
    """Add ``ok`` to rows of ``markdown`` and ``error``; a failed row keeps its place and has no value.

    The error of an earlier step stands; a conversion without any text fails as ``empty``.
    """
    error = F.coalesce("error", F.when(F.coalesce("markdown", F.lit("")) == "", empty))
    ok = F.col("error").isNull()
    return converted.withColumn("error", error).withColumns({"ok": ok, "markdown": F.when(ok, F.col("markdown"))})
