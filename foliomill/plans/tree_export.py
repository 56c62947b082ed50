"""Export of page trees as named Markdown entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.functions.constants import FOLDER_NOTE, SKIPPED_HEADER, SKIPPED_PATH, WIKI_BODY_PATH
from foliomill.functions.text import sanitize_title
from foliomill.operators.naming import PART_BYTES, totals_within, with_parts
from foliomill.operators.tree import capped, fetched, with_paths
from foliomill.plans.page_markdown import convert_fragments

def skipped_pages(tree: DataFrame) -> DataFrame:
    """Pages whose body could not be read, with the reason."""
    path = F.concat(F.lit(WIKI_BODY_PATH[0]), F.col("id"), F.lit(WIKI_BODY_PATH[1]))
    return tree.where(~fetched(tree)).select(
        "root_id", "id", "depth", "ord_path", "title",
        F.concat(F.lit("HTTP "), F.col("status").cast("string"), F.lit(" for "), path).alias("error"))


def skip_report(tree: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """The skip report of each root that skipped a page.

    The report is cut into parts of about ``part_bytes``, in order; the first starts with the header.
    All parts have the same path: the file is the parts one after the other.
    """
    line = F.concat(F.lit("- "), "title", F.lit(": "), "error", F.lit("\n"))
    lines = skipped_pages(tree).select("root_id", "depth", "ord_path", line.alias("line"), F.octet_length(line).alias("size"))
    placed = with_parts(totals_within(lines, ["root_id"], ["depth", "ord_path"], {"_before": "size", "_nth": None}), part_bytes)
    parts = placed.groupBy("root_id", "part").agg(F.min("_nth").alias("_nth"), F.expr("listagg(line, '') WITHIN GROUP (ORDER BY _nth)").alias("body"))
    head = F.when(F.col("_nth") == 0, F.lit(f"{SKIPPED_HEADER}\n\n")).otherwise("")
    return parts.select("root_id", "part", F.lit(SKIPPED_PATH).alias("path"), F.concat(head, "body").alias("content"))


def export_entries(tree: DataFrame, bodies: DataFrame) -> DataFrame:
    """``root_id, id, path, content, kind`` of every node that could be read.

    ``tree`` has one row per (root, node); ``bodies`` is ``id, title, html_body``. Each body is
    converted once, however many roots reach it.
    """
    rows = with_paths(tree.where(fetched(tree)))
    pages = rows.where("type = 'page'")
    wanted = bodies.join(pages.select("id").distinct(), "id", "left_semi")
    converted = convert_fragments(wanted, "id", "html_body", "title").select("id", "markdown")
    as_pages = pages.join(converted, "id").select(
        "root_id", "id", "depth", "ord_path", "path", F.col("markdown").alias("content"), F.lit("page").alias("kind"))
    folders = rows.where("type = 'folder'").select(
        "root_id", "id", "depth", "ord_path", "path",
        F.concat(F.lit("# "), "title", F.lit(f"\n\n{FOLDER_NOTE}\n")).alias("content"), F.lit("folder").alias("kind"))
    return as_pages.unionByName(folders)


def export_tree(tree: DataFrame, bodies: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """All entries of an export: pages, folders and the skip report. A file is the ``part`` rows of its path, in order."""
    entries = export_entries(tree, bodies).select("root_id", "path", F.lit(0).alias("part"), "content", "kind")
    return entries.unionByName(skip_report(tree, part_bytes).select("root_id", "path", "part", "content", F.lit("report").alias("kind")))


def export_summary(tree: DataFrame, cap: int | None = None) -> DataFrame:
    """Per root: pages exported and skipped, share done and the name of the bundle.

    With ``cap``, all counts are of the first ``cap`` nodes of each root, which ``tree`` must have been discovered with.
    """
    if cap is not None:
        tree = capped(tree, cap)
    n = F.count("*")
    pages = F.count_if(F.col("type") == "page")
    read = F.count_if((F.col("type") == "page") & (F.col("status") == 200))
    out = tree.groupBy("root_id").agg(
        n.alias("n_nodes"), F.count_if(~fetched(tree)).alias("n_skipped"), pages.alias("n_pages"), read.alias("n_read"),
        F.max(F.when(F.col("depth") == 0, F.col("title"))).alias("root_title"))
    return out.select(
        "root_id", (F.col("n_nodes") - F.col("n_skipped")).alias("n_exported"), "n_skipped", "n_pages",
        F.when(F.col("n_pages") > 0, F.floor(100 * F.col("n_read") / F.col("n_pages") + 0.5)).otherwise(0).cast("bigint").alias("percent_read"),
        F.concat(sanitize_title("root_title"), F.lit(".zip")).alias("bundle_name"))
