"""All queries by name: each takes a session and a data folder and gives a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliomill import fixtures
from foliomill.functions import text as T
from foliomill.operators import html_structure as H
from foliomill.operators import markdown_blocks as MB
from foliomill.operators import markdown_inline as MI
from foliomill.operators import tree as TR
from foliomill.operators.html_blocks import sniff_language, structured_tokens, with_title
from foliomill.operators.html_links import page_links
from foliomill.operators.html_tokens import co_locate, tokenize, with_attributes, with_text
from foliomill.operators.naming import dedupe_names, number_within
from foliomill.plans import page_exports as PX
from foliomill.plans import tree_export as TX
from foliomill.plans.markdown_html import markdown_to_html
from foliomill.plans.page_markdown import BLOCKS, TITLE_SOURCES, convert_fragments, convert_pages, page_blocks
from foliomill.session import checkpoint_folder
from foliomill.sinks.files import write_files
from foliomill.sources.tables import is_markdown_path, read_markdown_files, read_table, spread
from foliomill.sources.wiki_responses import follow_pages, read_children_responses, read_page_responses
from foliomill.streaming import convert as ST

TIMESTAMP = "2025-01-15T12:00:00.000Z"
DAY = "2025-01-15"
Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _pages(spark, sf):
    return read_table(spark, sf, "pages")


def _docs(spark, sf):
    return read_table(spark, sf, "documents")


# -- scalar functions --------------------------------------------------------------------

@query
def token_estimate(spark, sf):
    return _docs(spark, sf).select("doc_id", T.utf16_length("text").cast("bigint").alias("units"), T.estimate_tokens("text").alias("tokens"))


@query
def clean_text(spark, sf):
    return _docs(spark, sf).select("doc_id", T.clean_text("text").alias("cleaned"))


@query
def slugify_url(spark, sf):
    return _pages(spark, sf).select("page_id", T.slugify_url("url").alias("slug"), T.sanitize_file_name("url").alias("file_name"))


@query
def sanitize_title(spark, sf):
    return _docs(spark, sf).select("doc_id", T.sanitize_title("text").alias("file_title"))


@query
def escape_html(spark, sf):
    return _pages(spark, sf).select("page_id", T.escape_html("html").alias("escaped"))


@query
def safe_url(spark, sf):
    schemes = F.array(*[F.lit(s) for s in ("", "javascript:", "java\tscript:", "mailto:", "DATA:", "./", "x+y:")])
    pages = _pages(spark, sf).withColumn("target", F.concat(F.element_at(schemes, (F.col("page_id") % 7 + 1).cast("int")), "url"))
    return pages.select("page_id", "target", T.safe_url("target").alias("safe"))


@query
def heading_anchor(spark, sf):
    lines = _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", T.heading_anchor("line").alias("anchor"))


@query
def wiki_url_parse(spark, sf):
    kinds = F.array(*[F.lit(k) for k in ("pages", "folder", "whiteboard", "pages")])
    hosts = F.array(*[F.lit(h) for h in ("https://acme.atlassian.net", "https://Beta.Atlassian.net:8443", "https://example.com")])
    d = F.col("doc_id")
    url = F.concat(F.element_at(hosts, (d % 3 + 1).cast("int")), F.lit("/wiki/spaces/"), "lang", F.lit("/"),
                   F.element_at(kinds, (d % 4 + 1).cast("int")), F.lit("/"), d.cast("string"), F.lit("/Some-Title?x=1"))
    p = F.col("p")
    return _docs(spark, sf).select("doc_id", T.parse_wiki_url(url).alias("p")).select(
        "doc_id", p["origin"].alias("origin"), p["tenant"].alias("tenant"), p["content_type"].alias("content_type"), p["id"].alias("id"))


@query
def depth_setting(spark, sf):
    d = F.col("doc_id")
    setting = (F.when(d % 5 == 0, "all").when(d % 5 == 1, d.cast("string")).when(d % 5 == 2, "-3")
               .when(d % 5 == 3, F.split_part("text", F.lit(" "), F.lit(1))).otherwise(F.concat(F.lit(" "), d.cast("string"), F.lit("px"))))
    return _docs(spark, sf).select("doc_id", T.normalize_depth(setting).alias("max_depth"))


@query
def md_files(spark, sf):
    paths = fixtures.paths_fixture(_docs(spark, sf))
    return paths.where(is_markdown_path(F.col("path"))).select("doc_id", "path")


@query
def md_title(spark, sf):
    docs = fixtures.markdown_fixture(_docs(spark, sf))
    return docs.select("doc_id", T.markdown_title(F.col("text"), F.concat(F.lit("file:///d/My%20Doc%20"), F.col("doc_id").cast("string"), F.lit(".md"))).alias("title"))


# -- HTML structure ----------------------------------------------------------------------

@query
def html_tokens(spark, sf):
    rows = with_attributes(with_text(tokenize(_pages(spark, sf))))
    attrs = F.array_join(F.transform("attrs", lambda a: F.concat(a["name"], F.lit("="), a["value"])), ";")
    return rows.select("page_id", "pos", "kind", "tag", "text", attrs.alias("attributes"))


def _located(spark, sf):
    return co_locate(_pages(spark, sf).select("page_id", "html"), "page_id")


@query
def html_elements(spark, sf):
    rows = H.with_totals(H.tagged_tokens(_located(spark, sf), "page_id", "html"), "page_id", measure_text=False)
    rows = H.with_scopes(H.with_nesting(H.with_extents(rows, "page_id", measure_text=False), "page_id"), "page_id")
    rows = H.with_levels(H.with_child_numbers(H.with_parents(rows, "page_id"), "page_id"), "page_id")
    return rows.where("end_pos IS NOT NULL").select(
        "page_id", "tag", F.col("pos").alias("start_pos"), "end_pos", "is_closed", F.col("parent.pos").alias("parent_pos"), "child_no", "level")


@query
def html_blocks(spark, sf):
    blocks = page_blocks(_pages(spark, sf), only=BLOCKS, inside=False)
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("block_pos"))
    return blocks.select("page_id", number.alias("block_no"), "tag", "md", F.col("nested").alias("is_nested"))


@query
def skip_boilerplate(spark, sf):
    blocks = page_blocks(_pages(spark, sf), only=BLOCKS, inside=False)
    return blocks.groupBy("page_id").agg(
        F.count_if("skipped").alias("n_skipped"), F.count_if(~F.col("skipped")).alias("n_kept"),
        F.max(F.when(F.col("skipped"), F.col("md"))).alias("skipped_md"))


@query
def skip_hidden(spark, sf):
    """Hidden by a style of its own; visibility passes on to what is inside, display does not."""
    blocks = page_blocks(fixtures.hidden_fixture(_docs(spark, sf)), "doc_id", only=("p",), inside=False, around=("skipped",))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("block_pos"))
    return blocks.select("doc_id", number.alias("paragraph_no"), "md", "skipped")


def _candidates(pages, id_col):
    rows = H.with_totals(H.tagged_tokens(co_locate(pages.select(id_col, "html"), id_col), id_col, "html"), id_col)
    rows = H.with_candidates(H.with_scopes(H.with_nesting(H.with_extents(rows, id_col), id_col), id_col), id_col)
    return rows.where(F.col("tag").isin(H.DENSITY_TAGS + H.FALLBACK_TAGS) & F.col("end_pos").isNotNull())


@query
def valid_containers(spark, sf):
    return _candidates(_pages(spark, sf), "page_id").select(
        "page_id", "tag", F.col("pos").alias("start_pos"), F.col("measure.n_chars").cast("bigint").alias("n_chars"),
        F.col("measure.n_blocks").cast("bigint").alias("n_blocks"), "is_valid")


@query
def content_density(spark, sf):
    shells = fixtures.shell_fixture(_docs(spark, sf))
    return _candidates(shells, "doc_id").where("density IS NOT NULL").select(
        "doc_id", F.col("measure.n_paragraphs").cast("bigint").alias("n_paragraphs"),
        F.col("measure.paragraph_chars").cast("bigint").alias("paragraph_chars"),
        F.col("measure.n_descendants").cast("bigint").alias("n_descendants"))


def _container(pages, id_col):
    rows = structured_tokens(co_locate(pages.select(id_col, "html"), id_col), id_col).where("pos <= 0")
    return rows.select(id_col, F.col("container.rank").alias("container_rank"), F.col("container.tag").alias("container_tag"))


@query
def main_content(spark, sf):
    return _container(_pages(spark, sf), "page_id")


@query
def main_content_shell(spark, sf):
    return _container(fixtures.shell_fixture(_docs(spark, sf)), "doc_id")


# -- HTML to Markdown --------------------------------------------------------------------

def _converted(spark, sf):
    return convert_pages(_pages(spark, sf), keep=("url",))


@query
def page_title(spark, sf):
    blocks = with_title(page_blocks(_pages(spark, sf), only=TITLE_SOURCES, inside=False, around=("skipped", "in_main")))
    return blocks.where("block = 'page'").select("page_id", "title")


@query
def page_title_shell(spark, sf):
    blocks = with_title(page_blocks(fixtures.shell_fixture(_docs(spark, sf)), "doc_id", only=TITLE_SOURCES, inside=False, around=("skipped", "in_main")), "doc_id")
    return blocks.where("block = 'page'").select("doc_id", "title")


@query
def page_outline(spark, sf):
    return _converted(spark, sf).select("page_id", "outline")


@query
def page_markdown(spark, sf):
    return _converted(spark, sf).select("page_id", "url", "title", "markdown", "tokens")


@query
def page_markdown_shell(spark, sf):
    return convert_pages(fixtures.shell_fixture(_docs(spark, sf)), "doc_id").select("doc_id", "title", "markdown", "outline", "tokens")


@query
def paragraphs_md(spark, sf):
    blocks = page_blocks(_pages(spark, sf), only=("p",), inside=False, around=())
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("block_pos"))
    return blocks.select("page_id", number.alias("paragraph_no"), "md")


@query
def page_links_all(spark, sf):
    return page_links(_pages(spark, sf)).select("page_id", "link_no", "href", "text")


REGISTRY["page_links"] = REGISTRY.pop("page_links_all")


def _fixture_blocks(spark, sf, kind):
    return page_blocks(fixtures.html_fixture(_docs(spark, sf)), "doc_id", whole_page=False, only=(kind,), around=())


def _shape_blocks(spark, sf, kind):
    return page_blocks(fixtures.shapes_fixture(_docs(spark, sf)), "doc_id", whole_page=False, only=(kind,), around=())


def _numbered(blocks, *columns):
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("block_pos"))
    return blocks.select("doc_id", number.alias("block_no"), *columns)


@query
def headings_md(spark, sf):
    return _numbered(_fixture_blocks(spark, sf, "h"), "tag", "md")


@query
def inline_md(spark, sf):
    return _numbered(_fixture_blocks(spark, sf, "p"), "md")


@query
def inline_code_md(spark, sf):
    return _numbered(_fixture_blocks(spark, sf, "code"), "md")


@query
def code_blocks_md(spark, sf):
    return _numbered(_fixture_blocks(spark, sf, "pre"), "language", "md")


@query
def code_language(spark, sf):
    return _docs(spark, sf).select("doc_id", sniff_language(F.col("text")).alias("language"))


@query
def tables_md(spark, sf):
    return _numbered(_shape_blocks(spark, sf, "table"), "md")


@query
def table_cells(spark, sf):
    rows = _shape_blocks(spark, sf, "table").select("doc_id", F.posexplode("rows").alias("row_no", "r"))
    return rows.select("doc_id", "row_no", F.col("r.cells").alias("cells"), F.col("r.n_cells").alias("n_cells"), F.col("r.n_td").alias("n_td"))


@query
def lists_md(spark, sf):
    return _numbered(_shape_blocks(spark, sf, "list"), "tag", "md")


@query
def fragment_markdown(spark, sf):
    bodies = fixtures.body_fixture(_docs(spark, sf))
    return convert_fragments(bodies, "id", "html_body", "title").select("id", "title", "markdown")


# -- outputs -----------------------------------------------------------------------------

@query
def convert_outcomes(spark, sf):
    pages = _converted(spark, sf).select(F.lit("page").alias("origin"), F.col("page_id").cast("string").alias("id"), "markdown")
    fetched = read_page_responses(fixtures.broken(fixtures.page_responses(_docs(spark, sf)), F.col("doc_id")))
    bodies = fetched.select(F.col("doc_id").cast("string").alias("id"), "html_body", "error")
    made = convert_fragments(bodies, "id", "html_body", keep=("error",)).select(F.lit("made").alias("origin"), "id", "markdown", "error")
    rows = PX.outcomes(pages.withColumn("error", F.lit(None).cast("string")).unionByName(made))
    return rows.select("origin", "id", "ok", "error", T.estimate_tokens("markdown").alias("tokens"))


@query
def render_output(spark, sf):
    rows = _converted(spark, sf).withColumn("mode", F.explode(F.array(F.lit("md"), F.lit("json"), F.lit("xml"))))
    content = T.render_output("mode", "url", "title", "markdown", TIMESTAMP)
    return rows.select("page_id", "mode", content.alias("content"), F.col("tokens").alias("markdown_tokens"),
                       T.estimate_tokens(content).alias("output_tokens"))


@query
def filename_dedupe(spark, sf):
    slugs = _pages(spark, sf).select("page_id", T.slugify_url("url").alias("slug"))
    return dedupe_names(slugs, "slug", "page_id").select("page_id", "slug", "ordinal", "name")


@query
def save_all_pages(spark, sf):
    return PX.named_outputs(_pages(spark, sf), _converted(spark, sf), "xml", TIMESTAMP)


@query
def merge_session(spark, sf):
    host = T.url_parts("url")["host"]
    return PX.merge_sessions(_pages(spark, sf), _converted(spark, sf), host, F.lit(DAY).cast("date"))


@query
def merge_session_parts(spark, sf):
    host = T.url_parts("url")["host"]
    return PX.merge_sessions(_pages(spark, sf), _converted(spark, sf), host, F.lit(DAY).cast("date"), part_bytes=20_000)


@query
def model_fit(spark, sf):
    return PX.model_fit(_docs(spark, sf).select("doc_id", T.estimate_tokens("text").alias("tokens"))).select(
        "doc_id", "tokens", "model", "token_limit", "fits")


@query
def token_budget(spark, sf):
    rows = _converted(spark, sf).select(T.url_parts("url")["host"].alias("host"), "tokens")
    return rows.groupBy("host").agg(F.count("*").alias("n_pages"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("max_tokens"))


# -- trees -------------------------------------------------------------------------------

def _tree(spark, sf, max_depth=None, cap=None):
    nodes = fixtures.tree_fixture(_docs(spark, sf))
    roots = spark.range(1).select(F.col("id").cast("string").alias("root_id"))
    return TR.discover_tree(nodes, roots, max_depth, cap)


def _branches(spark, sf, cap):
    """Every readable node as the root of its own export, two levels deep."""
    nodes = fixtures.tree_fixture(_docs(spark, sf))
    roots = nodes.where("type IN ('page', 'folder') AND status = 200").select(F.col("id").alias("root_id"))
    return TR.discover_tree(nodes, roots, 2, cap)


@query
def tree_children_ingest(spark, sf):
    responses = fixtures.children_responses(_docs(spark, sf))
    return read_children_responses(fixtures.broken(responses, F.col("parent_id").cast("bigint")), keep=("parent_id", "cursor"))


@query
def tree_body_ingest(spark, sf):
    return read_page_responses(fixtures.broken(fixtures.page_responses(_docs(spark, sf)), F.col("doc_id")))


@query
def tree_paginate(spark, sf):
    pages = follow_pages(fixtures.children_responses(_docs(spark, sf)))
    children = read_children_responses(pages, keep=("parent_id", "page_no")).where("error IS NULL")
    numbered = number_within(children.select("parent_id", "page_no", "child_no", "id", "type"), ["parent_id"], ["page_no", "child_no"], "child_ord")
    return numbered.select("parent_id", F.col("child_ord").cast("int").alias("child_ord"), "id", "type")


def _path_text(column):
    return F.array_join(F.transform(column, lambda o: o.cast("string")), "/")


@query
def tree_discover(spark, sf):
    return _tree(spark, sf).select("id", "title", "parent_id", "type", "depth", _path_text("ord_path").alias("ord_path"))


@query
def tree_depth(spark, sf):
    return _tree(spark, sf, max_depth=1).select("id", "depth")


@query
def tree_cap(spark, sf):
    shown = TR.capped(_branches(spark, sf, 8), 8)
    return shown.select("root_id", "bfs_no", "id", "depth")


@query
def tree_preview(spark, sf):
    return TR.tree_summary(_branches(spark, sf, 8), 8)


@query
def tree_paths(spark, sf):
    tree = TR.with_paths(_tree(spark, sf))
    return TR.with_path_collisions(tree).select("id", "path", "path_collision")


@query
def sibling_names(spark, sf):
    tree = _tree(spark, sf)
    return TR.with_paths(tree.where(TR.fetched(tree))).select("id", "parent_id", "base_name", "name")


@query
def tree_skipped(spark, sf):
    return TX.skipped_pages(_tree(spark, sf)).select("id", "title", "error")


@query
def tree_skipped_report(spark, sf):
    return TX.skip_report(_tree(spark, sf)).select("part", "path", "content")


@query
def tree_export_entries(spark, sf):
    return TX.export_tree(_tree(spark, sf), fixtures.body_fixture(_docs(spark, sf))).select("path", "part", "content", "kind")


@query
def tree_export_capped(spark, sf):
    tree = TR.capped(_tree(spark, sf, cap=100))
    return TX.export_tree(tree, fixtures.body_fixture(_docs(spark, sf))).select("path", "part", "content", "kind")


@query
def tree_export_summary(spark, sf):
    return TX.export_summary(_tree(spark, sf), cap=None)


# -- Markdown ----------------------------------------------------------------------------

def _md(spark, sf):
    return fixtures.markdown_fixture(spread(_docs(spark, sf)))


def _md_blocks(spark, sf, kind):
    return MB.markdown_blocks(_md(spark, sf)).where(F.col("kind") == kind)


@query
def md_lines(spark, sf):
    lines = F.split(MB.without_last_feed(MB.normalize_lines("text")), "\n", -1)
    return _md(spark, sf).select("doc_id", F.posexplode(lines).alias("line_no", "line"))


@query
def md_block_profile(spark, sf):
    blocks = MB.markdown_blocks(_md(spark, sf))
    return blocks.groupBy("doc_id", "kind").count().withColumnRenamed("count", "n_blocks")


@query
def md_headings(spark, sf):
    text = F.col("text")
    return _md_blocks(spark, sf, "heading").select(
        "doc_id", MB.heading_level(text).alias("level"), MB.heading_text(text).alias("heading"),
        T.heading_anchor(MB.heading_text(text)).alias("anchor"))


@query
def md_hr(spark, sf):
    return _md_blocks(spark, sf, "rule").select("doc_id", "block_no")


@query
def md_code_blocks(spark, sf):
    return _md_blocks(spark, sf, "fence").select("doc_id", MB.fence_language(F.col("text")).alias("language"), MB.fence_body(F.col("text")).alias("code"))


@query
def md_blockquotes(spark, sf):
    blocks = MB.markdown_blocks(_md(spark, sf)).where("depth > 0 AND kind <> 'item'")
    return blocks.select("doc_id", "depth", "kind", MB.without_last_feed(F.col("text")).alias("quoted"))


@query
def md_list_items(spark, sf):
    items = _md_blocks(spark, sf, "item")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("block_no"))
    return items.select("doc_id", number.alias("item_no"), "depth", "ordered", F.col("text").alias("item"))


@query
def md_tasks(spark, sf):
    text = F.col("text")
    return _md_blocks(spark, sf, "item").where(text.rlike(MB.TASK_PATTERN)).select(
        "doc_id", (F.lower(F.regexp_extract(text, MB.TASK_PATTERN, 1)) == "x").alias("done"),
        F.regexp_extract(text, MB.TASK_PATTERN, 2).alias("task"))


@query
def md_tables(spark, sf):
    rows = _md_blocks(spark, sf, "table").select("doc_id", F.posexplode(MB.table_lines(F.col("text"))).alias("row_no", "line"))
    return rows.select("doc_id", "row_no", F.posexplode(MB.split_cells(F.col("line"))).alias("cell_no", "cell"))


@query
def md_paragraphs(spark, sf):
    blocks = _md_blocks(spark, sf, "paragraph").where("depth = 0")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("block_no"))
    return blocks.select("doc_id", number.alias("paragraph_no"), MB.without_last_feed(F.col("text")).alias("paragraph"))


@query
def md_code_spans(spark, sf):
    parts = _md_blocks(spark, sf, "paragraph").select("doc_id", F.explode(MI.inline_parts(F.col("text"))).alias("p"))
    return parts.where("p.code").select("doc_id", F.col("p.text").alias("code"))


def _targets(spark, sf, pattern, label):
    parts = _md_blocks(spark, sf, "paragraph").select("doc_id", F.explode(MI.inline_parts(F.col("text"))).alias("p")).where("NOT p.code")
    found = F.regexp_extract_all(T.escape_html("p.text"), F.lit(pattern), F.lit(0))
    rows = parts.select("doc_id", F.explode(found).alias("m"))
    return rows.select("doc_id", F.regexp_extract("m", pattern, 1).alias(label), T.safe_url(F.regexp_extract("m", pattern, 2)).alias("url"))


@query
def md_images(spark, sf):
    return _targets(spark, sf, MI.IMAGE, "alt")


@query
def md_links(spark, sf):
    return _targets(spark, sf, r"(?<!!)" + MI.LINK, "label")


@query
def md_inline_html(spark, sf):
    blocks = _md_blocks(spark, sf, "paragraph").where("depth = 0")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("block_no"))
    return blocks.select("doc_id", number.alias("paragraph_no"), MI.render_inline(MB.without_last_feed(F.col("text"))).alias("html"))


@query
def md_to_html(spark, sf):
    return markdown_to_html(_md(spark, sf)).select("doc_id", "html")


@query
def md_depth_cap(spark, sf):
    """Quotes 98 to 103 deep: from the cap on, marks are text."""
    marks = F.repeat(F.lit(">"), (F.col("doc_id") % 6 + 98).cast("int"))
    docs = fixtures.with_words(spread(_docs(spark, sf))).select("doc_id", F.concat(marks, F.lit(" "), "a").alias("text"))
    return markdown_to_html(docs).select("doc_id", "html")


# -- streams -----------------------------------------------------------------------------

def _new_folder(spark):
    return f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"


@query
def stream_convert(spark, sf):
    out = _new_folder(spark)
    ST.convert_stream(ST.table_stream(spark, sf, "pages"), out)
    return spark.read.parquet(f"{out}/pages").select("page_id", "title", "markdown", "tokens")


@query
def stream_filenames(spark, sf):
    """The pages arrive in four deliveries; the stream is resumed after each."""
    out, pages = _new_folder(spark), _pages(spark, sf)
    low, high = pages.agg(F.coalesce(F.min("page_id"), F.lit(0)), F.coalesce(F.max("page_id"), F.lit(0))).first()
    step = (high - low) // 4 + 1
    for k in range(4):
        arrived = pages.where(F.col("page_id").between(low + k * step, low + (k + 1) * step - 1))
        arrived.select("page_id", "url", "html").write.mode("append").parquet(f"{out}/in")
        ST.name_stream(ST.page_stream(spark, f"{out}/in"), out, compact_every=2)
    return spark.read.parquet(f"{out}/names").select("page_id", "slug", "ordinal", "name")


# -- files -------------------------------------------------------------------------------

@query
def md_files_written(spark, sf):
    """Documents as files of several endings, and what the reader of Markdown files finds of them."""
    out = f"{checkpoint_folder(spark)}/files-{uuid.uuid4().hex}"
    endings = F.array(*[F.lit(e) for e in (".md", ".MD", ".markdown", ".mdown", ".mkd", ".html")])
    name = F.concat((F.col("doc_id") % 10).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.element_at(endings, (F.col("doc_id") % 6 + 1).cast("int")))
    manifest = write_files(_docs(spark, sf).select(name.alias("path"), F.col("text").alias("content")), out)
    found = read_markdown_files(spark, out).withColumn("target", F.regexp_extract("path", "[^/]+/[^/]+$", 0))
    return manifest.join(found, "target", "left").select(
        "target", "n_bytes", "sha256", F.col("text").isNotNull().alias("is_markdown"), "text")
