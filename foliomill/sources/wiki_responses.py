"""Stored wiki responses to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.functions.constants import FOLDER_TITLE_DEFAULT, PAGE_TITLE_DEFAULT
from foliomill.functions.text import next_cursor, non_empty
from foliomill.session import checkpoint_folder

CHILDREN_SCHEMA = "results array<struct<id:string,title:string,type:string>>, _links struct<next:string>"
PAGE_SCHEMA = "id string, title string, parentId string, body struct<export_view:struct<value:string>>"


def _parsed(responses: DataFrame, json_col: str, schema: str, required: str) -> DataFrame:
    """Add ``_r``, the response by ``schema``, and ``error``: why it cannot be used, NULL for a good one."""
    # The parser puts the text of a response that it cannot read into the last field.
    reply = F.from_json(json_col, f"{schema}, _unread string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_unread"})
    rows = responses.withColumn("_r", reply)
    error = (F.when(F.trim(F.coalesce(json_col, F.lit(""))) == "", "empty response")
             .when(F.col("_r._unread").isNotNull(), "malformed JSON")
             .when(F.col(f"_r.{required}").isNull(), f"no {required} in response"))
    return rows.withColumn("error", error)


def read_page_responses(responses: DataFrame, json_col: str = "response", folder: bool = False) -> DataFrame:
    """``id, title, html_body, parent_id`` of page or folder responses, with defaults, and ``error``.

    Every response keeps its row: one that cannot be used has NULLs and says why in ``error``.
    """
    default = FOLDER_TITLE_DEFAULT if folder else PAGE_TITLE_DEFAULT
    rows = _parsed(responses, json_col, PAGE_SCHEMA, "id")
    good = F.col("error").isNull()
    return rows.select(
        *[c for c in responses.columns if c != json_col], F.when(good, F.col("_r.id")).alias("id"),
        F.when(good, F.coalesce(non_empty("_r.title"), F.lit(default))).alias("title"),
        F.when(good, F.coalesce("_r.body.export_view.value", F.lit(""))).alias("html_body"),
        F.when(good, non_empty("_r.parentId")).alias("parent_id"), "error")


def read_children_responses(responses: DataFrame, json_col: str = "response", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per child: ``child_no`` (place in the response), ``id``, ``title``, ``type``, and ``error``.

    A response that cannot be used has one row with no child and the reason in ``error``.
    """
    rows = _parsed(responses, json_col, CHILDREN_SCHEMA, "results")
    listed = F.when(F.col("error").isNull(), F.col("_r.results"))
    rows = rows.select(*keep, "error", F.posexplode_outer(listed).alias("child_no", "c")).where("error IS NOT NULL OR child_no IS NOT NULL")
    found = F.col("child_no").isNotNull()
    return rows.select(*keep, "child_no", F.col("c.id").alias("id"),
                       F.when(found, F.coalesce(non_empty("c.title"), F.lit(PAGE_TITLE_DEFAULT))).alias("title"),
                       F.when(found, F.coalesce(non_empty("c.type"), F.lit("page"))).alias("type"), "error")


def rejected_responses(responses: DataFrame, schema: str, required: str, json_col: str = "response") -> DataFrame:
    """The responses that cannot be used, as they came, with the reason in ``error``: for a table of their own."""
    return _parsed(responses, json_col, schema, required).where("error IS NOT NULL").select(*responses.columns, "error")


def follow_pages(responses: DataFrame, parent_col: str = "parent_id", cursor_col: str = "cursor", json_col: str = "response") -> DataFrame:
    """Order the responses of each parent by their cursors; adds ``page_no`` from 0.

    A chain is a list linked by cursors. It is ranked by pointer doubling: every round a
    response learns who stands twice as far before it, so a chain of n responses takes
    log2(n) joins on (parent, cursor), each spread over all responses. Responses that no
    chain from the start reaches are left out. Of several responses to one request, such as a
    repeated call, the smallest counts.
    """
    checkpoint_folder(responses.sparkSession)
    keyed = responses.withColumn("_key", F.coalesce(cursor_col, F.lit("")))
    others = [c for c in responses.columns if c != parent_col]
    rows = keyed.groupBy(parent_col, "_key").agg(F.min(F.struct(*others)).alias("_kept")).select(parent_col, "_key", "_kept.*")
    rows = rows.withColumn("_next", next_cursor(F.from_json(json_col, CHILDREN_SCHEMA)["_links"]["next"]))
    links = rows.select(parent_col, F.col("_key").alias("_prev"), F.col("_next").alias("_key")).where("_key IS NOT NULL AND _key <> ''")
    # _jump: the response that many places before, NULL once the start has been passed.
    state = rows.select(parent_col, "_key").join(links, [parent_col, "_key"], "left").select(
        parent_col, "_key", F.col("_prev").alias("_jump"), F.coalesce("_prev", "_key").alias("_start"),
        F.when(F.col("_prev").isNotNull(), 1).otherwise(0).cast("bigint").alias("page_no")).checkpoint()
    # 40 rounds reach over a million million responses; a chain that is longer bites its own tail.
    for rounds in range(41):
        if state.where("_jump IS NOT NULL AND _jump <> _key").isEmpty():
            break
        if rounds == 40:
            raise ValueError("chains of responses not ranked after 40 rounds: cursors go in circles")
        ahead = state.select(parent_col, F.col("_key").alias("_jump"), F.col("_jump").alias("_far"),
                             F.col("_start").alias("_from"), F.col("page_no").alias("_more"))
        state = state.join(ahead, [parent_col, "_jump"], "left").select(
            parent_col, "_key", F.col("_far").alias("_jump"), F.coalesce("_from", "_start").alias("_start"),
            (F.col("page_no") + F.coalesce("_more", F.lit(0))).alias("page_no")).checkpoint()
    reached = state.where("_jump IS NULL AND _start = ''").select(parent_col, "_key", "page_no")
    return rows.join(reached, [parent_col, "_key"]).drop("_key", "_next")
