"""Links of a page as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliomill.functions.text import clean_text
from foliomill.operators.html_structure import starts, tagged_tokens, with_extents, with_totals
from foliomill.operators.html_tokens import co_locate


def page_links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``link_no`` (from 1), ``href`` and cleaned anchor ``text`` of every link that has both."""
    rows = tagged_tokens(co_locate(pages.select(id_col, html_col), id_col), id_col, html_col)
    rows = with_extents(with_totals(rows, id_col, measure_text=False), id_col, measure_text=False)
    run = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_a", F.last(F.when(starts("a"), F.struct("pos", "end_pos", "info")), ignorenulls=True).over(run))
    rows = rows.where("pos <= _a.end_pos AND _a.info <> ''")
    links = rows.groupBy(id_col, F.col("_a.pos").alias("_pos")).agg(
        F.max("_a.info").alias("href"), F.expr("listagg(text, '') WITHIN GROUP (ORDER BY pos)").alias("text"))
    links = links.where("text <> ''").withColumn("text", clean_text("text"))
    return links.withColumn("link_no", F.row_number().over(Window.partitionBy(id_col).orderBy("_pos"))).drop("_pos")
