"""Numbering and naming within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill.session import checkpoint_folder

# Bytes of a part of a long document.
PART_BYTES = 64 << 20


def with_parts(rows: DataFrame, part_bytes: int, before: str = "_before") -> DataFrame:
    """Add ``part``, the number of the piece that a row lies in, from the bytes before it.

    A piece begins with the first row at or past each multiple of ``part_bytes``, so it holds that much at most
    and one row more; numbers that a large row skips stay unused.
    """
    return rows.withColumn("part", F.floor(F.col(before) / part_bytes).cast("int"))


def totals_within(rows: DataFrame, group_cols: list[str], order_cols: str | list[str], sums: dict[str, str | None]) -> DataFrame:
    """Add running totals over the rows of a group before each row, in the order of ``order_cols``.

    ``sums`` names them: of a numeric column (NULL counts as 0), or of rows where it is None. A plain window
    would bring a group into one task, however large it is. Here the rows are sorted over all partitions by (group, order), so
    a large group fills several of them. Each run of a group within a partition is added up, and a row's total is that
    within its run, moved up by the runs before. Any sortable type will do; NULL is a group, and an order, of its own. Rows equal
    in all order columns come in either order.

    ``rows`` should be slim: the sorted rows are checkpointed, as their places belong to that sort.
    """
    order = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    checkpoint_folder(rows.sparkSession)
    keys = [*group_cols, *order]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    # The upper bits of the place are the partition.
    placed = placed.checkpoint().withColumn("_run", F.shiftright("_place", 33))
    amounts = {out: F.coalesce(F.col(c), F.lit(0)).cast("bigint") if c else F.lit(1).cast("bigint") for out, c in sums.items()}
    weighted = [out for out, c in sums.items() if c]
    if weighted:
        run = Window.partitionBy("_run", *group_cols).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
        placed = placed.withColumns({f"_in_{out}": F.coalesce(F.sum(amounts[out]).over(run), F.lit(0)) for out in weighted})
    runs = placed.groupBy(*group_cols, "_run").agg(F.min("_place").alias("_first"), *[F.sum(amounts[out]).alias(f"_n_{out}") for out in sums])
    before = Window.partitionBy(*group_cols).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    moves = runs.select(*[F.col(c).alias(f"_group_{i}") for i, c in enumerate(group_cols)], F.col("_run").alias("_its_run"), "_first",
                        *[F.coalesce(F.sum(f"_n_{out}").over(before), F.lit(0)).alias(f"_move_{out}") for out in sums])
    same = F.col("_run") == F.col("_its_run")
    for i, c in enumerate(group_cols):
        same &= F.col(c).eqNullSafe(F.col(f"_group_{i}"))
    inside = {out: F.col(f"_in_{out}") if out in weighted else F.col("_place") - F.col("_first") for out in sums}
    return placed.join(moves, same).select(*[F.col(c) for c in rows.columns if c not in sums], *[(inside[out] + F.col(f"_move_{out}")).alias(out) for out in sums])


def number_within(rows: DataFrame, group_cols: list[str], order_cols: str | list[str], out: str = "ordinal") -> DataFrame:
    """Add the 1-based position of a row in its group, in the order of ``order_cols``; see ``totals_within``."""
    return totals_within(rows, group_cols, order_cols, {out: None}).withColumn(out, F.col(out) + 1).select(*[c for c in rows.columns if c != out], out)


def dedupe_names(rows: DataFrame, name_col: str, order_col: str, out: str = "name") -> DataFrame:
    """The n-th row of a name gets ``-n`` from the second on. ``name_collision`` marks a result
    that another base name has as well."""
    numbered = number_within(rows, [name_col], order_col)
    name = F.when(F.col("ordinal") > 1, F.concat_ws("-", name_col, F.col("ordinal").cast("string"))).otherwise(F.col(name_col))
    named = numbered.withColumn(out, name)
    double = named.groupBy(F.col(out).alias("_double")).count().where("count > 1").select("_double")
    return named.join(double, F.col(out) == F.col("_double"), "left").withColumn(
        "name_collision", F.col("_double").isNotNull()).drop("_double")


def first_in_group(rows: DataFrame, group_cols: list[str], id_col: str, order: Column, out: str = "is_first") -> DataFrame:
    """Flag the first row of each group.

    The first ids come from a pre-aggregated minimum and are joined back on the unique id,
    so no group, however large, meets in one task.
    """
    firsts = rows.groupBy(*group_cols).agg(F.min(F.struct(order.alias("o"), F.col(id_col).alias("id"))).alias("f"))
    firsts = firsts.select(F.col("f.id").alias(id_col), F.lit(True).alias(out))
    return rows.join(firsts, id_col, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def first_rows(rows: DataFrame, group_cols: list[str], order_cols: str | list[str], k: int, out: str = "_n") -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1 in ``out``.

    Each partition's rows of a group are cut to the first k on their own, then those of 256 partitions together, then those of
    the group: no task sorts more than a partition or 256 * k rows of one group, however large it is, and for any k.
    """
    order = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    part = f"{out}_part"
    rows = rows.withColumn(part, F.spark_partition_id())
    for span in (1, 256):
        own = Window.partitionBy(*group_cols, F.floor(F.col(part) / span)).orderBy(*order)
        rows = rows.withColumn(out, F.row_number().over(own)).where(F.col(out) <= k)
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*group_cols).orderBy(*order))).where(F.col(out) <= k).drop(part)
