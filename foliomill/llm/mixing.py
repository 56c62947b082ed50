"""Mixing sources to target weights, with whole copies by pivotal dependent rounding.

A source's target over its size is the number of copies of each of its rows; the whole part is
taken as it is, the fraction is a probability of one copy more. Two rows meet: mass (size times
probability) goes from one to the other, at random but fair, until one of the two has
probability 0 or 1. The other one goes on. Blocks of rows do so side by side, and the row each
block leaves goes on to the next level of the tree. Mass is kept at each meeting, so the taken size
of a source differs from its target by less than one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill.llm.words import written
from foliomill.operators.naming import number_within

BLOCK = 256


def source_targets(sizes: DataFrame, weight: Column, source: str = "source", size: str = "source_size",
                   share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Add ``target`` to each source: ``share`` times all sizes, by weight, at most ``most`` times its size.

    The excess of a source at its limit goes to the others by weight, until none is above. A
    source is at its limit if limit / weight is small; in that order the level that the rest
    can reach follows from running sums. One row per source: the window is over a table of sources,
    as the code points' order of the weights is. If all are at their limits the rest stays unused.
    """
    rows = sizes.withColumn("_w", weight).withColumn("_limit", F.col(size) * most)
    budget = rows.agg(F.sum(size) * share).first()[0] or 0.0
    order = Window.orderBy(F.col("_limit") / F.col("_w"), F.col(source).asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("_level", (F.lit(float(budget)) - F.coalesce(F.sum("_limit").over(upto), F.lit(0.0))) / F.sum("_w").over(after))
    rows = rows.withColumn("_full", F.col("_limit") <= F.col("_w") * F.col("_level"))
    # The first source below its limit sets the level of all that follow.
    level = F.min(F.when(~F.col("_full"), F.struct((F.col("_limit") / F.col("_w")).alias("r"), (-F.col("_level")).alias("l")))).over(Window.partitionBy())
    rows = rows.withColumn("_open", -level["l"])
    return rows.withColumn("target", F.coalesce(F.least("_limit", F.col("_w") * F.col("_open")), F.col("_limit"))).drop(
        "_w", "_limit", "_level", "_full", "_open")


def _meet(block: Column, level: int, seed: int) -> Column:
    """Fold a block of rows: ``left`` is the row that is still open, ``done`` the settled ones."""
    def step(state, row):
        a, b = state["left"], row
        # Mass that can go from b to a, and from a to b, until one of them is whole.
        up = F.least((1 - a["p"]) * a["size"], b["p"] * b["size"])
        down = F.least(a["p"] * a["size"], (1 - b["p"]) * b["size"])
        chance = F.shiftrightunsigned(F.xxhash64(a["row"], b["row"], F.lit(level), F.lit(seed)), 11) / F.lit(float(1 << 53))
        moved = F.when(chance * (up + down) < down, up).otherwise(-down)
        pa, pb = a["p"] + moved / a["size"], b["p"] - moved / b["size"]
        # What just became whole is set so exactly, whatever the rounding of the division.
        a_whole = F.when(moved > 0, (1 - a["p"]) * a["size"] <= b["p"] * b["size"]).otherwise(a["p"] * a["size"] <= (1 - b["p"]) * b["size"])
        pa = F.when(a_whole, F.when(moved > 0, 1.0).otherwise(0.0)).otherwise(pa)
        pb = F.when(~a_whole, F.when(moved > 0, 0.0).otherwise(1.0)).otherwise(pb)
        settled = F.when(a_whole, F.struct(a["row"].alias("row"), a["size"].alias("size"), pa.alias("p"))).otherwise(
            F.struct(b["row"].alias("row"), b["size"].alias("size"), pb.alias("p")))
        left = F.when(a_whole, F.struct(b["row"].alias("row"), b["size"].alias("size"), pb.alias("p"))).otherwise(
            F.struct(a["row"].alias("row"), a["size"].alias("size"), pa.alias("p")))
        return F.struct(left.alias("left"), F.array_append(state["done"], settled).alias("done"))

    start = F.struct(block[0].alias("left"), F.slice(block, 1, 0).alias("done"))
    return F.aggregate(F.slice(block, F.lit(2), F.size(block)), start, step)


def pivotal_rounding(rows: DataFrame, group: str = "source", row: str = "row", size: str = "size", p: str = "p",
                     seed: int = 0, block: int = BLOCK) -> DataFrame:
    """``(group, row, take)``: 0 or 1 for each row, 1 with probability ``p``, the mass of each group kept.

    ``row`` numbers the rows of a group from 0 without gaps; ``p`` lies in [0, 1], sizes are
    positive. Rows meet in blocks of ``block`` neighbours; one row of each block goes on to the next level.
    The last row of a group takes the copy with its own probability. Chances are hashes of row
    numbers, so reruns agree.
    """
    now = rows.select(F.col(group).alias("g"), F.col(row).alias("row"), F.col(row).alias("place"),
                      F.col(size).cast("double").alias("size"), F.col(p).cast("double").alias("p"))
    settled = now.where("p <= 0 or p >= 1").select("g", "row", F.when(F.col("p") >= 1, 1).otherwise(0).alias("take"))
    now = now.where("p > 0 and p < 1")
    parts, level = [settled], 0
    while True:
        folded = now.groupBy("g", F.floor(F.col("place") / block).alias("block")).agg(
            F.sort_array(F.collect_list(F.struct("row", "size", "p"))).alias("rows"))
        folded = written(folded.select("g", "block", _meet(F.col("rows"), level, seed).alias("x")), "rounding")
        done = folded.select("g", F.explode("x.done").alias("d"))
        parts.append(done.select("g", "d.row", F.when(F.col("d.p") > 0.5, 1).otherwise(0).alias("take")))
        now = folded.select("g", "x.left.row", F.col("block").alias("place"), "x.left.size", "x.left.p")
        level += 1
        if (folded.agg(F.max("block")).first()[0] or 0) == 0:
            break
    chance = F.shiftrightunsigned(F.xxhash64("row", F.lit(level), F.lit(seed)), 11) / F.lit(float(1 << 53))
    parts.append(now.select("g", "row", F.when(chance < F.col("p"), 1).otherwise(0).alias("take")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("g", group)


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
                id_col: str = "doc_id", source: str = "source", size: str = "size", seed: int = 0) -> DataFrame:
    """Add ``source_size``, ``target`` and ``copies`` (0 to ``most``) to slim rows of id, source and size.

    Sources in the order of their code points, NULL last, have the weights in turn. Rows of size 0
    or NULL take no part in the rounding: they get the whole part of their source's ratio.
    Repeated rows are rows of their own.
    """
    # Written first: the sort looks at its input twice, and the size may have to be counted from a text.
    slim = written(docs.select(id_col, source, size), "mix-sizes")
    placed = number_within(slim, [source], [size, id_col], "row").withColumn("row", F.col("row") - 1)
    placed = written(placed, "mix-rows")
    sums = placed.groupBy(source).agg(F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    targets = written(source_targets(sums.withColumn("_turn", weight), F.col("_turn"), source, "source_size", share, most).drop("_turn"), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    ratios = targets.select(F.col(source).alias("_s"), "source_size", "target", F.floor(ratio).cast("bigint").alias("_whole"), (ratio - F.floor(ratio)).alias("_p"))
    # Targets are one row per source; whether they are broadcast is left to the size check of the optimizer.
    rows = placed.join(ratios, F.col(source).eqNullSafe(F.col("_s"))).drop("_s")
    takes = pivotal_rounding(rows.where(F.coalesce(F.col(size), F.lit(0)) > 0).withColumn("p", F.col("_p")), source, "row", size, "p", seed)
    takes = takes.select(F.col(source).alias("_s"), F.col("row").alias("_row"), "take")
    joined = rows.join(takes, F.col(source).eqNullSafe(F.col("_s")) & (F.col("row") == F.col("_row")), "left")
    copies = F.col("_whole") + F.coalesce("take", F.lit(0))
    return joined.select(id_col, source, size, "source_size", "target", copies.alias("copies"))
