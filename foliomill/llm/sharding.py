"""Sharding by a k-d tree: cut at weighted medians along the widest metadata dimension.

Every dimension is turned into ranks by a spread sort, so widths of unlike columns compare and
ties are told apart. All open nodes of the tree are cut at once: a histogram of bytes for each
(node, dimension) finds the widest dimension and the bin of the median, and further histograms
inside that bin find the cut to within a tolerance. What the driver gets is one row per node.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.llm.words import written
from foliomill.operators.naming import number_within

BINS = 1024


@dataclass
class Node:
    """A part of the tree that still holds several shards: ``first`` to ``first + shards - 1``."""

    first: int
    shards: int
    dim: int = 0
    low: int = 0  # the range of ranks that holds the cut
    high: int = 0
    below: int = 0  # bytes under ``low``
    total: int = 0
    mass: int = 0  # bytes of the range


def _chosen(nodes: list[Node], value) -> Column:
    """A CASE over the nodes by their number; nodes are as many as shards at most."""
    items = [x for n in nodes for x in (F.lit(n.first), value(n))]
    return F.element_at(F.create_map(*items), F.col("node"))


def _widest(units: DataFrame, nodes: list[Node], dims: int) -> None:
    measures = [F.sum("size").alias("total")]
    for d in range(dims):
        measures += [F.min(f"rank_{d}").alias(f"low_{d}"), F.max(f"rank_{d}").alias(f"high_{d}")]
    rows = {r.node: r for r in units.where(F.col("node").isin([n.first for n in nodes])).groupBy("node").agg(*measures).collect()}
    for n in nodes:
        row = rows.get(n.first)
        if row:
            n.dim = max(range(dims), key=lambda d: (row[f"high_{d}"] - row[f"low_{d}"], -d))
            n.low, n.high, n.total, n.mass, n.below = row[f"low_{n.dim}"], row[f"high_{n.dim}"], row.total, row.total, 0


def _narrow(units: DataFrame, nodes: list[Node], dims: int, bins: int) -> None:
    """Shrink the range of each node to the bin that holds its cut."""
    rank = F.coalesce(*[F.when(_chosen(nodes, lambda n: F.lit(n.dim)) == d, F.col(f"rank_{d}")) for d in range(dims)])
    width = {n.first: max(1, -(-(n.high - n.low + 1) // bins)) for n in nodes}
    rows = units.where(F.col("node").isin([n.first for n in nodes])).withColumn("r", rank)
    rows = rows.where((F.col("r") >= _chosen(nodes, lambda n: F.lit(n.low))) & (F.col("r") <= _chosen(nodes, lambda n: F.lit(n.high))))
    bin_of = F.floor((F.col("r") - _chosen(nodes, lambda n: F.lit(n.low))) / _chosen(nodes, lambda n: F.lit(width[n.first])))
    sums: dict[int, list[tuple[int, int]]] = {}
    for r in rows.groupBy("node", bin_of.alias("bin")).agg(F.sum("size").alias("size")).orderBy("node", "bin").collect():
        sums.setdefault(r.node, []).append((r.bin, r.size))
    for n in nodes:
        goal = n.total * (n.shards // 2) / n.shards
        below = n.below
        for bin_no, size in sums[n.first]:
            if below + size >= goal or bin_no == sums[n.first][-1][0]:
                low = n.low + bin_no * width[n.first]
                n.low, n.high, n.below, n.mass = low, min(n.high, low + width[n.first] - 1), below, size
                break
            below += size


def kd_shards(rows: DataFrame, dims: list[str], size: str, shards: int, group: str | None = None,
              bins: int = BINS, tolerance: float = 0.002) -> DataFrame:
    """Add ``shard`` (0 to shards - 1), nearly equal in the sum of ``size``, and its ``slot``.

    A node of k shards is cut where floor(k / 2) / k of its bytes lie below, along the dimension
    that spans most ranks; so leaves reach the target ``total / shards`` together. A cut is off by at
    most ``tolerance`` of a leaf or one row. Rows of one ``group`` value (such as a content hash)
    stay together as one unit if they hold at most a twentieth of a leaf; larger groups are
    cut like other rows, which ``together`` tells. Slots number the rows of a shard from 0 without gaps. NULL is the
    lowest value of a dimension, a NULL size counts 0. Rows equal in everything are units of their own and may be exchanged
    with each other; all other results repeat. An empty table gives an empty one. Any column names will do but
    those of the result.

    ``rows`` should be slim: metadata, no texts. It is written to the shared folder a few times.
    """
    own = list(rows.columns)
    if clash := {"shard", "slot", "together"} & {c.lower() for c in own}:
        raise ValueError(f"{sorted(clash)} are columns of the result: pass them under other names")
    base = written(rows.select(F.struct(*own).alias("row"), *[F.col(c).alias(f"dim_{d}") for d, c in enumerate(dims)],
                               F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("size"),
                               (F.col(group) if group else F.lit(None).cast("int")).alias("group")), "shard-rows")
    total = base.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    target = max(1, total // shards)
    sums = base.where("group IS NOT NULL").groupBy(F.col("group").alias("g")).agg(F.sum("size").alias("n")).where(F.col("n") <= target // 20)
    base = base.join(sums.select("g"), F.col("group") == F.col("g"), "left")
    together = F.col("g").isNotNull()
    # A group is a negative number, a row its place, written once: rows equal in everything stay apart. Ties go by content, so reruns agree.
    unit = F.when(together, -F.shiftrightunsigned(F.xxhash64("g", F.lit("group")), 1) - 1).otherwise(F.monotonically_increasing_id())
    tie = F.when(together, F.xxhash64("g")).otherwise(F.xxhash64("row"))
    base = written(base.select("row", "size", *[f"dim_{d}" for d in range(len(dims))], together.alias("together"), unit.alias("unit"), tie.alias("tie")), "shard-units")
    # The unit's place in each dimension is that of its smallest row.
    units = base.groupBy("unit").agg(F.sum("size").alias("size"), F.min("tie").alias("tie"), *[F.min(f"dim_{d}").alias(f"dim_{d}") for d in range(len(dims))])
    for d in range(len(dims)):
        units = number_within(units, [], [f"dim_{d}", "tie", "unit"], f"rank_{d}")
    units = written(units.select("unit", "size", *[f"rank_{d}" for d in range(len(dims))], F.lit(0).alias("node")), "shard-ranks")
    open_nodes = [Node(0, shards)] if shards > 1 else []
    while open_nodes:
        _widest(units, open_nodes, len(dims))
        open_nodes = [n for n in open_nodes if n.total]
        if not open_nodes:
            break
        while wide := [n for n in open_nodes if n.high > n.low and n.mass > tolerance * n.total / n.shards]:
            _narrow(units, wide, len(dims), bins)
        for n in open_nodes:  # the bin goes to the nearer side
            if n.below + n.mass / 2 > n.total * (n.shards // 2) / n.shards:
                n.high = n.low - 1
        rank = F.coalesce(*[F.when(_chosen(open_nodes, lambda n: F.lit(n.dim)) == d, F.col(f"rank_{d}")) for d in range(len(dims))])
        moved = F.when(rank > _chosen(open_nodes, lambda n: F.lit(n.high)), F.col("node") + _chosen(open_nodes, lambda n: F.lit(n.shards // 2)))
        units = written(units.withColumn("node", F.coalesce(moved, F.col("node"))), "shard-cut")
        halves = [Node(n.first, n.shards // 2) for n in open_nodes] + [Node(n.first + n.shards // 2, n.shards - n.shards // 2) for n in open_nodes]
        open_nodes = [n for n in halves if n.shards > 1]
    placed = base.join(units.select("unit", F.col("node").alias("shard")), "unit").select("row", "together", "shard")
    numbered = number_within(placed, ["shard"], ["row"], "slot")
    return numbered.select(*[F.col(f"row.`{c}`").alias(c) for c in own], "shard", (F.col("slot") - 1).alias("slot"), "together")
