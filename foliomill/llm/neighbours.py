"""Approximate nearest neighbours: an NN-descent graph, and greedy search in it.

The graph of each vector's near neighbours starts from blocks of vectors that lie together in a random
order of the space. Then neighbours of neighbours are compared, round by round: each vector's neighbours, in
either direction, meet in a Spark join and are compared with each other, and every vector keeps its nearest.
A query walks the graph: the nearest vectors it has seen and not yet left are replaced by their
neighbours, until the nearest ones are all left.

Equal vectors are one node, so that a vector with very many copies is no hub.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill.llm.simhash import _groups
from foliomill.llm.words import written
from foliomill.operators.naming import number_within

DEGREE = 32
BACK = 24
BLOCK = 64
ORDERS = 4
ROUNDS = 7
BREADTH = 192


def usable(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(id, v)``, v in double precision; without NULL ids and vectors that are NULL, zero, or hold NULL or non-finite components.

    If dimensions differ, the most frequent one is used (of equally frequent ones the largest).
    """
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).where(F.coalesce(fine, F.lit(False)))
    rows = rows.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (size["n"] if size else 0))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors from bytes: a scale in single precision, then a signed byte (or a half float) for each component."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    rows = raw.reshape(-1, 4 + width) if len(column) and len(raw) // len(column) == 4 + width else raw.reshape(-1, 4 + 2 * width)
    kind = np.int8 if rows.shape[1] == 4 + width else np.float16
    scale = np.ascontiguousarray(rows[:, :4]).view(np.float32)
    return np.ascontiguousarray(rows[:, 4:]).view(kind).astype(np.float32) * scale


def _nearest_in_groups(group: np.ndarray, x: np.ndarray, fresh: np.ndarray, limit: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(row, row, distance)`` of the k nearest within a group, of each row; nearer than its limit, and one of the two fresh."""
    edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
    sizes = np.diff(edges)
    for size in np.unique(sizes):
        firsts = edges[:-1][sizes == size]
        for part in np.array_split(firsts, max(1, len(firsts) * size * size // (1 << 22))):
            if size < 2 or not len(part):
                continue
            rows = part[:, None] + np.arange(size)
            own = x[rows]
            square = (own * own).sum(axis=2)
            d = np.sqrt(np.maximum(square[:, :, None] + square[:, None, :] - 2 * (own @ own.transpose(0, 2, 1)), 0))
            d[~(fresh[rows][:, :, None] | fresh[rows][:, None, :])] = np.inf
            d[:, np.arange(size), np.arange(size)] = np.inf
            d[d >= limit[rows][:, :, None]] = np.inf
            top = np.argpartition(d, min(k, size - 1) - 1, axis=2)[:, :, :k] if k < size else np.broadcast_to(np.arange(size), d.shape)
            near = np.take_along_axis(d, top, axis=2)
            g, a, b = np.nonzero(near < np.inf)
            yield rows[g, a], rows[g, top[g, a, b]], near[g, a, b]


def _compare(members: DataFrame, width: int, k: int) -> DataFrame:
    """``(src, dst, d)`` between the members ``(g, node, x, fresh, limit)`` of each group."""
    def task(batches):
        for table in _groups(batches, ("g",)):
            if not table.num_rows:
                continue
            node = table.column("node").to_numpy()
            found = _nearest_in_groups(table.column("g").to_numpy(), _matrix(table.column("x"), width),
                                       table.column("fresh").to_numpy(zero_copy_only=False), table.column("limit").to_numpy(), k)
            for a, b, d in found:
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b]), pa.array(d.astype(np.float32))], ["src", "dst", "d"])

    placed = members.select("g", "node", "x", "fresh", "limit").repartition("g").sortWithinPartitions("g")
    return placed.mapInArrow(task, "src bigint, dst bigint, d float")


def _first(rows: DataFrame, by: str, n: int, *order: Column) -> DataFrame:
    """The first n rows of each group; Spark drops the others before the shuffle already."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def _packed(nodes: DataFrame) -> DataFrame:
    """``(node, x, h)``: the components as signed bytes for the graph, as half floats for the search; both scaled to the vector.

    They only find candidates. Distances that are returned come from the vectors themselves.
    """
    def task(batches):
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("v").flatten().to_numpy().reshape(b.num_rows, -1)
            top = np.abs(v).max(axis=1, keepdims=True)
            unit = v / top
            coarse, fine = np.rint(unit * 127).astype(np.int8), unit.astype(np.float16)
            x = [s.tobytes() + r.tobytes() for s, r in zip((top / 127).astype(np.float32), coarse)]
            h = [s.tobytes() + r.tobytes() for s, r in zip(top.astype(np.float32), fine)]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(x, pa.binary()), pa.array(h, pa.binary())], ["node", "x", "h"])

    return nodes.select("node", "v").mapInArrow(task, "node bigint, x binary, h binary")


def _blocks(packed: DataFrame, width: int, order_no: int, block: int) -> DataFrame:
    """``(node, g)``: blocks of neighbours in the order of the signs of random projections."""
    rng = np.random.default_rng(order_no)
    directions = rng.standard_normal((width, 48)).astype(np.float32)
    bits = 1 << np.arange(47, -1, -1, dtype=np.int64)

    def task(batches):
        for b in batches:
            signs = _matrix(b.column("x"), width) @ directions > 0
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(signs @ bits)], ["node", "code"])

    codes = packed.mapInArrow(task, "node bigint, code bigint")
    return number_within(codes, [], ["code", "node"], "n").select("node", F.floor((F.col("n") - 1) / block).cast("bigint").alias("g"))


def neighbour_graph(packed: DataFrame, width: int, degree: int = DEGREE, back: int = BACK, rounds: int = ROUNDS, orders: int = ORDERS,
                    block: int = BLOCK, settled: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """``(graph, blocks)``: ``(src, dst, d)`` with up to ``degree`` neighbours per node, and the first of the starting blocks.

    ``packed`` has different vectors. In a round a node's neighbours are compared, and with them the nearest ``back`` of the nodes
    that have it as a neighbour. Rounds end when less than the share ``settled`` of the edges is new.
    """
    packed = packed.select("node", "x")
    graph, first = None, None
    for k in range(orders):
        block_of = written(_blocks(packed, width, k, block), "blocks")
        first = block_of if first is None else first
        members = block_of.join(packed, "node").withColumns({"fresh": F.lit(True), "limit": F.lit(float("inf")).cast("float")})
        near = _compare(members, width, degree)
        graph = near if graph is None else graph.unionByName(near)
    graph = written(_first(graph.groupBy("src", "dst").agg(F.min("d").alias("d")), "src", degree, F.col("d"), F.col("dst")).withColumn("fresh", F.lit(True)), "graph")
    for _ in range(rounds):
        others = _first(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "d", "fresh"), "src", back, F.col("d"), F.col("dst"))
        ways = graph.unionByName(others).groupBy(F.col("src").alias("g"), F.col("dst").alias("node")).agg(F.max("fresh").alias("fresh"))
        limit = graph.groupBy(F.col("src").alias("node")).agg(F.when(F.count("*") >= degree, F.max("d")).otherwise(float("inf")).cast("float").alias("limit"))
        known = packed.join(limit, "node", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf")).cast("float")))
        found = _compare(ways.join(known, "node"), width, degree)
        merged = graph.select("src", "dst", "d", F.lit(0).alias("new")).unionByName(found.withColumn("new", F.lit(1)))
        merged = merged.groupBy("src", "dst").agg(F.min("d").alias("d"), (F.min("new") == 1).alias("fresh"))
        graph = written(_first(merged, "src", degree, F.col("d"), F.col("dst")), "graph")
        total, new = graph.agg(F.count("*"), F.count_if("fresh")).first()
        if new <= settled * total:
            break
    return graph.select("src", "dst", "d"), first


def _distance(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def greedy_search(packed: DataFrame, width: int, graph: DataFrame, queries: DataFrame, entries: DataFrame, found: int,
                  breadth: int = BREADTH, max_rounds: int = 60) -> DataFrame:
    """``(query, node, d)``: the ``found`` nearest nodes each query has met, with distances of half precision.

    ``queries`` is ``(query, q)``, ``entries`` ``(query, node)`` the nodes to start from. In a round a query leaves the
    nearest third of its ``breadth`` nearest nodes, as far as they are not yet left, by their edges in either direction.
    It ends when all ``breadth`` are left.
    """
    breadth = max(breadth, found)
    step = -(-breadth // 3)
    both = written(graph.select("src", "dst").unionByName(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")

    def task(batches):
        for b in batches:
            gap = _matrix(b.column("h"), width) - _matrix(b.column("q"), width)
            d = pa.array(np.sqrt((gap * gap).sum(axis=1)).astype(np.float64))
            yield pa.RecordBatch.from_arrays([b.column("query"), b.column("node"), d, pa.array(np.zeros(b.num_rows, bool))], ["query", "node", "d", "left"])

    def measured(pairs):
        joined = pairs.join(packed.select("node", "h"), "node").join(queries, "query").select("query", "node", "h", "q")
        return joined.mapInArrow(task, "query bigint, node bigint, d double, left boolean")

    seen = written(_first(measured(entries.distinct()), "query", breadth, F.col("d"), F.col("node")), "search")
    for _ in range(max_rounds):
        leaving = _first(seen.where(~F.col("left")), "query", step, F.col("d"), F.col("node")).select("query", F.col("node").alias("src"))
        leaving = written(leaving, "leaving")
        if leaving.isEmpty():
            return _first(seen, "query", found, F.col("d"), F.col("node")).select("query", "node", "d")
        reached = leaving.join(both, "src").select("query", F.col("dst").alias("node")).distinct()
        new = measured(reached.join(seen.select("query", "node"), ["query", "node"], "left_anti"))
        marks = leaving.select("query", F.col("src").alias("node"), F.lit(True).alias("now"))
        old = seen.join(marks, ["query", "node"], "left").select("query", "node", "d", F.coalesce(F.col("left") | F.col("now"), F.col("left")).alias("left"))
        seen = written(_first(old.unionByName(new), "query", breadth, F.col("d"), F.col("node")), "search")
    raise RuntimeError(f"greedy search not ended after {max_rounds} rounds")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector: str = "embedding",
            degree: int = DEGREE, rounds: int = ROUNDS, breadth: int = BREADTH) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest rows found for each row that ``is_query`` tells.

    The score is the Euclidean distance in double precision; ties go to the smaller id. Every usable
    row but the query's own is a candidate. Rows of equal ids are taken as one row each: all of them but
    those of the query's id are candidates.
    """
    asking = vectors.where(is_query).select(F.col(id_col).alias("id"), F.lit(True).alias("asks")).distinct()
    rows = written(usable(vectors, id_col, vector).join(asking, "id", "left"), "rows")
    nodes = written(rows.groupBy("v").agg(F.min("id").alias("node"), F.count_if("asks").alias("asked")), "nodes")
    size = nodes.selectExpr("size(v) as n").first()
    width = size[0] if size else 1
    tagged = written(rows.join(nodes.select("v", "node"), "v").select("id", "node", "asks"), "tagged")
    packed = written(_packed(nodes), "vectors")
    graph, blocks = neighbour_graph(packed, width, degree, rounds=rounds)
    # Queries of one vector search once.
    asked = nodes.where("asked > 0").select(F.col("node").alias("query"), F.col("v").alias("q"))
    own = asked.select("query", F.col("query").alias("node"))
    in_block = own.join(blocks, "node").select("query", "g").join(blocks, "g").select("query", "node")
    halves = written(own.join(packed, "node").select("query", F.col("h").alias("q")), "queries")
    # Twice as many as asked for, so that half precision loses none; then distances of the vectors themselves.
    found = greedy_search(packed, width, graph, halves, own.unionByName(in_block), 2 * (k + 1), breadth).select("query", "node")
    exact = found.join(nodes.select("node", "v"), "node").join(asked, "query").select("query", "node", _distance("v", "q").alias("d"))
    found = written(_first(exact, "query", k + 1, F.col("d"), F.col("node")), "found")
    # Of a vector with many copies only the first k + 1 can be among the nearest k.
    copies = _first(tagged.select("id", "node"), "node", k + 1, F.col("id"))
    near = found.join(copies, "node").select("query", F.col("id").alias("vec_id"), F.col("d").alias("score"))
    near = _first(near, "query", k + 1, F.col("score"), F.col("vec_id"))
    asks = tagged.where("asks").select(F.col("id").alias("query_id"), F.col("node").alias("query"))
    pairs = asks.join(near, "query").where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
