"""Page trees: discovery level by level, paths and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill.functions.constants import TREE_CAP, TREE_TYPES
from foliomill.functions.text import sanitize_title
from foliomill.operators.naming import first_in_group, first_rows
from foliomill.session import checkpoint_folder

NODE_COLUMNS = ["root_id", "id", "title", "parent_id", "type", "status", "ord", "depth", "ord_path", "id_path", "title_path"]


def discover_tree(nodes: DataFrame, roots: DataFrame, max_depth: int | None = None, cap: int | None = None) -> DataFrame:
    """Nodes reachable from each root, with their depth and place in breadth-first order.

    ``nodes``: ``id, title, parent_id, type, status, ord`` (``ord``: place among siblings).
    ``roots``: ``root_id``. Only pages and folders are followed, children of an unreadable
    node (``status`` not 200) are not, and a node is not entered again below itself.

    One join per level against the nodes; a parent with very many children is left to adaptive
    execution, which splits it. Each level is checkpointed to the shared folder, so lineage
    stays short and a lost executor costs one level. With ``cap`` a root stops as soon as it has more nodes than that: the surplus is
    cut per root, partition by partition first (``first_rows``), and one node past the cap is kept so that
    truncation can be told.
    """
    checkpoint_folder(nodes.sparkSession)
    children = nodes.where(F.col("type").isin(TREE_TYPES) & F.col("parent_id").isNotNull()).select(
        "id", "title", "parent_id", "type", "status", "ord")
    children = children.checkpoint()
    # A node with several parents has several rows; as a root it counts once.
    level = nodes.join(roots, nodes["id"] == roots["root_id"]).dropDuplicates(["root_id"]).select(
        "root_id", "id", "title", F.lit(None).cast("string").alias("parent_id"), "type", "status", "ord",
        F.lit(0).alias("depth"), F.array(F.lit(0).cast("bigint")).alias("ord_path"), F.array("id").alias("id_path"),
        F.array("title").alias("title_path")).checkpoint()
    levels, depth = [level], 0
    while max_depth is None or depth < max_depth:
        parents = level.where("status = 200").select(
            "root_id", F.col("id").alias("parent_id"), "depth", "ord_path", "id_path", "title_path")
        found = children.join(parents, "parent_id").where(~F.array_contains("id_path", F.col("id"))).select(
            "root_id", "id", "title", "parent_id", "type", "status", "ord", (F.col("depth") + 1).alias("depth"),
            F.array_append("ord_path", F.col("ord")).alias("ord_path"), F.array_append("id_path", F.col("id")).alias("id_path"),
            F.array_append("title_path", F.col("title")).alias("title_path"))
        if cap is not None:
            so_far = levels[0]
            for earlier in levels[1:]:
                so_far = so_far.unionByName(earlier)
            used = so_far.groupBy("root_id").agg(F.count("*").alias("_used"))
            found = first_rows(found, ["root_id"], "ord_path", cap + 1)
            found = found.join(used, "root_id").where(F.col("_n") + F.col("_used") <= cap + 1).drop("_n", "_used")
        level = found.checkpoint()
        if level.isEmpty():
            break
        levels.append(level)
        depth += 1
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def capped(tree: DataFrame, cap: int = TREE_CAP) -> DataFrame:
    """The first ``cap`` nodes of each root in breadth-first order, numbered by ``bfs_no``.

    ``tree`` comes from ``discover_tree`` with the same cap, so a root has at most cap + 1 rows.
    """
    order = Window.partitionBy("root_id").orderBy("depth", "ord_path")
    return tree.withColumn("bfs_no", F.row_number().over(order)).where(F.col("bfs_no") <= cap)


def tree_summary(tree: DataFrame, cap: int = TREE_CAP) -> DataFrame:
    """Per root: nodes shown, whether the tree was cut, and a label."""
    shown = F.least(F.count("*"), F.lit(cap))
    out = tree.groupBy("root_id").agg(
        shown.alias("n_nodes"), (F.count("*") > cap).alias("truncated"),
        F.max(F.when(F.col("depth") == 0, F.col("title"))).alias("root_title"))
    noun = F.when(F.col("n_nodes") == 1, "page").otherwise("pages")
    return out.withColumn("label", F.concat_ws(" ", F.lit("Found"), F.col("n_nodes").cast("string"), noun))


def fetched(tree: DataFrame) -> Column:
    """Folders have no body to fetch; a page counts when its response was read."""
    return (F.col("type") == "folder") | (F.col("status") == 200)


def with_paths(tree: DataFrame) -> DataFrame:
    """Add ``name``, ``path`` and ``path_collision``.

    A sibling keeps its name unless an earlier one has it, be it by title or by what was added to its title; else
    it gets the last six characters of its id. Folders in the path are the plain names of the ancestors.
    """
    rows = tree.withColumns({
        "base_name": sanitize_title("title"),
        "_parent": F.coalesce("parent_id", F.lit("__root__")),
        "node_key": F.concat_ws("/", "root_id", F.array_join("id_path", "/")),
    })
    rows = first_in_group(rows, ["root_id", "_parent", "base_name"], "node_key", F.struct("depth", "ord_path"))
    longer = F.concat_ws("-", "base_name", F.right(F.col("id"), F.lit(6)))
    rows = _taken_by_longer_names(rows.withColumn("_longer", longer))
    name = F.when(F.col("is_first"), F.col("base_name")).otherwise(F.col("_longer"))
    folders = F.transform(F.slice("title_path", F.lit(1), F.size("title_path") - 1), sanitize_title)
    return rows.withColumn("name", name).withColumn(
        "path", F.concat(F.array_join(F.array_append(folders, F.col("name")), "/"), F.lit(".md"))).drop("_parent", "node_key", "_longer")


def _taken_by_longer_names(rows: DataFrame) -> DataFrame:
    """Clear ``is_first`` where an earlier sibling was given, with its id added, the plain name of the row.

    Only rows whose plain name equals a longer one of a sibling are looked at, so nearly always the first
    round finds none. A row that loses its plain name gets a longer one too, hence the rounds.
    """
    place = F.struct("depth", "ord_path").alias("place")
    checkpoint_folder(rows.sparkSession)
    longer = rows.select("root_id", "_parent", F.col("_longer").alias("base_name"), F.col("node_key").alias("by"), place)
    mine = rows.where("is_first").select("root_id", "_parent", "base_name", "node_key", place)
    taken = mine.join(longer.withColumnRenamed("place", "by_place"), ["root_id", "_parent", "base_name"]).where(
        "by_place < place").select("node_key", "by").checkpoint()
    if taken.isEmpty():
        return rows
    later = rows.where("NOT is_first").select(F.col("node_key").alias("by"))
    lost = taken.join(later, "by", "left_semi").select("node_key").distinct().checkpoint()
    while True:
        more = taken.join(lost.select(F.col("node_key").alias("by")), "by", "left_semi").select("node_key").distinct()
        more = more.join(lost, "node_key", "left_anti").checkpoint()
        if more.isEmpty():
            break
        lost = lost.unionByName(more).checkpoint()
    marked = rows.join(lost.withColumn("_lost", F.lit(True)), "node_key", "left")
    return marked.withColumn("is_first", F.col("is_first") & F.col("_lost").isNull()).drop("_lost")


def with_path_collisions(entries: DataFrame) -> DataFrame:
    """Add ``path_collision``: another entry of the root has the same path.

    The paths that occur twice come from a pre-aggregated count; the join on them is left to
    adaptive execution, which splits a path that many rows share.
    """
    double = entries.groupBy("root_id", "path").count().where("count > 1").select("root_id", "path", F.lit(True).alias("path_collision"))
    return entries.join(double, ["root_id", "path"], "left").withColumn("path_collision", F.coalesce("path_collision", F.lit(False)))
