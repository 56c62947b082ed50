import pytest
from pyspark.sql import functions as F

from foliomill.operators import tree as TR
from foliomill.plans import tree_export as TX
from foliomill.sinks.files import write_files
from foliomill.sources.wiki_responses import CHILDREN_SCHEMA, follow_pages, read_children_responses, read_page_responses, rejected_responses

SCHEMA = "id string, title string, parent_id string, type string, status int, ord bigint"
BODIES = "id string, title string, html_body string"


def discover(spark, rows, root="1", depth=None, cap=None):
    roots = spark.createDataFrame([(root,)], "root_id string")
    return TR.discover_tree(spark.createDataFrame(rows, SCHEMA), roots, depth, cap)


def ids(tree):
    return [(r.id, r.depth) for r in tree.orderBy("depth", "ord_path").collect()]


CHAIN = [("1", "Root", None, "page", 200, 0), ("2", "Child A", "1", "page", 200, 1), ("3", "Grand", "2", "page", 200, 2)]


def test_depth_limits(spark):
    assert ids(discover(spark, CHAIN, depth=0)) == [("1", 0)]
    assert ids(discover(spark, CHAIN, depth=1)) == [("1", 0), ("2", 1)]
    assert ids(discover(spark, CHAIN)) == [("1", 0), ("2", 1), ("3", 2)]


def test_types_unreadable_nodes_and_cycles(spark):
    rows = CHAIN + [("4", "W", "1", "whiteboard", 200, 4), ("5", "D", "1", "database", 200, 5), ("9", "Locked", "1", "page", 403, 9),
                    ("10", "Hidden", "9", "page", 200, 10), ("1", "Root", "3", "page", 200, 11)]
    assert ids(discover(spark, rows)) == [("1", 0), ("2", 1), ("9", 1), ("3", 2)]


def test_cap_and_truncation(spark):
    rows = [CHAIN[0]] + [(str(k), f"C{k}", "1", "page", 200, k) for k in range(10, 20)] + [("99", "x", "1", "whiteboard", 200, 99)]
    tree = discover(spark, rows, cap=5)
    assert tree.count() == 6
    assert ids(TR.capped(tree, 5)) == [("1", 0), ("10", 1), ("11", 1), ("12", 1), ("13", 1)]
    summary = TR.tree_summary(tree, 5).first()
    assert (summary.n_nodes, summary.truncated, summary.label) == (5, True, "Found 5 pages")
    # Just as many nodes as the cap: nothing is cut, whatever else the parent holds.
    assert TR.tree_summary(discover(spark, rows, cap=11), 11).first().truncated is False
    assert TR.tree_summary(discover(spark, CHAIN[:1]), 100).first().label == "Found 1 page"


def test_a_large_cap_on_one_hot_root(spark):
    nodes = spark.range(20_000).select(
        F.col("id").cast("string").alias("id"), F.lit("T").alias("title"), F.when(F.col("id") > 0, "0").alias("parent_id"),
        F.lit("page").alias("type"), F.lit(200).alias("status"), ((F.col("id") * 7919) % 20_011).alias("ord")).repartition(9)
    roots = spark.createDataFrame([("0",)], "root_id string")
    tree = TR.discover_tree(nodes, roots, None, 1500)
    assert tree.count() == 1501
    shown = {r.id for r in TR.capped(tree, 1500).collect()}
    assert shown == {"0"} | {r.id for r in nodes.where("id <> '0'").orderBy("ord").limit(1499).collect()}


def test_export(spark):
    rows = [("1", "Root", None, "page", 200, 0), ("200001", "Dup", "1", "page", 200, 1), ("200002", "Dup", "1", "page", 200, 2),
            ("9", "Locked", "1", "page", 403, 3), ("7", "Stuff/x", "1", "folder", 200, 4), ("8", "In", "7", "page", 200, 5),
            ("300001", "Dup", "200002", "page", 200, 6)]
    bodies = spark.createDataFrame([(r[0], r[1], f"<h1>{r[1]}</h1><p>b{r[0]}</p>") for r in rows], BODIES)
    tree = discover(spark, rows)
    got = {r.path: r.content for r in TX.export_tree(tree, bodies).collect()}
    assert set(got) == {"Root.md", "Root/Dup.md", "Root/Dup-200002.md", "Root/Stuff-x.md", "Root/Stuff-x/In.md", "Root/Dup/Dup.md", "_skipped.txt"}
    assert got["Root/Dup-200002.md"] == "# Dup\n\nb200002\n\n"
    assert got["Root/Stuff-x.md"].startswith("# Stuff/x\n\n_(")
    assert got["_skipped.txt"].endswith("\n\n- Locked: HTTP 403 for /wiki/api/v2/pages/9?body-format=export_view\n")
    summary = TX.export_summary(tree).first()
    assert (summary.n_exported, summary.n_skipped, summary.n_pages, summary.percent_read, summary.bundle_name) == (6, 1, 6, 83, "Root.zip")


def test_failed_page_reserves_no_name(spark):
    rows = [CHAIN[0], ("21", "Same", "1", "page", 403, 1), ("22", "Same", "1", "page", 200, 2)]
    tree = discover(spark, rows)
    names = {r.id: r.name for r in TR.with_paths(tree.where(TR.fetched(tree))).collect()}
    assert names["22"] == "Same"


def test_responses(spark):
    pages = spark.createDataFrame([
        ("p", None, '{"results":[{"id":1,"title":"A","type":"page"},{"id":2,"title":""}],"_links":{"next":"/x?limit=2&cursor=P%202"}}'),
        ("p", "P 2", '{"results":[{"id":3,"title":"C","type":"folder"}],"_links":{"next":"/x?cursor=P3"}}'),
        ("p", "P3", '{"results":[{"id":4}]}'), ("p", "lost", '{"results":[{"id":5}]}'), ("q", None, "{}")],
        "parent_id string, cursor string, response string")
    rows = read_children_responses(follow_pages(pages), keep=("parent_id", "page_no"))
    assert [tuple(r) for r in rows.where("error IS NOT NULL").collect()] == [("q", 0, None, None, None, None, "no results in response")]
    rows = rows.where("error IS NULL")
    got = [tuple(r) for r in rows.orderBy("parent_id", "page_no", "child_no").select("page_no", "id", "title", "type").collect()]
    assert got == [(0, "1", "A", "page"), (0, "2", "Untitled", "page"), (1, "3", "C", "folder"), (2, "4", "Untitled", "page")]
    body = spark.createDataFrame([('{"id":7,"title":"","parentId":3,"body":{"export_view":{"value":"<p>x</p>"}}}',)], "response string")
    assert tuple(read_page_responses(body).first()) == ("7", "Untitled", "<p>x</p>", "3", None)
    assert read_page_responses(body.select(F.lit('{"id":7}').alias("response")), folder=True).first().title == "Untitled folder"


def test_names_taken_by_longer_ones(spark):
    rows = [CHAIN[0], ("100001", "Dup", "1", "page", 200, 1), ("200002", "Dup", "1", "page", 200, 2), ("300003", "Dup-200002", "1", "page", 200, 3),
            ("400004", "Dup-200002-300003", "1", "page", 200, 4), ("500005", "Dup-600006", "1", "page", 200, 5), ("600006", "Dup", "1", "page", 200, 6)]
    names = {r.id: r.name for r in TR.with_paths(discover(spark, rows)).collect()}
    assert names == {"1": "Root", "100001": "Dup", "200002": "Dup-200002", "300003": "Dup-200002-300003",
                     "400004": "Dup-200002-300003-400004", "500005": "Dup-600006", "600006": "Dup-600006"}


def test_one_report_however_long(spark, tmp_path):
    rows = [CHAIN[0]] + [(str(k), f"C{k}", "1", "page", 403, k) for k in range(10, 10 + 10_050)]
    tree = discover(spark, rows)
    bodies = spark.createDataFrame([("1", "Root", "<p>x</p>")], BODIES)
    entries = TX.export_tree(tree, bodies, part_bytes=100_000)
    write_files(entries, tmp_path.as_uri(), part_col="part", folder_col="root_id")
    lines = (tmp_path / "1" / "_skipped.txt").read_text().split("\n\n", 1)[1].splitlines()
    assert [x.split(":")[0] for x in lines] == [f"- C{k}" for k in range(10, 10 + 10_050)]
    assert (tmp_path / "1" / "Root.md").exists()
    with pytest.raises(ValueError):
        write_files(entries, tmp_path.as_uri())


def test_summary_with_and_without_cap(spark):
    rows = [CHAIN[0]] + [(str(k), f"C{k}", "1", "page", 403 if k % 2 else 200, k) for k in range(10, 30)]
    whole = TX.export_summary(discover(spark, rows)).first()
    assert (whole.n_exported, whole.n_skipped) == (11, 10)
    cut = TX.export_summary(discover(spark, rows, cap=5), 5).first()
    assert (cut.n_exported, cut.n_skipped) == (3, 2)


def test_repeated_responses_count_once(spark):
    rows = [("p", None, '{"results":[{"id":1}],"_links":{"next":"/x?cursor=a"}}')] * 2
    rows += [("p", "a", '{"results":[{"id":2}],"_links":{"next":"/x?cursor=b"}}')] * 3 + [("p", "b", '{"results":[{"id":3}]}')]
    got = read_children_responses(follow_pages(spark.createDataFrame(rows, "parent_id string, cursor string, response string")), keep=("page_no",))
    assert sorted((r.page_no, r.id) for r in got.collect()) == [(0, "1"), (1, "2"), (2, "3")]


def test_no_response_is_lost(spark):
    replies = [None, "", "  ", "no JSON", '{"results": [{"id": 1}', '{"results": "x"}', '{"message": "Forbidden"}', "[]", "null", '{"results": []}', '{"results": [{"id": 1}]}']
    rows = spark.createDataFrame(list(enumerate(replies)), "n int, response string")
    got = {r.n: r.error for r in read_children_responses(rows, keep=("n",)).collect()}
    empty, malformed, none = "empty response", "malformed JSON", "no results in response"
    assert got == {0: empty, 1: empty, 2: empty, 3: malformed, 4: malformed, 5: malformed, 6: none, 7: malformed, 8: malformed, 10: None}
    pages = {r.n: (r.id, r.title, r.error) for r in read_page_responses(rows).collect()}
    assert len(pages) == len(replies) and all(p[0] is None and p[1] is None and p[2] for p in pages.values())
    rejected = rejected_responses(rows, CHILDREN_SCHEMA, "results").collect()
    assert {r.n: r.response for r in rejected} == {n: replies[n] for n in range(9)}
