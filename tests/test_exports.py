import hashlib

import pytest
from pyspark.sql import functions as F

from foliomill.operators.naming import dedupe_names, number_within, totals_within
from foliomill.plans import page_exports as PX
from foliomill.plans import tree_export as TX
from foliomill.sinks.files import write_files
from foliomill.sources.tables import read_html_files, read_markdown_files
from foliomill.streaming import convert as ST


def test_names(spark):
    rows = spark.createDataFrame([(1, "a"), (5, "a"), (7, "b"), (900, "a")], "id bigint, slug string")
    assert [r.name for r in dedupe_names(rows, "slug", "id").orderBy("id").collect()] == ["a", "a-2", "b", "a-3"]


def test_numbers_of_a_large_group_match_a_window(spark):
    rows = spark.range(5000).select((F.col("id") * 37 % 100003).alias("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("g"))
    got = {r.id: r.ordinal for r in number_within(rows, ["g"], "id").collect()}
    seen, expected = {}, {}
    for r in sorted(rows.collect(), key=lambda r: r.id):
        seen[r.g] = expected[r.id] = seen.get(r.g, 0) + 1
    assert got == expected


def test_session_parts_join_to_one_document(spark):
    pages = spark.createDataFrame([(i, "http://h/x") for i in range(7)], "page_id bigint, url string")
    converted = pages.select("page_id", "url", F.lit("T").alias("title"), F.concat(F.lit("m"), "page_id").alias("markdown"))
    def text(size, n_parts):
        parts = PX.merge_sessions(pages, converted, F.lit("s"), F.lit("2025-01-05").cast("date"), part_bytes=size).orderBy("part").collect()
        assert len(parts) == n_parts and sum(p.n_pages for p in parts) == 7
        return "".join(p.content for p in parts)
    assert text(1, 7) == text(60, 3) == text(10**6, 1) == "# Research Session — January 5, 2025\n\n" + "".join(f"## [T](http://h/x)\n\nm{i}\n\n---\n\n" for i in range(7))


def test_totals_of_a_large_group_match_a_window(spark):
    rows = spark.range(3000).select((F.col("id") * 37 % 100003).alias("id"), F.when(F.col("id") % 3 == 0, "hot").alias("g"), (F.col("id") % 11).alias("size"))
    got = {r.id: (r.before, r.nth) for r in totals_within(rows.repartition(7), ["g"], "id", {"before": "size", "nth": None}).collect()}
    seen, expected = {}, {}
    for r in sorted(rows.collect(), key=lambda r: r.id):
        total, n = seen.get(r.g, (0, 0))
        expected[r.id], seen[r.g] = (total, n), (total + r.size, n + 1)
    assert got == expected


def test_a_long_skip_report_is_one_ordered_document(spark):
    tree = spark.range(10_050).select(
        F.lit("r").alias("root_id"), F.col("id").cast("string").alias("id"), F.lit(1).alias("depth"), F.array("id").alias("ord_path"),
        F.concat(F.lit("T"), "id").alias("title"), F.lit("page").alias("type"), F.lit(403).alias("status")).repartition(5)
    parts = TX.skip_report(tree, part_bytes=100_000).orderBy("part").collect()
    lines = "".join(p.content for p in parts).split("\n")
    assert len(parts) > 5 and max(len(p.content) for p in parts) < 101_000 and {p.path for p in parts} == {"_skipped.txt"}
    assert lines[1:2] == [""] and [line.split(":")[0] for line in lines[2:-1]] == [f"- T{i}" for i in range(10_050)]


def test_model_fit(spark):
    rows = spark.createDataFrame([(8192,), (200001,)], "tokens bigint")
    got = [(r.tokens, r.model, r.fits) for r in PX.model_fit(rows).collect()]
    assert got == [(8192, "gpt-4", True), (8192, "gpt-4o", True), (8192, "claude", True), (8192, "gemini", True),
                   (200001, "gpt-4", False), (200001, "gpt-4o", False), (200001, "claude", False), (200001, "gemini", True)]


def test_outcomes_keep_their_place(spark):
    rows = spark.createDataFrame([(i, "x" if i != 3 else "", "boom" if i == 4 else None) for i in range(1, 6)], "id int, markdown string, error string")
    got = PX.outcomes(rows).orderBy("id").collect()
    assert [(r.ok, r.error, r.markdown) for r in got] == [(True, None, "x")] * 2 + [(False, "no content", None), (False, "boom", None), (True, None, "x")]


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("a.md", "# A é"), ("d/b.MD", "b"), ("d/c.txt", "c"), ("p.html", "<p>x\ny</p>")], "path string, content string")
    write_files(rows, tmp_path.as_uri())
    write_files(rows, tmp_path.as_uri())
    got = {r.path.rpartition("/")[2]: r.text for r in read_markdown_files(spark, str(tmp_path)).collect()}
    assert got == {"a.md": "# A é", "b.MD": "b"}
    assert read_html_files(spark, f"{tmp_path}/p.html").first().html == "<p>x\ny</p>"
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file() and not any(x.startswith(("_", ".")) for x in p.relative_to(tmp_path).parts)) == ["a.md", "b.MD", "c.txt", "p.html"]


def test_a_failed_write_leaves_the_target_alone(spark, tmp_path):
    manifest = write_files(spark.createDataFrame([("a.md", 1, "x"), ("a.md", 0, "é"), ("b/c.md", 0, None)], "path string, n int, content string"), tmp_path.as_uri(), part_col="n")
    assert {(r.target, r.n_bytes, r.sha256) for r in manifest.collect()} == {("a.md", 3, hashlib.sha256("éx".encode()).hexdigest()), ("b/c.md", 0, hashlib.sha256(b"").hexdigest())}
    assert (tmp_path / "a.md").read_text() == "éx" and (tmp_path / "b/c.md").read_text() == ""
    bad = spark.createDataFrame([("a.md", "new"), ("z.md", "boom")], "path string, content string").repartition(1)
    with pytest.raises(Exception):
        write_files(bad.withColumn("content", F.when(F.col("path") == "z.md", F.raise_error(F.lit("no"))).otherwise(F.col("content"))), tmp_path.as_uri())
    assert (tmp_path / "a.md").read_text() == "éx" and not (tmp_path / "z.md").exists()
    with pytest.raises(ValueError):
        write_files(bad.withColumn("path", F.lit("a.md")), tmp_path.as_uri())


@pytest.fixture
def arrivals(spark, tmp_path):
    folder = tmp_path / "in"
    for k, part in enumerate(([(1, "http://h/a"), (2, "http://h/b")], [(4, "http://h/a"), (3, "http://h/a")], [(9, "http://h/b"), (8, "http://h/c")])):
        rows = spark.createDataFrame([(i, u, f"<h1>H{i}</h1><p>x</p>") for i, u in part], ST.PAGE_SCHEMA)
        rows.coalesce(1).write.parquet(f"{folder}/part={k}")
    return str(folder)


def test_streams(spark, arrivals, tmp_path):
    stream = lambda: ST.page_stream(spark, f"{arrivals}/*", max_files=1)
    ST.name_stream(stream(), f"{tmp_path}/names-out")
    names = {r.page_id: r.name for r in spark.read.parquet(f"{tmp_path}/names-out/names").collect()}
    assert names == {1: "a", 2: "b", 3: "a-2", 4: "a-3", 9: "b-2", 8: "c"}
    # Small buckets, a snapshot every second batch; a batch that comes again changes nothing.
    for k in (0, 1, 1, 2):
        batch = spark.read.schema(ST.PAGE_SCHEMA).parquet(f"{arrivals}/part={k}")
        ST.name_batch(batch, k, f"{tmp_path}/again", buckets=2, compact_every=2)
    assert {r.page_id: r.name for r in spark.read.parquet(f"{tmp_path}/again/names").collect()} == names
    ST.convert_stream(stream(), f"{tmp_path}/pages-out")
    pages = {r.page_id: r.markdown for r in spark.read.parquet(f"{tmp_path}/pages-out/pages").collect()}
    assert pages == {i: f"# H{i}\n\nx\n\n" for i in (1, 2, 3, 4, 8, 9)}


def test_stream_of_a_table_in_a_file_or_a_folder(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"http://h/{k}", f"<h1>H{k}</h1>") for k in range(4)], ST.PAGE_SCHEMA)
    rows.repartition(3).write.parquet(f"{tmp_path}/many/pages.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/parts")
    (tmp_path / "one").mkdir()
    next((tmp_path / "parts").glob("part-*")).rename(tmp_path / "one" / "pages.parquet")
    for kind in ("many", "one"):
        ST.convert_stream(ST.table_stream(spark, f"{tmp_path}/{kind}", "pages"), f"{tmp_path}/{kind}-out")
        got = spark.read.parquet(f"{tmp_path}/{kind}-out/pages").collect()
        assert sorted((r.page_id, r.markdown) for r in got) == [(k, f"# H{k}\n\n") for k in range(4)]


def test_numbers_of_null_groups_and_any_ids(spark):
    rows = spark.createDataFrame([("g", 0, "-5"), ("g", 2**60, "b"), (None, -(2**62), "a"), (None, 5, None), ("h", None, "z")], "g string, id bigint, s string")
    got = {(r.g, r.id): r.ordinal for r in number_within(rows, ["g"], "id").collect()}
    assert got == {("g", 0): 1, ("g", 2**60): 2, (None, -(2**62)): 1, (None, 5): 2, ("h", None): 1}
    assert {(r.g, r.s): r.n for r in number_within(rows, [], ["s", "id"], "n").collect()} == {
        (None, None): 1, ("g", "-5"): 2, (None, "a"): 3, ("g", "b"): 4, ("h", "z"): 5}


def test_name_collisions_are_told(spark):
    rows = spark.createDataFrame([(1, "foo"), (2, "foo"), (3, "foo-2"), (4, "bar")], "id bigint, slug string")
    assert {r.id: (r.name, r.name_collision) for r in dedupe_names(rows, "slug", "id").collect()} == {
        1: ("foo", False), 2: ("foo-2", True), 3: ("foo-2", True), 4: ("bar", False)}


def test_sessions_keep_pages_without_a_group(spark):
    pages = spark.createDataFrame([(1, "http://h/x"), (2, None), (3, "nonsense")], "page_id bigint, url string")
    converted = pages.select("page_id", F.coalesce("url", F.lit("-")).alias("url"), F.lit("T").alias("title"), F.lit("m").alias("markdown"))
    got = PX.merge_sessions(pages, converted, F.regexp_extract("url", "http://(h)", 1), F.lit("2025-01-05").cast("date")).collect()
    assert sum(r.n_pages for r in got) == 3


def test_files_that_are_not_utf8(spark, tmp_path):
    (tmp_path / "x.Md").write_bytes(b"\xef\xbb\xbfa\xffb")
    (tmp_path / "y.mdx").write_bytes(b"no")
    assert [r.text for r in read_markdown_files(spark, str(tmp_path)).collect()] == ["a�b"]
