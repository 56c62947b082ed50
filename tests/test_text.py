import pytest
from pyspark.sql import functions as F

from foliomill.functions import text as T


def apply(spark, fn, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in rows.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]


def check(spark, fn, cases):
    got = apply(spark, fn, [c[0] for c in cases])
    assert got == [c[1] for c in cases]


def test_sanitize_title(spark):
    check(spark, T.sanitize_title, [
        ("Hello / World", "Hello - World"), ("My:Title*?", "My-Title--"), ('Quoted "thing"', "Quoted -thing-"),
        ("  many   spaces  ", "many spaces"), ("", "untitled"), ("   ", "untitled"), (None, "untitled"),
        ("a" * 200, "a" * 80), ("end. . ", "end"), ("😀" * 60, "😀" * 40), ("x" + "😀" * 60, "x" + "😀" * 39)])


def test_clean_text(spark):
    check(spark, T.clean_text, [
        ("  hello   world  ", "hello world"), ("a `b` c", "a \\`b\\` c"), ("Hello , world !", "Hello, world!"),
        ("\u00a0a\u2003\n\ufeffb\u3000", "a b"), (None, "")])


def test_tokens_count_utf16_units(spark):
    check(spark, T.estimate_tokens, [("", 0), ("a", 1), ("abcd", 1), ("abcde", 2), ("a😀b", 1), ("a😀bcd", 2)])


def test_entities_in_one_pass(spark):
    check(spark, T.decode_entities, [
        ("&amp;lt;", "&lt;"), ("a &lt;b&gt; &quot;&apos;", "a <b> \"'"), ("&#65;&#x1F600;&#0;", "A😀\ufffd"),
        ("&unknown; & &", "&unknown; & &"), ("&eacute;", "é"), ("plain", "plain")])


def test_slugify_url(spark):
    check(spark, T.slugify_url, [
        ("https://h.example.com/a/My%20Page.html?x=1", "my-page"), ("https://example.com/", "example"), ("not a url", "page"),
        ("https://example.com/%E0%A4%A", "page"), ("https://e.com/a+b/", "a-b"), ("https://e.com/" + "x" * 34 + "--y", "x" * 34),
        ("https://Example.COM/a/b/---", "example.com"), (None, "page"), ("http://", "page")])
    assert apply(spark, T.sanitize_file_name, ["not a url"]) == ["page-content"]


def test_escape_and_safe_url(spark):
    check(spark, T.escape_html, [('<a href="x" & y>', "&lt;a href=&quot;x&quot; &amp; y&gt;"), (None, "")])
    check(spark, T.safe_url, [
        ("https://a.b", "https://a.b"), ("./rel/path.md", "./rel/path.md"), ("other.md", "other.md"), ("#anchor", "#anchor"),
        ("vbscript:x", "#"), ("java\tscript:alert(1)", "#"), ("java\nscript:alert(1)", "#"), ("\x01javascript:alert(1)", "#"),
        ("mailto:a@b", "mailto:a@b"), ("DATA:x", "#")])


def test_wiki_urls(spark):
    got = apply(spark, T.parse_wiki_url, [
        "https://acme.atlassian.net/wiki/spaces/ENG/pages/12345/Some-Title", "https://acme.atlassian.net/wiki/spaces/ENG/folder/999/Stuff",
        "https://example.com/wiki/spaces/X/pages/1", "https://acme.atlassian.net/browse/JIRA-1",
        "https://acme.atlassian.net/wiki/spaces/X/whiteboard/123", "", "not a url", None])
    assert tuple(got[0]) == ("https://acme.atlassian.net", "acme", "page", "12345")
    assert tuple(got[1]) == ("https://acme.atlassian.net", "acme", "folder", "999")
    assert got[2:] == [None] * 6


def test_depth_settings(spark):
    check(spark, T.normalize_depth, [("all", None), ("0", 0), ("1", 1), (" 7px", 7), ("-3", 0), ("x", 0), (None, 0)])


def test_markdown_title(spark):
    rows = spark.createDataFrame([("a\n#  My Title ##\n# two", "x.md"), ("no heading", "file:///d/My%20Doc.md"), ("## two", "/")], "t string, p string")
    got = [r[0] for r in rows.select(T.markdown_title("t", "p")).collect()]
    assert got == ["My Title", "My Doc.md", "markdown"]


@pytest.mark.parametrize("mode,expected", [
    ("md", "# \"x\"\n"),
    ("json", '{\n  "url": "u",\n  "title": "t",\n  "markdown": "# \\"x\\"\\n",\n  "tokens": 2,\n  "timestamp": "T"\n}'),
    ("xml", "<document>\n<source>u</source>\n<document_content>\n# \"x\"\n\n</document_content>\n</document>")])
def test_render_output(spark, mode, expected):
    rows = spark.createDataFrame([(mode, "u", "t", '# "x"\n')], "mode string, url string, title string, md string")
    assert rows.select(T.render_output("mode", "url", "title", "md", "T")).first()[0] == expected


def test_letters_of_whole_texts_are_found_by_one_class(spark):
    from foliomill.fixtures import with_words

    cases = [("a b", "a b"), ("a  b", "a b"), (" a,b.\n c 1 d ", "a b c d"), ("é a é", "a"), ("1 ", "x"), ("", "x"), (None, "x"), ("\ta\t", "a")]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id int, text string")
    rows = with_words(docs)
    assert [r.t for r in rows.orderBy("doc_id").collect()] == [t for _, t in cases]
    # Alternatives made the matcher about six times slower, on every character of the documents.
    assert "|" not in rows.select("t")._jdf.queryExecution().optimizedPlan().toString()
    assert "|" not in T.tidy_inline(F.col("text"))._jc.toString()
