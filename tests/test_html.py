from pyspark.sql import functions as F

from foliomill.functions.text import decode_entities
from foliomill.operators import html_structure as H
from foliomill.operators.html_blocks import structured_tokens
from foliomill.operators.html_links import page_links
from foliomill.operators.html_tokens import tokenize, with_attributes, with_text
from foliomill.operators import html_tokens
from foliomill.plans.page_markdown import convert_fragments, convert_pages, page_blocks

FRAGMENTS = [
    ("", None, ""),
    (None, None, ""),
    ("<h2>Two</h2><h3>Three</h3><h6>Six</h6>", None, "## Two\n\n### Three\n\n###### Six\n\n"),
    ("<p>Hello world</p>", None, "Hello world\n\n"),
    ("<h1>Title</h1><p>Body</p>", "Title", "# Title\n\nBody\n\n"),
    ("<h1>Different</h1><p>Body</p>", "Title", "# Title\n\n# Different\n\nBody\n\n"),
    ('<p>This is <strong>bold</strong>, <em>it</em>, <code> in`l </code>, <s>s</s>, and <a href="https://x.test">a link</a>.</p>', None,
     "This is **bold**, *it*, `in`l`, ~~s~~, and [a link](https://x.test).\n\n `in\\`l` "),
    ("<p>line1<br>line2</p>", None, "line1 \nline2\n\n"),
    ("<pre><code>const x = 1;</code></pre>", None, "```javascript\nconst x = 1;\n```\n\n"),
    ('<pre><code class="language-python">print("hi")\n\tx</code></pre>', None, '```python\nprint("hi")\n  x\n```\n\n'),
    ('<pre data-lang="Go">a < b</pre>', None, "```go\na < b\n```\n\n"),
    ("<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr><tr><th>x</th></tr></table>", None,
     "\n| A | B |\n| --- | --- |\n| 1 | 2 |\n\n"),
    ("<table></table><table><tr></tr></table>", None, ""),
    # Cells of tables inside count for every row around them; rows and cells may lack their tags.
    ("<table><tr><td>a<table><tr><td>n</td></tr></table></td><td>b</td></tr><tr><td>c</td></tr></table>", None,
     "\n| an | n | b |\n| --- | --- | --- |\n| n |\n| c |\n\n\n| n |\n| --- |\n\n"),
    ("<table><thead><tr><th>A<th>B<tbody><tr><td>1<td>2</table>", None, "\n| A | B |\n| --- | --- |\n| 1 | 2 |\n\n"),
    ("<table><td>a</td><td>b</td><tr><td>c</td></tr><td>d", None, "\n| a | b |\n| --- | --- |\n| c |\n| d |\n\n"),
    ("<table><tr><td><div>a<div>b</td><td>c</td></tr></table>", None, "\n| ab | c |\n| --- | --- |\n\n"),
    # Numbers count all children; a list nests only where it stands directly in an item.
    ("<ol><p>x</p><li>a</li><div>z</div><li>b</li></ol>", None, "2. a\n4. b\n\nx\n\n"),
    ("<ul><li>a</li><ul><li>b</li></ul><li>c</li></ul>", None, "- a\n- c\n\n- b\n\n"),
    ("<ul><li>a<div><ul><li>b<ol><li>c</ol></ul></div></li><li>d</li></ul>", None, "- abc\n- d\n\n- b\n  1. c\n\n1. c\n\n"),
    ("<ul><div><li>x</li></div><li>a<ul><li>b<ul><li>c</ul></ul>t<li>d</ul>", None, "- at\n  - b\n    - c\n- d\n\n- b\n  - c\n\n- c\n\n"),
    ("<ol><li>cut<li>off <ul><li>here", None, "1. cut\n2. off\n  - here\n\n- here\n\n"),
    ("<ul><li>One</li><li>Two</li></ul>", None, "- One\n- Two\n\n"),
    ("<ol><li>First<li>Second<li>Third</ol>", None, "1. First\n2. Second\n3. Third\n\n"),
    ("<ul><li>top<ul><li>nested</li></ul> tail</li><li>x</li></ul>", None, "- top tail\n  - nested\n- x\n\n- nested\n\n"),
    ("<ol><li>a<ul><li>b<ol><li>c</li><li>d</li></ol></li></ul></li></ol>", None,
     "1. a\n  - b\n    1. c\n    2. d\n\n- b\n  1. c\n  2. d\n\n1. c\n2. d\n\n"),
    # A paragraph inside an item counts as part of the item and on its own.
    ("<ul><li><p>in <b>item</b></p></li></ul>", None, "- in **item**\n\nin **item**\n\n"),
    # Empty pairs vanish, formatting ends with its block, a late end tag does nothing.
    ('<p><b><i></i></b>x<b>un<i>closed<p>b</i></b>c <a href="q"></a><a>n</a></p>', None, "x**un*closed***\n\nbc n\n\n"),
    ("<p>a</b><b>b</b></p>", None, "a**b**\n\n"),
    ('<p title="a>b">q &amp;amp; &#65;</p><!-- <p>no</p> --><script>var t="</p><p>s"</script>', None, "q &amp; A\n\n"),
    ("<p>  \n </p><p><code></code></p>", None, " `` "),
    ("<p>cut off <b", None, "cut off\n\n"),
    ("<p " + " ".join(f'd{i}="{i}"' for i in range(250)) + ' title="a>b">many values</p>', None, "many values\n\n"),
    ("<p>&#0000000065;&#x00000000000042; &#128;&#159; &#99999999999999;</p>", None, "AB €Ÿ \ufffd\n\n"),
]


def test_fragments(spark):
    rows = spark.createDataFrame([(i, f[0], f[1]) for i, f in enumerate(FRAGMENTS)], "id int, html string, title string")
    got = {r.id: r.markdown for r in convert_fragments(rows, "id", "html", "title").collect()}
    for i, (html, title, expected) in enumerate(FRAGMENTS):
        assert got[i] == expected, (html, title)


LONG = "word " * 30
PAGES = {
    # selector order: the article wins over the classed div around it
    "article": (f'<body><div class="content"><article><h1>T</h1><p>{LONG}</p></article></div></body>', 5, "T", f"# T\n\n{LONG.strip()}\n\n"),
    "class": (f'<body><p>out</p><div class="post-body x"><p>{LONG}</p></div></body>', 10, None, f"{LONG.strip()}\n\n"),
    "readme": (f'<body><div id="readme"><article><p>{LONG}</p></article></div></body>', 0, None, f"{LONG.strip()}\n\n"),
    "boxed": (f'<body><div class="container"><div><section><p>{LONG}a</p></section></div><section><p>{LONG}</p></section></div></body>',
              20, None, f"{LONG.strip()}\n\n"),
    # the first match of a selector is too short; the first valid section is taken
    "section": (f'<body><article><p>short</p></article><section><p>{LONG}</p></section></body>', 22, None, f"{LONG.strip()}\n\n"),
    "density": (f'<body><div><div><p>{LONG}</p><p>{LONG}</p></div><span>x</span></div></body>', 23, None, f"{LONG.strip()}\n\n" * 2),
    "body": ("<body><p>short</p></body>", 24, None, "short\n\n"),
    "no body": ("<p>short</p>", None, None, "short\n\n"),
    "chrome": (f'<body><nav><p>n</p></nav><footer><p>kept</p></footer><div role="banner"><h1>no</h1></div><div class="a sidebar"><p>s</p></div>'
               f'<p style="display: none">h</p><div style="visibility:hidden"><p>v</p></div><ul class="menu"><li>m</li></ul><h2>yes</h2></body>',
               24, None, "kept\n\n## yes\n\n"),
    "og": ('<head><meta property="og:title" content="O `g`"><title>D</title></head><body><h1>H</h1></body>', 24, "O \\`g\\`", "# O \\\\`g\\\\`\n\n# H\n\n"),
    "blank og": ('<head><meta property="og:title" content=" "><title>D</title></head><body><h1>H</h1></body>', 24, "", "# H\n\n"),
    "empty og": ('<head><meta property="og:title" content=""><meta name="twitter:title" content="Tw"></head><body><h1>H</h1></body>', 24, "Tw", "# Tw\n\n# H\n\n"),
    "doc title": ("<head><title> D\n &amp; E </title></head><body><nav><h1>n</h1></nav><p>x</p></body>", 24, "D & E", "# D & E\n\nx\n\n"),
    "empty": ("", None, None, ""),
}


def test_many_marks_and_odd_characters(spark):
    n = 10_000
    many = "<p>" + "".join(f"<b>{i}</b><i></i>" for i in range(n)) + "<em>" * 50 + "x\uFDD0y\uFDD6\uFDD7\uFDDF1"
    deep = "<p>" + "<b><i><s>" * 500 + "</s></i></b>" * 500 + "z<del><a href='q'>"
    rows = spark.createDataFrame([(1, many), (2, deep)], "id int, html string")
    got = {r.id: r.markdown for r in convert_fragments(rows, "id", "html").collect()}
    assert got[1] == "".join(f"**{i}**" for i in range(n)) + "*" * 50 + "x\uFDD0y\uFDD6\uFDD7\uFDDF1" + "*" * 50 + "\n\n"
    assert got[2] == "z\n\n"


def test_pages(spark):
    rows = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PAGES.values())], "page_id int, html string")
    got = {r.page_id: r for r in convert_pages(rows).collect()}
    ranks = {r.page_id: r.rank for r in structured_tokens(rows, "page_id", "html").where("pos <= 0").select("page_id", "container.rank").collect()}
    for i, (name, (_, rank, title, markdown)) in enumerate(PAGES.items()):
        assert ranks[i] == rank, name
        assert got[i].title == title, name
        assert got[i].markdown == markdown, name
        assert got[i].tokens == -(-len(markdown) // 4), name
    assert got[list(PAGES).index("chrome")].outline == "## yes"


def test_references(spark):
    rows = [("&AMP; &AMP &check; &copy2 &notit; &notin; &lbrack;x&rbrack; &nosuch; &ampx & &; &#65 &#x41g &#65=", "& & ✓ ©2 ¬it; ∉ [x] &nosuch; &x & &; A Ag A="),
            ("&NotEqualTilde; &fjlig; &Tab;.", "≂̸ fj \t.")]
    got = spark.createDataFrame(rows, "t string, e string").select(decode_entities("t").alias("t"), "e").collect()
    assert [r.t for r in got] == [r.e for r in got]
    page = spark.createDataFrame([(1, '<a href="?a=1&copy=2&amp;b&lt&copy;&notit;&copy" title=&AMP>x</a>')], "page_id int, html string")
    attrs = with_attributes(with_text(tokenize(page))).where("attrs IS NOT NULL").first().attrs
    assert [a.value for a in attrs] == ["?a=1&copy=2&b<©&notit;©", "&"]


def test_parents_levels_and_child_numbers(spark):
    html = "<html><body><div><p>a<p>b<b>c</b><ul><li>x<br><li>y<i>z</i></ul></div><table><tr><td>1<td>2<tr><td>3</table><p>end"
    page = H.with_totals(H.tagged_tokens(spark.createDataFrame([(1, html)], "page_id int, html string"), "page_id", "html"), "page_id")
    rows = H.with_parents(H.with_scopes(H.with_nesting(H.with_extents(page, "page_id"), "page_id"), "page_id"), "page_id")
    rows = H.with_levels(H.with_child_numbers(rows, "page_id"), "page_id").where("kind = 'open'").orderBy("pos").collect()
    got = [(r.tag, r.parent.tag, r.child_no, r.level) for r in rows]
    assert got == [("html", "", 1, 0), ("body", "html", 1, 1), ("div", "body", 1, 2), ("p", "div", 1, 3), ("p", "div", 2, 3), ("b", "p", 1, 4),
                   ("ul", "div", 3, 3), ("li", "ul", 1, 4), ("br", "li", 1, 5), ("li", "ul", 2, 4), ("i", "li", 1, 5), ("table", "body", 2, 2),
                   ("tr", "table", 1, 3), ("td", "tr", 1, 4), ("td", "tr", 2, 4), ("tr", "table", 2, 3), ("td", "tr", 1, 4), ("p", "body", 3, 2)]


def test_links(spark):
    rows = spark.createDataFrame([(1, '<p><a href="/a">A <b>b</b></a><a>none</a><a href="/e"></a><a href=\'/c?x=1&amp;y\'>C</a>')], "page_id int, html string")
    assert [tuple(r) for r in page_links(rows).select("link_no", "href", "text").orderBy("link_no").collect()] == [(1, "/a", "A b"), (2, "/c?x=1&y", "C")]


def test_one_shuffle_and_no_python(spark, sf):
    plan = convert_pages(spark.read.parquet(f"{sf}/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Join" not in plan and "Python" not in plan
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan


def test_a_deep_page_reads_like_a_flat_one(spark):
    def page(depth):
        text = "words that fill the section " * 8
        return ("<html><body>" + "<div>" * depth + f'<div class="container"><p>aside</p><section><p>{text}</p><p>{text}</p></section></div>'
                + "</div>" * depth + "</body></html>")

    rows = spark.createDataFrame([(d, "http://h/x", page(d)) for d in (3, 70, 300)], "page_id int, url string, html string")
    got = convert_pages(rows, keep=("url",)).select("markdown").distinct().collect()
    assert len(got) == 1 and "aside" not in got[0].markdown


PAGE = ("<head><title>T</title><meta property='og:title' content='O'></head><nav><p>menu</p></nav><h1>A <b>b</b></h1><p>x <i>y</i> <code>z</code></p>"
        "<pre><code class='language-c'>c</code></pre><ol><li>a<ul><li>b</ul><li>c</ol><table><tr><td>1<td>2<tr><th>3</table>")


def test_some_kinds_of_blocks_are_those_among_all(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (None, PAGE[60:])], "page_id long, html string")
    columns = ["page_id", "block", "block_pos", "tag", "md", "language", "skipped", "nested", "in_main"]
    every = page_blocks(pages).select(*columns)
    rows = sorted(map(str, every.collect()))
    windows = lambda frame: frame._jdf.queryExecution().executedPlan().toString().count("Window")
    seen = []
    for only in (("h",), ("p",), ("pre",), ("code",), ("table",), ("list",), ("page", "h", "og", "tw", "title")):
        some = page_blocks(pages, only=only, inside=False).select(*columns)
        got = sorted(map(str, some.collect()))
        assert got == [r for r in rows if any(f"block='{k}'," in r for k in only)] and windows(some) < windows(every)
        seen += got
    assert sorted(seen) == sorted(rows + [r for r in rows if "block='h'" in r])


def test_partitions_of_pages_follow_their_bytes(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "<p>x</p>")], "page_id long, html string")
    monkeypatch.setattr(html_tokens, "scanned_bytes", lambda frame: 1 << 30)
    assert html_tokens.co_locate(pages, "page_id").rdd.getNumPartitions() == 512


ODD_PAGES = [
    (1, "<p>a <b>b</b><h2>c <i>d</i></h2></table><p>e<table><tr><td>f<p>g</td><th>h<table><td>i</table></tr></table>j</h1><h1>k"),
    (2, "<div class=sidebar><p>a<li>b</div></p><h3>c<h3>d</h3>e</h3>f<pre>g <code class=language-x>h</code></pre><code>i</pre>j</code>k"),
    (3, "</table></table><table><tr><td>a</td></tr></table>b<table><tr><td>c<ul><li>d</li></ul><div></table>e</div><td>f"),
    (4, "<ul><li>a<p> b \t c .<ol><li>d</ul>e<p>f</p></ol><script>g</script><p>h<script>i</script><b></b> j</b></p><!-- k -->"),
    (5, "only text"), (6, None), (7, "<title>a</title><meta property='og:title' content='b'><main><h1>c</h1></main><h1 hidden>d"),
]


def test_blocks_of_one_kind_are_as_among_all(spark):
    pages = spark.createDataFrame(ODD_PAGES, "page_id long, html string")
    found = page_blocks(pages, whole_page=False).collect()
    for kind in ("h", "p", "code", "table"):
        alone = page_blocks(pages, whole_page=False, only=(kind,), around=()).collect()
        key = lambda r: (r.page_id, r.block_pos, r.tag, r.md)
        assert sorted(map(key, alone)) == sorted(key(r) for r in found if r.block == kind), kind


def test_queries_of_one_kind_plan_few_sorts_and_tokens(spark, sf):
    from foliomill.operators.html_blocks import structured_tokens
    from foliomill.queries import REGISTRY

    for name, most in (("inline_md", 5), ("skip_hidden", 5)):
        plan = REGISTRY[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert sum("- Sort [" in line for line in plan.splitlines()) <= most, name
    pages = spark.createDataFrame([(1, "<div><p>a <b>b</b></p><h2>c <i>d</i></h2><table><tr><td>e</td></tr></table>f</div>")], "page_id long, html string")
    kept = structured_tokens(pages, whole_page=False, only=("h",), around=()).orderBy("pos").collect()
    assert [r.text or r.tag for r in kept] == ["div", "h2", "c ", "d", "h2"]
    kept = structured_tokens(pages, whole_page=False, only=("table",), around=()).orderBy("pos").collect()
    assert [r.text for r in kept if r.text] == ["e"]


def test_white_space_is_trimmed_at_both_ends(spark):
    from foliomill.functions.constants import WS, WS_CHARACTERS
    from foliomill.functions.text import tidy_inline, trim_ws

    # Characters next to the white space of the pattern belong to neither.
    near = spark.createDataFrame([(chr(k),) for k in range(0x10000) if not 0xD800 <= k <= 0xDFFF], "c string")
    assert {r.c for r in near.where(F.col("c").rlike(f"[{WS}]")).collect()} == set(WS_CHARACTERS)
    row = spark.createDataFrame([("﻿ \t a  b\t.　c\n  ",)], "v string").select(trim_ws("v").alias("t"), tidy_inline("v").alias("i")).first()
    assert tuple(row) == ("a  b\t.　c", "a b.　c")


def test_scopes_need_one_sort_of_their_own(spark, sf):
    from foliomill.queries import REGISTRY

    html = "<div><b>a<i></b>b</i><div></div><section><u></section>c</u></div>d<b>e"
    page = H.with_totals(H.tagged_tokens(spark.createDataFrame([(1, html)], "page_id int, html string"), "page_id", "html"), "page_id")
    rows = H.with_scopes(H.with_nesting(H.with_extents(page, "page_id"), "page_id"), "page_id").orderBy("pos").collect()
    assert [(r.text or r.tag, r.scope and r.scope.pos) for r in rows] == [
        ("div", None), ("b", 0), ("a", 1), ("i", 1), ("b", 1), ("b", 1), ("i", 0), ("div", 0), ("div", 0), ("section", 0), ("u", 9), ("section", 9), ("c", 9),
        ("u", 0), ("div", None), ("d", None), ("b", None), ("e", None)]
    plan = REGISTRY["fragment_markdown"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert sum("- Sort [" in line for line in plan.splitlines()) <= 12
