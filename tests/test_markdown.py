from pyspark.sql import functions as F

from foliomill.operators.markdown_blocks import _open_level, cut_blocks, markdown_blocks, normalize_lines
from foliomill.plans.markdown_html import markdown_to_html

CASES = [
    ("# Hello World", '<h1 id="hello-world">Hello World</h1>\n'), ("###### Deep", '<h6 id="deep">Deep</h6>\n'),
    ("## A `code` title ##", '<h2 id="a-code-title">A <code>code</code> title</h2>\n'), ("####### nope", "<p>####### nope</p>\n"),
    ("first para\n\nsecond para", "<p>first para</p>\n<p>second para</p>\n"),
    ("**bold** *ital* ~~gone~~ `x=1`", "<p><strong>bold</strong> <em>ital</em> <del>gone</del> <code>x=1</code></p>\n"),
    ("__bold__ and _ital_", "<p><strong>bold</strong> and <em>ital</em></p>\n"), ("`**not bold**`", "<p><code>**not bold**</code></p>\n"),
    ("``a ` b``", "<p><code>a ` b</code></p>\n"), ("**a `x` b**", "<p>**a <code>x</code> b**</p>\n"),
    ('[site](https://x.dev) ![pic](img.png "t")', '<p><a href="https://x.dev">site</a> <img src="img.png" alt="pic" title="t"></p>\n'),
    ("see <https://example.com/a?b&c>", '<p>see <a href="https://example.com/a?b&amp;c">https://example.com/a?b&amp;c</a></p>\n'),
    ("line one  \nline two", "<p>line one<br>\nline two</p>\n"), ("a * b * c", "<p>a * b * c</p>\n"),
    ("<script>alert(1)</script>\n\n<img src=x>", "<p>&lt;script&gt;alert(1)&lt;/script&gt;</p>\n<p>&lt;img src=x&gt;</p>\n"),
    ("[x](javascript:alert) ![x](data:text/html;base64,xxx) [y](java\x01script:z)", '<p><a href="#">x</a> <img src="#" alt="x"> <a href="#">y</a></p>\n'),
    ("```js\nconst a = 1 < 2;\n**not bold**\n```", '<pre><code class="language-js">const a = 1 &lt; 2;\n**not bold**\n</code></pre>\n'),
    ("~~~\nplain\n~~~", "<pre><code>plain\n</code></pre>\n"), ("```\nline1\nline2", "<pre><code>line1\nline2\n</code></pre>\n"),
    # The two kinds of fence do not close each other.
    ("```\n~~~\n```\n~~~\n```\n~~~", "<pre><code>~~~\n</code></pre>\n<pre><code>```\n</code></pre>\n"),
    ("> outer\n> > inner", "<blockquote>\n<p>outer</p>\n<blockquote>\n<p>inner</p>\n</blockquote>\n</blockquote>\n"),
    (">a\nlazy\n- b\n\nx", "<blockquote>\n<p>a\nlazy</p>\n<ul>\n<li>b</li>\n</ul>\n</blockquote>\n<p>x</p>\n"),
    (">\nnot lazy", "<blockquote>\n</blockquote>\n<p>not lazy</p>\n"),
    (">>a\n- b", "<blockquote>\n<blockquote>\n<p>a</p>\n<ul>\n<li>b</li>\n</ul>\n</blockquote>\n</blockquote>\n"),
    ("> ```\n> code\n> ```\n> # h", '<blockquote>\n<pre><code>code\n</code></pre>\n<h1 id="h">h</h1>\n</blockquote>\n'),
    ("- one\n- two", "<ul>\n<li>one</li>\n<li>two</li>\n</ul>\n"), ("1. a\n2) b", "<ol>\n<li>a</li>\n<li>b</li>\n</ol>\n"),
    ("- parent\n  - child\n- sibling", "<ul>\n<li>parent<ul>\n<li>child</li>\n</ul>\n</li>\n<li>sibling</li>\n</ul>\n"),
    ("- a\n      - b\n   1. c\n- d", "<ul>\n<li>a<ul>\n<li>b</li>\n</ul>\n<ol>\n<li>c</li>\n</ol>\n</li>\n<li>d</li>\n</ul>\n"),
    ("    - x\n  - y\n\n- z", "<ul>\n<li>x</li>\n</ul>\n<ul>\n<li>y</li>\n</ul>\n<ul>\n<li>z</li>\n</ul>\n"),
    ("- [ ] todo\n- [x] done", '<ul>\n<li class="task"><input type="checkbox" disabled> todo</li>\n<li class="task"><input type="checkbox" disabled checked> done</li>\n</ul>\n'),
    ("- item\n\nparagraph after", "<ul>\n<li>item</li>\n</ul>\n<p>paragraph after</p>\n"), ("- a\n\n\n- b", "<ul>\n<li>a</li>\n</ul>\n<ul>\n<li>b</li>\n</ul>\n"),
    ("| Name | Age |\n|:-----|----:|\n| Ann  | 30  |\n| x |",
     '<table>\n<thead>\n<tr><th style="text-align:left">Name</th><th style="text-align:right">Age</th></tr>\n</thead>\n<tbody>\n'
     '<tr><td style="text-align:left">Ann</td><td style="text-align:right">30</td></tr>\n'
     '<tr><td style="text-align:left">x</td><td style="text-align:right"></td></tr>\n</tbody>\n</table>\n'),
    ("| a |\n|---|\n| x \\| y |", "<table>\n<thead>\n<tr><th>a</th></tr>\n</thead>\n<tbody>\n<tr><td>x | y</td></tr>\n</tbody>\n</table>\n"),
    ("a | b\nc | d", "<p>a | b\nc | d</p>\n"), ("a|b\n|--|--|", "<p>a|b\n|--|--|</p>\n"), ("text\n---", "<p>text\n---</p>\n"),
    ("---", "<hr>\n"), ("* * *", "<hr>\n"), ("___", "<hr>\n"), ("--", "<p>--</p>\n"),
    ("", ""), (None, ""), ("# A\r\n\r\ntext\r\n", '<h1 id="a">A</h1>\n<p>text</p>\n'),
]


def test_documents(spark):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "id int, text string")
    got = {r.id: r.html for r in markdown_to_html(rows).collect()}
    for i, (text, expected) in enumerate(CASES):
        assert got[i] == expected, text


def test_deep_and_long_documents(spark):
    texts = [">" * 5000 + " x", "\n".join("  " * d + f"- item{d}" for d in range(300)), "\n".join(f"- i{d}" for d in range(20000)),
             "\n".join(f"line {d}" for d in range(20000)), "| a |\n|---|\n" + "| x |\n" * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(5)
    got = {r.id: r.html for r in markdown_to_html(rows).collect()}
    assert got[0].count("<blockquote>") == 100 and "<p>&gt;" in got[0]
    assert "item299" in got[1] and got[1].count("<ul>") == got[1].count("</ul>") == 101
    assert got[2].count("<li>") == 20000 and got[3].count("\n") == 20000 and got[4].count("<td>") == 3000
    assert not any("<script" in h for h in got.values())


def test_nothing_is_shuffled(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for frame in (markdown_to_html(docs), markdown_blocks(docs)):
        assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()


def test_equal_marks_are_opened_many_at_once(spark):
    docs = [(1, ">" * 20 + " a\n" + "> " * 20 + "b"), (2, ">" * 8 + "a\n>>b"), (3, ">" * 9 + "a\u2028>b"), (4, ">" * 103 + " a")]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    one = F.array_max(F.transform(_open_level(cut_blocks(normalize_lines("text"), F.lit(0))), lambda b: b["depth"]))
    assert {r.doc_id: r.d for r in rows.select("doc_id", one.alias("d")).collect()} == {1: 8, 2: 1, 3: 1, 4: 8}
    html = {r.doc_id: r.html for r in markdown_to_html(rows).collect()}
    quotes = lambda n, inner: "<blockquote>\n" * n + inner + "</blockquote>\n" * n
    assert html[1] == quotes(20, "<p>a\nb</p>\n") and html[4].count("<blockquote>") == 100 == html[4].count("</blockquote>")
