"""Inputs for the operators whose shapes the given pages do not have.

Each is one expression over ``documents``, so there is one generated page, Markdown text or
tree node per document and the work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def word(n: int) -> Column:
    # Only as many words as asked for are cut off.
    found = F.regexp_replace(F.split_part(F.substring_index("text", " ", n), F.lit(" "), F.lit(n)), "[^A-Za-z]", "")
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("x"))


def with_words(documents: DataFrame) -> DataFrame:
    """The first words ``a b c``, the id ``i`` and ``t``: the letters of the whole text, as words."""
    # One class of characters: a pattern with alternatives takes several times as long on whole texts.
    letters = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", " "))
    return documents.withColumns({"a": word(1), "b": word(2), "c": word(3), "i": F.col("doc_id").cast("string"),
                                  "t": F.coalesce(F.nullif(letters, F.lit("")), F.lit("x"))})


def _fill(template: str) -> Column:
    """Replace {a} {b} {c} {i} in a template by the columns of ``with_words``."""
    parts, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(head), F.col(name)]
    return F.concat(*parts, F.lit(rest))


ARTICLE = (
    '<article><h1>{a} {b}</h1><h2>{c}</h2><p>This is <strong>{a}</strong> , <em>{b}</em>, <code>{c}</code>, <s>{a}</s> and '
    '<a href="https://x.test/{i}">{b}</a> .</p>'
    '<pre><code class="language-python">print("{a}")</code></pre><pre>SELECT {b} FROM t</pre>'
    '<table><tr><th>K</th><th>V</th></tr><tr><td>{c}</td><td>{i}</td></tr></table>'
    '<ul><li>{a}<ul><li>{b}</li></ul></li><li>{c}</li></ul><ol><li>{a}</li><li>{b}</li></ol></article>'
    '<div class="sidebar"><p>{t}</p></div>'
)
MARKDOWN = "\n".join([
    "# {a} {b}", "", "Intro **{a}** and *{b}* with `{c}` and ~~{a}~~.", "", "- {a}", "- [x] {b}", "  - {c}", "",
    "1. {a}", "2. {b}", "", "```sql", "SELECT {a}", "```", "", "| k | v |", "|:---|---:|", "| {a} | {i} |", "",
    "> {b}", "", "---", "", "[{c}](https://example.com/{i}) ![{i}](data:x) [y](javascript:z)", "",
])


# Shapes that browsers accept: other children in a list, lists in lists and in other elements, end tags left out, tables in tables.
SHAPES = (
    '<ol><p>{a}</p><li>{b}</li><div>{c}</div><li>{i}</li></ol><ul><li>{a}</li><ul><li>{b}</li></ul><li>{c}</li></ul>'
    '<ul><li>{a}<div><ol><li>{b}</li></ol></div></li></ul><ul><li>{a}<li>{b}<ol><li>{c}<li>{a}</ol></ul>'
    '<table><tr><td>{a}<table><tr><td>{b}</td><td>{c}</td></tr><tr><th>{i}</th></tr></table></td><td>{c}</td></tr><tr><td>{b}</td></tr></table>'
    '<table><tr><td>{a}<td>{b}<tr><td>{c}</table>'
)


def shapes_fixture(documents: DataFrame) -> DataFrame:
    return with_words(documents).select("doc_id", _fill(ARTICLE + SHAPES).alias("html"))


def html_fixture(documents: DataFrame) -> DataFrame:
    return with_words(documents).select("doc_id", _fill(ARTICLE).alias("html"))


HIDDEN = (
    '<p style="color: red; display : none">{a}</p><div style="visibility: hidden"><p>{b}</p></div><div style="display:none"><p>{c}</p></div>'
    '<p style="background: url(display:none)">{i}</p><p>{t}</p>'
)


def hidden_fixture(documents: DataFrame) -> DataFrame:
    return with_words(documents).select("doc_id", _fill(HIDDEN).alias("html"))


def markdown_fixture(documents: DataFrame) -> DataFrame:
    """Generated Markdown (``origin`` 1) and the documents themselves (``origin`` 0), keyed 2 * doc_id + origin."""
    made = with_words(documents).select((F.col("doc_id") * 2 + 1).alias("doc_id"), _fill(MARKDOWN).alias("text"))
    return documents.select((F.col("doc_id") * 2).alias("doc_id"), "text").unionByName(made)


def shell_fixture(documents: DataFrame) -> DataFrame:
    """Whole pages whose content sits in a main element, a classed div, an article or a plain div."""
    rows = with_words(documents)
    article = _fill(ARTICLE)
    head = F.concat(F.lit("<html><head><title>T "), "i", F.lit("</title>"))
    og = F.concat(F.lit('<meta property="og:title" content="'), "a", F.lit('">'))
    plain = F.concat(F.lit("<div><div class=\"x\"><p>"), F.repeat(F.concat("a", F.lit(" ")), F.lit(60)), F.lit("</p><p>"),
                     F.repeat(F.concat("b", F.lit(" ")), F.lit(60)), F.lit("</p></div><span>more</span></div>"))
    kind = F.col("doc_id") % 4
    body = (F.when(kind == 0, F.concat(F.lit("<main>"), article, F.lit("</main>")))
            .when(kind == 1, F.concat(F.lit('<div class="post-content">'), article, F.lit("</div>")))
            .when(kind == 2, article).otherwise(plain))
    return rows.select("doc_id", F.concat(
        head, F.when(kind == 2, og).otherwise(""), F.lit("</head><body>"), body, F.lit("</body></html>")).alias("html"))


def tree_fixture(documents: DataFrame) -> DataFrame:
    d = F.col("doc_id")
    return documents.select(
        d.cast("string").alias("id"), F.concat("lang", F.lit(" / Part: "), (d % 2).cast("string")).alias("title"),
        F.when(d > 0, F.floor((d - 1) / 5).cast("string")).alias("parent_id"),
        F.when(d == 0, "page").when(d % 11 == 3, "folder").when(d % 17 == 5, "whiteboard").otherwise("page").alias("type"),
        F.when(d % 13 == 7, 403).otherwise(200).alias("status"), d.alias("ord"))


def body_fixture(documents: DataFrame) -> DataFrame:
    rows = with_words(documents)
    return rows.select(F.col("doc_id").cast("string").alias("id"),
                       F.concat("lang", F.lit(" / Part: "), (F.col("doc_id") % 2).cast("string")).alias("title"),
                       _fill(ARTICLE).alias("html_body"))


def children_responses(documents: DataFrame) -> DataFrame:
    """Children of each node, two to a response, with the cursor of the next response."""
    nodes = tree_fixture(documents).where("parent_id IS NOT NULL")
    pos = ((F.col("ord") - 1) % 5).cast("int")
    nodes = nodes.withColumns({"_pos": pos, "_page": F.floor(pos / 2).cast("int")})
    listed = nodes.groupBy("parent_id", "_page").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "title", "type"))).alias("_c"))
    # The last response of a node is known from the number of documents, one row.
    total = documents.agg(F.max("doc_id").alias("_max"))
    listed = listed.join(F.broadcast(total))
    last_child = F.least(F.col("_max"), F.col("parent_id").cast("bigint") * 5 + 5)
    more = (F.col("parent_id").cast("bigint") * 5 + 1 + (F.col("_page") + 1) * 2) <= last_child
    link = F.when(more, F.concat(F.lit("/x?limit=2&cursor="), (F.col("_page") + 1).cast("string")))
    body = F.to_json(F.struct(
        F.transform("_c", lambda c: F.struct(c["id"].cast("bigint").alias("id"), c["title"].alias("title"), c["type"].alias("type"))).alias("results"),
        F.struct(link.alias("next")).alias("_links")))
    return listed.select("parent_id", F.when(F.col("_page") > 0, F.col("_page").cast("string")).alias("cursor"), body.alias("response"))


def page_responses(documents: DataFrame) -> DataFrame:
    rows = with_words(documents)
    d = F.col("doc_id")
    body = F.to_json(F.struct(
        d.alias("id"), F.when(d % 7 == 0, "").otherwise(F.concat("lang", F.lit(" page "), "i")).alias("title"),
        F.when(d > 0, F.floor((d - 1) / 5)).alias("parentId"),
        F.struct(F.struct(F.when(d % 5 != 1, F.concat(F.lit("<p>"), "t", F.lit("</p>"))).alias("value")).alias("export_view")).alias("body")))
    return rows.select("doc_id", body.alias("response"))


def broken(responses: DataFrame, number: Column) -> DataFrame:
    """Responses of which three in nine, by ``number``, are cut off, missing, or hold a message instead."""
    half = F.expr("substring(response, 1, cast(length(response) / 2 AS int))")
    body = F.when(number % 9 == 4, half).when(number % 9 == 6, F.lit(None)).when(number % 9 == 8, '{"message": "Forbidden"}').otherwise(F.col("response"))
    return responses.withColumn("response", body)


def paths_fixture(documents: DataFrame) -> DataFrame:
    endings = F.array(*[F.lit(e) for e in (".md", ".MD", ".markdown", ".mdown", ".mkd", ".html")])
    return documents.select("doc_id", F.concat(
        F.lit("file:///docs/"), F.col("doc_id").cast("string"), F.element_at(endings, (F.col("doc_id") % 6 + 1).cast("int"))).alias("path"))
