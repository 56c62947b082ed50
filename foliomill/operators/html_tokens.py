"""HTML text to a token table: one row per tag, text run or raw element."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.functions.text import decode_entities

# Script, style, title and textarea hold text in which tags do not count, so each is one token.
RAW_TAGS = ["script", "style", "title", "textarea"]
_RAW = "|".join(rf"<{t}\b.*?(?:</{t}\s*>|\z)" for t in RAW_TAGS)
# A quoted attribute value may hold ">", and a tag any number of values: every repeat of one character class is
# possessive, and the outer one too, so the matcher needs no stack. A tag with an open quote ends at the first ">".
_TAG = r"""</?[a-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|</?[a-z][^>]*+>"""
TOKEN_PATTERN = rf"(?is)<!--.*?(?:-->|\z)|{_RAW}|<[!?][^>]*>?|{_TAG}|</?[a-z][^<>]*\z|[^<]+|<"
ATTRIBUTE_PATTERN = r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""

VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]


# Stored bytes per shuffle partition. Tokens with their facts take several hundred times the room of a compressed page.
PARTITION_BYTES = 2 * 1024 * 1024
# The JVM compiles no method of more bytes, and what it interprets takes several times as long.
METHOD_BYTES = 8000


def scanned_bytes(frame: DataFrame) -> int:
    """Size of the stored tables that a frame reads.

    Only scans count: the size that a plan guesses for a checkpointed join can be far off.
    """
    leaves = frame._jdf.queryExecution().optimizedPlan().collectLeaves()
    scans = [leaves.apply(k) for k in range(leaves.size())]
    return sum(int(str(leaf.stats().sizeInBytes())) for leaf in scans if "Relation" in leaf.getClass().getSimpleName()
               and leaf.getClass().getSimpleName() != "LocalRelation")


def co_locate(pages: DataFrame, id_col: str, partitions: int | None = None) -> DataFrame:
    """Hash-partition whole pages by their id, once.

    Every later window and aggregate is keyed by the id first, so this is the only shuffle of
    a conversion, and it moves pages before they are split into tokens. The number of
    partitions follows the size of the input and is fixed: merging partitions by their size
    before the split would leave too few tasks for the work after it.

    The conversion projects so many columns that whole stages get methods which are never compiled; the session is
    told to cut up those.
    """
    pages.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", str(METHOD_BYTES))
    if partitions is None:
        least = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        partitions = max(least, -(-scanned_bytes(pages) // PARTITION_BYTES))
    return pages.repartition(partitions, id_col)


def tokenize(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``id_col, *keep, pos, tok, kind, tag``; ``kind`` is one of text, open, close, raw, comment.

    A page without any text keeps one empty row at position -1.
    """
    tokens = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(TOKEN_PATTERN), F.lit(0))
    rows = pages.select(id_col, *keep, F.posexplode_outer(tokens).alias("_pos", "_tok"))
    rows = rows.select(id_col, *keep, F.coalesce("_pos", F.lit(-1)).alias("pos"), F.coalesce("_tok", F.lit("")).alias("tok"))
    name = F.lower(F.regexp_extract("tok", r"^</?([a-zA-Z][^\s/>]*)", 1))
    is_markup = F.col("tok").startswith("<") & (F.col("tok") != "<")
    rows = rows.withColumn("tag", F.when(is_markup, F.nullif(name, F.lit(""))))
    second = F.substring("tok", 2, 1)
    kind = (
        F.when(~is_markup, "text")
        .when(F.col("tag").isNull(), "comment")
        .when((second != "/") & F.col("tag").isin(RAW_TAGS), "raw")
        .when(~F.col("tok").endswith(">"), "comment")
        .when(second == "/", "close")
        .otherwise("open")
    )
    return rows.withColumn("kind", kind)


def raw_inner(tok: Column) -> Column:
    """Content of a raw element token, without its tags."""
    return F.regexp_replace(tok, F.lit(r"(?is)^<[a-z]+\b[^>]*>?|</[a-z]+\s*>\z"), F.lit(""))


def with_text(tokens: DataFrame) -> DataFrame:
    """Add ``text``: character data of text and raw tokens with references decoded, else NULL."""
    inner = raw_inner(F.col("tok"))
    is_raw = F.col("kind") == "raw"
    coded = F.when(F.col("kind") == "text", F.col("tok")).when(is_raw & ~F.col("tag").isin("script", "style"), inner)
    return tokens.withColumn("text", F.when(is_raw & F.col("tag").isin("script", "style"), inner).otherwise(decode_entities(coded)))


def with_attributes(tokens: DataFrame) -> DataFrame:
    """Add ``attrs``: ARRAY<STRUCT<name, value>> in source order, NULL for a tag that has none.

    The whole tag is read from left to right, so text inside a quoted value is never taken
    for an attribute.
    """
    body = F.regexp_replace("tok", r"^<[a-zA-Z][^\s/>]*|/?>\z", "")
    found = F.regexp_extract_all(body, F.lit(ATTRIBUTE_PATTERN), F.lit(0))

    def pair(item: Column) -> Column:
        value = F.regexp_extract(item, r"(?s)=\s*(.*)\z", 1)
        quoted = value.rlike(r"""(?s)^".*"\z|^'.*'\z""")
        bare = F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
        return F.struct(F.lower(F.regexp_extract(item, r"^[^\s=]+", 0)).alias("name"),
                        decode_entities(bare, in_attribute=True).alias("value"))

    has_any = (F.col("kind") == "open") & F.col("tok").rlike(r"^<[^\s>]+[\s/]+[^\s/>]")
    return tokens.withColumn("attrs", F.when(has_any, F.transform(found, pair)))


def attribute(name: str) -> Column:
    """Value of the first attribute of that name; NULL when it is absent."""
    return F.try_element_at(F.filter("attrs", lambda a: a["name"] == name), F.lit(1))["value"]
