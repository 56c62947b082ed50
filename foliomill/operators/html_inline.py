"""Inline HTML to Markdown pieces.

A piece is the text or mark of one token behind its position, ten digits wide, so pieces of a block sort by
themselves and each is unlike any other. Marks are told from text by being pieces of their own: which pairs are left
open, or have nothing in between, is a question of sets of pieces and of how much output there was before a tag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.functions.constants import INLINE_MARKS, WS

# Code is trimmed once it is put together: its marks are noncharacters until then, which the text has escaped.
CODE_BEGIN, CODE_END, ESCAPE = "﷖", "﷗", "﷟"
ESCAPED = {ESCAPE: ESCAPE + "0", CODE_BEGIN: ESCAPE + "1", CODE_END: ESCAPE + "2"}
MARKS = INLINE_MARKS | {"code": CODE_END}
WIDTH = 10


def _place(pos: Column) -> Column:
    return F.lpad(pos.cast("string"), WIDTH, "0")


def _has_any(value: Column) -> Column:
    """Whether a text holds one of the ``ESCAPED``: next to none does, and a search for bytes costs less than a pattern."""
    return F.contains(value, F.lit(ESCAPE)) | F.contains(value, F.lit(CODE_BEGIN)) | F.contains(value, F.lit(CODE_END))


def _escape(value: Column) -> Column:
    out = value
    for char, text in ESCAPED.items():
        out = F.replace(out, F.lit(char), F.lit(text))
    return F.when(_has_any(value), out).otherwise(value)


def _end_mark(tag: Column, href: Column) -> Column:
    out = F.when((tag == "a") & (F.coalesce(href, F.lit("")) != ""), F.concat(F.lit("]("), _escape(href), F.lit(")")))
    for name, mark in MARKS.items():
        out = out.when(tag == name, mark)
    return out


def _begin_mark(end: Column) -> Column:
    """The mark that goes with an end mark."""
    return F.when(end == CODE_END, CODE_BEGIN).when(end.startswith("]("), "[").otherwise(end)


def with_fragments(rows: DataFrame) -> DataFrame:
    """Add the inline ``piece`` of each token, without one NULL.

    ``opened`` stands for a start tag that needs an end mark, ``closed`` for the one that an end tag closes, in the same
    form: position, output before it, end mark. ``dropped`` holds both pieces of a pair without content. Start
    tags from before the innermost open paragraph or list item do not count: formatting ends with its block.
    """
    block = F.coalesce(F.greatest("cur_p", "cur_li"), F.lit(-1))
    tag, opening, closing = F.col("tag"), F.col("kind") == "open", F.col("kind") == "close"
    in_code = F.col("cur_code") >= block
    rows = rows.withColumn("_code", F.coalesce(in_code & (tag != "code"), in_code, F.lit(False)))
    markable = tag.isin(*MARKS, "a") & ~F.col("_code")
    begun = F.when(opening & markable, _end_mark(tag, F.col("info")))
    ended = F.when(closing & markable & (F.col("opener.pos") >= block), _end_mark(tag, F.col("opener.info")))
    before = F.col("opener.at.n_out")
    text = F.when(F.col("_code"), F.col("text")).otherwise(F.replace(F.col("text"), F.lit("`"), F.lit("\\`")))
    rows = rows.withColumns({"_begun": begun, "_ended": ended})
    rows = rows.withColumn("_mark", F.when(F.col("_begun").isNotNull(), _begin_mark(F.col("_begun"))).otherwise(F.col("_ended")))
    fragment = (F.when(F.col("text") != "", _escape(text)).when(opening & (tag == "br") & ~F.col("_code"), "  \n").otherwise(F.col("_mark")))
    empty = F.col("_ended").isNotNull() & (tag != "code") & (before == F.col("at.n_out"))
    return rows.withColumns({
        "piece": F.concat(_place(F.col("pos")), fragment),
        "opened": F.concat(_place(F.col("pos")), _place(F.col("at.n_out")), "_begun"),
        "closed": F.concat(_place(F.col("opener.pos")), _place(before), "_ended"),
        "dropped": F.when(empty, F.array(F.concat(_place(F.col("opener.pos")), _begin_mark(F.col("_ended"))), F.concat(_place(F.col("pos")), "_ended"))),
    }).drop("_code", "_begun", "_ended", "_mark")


def finish_inline(pieces: str, opened: str, left: str, dropped: str, n_out: str) -> Column:
    """The Markdown of a block from what its tokens gave, ``left`` being the tags still open and ``n_out`` the output up to its end.

    Formatting still open at the end of the block is closed there, the innermost first; pairs without
    content vanish. Each mark is looked up in a set, so the work grows with the marks, not their square.
    """
    def end_of(o: Column) -> Column:
        return F.substring(o, 2 * WIDTH + 1, F.length(o))

    def is_empty(o: Column) -> Column:
        return (F.substring(o, WIDTH + 1, WIDTH).cast("int") == F.col(n_out)) & (end_of(o) != CODE_END)

    unused = F.transform(F.filter(left, is_empty), lambda o: F.concat(F.substring(o, 1, WIDTH), _begin_mark(end_of(o))))
    some = F.size(opened) > 0
    kept = F.when(some, F.array_except(F.array_sort(pieces), F.concat(F.flatten(dropped), unused))).otherwise(F.array_sort(pieces))
    tail = F.transform(F.filter(F.reverse(F.array_sort(left)), lambda o: ~is_empty(o)), end_of)
    body = F.array_join(F.transform(kept, lambda p: F.substring(p, WIDTH + 1, F.length(p))), "")
    return F.when(some, F.concat(body, F.array_join(tail, ""))).otherwise(body)


def plain_marks(value: Column) -> Column:
    """Trim code, write its marks as backticks and undo the escapes."""
    out = F.regexp_replace(F.regexp_replace(value, F.lit(rf"{CODE_BEGIN}[{WS}]+"), F.lit(CODE_BEGIN)), F.lit(rf"[{WS}]+{CODE_END}"), F.lit(CODE_END))
    for mark in (CODE_BEGIN, CODE_END):
        out = F.replace(out, F.lit(mark), F.lit("`"))
    for char, text in reversed(ESCAPED.items()):
        out = F.replace(out, F.lit(text), F.lit(char))
    return F.when(_has_any(value), out).otherwise(value)
