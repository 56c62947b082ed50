"""Repair of the structure of conversations: turns are aligned to the alternating grammar ``(s?(ua)+)?`` at least cost.

The grammar's string of a given length and first letter is fixed, and a prefix of every longer one. So one Wagner-Fischer
table of the turns against such a string holds the costs of all feasible lengths, one a column. Cells further off the
diagonal than an incumbent (a repair read off turn by turn) can pay for are not filled: Ukkonen's band, whose sides follow from what an
insertion and a deletion cost. Of equal costs the audit that comes first stands, the one read by a trace back from the cell.

A long conversation is aligned in segments. A segment is aligned from each state that the turns before can have reached (nothing
kept, last letter s, u or a); the cheapest repairs to each state are carried on, with the SHA-256 of the text so far.
"""

from __future__ import annotations

import hashlib
import os.path
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill.llm.words import slices

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
WHITE = " \t\n\x0b\f\r"
SEGMENT = 32
NOTHING = ""


def target(first: str, length: int) -> str:
    """The grammar's string of this length from ``first`` on: ``s`` is followed by ``u``, then u and a take turns."""
    pair = "au" if first == "a" else "ua"
    lead, rest = ("s", length - 1) if first == "s" else ("", length)
    return (lead + pair * (rest // 2 + 1))[:length]


def incumbent(turns: str, first: str) -> int | None:
    """The cost of a repair that begins with ``first``, read off turn by turn: faulty ones go, others are kept or given the next role."""
    cost, made, due = 0, 0, first
    for t in turns:
        fits = t.lower() == due
        if due == "s":
            cost += (TRUNCATED if t == "S" else 0) if fits else DELETE
        elif t.isupper() or t == "x":
            cost, fits = cost + DELETE, False
        else:
            cost, fits = cost + (0 if fits else REROLE), True
        if fits:
            made, due = made + 1, "a" if due == "u" else "u"
    if not made:
        return None if first == "s" else cost + INSERT
    return cost


def align(turns: str, first: str) -> dict[str, tuple[int, str]]:
    """The cheapest ``(cost, audit)`` by last letter, of aligning all turns with a string of one letter or more from ``first`` on.

    A turn is its role's initial (``o``: any other), in upper case if its text is cut off; ``x`` is one that must go.
    """
    n, bound = len(turns), incumbent(turns, first)
    if bound is None:
        return {}
    # One more insertion reaches the other last letter; "s" alone drops all turns but one.
    bound = max(bound + 2 * INSERT, DELETE * (n - 1) + TRUNCATED) if first == "s" else bound + INSERT
    below, above = bound // DELETE, bound // INSERT
    letters = target(first, n + above)
    row: dict[int, tuple[int, str]] = {}
    for i in range(n + 1):
        last, row = row, {}
        t = turns[i - 1] if i else ""
        extra = TRUNCATED if t.isupper() else 0
        for j in range(max(0, i - below), min(len(letters), i + above) + 1):
            best = (0, "") if i == j == 0 else None
            if i and j in last:
                best = (last[j][0] + DELETE, last[j][1] + "D")
            if j and letters[j - 1] != "s" and j - 1 in row:
                best = min(best or (bound + 1, ""), (row[j - 1][0] + INSERT, row[j - 1][1] + "I"))
            if i and j and j - 1 in last and t != "x":
                cost, audit = last[j - 1]
                if t.lower() == letters[j - 1]:
                    best = min(best or (bound + 1, ""), (cost + extra, audit + "K"))
                elif letters[j - 1] != "s":
                    best = min(best or (bound + 1, ""), (cost + extra + REROLE, audit + "R"))
            if best is not None and best[0] <= bound:
                row[j] = best
    found: dict[str, tuple[int, str]] = {}
    for j, cell in row.items():
        if j:
            found[letters[j - 1]] = min(found.get(letters[j - 1], cell), cell)
    return found


@lru_cache(maxsize=1 << 14)
def repairs(turns: str, opening: bool) -> list[tuple[str, str, int, str]]:
    """``(state before, state after, cost, audit)`` of a segment; only the state of nothing kept comes before the first one."""
    befores = (NOTHING,) if opening else (NOTHING, "s", "u", "a")
    by_first = {first: align(turns, first) for first in ("su" if opening else "sua")}
    out = []
    for before in befores:
        found = {before: (DELETE * len(turns), "D" * len(turns))}
        for first in {NOTHING: "su", "s": "u", "u": "a", "a": "u"}[before]:
            for after, cell in by_first[first].items():
                found[after] = min(found.get(after, cell), cell)
        out += [(before, after, *cell) for after, cell in found.items()]
    return out


class Conversation:
    """One conversation as its turns pass by, in order: faults, gaps, and the cheapest repair to each state."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.low = self.high = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.last = None  # (turn, role, text)
        self.segment: list[tuple[str, str, str]] = []
        self.settled: list[str] = []
        # By state: cost, audit since what is settled, SHA-256 of the lines so far, whether there is one.
        self.reached = {NOTHING: (0, "", hashlib.sha256(), False)}
        self.opening = True

    def add(self, turn, role: str, text: str, blank: bool, again: bool, cut: bool) -> None:
        if turn is not None:
            self.turns += self.high is None or turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        initial = role[:1]
        if self.last is not None:
            self.illegal += self.last[1][:1] + initial not in LEGAL
        self.last = (turn, role, text)
        letter = initial if initial in ("s", "u", "a") else "o"
        if blank:
            self.blank, letter = self.blank + 1, "x"
        elif again:
            self.duplicate, letter = self.duplicate + 1, "x"
        elif cut:
            self.truncated, letter = self.truncated + 1, letter.upper()
        self.segment.append((letter, role, text))
        if len(self.segment) == SEGMENT:
            self.carry()

    def carry(self) -> None:
        """Align the segment and carry the cheapest repairs on."""
        best: dict[str, tuple[int, str, str, str]] = {}
        for before, after, cost, audit in repairs("".join(t[0] for t in self.segment), self.opening):
            if before in self.reached:
                done = self.reached[before]
                way = (done[0] + cost, done[1] + audit, before, audit)
                best[after] = min(best.get(after, way), way)
        reached = {after: (cost, whole, *self.lines(self.reached[before], before, audit)) for after, (cost, whole, before, audit) in best.items()}
        # What all repairs share is settled: only where they differ is carried.
        same = os.path.commonprefix([r[1] for r in reached.values()])
        self.settled.append(same)
        self.reached = {state: (cost, audit[len(same):], *rest) for state, (cost, audit, *rest) in reached.items()}
        self.segment, self.opening = [], False

    def lines(self, done: tuple, state: str, audit: str):
        digest, some = done[2].copy(), done[3]
        turns = iter(self.segment)
        for edit in audit:
            letter, role, text = ("", "", "") if edit == "I" else next(turns)
            if edit == "D":
                continue
            state = letter.lower() if edit == "K" else "a" if state == "u" else "u"
            line = f"{role if edit == 'K' else ROLES[state]}:{text}"
            digest.update((("\n" if some else "") + line).encode())
            some = True
        return digest, some

    def result(self) -> tuple:
        if self.segment:
            self.carry()
        cost, audit, digest, _ = min((self.reached[s] for s in (NOTHING, "a") if s in self.reached), key=lambda r: r[:2])
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join([*self.settled, audit]), digest.hexdigest())


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | Column | None = None) -> DataFrame:
    """``(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` for every conversation.

    Turns count in the order of ``turn`` (NULL first), then role, then text. NULL roles and texts are one blank. A row where ``present`` is
    not true only names its conversation; one without turns has zeros, an empty audit and the hash of nothing. A NULL
    conversation is one of its own; an empty role fits no letter of the grammar. Repeated rows are duplicate turns. Other columns are
    not looked at.

    Rows move once, to their conversation, and pass a task in order: it holds a segment of turns and at most four repairs, so
    a conversation may be far larger than memory. Earlier equal turns are told by a window within that placement, which spills.
    One conversation stays in one task: its SHA-256 can only be read from first to last.
    """
    spoken = F.coalesce(F.col(text), F.lit(" "))
    trimmed = F.rtrim(spoken, F.lit(WHITE))
    here = F.lit(True) if present is None else F.coalesce(F.col(present) if isinstance(present, str) else present, F.lit(False))
    rows = turns.select(F.col(conv).alias("_conv"), F.col(turn).cast("bigint").alias("_turn"), F.coalesce(F.col(role), F.lit(" ")).alias("_role"),
                        spoken.alias("_text"), here.alias("_here"), (trimmed == "").alias("_blank"),
                        (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("_cut"))
    rows = rows.withColumn("_text", F.when(F.col("_here"), F.col("_text")).otherwise(F.lit("")))
    rows = rows.withColumn("_digest", F.sha2(F.col("_text").cast("binary"), 256)).repartition("_conv")
    # The placement by conversation serves the window as well.
    same = Window.partitionBy("_conv", "_here", "_role", "_digest").orderBy(F.col("_turn").asc_nulls_first())
    rows = rows.withColumn("_again", F.row_number().over(same) > 1).drop("_digest")
    rows = rows.sortWithinPartitions(F.col("_conv").asc_nulls_first(), F.col("_turn").asc_nulls_first(), "_role", "_text", "_again")
    names = [conv, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    if len(set(names)) < len(names):
        raise ValueError(f"{conv} is a column of the result: pass the id under another name")
    schema = turns.select(F.col(conv), *[F.lit(0).cast("bigint").alias(c) for c in names[1:7]], *[F.lit("").alias(c) for c in names[7:]]).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def task(batches):
        now, done, size = None, [], 0
        for part in slices(batches, "_text"):
            for conv_id, at, who, said, is_here, blank, cut, again in zip(*(c.to_pylist() for c in part.columns)):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.result())
                        size += 200 + len(done[-1][7])
                    now = Conversation(conv_id)
                if is_here:
                    now.add(at, who, said, blank, again, cut)
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done), arrow)], schema=arrow)
                done, size = [], 0
        if now is not None:
            done.append(now.result())
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done), arrow)], schema=arrow)

    return rows.mapInArrow(task, schema)


def damage(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, present)``: a twentieth each of the turns is dropped (not present), emptied, left without
    marks at ends of sentences, repeated, or said by the user, by CRC-32 of ``conv_id:turn``. NULLs count as one blank."""
    def plain(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(plain("text"), "[.!?]", "")).otherwise(plain("text"))
    role = F.when(kind == 4, "user").otherwise(plain("role"))
    copies = F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind != 0).alias("present"), F.explode(copies).alias("_n")).drop("_n")
