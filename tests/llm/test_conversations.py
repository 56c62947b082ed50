import hashlib
import itertools
import random
import re
import zlib

import pytest

from foliomill.llm import conversations as C

WHITE = " \t\n\x0b\f\r"


def every_repair(turns):
    """All edits of a short conversation, by trying each that the grammar and the cost of dropping all turns leave: (cost, audit, lines)."""
    out = []

    def go(i, cost, audit, letters, lines, inserted):
        if cost > 2 * len(turns) or not re.fullmatch("s?(ua)*u?", letters):
            return
        if i == len(turns):
            if re.fullmatch("(s?(ua)+)?", letters):
                out.append((cost, audit, lines))
        else:
            role, text, fault = turns[i]
            extra = 5 if fault == "truncated" else 0
            go(i + 1, cost + 2, audit + "D", letters, lines, 0)
            if fault not in ("blank", "duplicate"):
                go(i + 1, cost + extra, audit + "K", letters + (role[:1] or "?"), [*lines, f"{role}:{text}"], 0)
                for to in ("user", "assistant"):
                    go(i + 1, cost + 1 + extra, audit + "R", letters + to[0], [*lines, f"{to}:{text}"], 0)
        if inserted < 2:
            for to in ("user", "assistant"):
                go(i, cost + 5, audit + "I", letters + to[0], [*lines, f"{to}:"], inserted + 1)

    go(0, 0, "", "", [], 0)
    return min(out, key=lambda r: r[:2])


def plain(rows):
    """The contract for the rows (turn, role, text) of one conversation after damage."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, turns = set(), []
    for _, role, text in rows:
        signs = text.rstrip(WHITE)
        fault = "blank" if not signs else "duplicate" if (role, text) in seen else "truncated" if signs[-1] not in ".!?" else ""
        seen.add((role, text))
        turns.append((role, text, fault))
    numbers = {t for t, _, _ in rows if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    count = [sum(t[2] == f for t in turns) for f in ("blank", "duplicate", "truncated")]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    return turns, (gaps, *count, illegal)


def expected(rows):
    turns, facts = plain(rows)
    cost, audit, lines = every_repair(turns)
    return (*facts, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def some_rows(rng, n):
    roles = ["user", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "No!", "cut off", "", " \n", "Why?  ", None, "A\nb.", "é."]
    return [(rng.choice([None, *range(n + 2)]), rng.choices(roles, [6, 6, 2, 1, 1, 1])[0], rng.choices(texts, [6, 6, 3, 1, 1, 6, 1, 6, 6])[0]) for _ in range(n)]


def test_repairs_match_all_edits(spark, monkeypatch):
    rng = random.Random(5)
    given = {k: some_rows(rng, rng.randrange(0, 6)) for k in range(150)}
    given |= {k: [r for r in given[k - 200] for _ in range(2)] for k in range(200, 230)}
    given = {k: v for k, v in given.items() if len(v) < 8}
    given[150] = [(i, "user" if i % 2 else "assistant", f"Line {i}.") for i in range(6)]
    rows = [(k, *r, True, "clash") for k, v in given.items() for r in v] + [(k, 1, "user", "gone.", False, "clash") for k in given]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, here boolean, audit string").repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in C.repair(frame, present="here").collect()}
    assert got == {k: expected(v) for k, v in given.items()}


@pytest.mark.parametrize("size", [1, 2, 3, 32])
def test_segments_do_not_change_repairs(size, monkeypatch):
    rng = random.Random(size)
    monkeypatch.setattr(C, "SEGMENT", size)
    for _ in range(120):
        rows = some_rows(rng, rng.randrange(0, 6))
        turns, facts = plain(rows)
        one = C.Conversation(0)
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] if r[1] is not None else " ", r[2] if r[2] is not None else " "))
        for (at, _, _), (role, text, fault) in zip(order, turns):
            one.add(at, role, text, fault == "blank", fault == "duplicate", fault == "truncated")
        assert one.result()[1:] == expected(rows)


def test_the_band_loses_nothing():
    """Against the same table with all cells filled."""
    rng = random.Random(8)
    for _ in range(300):
        turns = "".join(rng.choices("suaoSUAx", [2, 8, 8, 1, 1, 2, 2, 3], k=rng.randrange(1, 14)))
        for first in "sua":
            letters = C.target(first, 2 * len(turns) + 2)
            table = {(0, 0): (0, "")}
            for i in range(len(turns) + 1):
                for j in range(len(letters) + 1):
                    ways = [table[0, 0]] if i == j == 0 else []
                    if i and (i - 1, j) in table:
                        ways.append((table[i - 1, j][0] + 2, table[i - 1, j][1] + "D"))
                    if j and letters[j - 1] != "s" and (i, j - 1) in table:
                        ways.append((table[i, j - 1][0] + 5, table[i, j - 1][1] + "I"))
                    if i and j and (i - 1, j - 1) in table and turns[i - 1] != "x":
                        cost, audit = table[i - 1, j - 1]
                        cost += 5 * turns[i - 1].isupper()
                        if turns[i - 1].lower() == letters[j - 1]:
                            ways.append((cost, audit + "K"))
                        elif letters[j - 1] != "s":
                            ways.append((cost + 1, audit + "R"))
                    if ways:
                        table[i, j] = min(ways)
            full = {}
            for j in range(1, len(letters) + 1):
                if (len(turns), j) in table:
                    cell, letter = table[len(turns), j], letters[j - 1]
                    full[letter] = min(full.get(letter, cell), cell)
            assert C.align(turns, first) == full


def test_long_conversation_and_long_texts(spark):
    """Thousands of turns, a third of all rows equal: against the four-state automaton, turn by turn."""
    rng = random.Random(3)
    rows = [(i, rng.choice(["user", "assistant"]), f"Text {i}" + rng.choice([".", ".", ".", ""])) for i in range(3000)]
    rows += [(i, "user", "Same.") for i in range(1500)] + [(4000, "assistant", "w " * 200_000 + "end.")]
    turns, facts = plain(rows)
    best = {"": (0, "")}
    step = {"": "u", "s": "u", "u": "a", "a": "u"}
    for role, _, fault in turns:
        for _ in range(2):  # insertions before the turn
            for state, (cost, audit) in list(best.items()):
                way = (cost + 5, audit + "I")
                best[step[state]] = min(best.get(step[state], way), way)
        after = {}
        for state, (cost, audit) in best.items():
            ways = [(state, (cost + 2, audit + "D"))]
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault else 0
                ways.append((step[state], (cost + extra + (role[0] != step[state]), audit + ("K" if role[0] == step[state] else "R"))))
            for to, way in ways:
                after[to] = min(after.get(to, way), way)
        best = after
    for state, (cost, audit) in list(best.items()):
        if state == "u":
            best["a"] = min(best.get("a", (cost + 5, audit + "I")), (cost + 5, audit + "I"))
    cost, audit = min(best[s] for s in ("", "a") if s in best)
    got = C.repair(spark.createDataFrame([(None, *r) for r in rows], "conv_id string, turn bigint, role string, text string")).collect()
    assert [tuple(r)[:8] for r in got] == [(None, *facts, cost, audit)]


def test_damage_and_empty_tables(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in (None, *range(40)) for t in (None, *range(5))]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = C.damage(frame).collect()
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        mine = [r for r in got if (r.conv_id, r.turn) == (c, t)]
        assert len(mine) == (2 if kind == 3 else 1)
        assert {tuple(r)[2:] for r in mine} == {("user" if kind == 4 else role, "" if kind == 1 else "One Two" if kind == 2 else text, kind != 0)}
    nothing = C.repair(C.damage(frame), present="present").where("repaired_sha256 = sha2('', 256)").where("cost = 0")
    assert nothing.where("audit <> ''").count() == 0
    assert C.repair(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        C.repair(frame.withColumnRenamed("conv_id", "audit"), conv="audit")
