"""URL filters: all glob rules run over each URL at once, as one bit-parallel automaton.

A URL is put into one canonical form, ``.host#path?query``: neither sign that parts it can occur in what
stands before it, so a rule's host part cannot match inside a path. Every rule is a run of states, one after
each of its tokens, and all runs lie end to end in 64-bit words. One character of the URL moves all of them:
``states = (states << 1 & accepts[character]) | (states & loops[character])`` (Shift-And; a ``*`` is a loop).
A rule matches where its last state is on at the end.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.llm.words import slices

ALLOW, BLOCK = "allow", "block"
MAX_STATES = 1 << 16
STEP_BYTES = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class HostRule(NamedTuple):
    """Holds for ``host`` and all its subdomains where the path starts with ``path``; both are plain text."""

    verdict: str
    host: str
    path: str = "/"


class Glob(NamedTuple):
    """Matches the whole host and the whole path, ``*`` being any run and ``?`` in the host one character.

    A ``?`` in ``path`` is a question mark: such a rule matches ``path?query`` as a whole, others leave the query open."""

    verdict: str
    host: str
    path: str = "*"


# Rules of the query: fixed values.
HOST_RULES = [
    HostRule(ALLOW, "com", "/"),
    HostRule(BLOCK, "example.com", "/en/"),
    HostRule(ALLOW, "www.example.com", "/en/"),
    HostRule(BLOCK, "net", "/es/"),
    HostRule(BLOCK, "net", "/fr/"),
]
# What is judged where no host rule fits: advertising, tracking and account pages, and files that are no pages.
GLOBS = [
    *(Glob(BLOCK, host) for host in ("ad.*", "ads.*", "adserver.*", "*.doubleclick.*", "track.*", "tracker.*", "pixel.*")),
    *(Glob(BLOCK, "*", path) for path in ("/login*", "/signin*", "/logout*", "/register*", "/cart*", "/checkout*", "/wp-admin/*", "/cgi-bin/*")),
    *(Glob(BLOCK, "*", f"*.{end}") for end in ("css", "exe", "gif", "gz", "ico", "iso", "jpeg", "jpg", "js", "mp3", "mp4", "png", "svg", "zip")),
    *(Glob(BLOCK, "*", f"*?*{key}=*") for key in ("phpsessid", "jsessionid", "sessionid")),
    Glob(ALLOW, "*", "/robots.txt"),
]


@dataclass
class Automaton:
    """Masks of all rules by class of character and word, the states that are on at first, and the last states of each rule
    (two where the query is open). ``letters`` are the sorted code points that a rule names; class 0 is any other."""

    letters: np.ndarray
    accepts: np.ndarray
    loops: np.ndarray
    start: np.ndarray
    ends: np.ndarray
    rule_of_end: np.ndarray

    def matches(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """``(texts, ends)`` booleans for the texts ``points[offsets[i]:offsets[i + 1]]``."""
        lengths = np.diff(offsets)
        places = np.minimum(np.searchsorted(self.letters, points), max(0, len(self.letters) - 1))
        kinds = np.where(self.letters[places] == points, places + 1, 0) if len(self.letters) else np.zeros(len(points), np.int64)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = offsets[:-1][order], lengths[order]
        states = np.repeat(self.start[None, :], len(order), axis=0)
        running = len(order)
        for at in range(int(lengths[0]) if len(lengths) else 0):
            while running and lengths[running - 1] <= at:
                running -= 1
            now = states[:running]
            kind = kinds[starts[:running] + at]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            states[:running] = (moved & self.accepts[kind]) | (now & self.loops[kind])
        found = np.zeros((len(order), len(self.ends)), bool)
        found[order] = (states[:, self.ends >> 6] >> (self.ends & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return found


def tokens_of(rule: HostRule | Glob) -> list[tuple[str, bool]]:
    """The rule as ``(sign, literal)`` over the canonical URL; signs that are not literal are wildcards."""
    plain = [(c, True) for c in rule.host.translate(str.maketrans(UPPER, LOWER))]
    if isinstance(rule, HostRule):
        return [("*", False), (".", True), *plain, ("#", True), *((c, True) for c in rule.path), ("**", False)]
    host = [(c, c not in "*?") for c, _ in plain]
    run, rest = ("**", []) if "?" in rule.path else ("path", [("query", False)])
    return [(".", True), *host, ("#", True), *((run, False) if c == "*" else (c, True) for c in rule.path), *rest]


def build(rules: list) -> Automaton:
    """Pack the rules. ``*`` loops on all but ``#``, ``path`` on all but ``?``, ``**`` on everything; an open query loops after its ``?``."""
    patterns = [tokens_of(r) for r in rules]
    letters = np.array(sorted({ord(c) for p in patterns for c, plain in p if plain} | {ord("#"), ord("?")}), np.uint32)
    class_of = {int(c): i + 1 for i, c in enumerate(letters)}
    n_classes = len(letters) + 1
    accepts, loops, start, ends = [], [], [], []  # (class or None for all, state)
    state = 0
    boundary, query = class_of[ord("#")], class_of[ord("?")]
    for pattern in patterns:
        start.append(state)
        final = [state]
        for c, plain in pattern:
            if plain:
                state += 1
                accepts.append((class_of[ord(c)], state))
            elif c == "?":
                state += 1
                accepts += [(k, state) for k in range(n_classes) if k != boundary]
            elif c == "*":
                loops += [(k, state) for k in range(n_classes) if k != boundary]
            elif c == "**":
                loops += [(k, state) for k in range(n_classes)]
            elif c == "path":
                loops += [(k, state) for k in range(n_classes) if k != query]
            else:
                # A path without a query mark holds with any query: the path's end and the state after "?" both count.
                final.append(state)
                state += 1
                accepts.append((query, state))
                loops += [(k, state) for k in range(n_classes)]
            final[-1] = state
        ends.append(final if len(final) == 2 else [final[-1]])
        state += 1
    if state > MAX_STATES:
        raise ValueError(f"{state} states of rules; {MAX_STATES} at most")
    words = max(1, -(-state // 64))

    def masks(pairs):
        out = np.zeros((n_classes, words), np.uint64)
        for k, s in pairs:
            out[k, s >> 6] |= np.uint64(1) << np.uint64(s & 63)
        return out

    first = np.zeros(words, np.uint64)
    for s in start:
        first[s >> 6] |= np.uint64(1) << np.uint64(s & 63)
    flat = [s for group in ends for s in group]
    rule_of_end = np.array([i for i, group in enumerate(ends) for _ in group], np.int64)
    return Automaton(letters, masks(accepts), masks(loops), first, np.array(flat, np.int64), rule_of_end)


def host_of(url: str | Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lowered; '' without ``://`` and for NULL."""
    return F.translate(F.regexp_extract(_rest(url), r"\A[^/?#]*", 0), UPPER, LOWER)


def path_of(url: str | Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; '' where there is none."""
    return F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1)


def _rest(url: str | Column) -> Column:
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def canonical(url: str | Column) -> Column:
    """``.host#path?query``, the query with its mark and without a fragment, as text that is valid UTF-8."""
    query = F.regexp_extract(_rest(url), r"\A[^?#]*(\?[^#]*)", 1)
    return F.make_valid_utf8(F.concat(F.lit("."), host_of(url), F.lit("#"), path_of(url), query))


def _best(rules: list) -> np.ndarray:
    """Rule numbers from the strongest on: more characters that are not wildcards, then the longer host, then block before allow."""
    def weight(i):
        r = rules[i]
        signs = (r.host + r.path) if isinstance(r, HostRule) else (r.host + r.path).replace("*", "")
        return -len(signs), -len(r.host), r.verdict != BLOCK, i

    return np.array(sorted(range(len(rules)), key=weight), np.int64)


def judge(urls: DataFrame, id_col: str = "page_id", url: str = "url", host_rules: list[HostRule] = HOST_RULES, globs: list[Glob] = GLOBS,
          default: str = ALLOW) -> DataFrame:
    """``(id_col, host, path, rule, pattern, verdict)`` for every URL.

    ``rule`` is the longest host rule that fits (host and path counted together; then the longer host, then
    ``block``), else NULL. The verdict is that rule's; without one it is that of the strongest glob that matches, by
    the same order, named in ``pattern`` as ``host path``; without that, ``default``. A NULL URL, an empty one and one without ``://``
    have an empty host and path. Repeated rows give repeated results, other columns are not looked at; ``id_col`` may be a
    struct that carries them, but must not have a name of the result.

    The masks are a constant of the job, bounded by ``MAX_STATES``; rows stay where they are, and a URL is one row
    whatever its length.
    """
    if id_col in ("host", "path", "rule", "pattern", "verdict"):
        raise ValueError(f"{id_col} is a column of the result: pass the id under another name")
    host_rules, globs = list(host_rules), list(globs)
    automaton = build([*host_rules, *globs])
    of_end, n_host = automaton.rule_of_end, len(host_rules)
    by_rule, by_glob = _best(host_rules), _best(globs) + n_host
    step = max(1, STEP_BYTES // (64 + 8 * automaton.accepts.shape[1] * 3))

    def strongest(hit: np.ndarray, order: np.ndarray, base: int) -> np.ndarray:
        if not len(order):
            return np.zeros(len(hit), np.int32)
        sorted_hits = hit[:, order]
        first = sorted_hits.argmax(axis=1)
        return np.where(sorted_hits.any(axis=1), order[first] - base + 1, 0).astype(np.int32)

    def task(batches):
        for sized in slices(batches, "_canonical"):
            for at in range(0, sized.num_rows, step):
                part = sized.slice(at, step)
                texts = part.column("_canonical").to_pylist()
                points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
                offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
                ends = automaton.matches(points, offsets)
                hit = np.zeros((len(texts), n_host + len(globs)), bool)
                for column, rule in enumerate(of_end):
                    hit[:, rule] |= ends[:, column]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), part.column("_host"), part.column("_path"),
                     pa.array(strongest(hit, by_rule, 0)), pa.array(strongest(hit, by_glob, n_host))], ["_id", "_host", "_path", "_rule", "_glob"])

    rows = urls.select(F.col(id_col).alias("_id"), host_of(url).alias("_host"), path_of(url).alias("_path"), canonical(url).alias("_canonical"))
    schema = rows.select("_id", "_host", "_path", F.lit(0).alias("_rule"), F.lit(0).alias("_glob")).schema
    found = rows.mapInArrow(task, schema)

    def named(number: str, values: list[str]) -> Column:
        return F.get(F.array(F.lit(None).cast("string"), *[F.lit(v) for v in values]), F.col(number))

    verdict = F.coalesce(named("_rule", [r.verdict for r in host_rules]), named("_glob", [g.verdict for g in globs]), F.lit(default))
    return found.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"),
                        named("_rule", [r.host + r.path for r in host_rules]).alias("rule"),
                        F.when(F.col("_rule") == 0, named("_glob", [f"{g.host} {g.path}" for g in globs])).alias("pattern"), verdict.alias("verdict"))
