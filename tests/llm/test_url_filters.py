import random
import re

import pytest

from foliomill.llm import url_filters as U


def parts(url):
    """Host, path and query, by the rule's words."""
    url = url or ""
    if "://" not in url:
        return "", "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    cut = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    path, rest = rest[:cut], rest[cut:]
    query = rest.split("#")[0] if rest.startswith("?") else ""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path, query


def regex(glob, one):
    return "".join(".*" if c == "*" else one if c == "?" else re.escape(c) for c in glob)


def judged(url, rules, globs):
    """(rule, pattern, verdict), rule by rule."""
    host, path, query = parts(url)
    fits = [r for r in rules if ("." + host).endswith("." + r.host) and path.startswith(r.path)]
    if fits:
        r = min(fits, key=lambda r: (-len(r.host + r.path), -len(r.host), r.verdict != "block"))
        return r.host + r.path, None, r.verdict
    found = []
    for i, g in enumerate(globs):
        text = path + query if "?" in g.path else path
        if re.fullmatch(regex(g.host, "."), host, re.S) and re.fullmatch(regex(g.path, r"\?"), text, re.S):
            found.append((-len((g.host + g.path).replace("*", "")), -len(g.host), g.verdict != "block", i))
    if found:
        g = globs[min(found)[-1]]
        return None, f"{g.host} {g.path}", g.verdict
    return None, None, "allow"


URLS = [None, "", "no scheme", "://", "http://", "http://com", "http://com/", "http://www.example.com/en/1", "HTTP://Www.EXAMPLE.com/en/x?y#z", "http://notexample.com/en/",
        "http://example.com:80/en/", "http://a.example.com/en", "x://a.net/es/", "x://net/fr/?q", "x://b.net/x.com/en/", "x://b.org?x.com/", "x://b.org#x.com/",
        "a://b://c/d", "http://ads.b.org/é\n?x", "http://x.doubleclick.y/", "http://b.org/a/b.zip", "http://b.org/a.zip?x=1", "http://b.org/?PHPSESSID=2&sessionid=3",
        "http://b.org/login", "http://b.org/robots.txt", "http://b.org/" + "x" * 70_000 + ".png", "http://" + "s." * 3000 + "example.com/en/", "http://ÀÉ.net/es/", "http://a b.com/\t"]


def test_query_rules_match_one_by_one(spark):
    rows = [(i, u, "clash") for i, u in enumerate(URLS + URLS)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in U.judge(frame).collect()}
    assert got == {i: (*parts(u)[:2], *judged(u, U.HOST_RULES, U.GLOBS)) for i, u, _ in rows}
    assert U.judge(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        U.judge(frame.withColumnRenamed("page_id", "path"), id_col="path")
    with pytest.raises(ValueError):
        U.judge(frame, globs=[U.Glob("block", "*", "x" * U.MAX_STATES)])


def test_random_rules_across_words(spark):
    """Hundreds of rules over a few letters, so runs of states cross the 64-bit words and many rules match at once."""
    rng = random.Random(4)

    def some(letters, n):
        return "".join(rng.choices(letters, k=rng.randrange(n)))

    rules = [U.HostRule(rng.choice(["allow", "block"]), some("ab.", 5), "/" + some("ab/", 4)) for _ in range(60)]
    globs = [U.Glob(rng.choice(["allow", "block"]), some("ab.*?", 6), some("ab/*?=", 6)) for _ in range(250)] + [U.Glob("block", "*", "*")]
    urls = [f"{some('xy', 3)}://{some('abAB.', 8)}{rng.choice(['', '/'])}{some('ab/.=', 9)}{rng.choice(['', '?'])}{some('ab=?', 5)}" for _ in range(700)]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: tuple(r)[3:] for r in U.judge(rows, host_rules=rules, globs=globs).collect()}
    assert got == {i: judged(u, rules, globs) for i, u in enumerate(urls)}
    only = {r.page_id: r.verdict for r in U.judge(rows, host_rules=[], globs=[], default="block").collect()}
    assert set(only.values()) == {"block"}
