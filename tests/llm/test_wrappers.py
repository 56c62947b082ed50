import itertools
import json
import random

from pyspark.sql import functions as F

from foliomill.llm import wrappers as W

HEAD = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body>"


def read(html):
    return W.main_text(html, None, frozenset())


def test_article_without_its_surroundings():
    page = HEAD + """<nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div>
    <article><header><h1>Title &amp;amp; more</h1></header><p><b>One
      two<br><p>thr<i>ee</i> &lt;b&gt; &#233;&copy
      <div class="share-buttons">Share</div><form><p>Mail</p></form><ul><li>a<li>b</ul><aside>See also</aside>
      <section id="comments"><p>Me too</p></section><p>end</article><footer>Foot</footer>"""
    assert read(page) == "Title &amp; more One two three <b> é© a b end"


def test_broken_and_odd_pages():
    assert read(None) == read("") == read("<p") == read("<article><p") == ""
    assert read("<") == "<" and read("1 < 2") == "1 < 2"
    assert read("plain text") == "plain text"
    assert read("<article><p>a<p>b</article></div></p>") == "a b"
    assert read('<article><p title="x>y">a</p><p title="x>b</p>') == "a b"
    assert read("<article>" + "<p>w " * 3000) == " ".join(["w"] * 3000)
    assert read("<div>" * 3000 + "deep") == "deep"
    assert read("<div class='menu'>m</div><div><p>long text here</p><p>more of it</p></div><div>x</div>") == "long text here more of it"
    assert read("<header>Site</header><div id='content'><p>a b c d</p></div>") == "a b c d"
    assert read("<article><script>if (a<b) x</script>t<textarea>no</textarea></article>") == "t"


def test_tree_matching():
    a = ["r", [["a", []], ["b", [["c", []], ["d", []]]], ["e", []]]]
    b = ["r", [["b", [["d", []]]], ["x", []], ["e", []], ["a", []]]]
    size, pairs = W.simple_tree_matching(a, b)
    assert size == 4 and sorted(x[0] for x, _ in pairs) == ["b", "d", "e", "r"]
    assert W.simple_tree_matching(["a", []], ["b", []]) == (0, [])
    found = W.alignment(json.dumps(a), json.dumps(b))
    assert found == {0: 0, 2: 1, 4: 2, 5: 4}


def test_constant_nodes_of_a_host_are_its_template(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><article><div class='lead'>Welcome to our site</div><p>Story {i}</p></article></body>", "x") for i in range(40)]
    rows += [(100 + i, f"http://copies.example/{i}", "<article><p>same</p></article>", "x") for i in range(20)]
    rows += [(200, None, None, None), (200, None, None, None), (201, "not a url", "<p>free</p>", "y")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = {r.page_id: r.text for r in W.extract(pages).collect()}
    assert all(got[i] == f"Story {i}" for i in range(40))
    assert all(got[100 + i] == "same" for i in range(20))
    assert got[200] == "" and got[201] == "free" and W.extract(pages).count() == len(rows)
    assert W.extract(pages.limit(0)).count() == 0


def test_a_deviating_page_and_several_layouts_keep_the_template(spark):
    note = "<div class='lead'>All rights of 2024 reserved</div>"
    rows = [(i, f"http://one.example/{i}", f"<article>{note if i else note.replace('2024', '2023')}<p>Story {i}</p></article>") for i in range(40)]
    shapes = ["<article><p>Tale {i}</p>{note}</article>", "<article>{note}<h1>Head {i}</h1><ul><li>Item {i}</ul></article>", "<article><table><tr><td>Cell {i}</table><section>{note}</section></article>"]
    rows += [(100 + i, f"http://three.example/{i}", shapes[i % 3].format(i=i, note=note)) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in W.extract(pages).collect()}
    assert all(got[i] == f"Story {i}" for i in range(1, 40))
    assert got[0] == "All rights of 2023 reserved Story 0"  # a text of its own is never lost
    assert all(got[100 + i] == (f"Tale {i}", f"Head {i} Item {i}", f"Cell {i}")[i % 3] for i in range(60))


def test_varying_slots_say_where_a_body_in_several_parts_lies(spark):
    rows = [(i, f"http://parts.example/{i}", f"<body><div class='one'><p>{f'first {i} ' * 9}</p></div><div class='two'><p>{f'second {i} ' * 7}</p></div>"
             "<div class='legal'>All rights reserved</div></body>") for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for r in W.extract(pages).collect():
        assert r.text == (f"first {r.page_id} " * 9 + f"second {r.page_id} " * 7).strip()


def test_classes_that_only_sound_like_surroundings(spark):
    body = "<p>{i} " + "first words " * 8 + "</p><p>{i} " + "second words " * 8 + "</p>"
    want = "{i} " + "first words " * 8 + "{i} " + "second words " * 8
    around = {"has": ("<div class='layout has-sidebar'>", "</div><div class='legal'>All rights</div>"), "related": ("<article class='related-post'>", "</article>"),
              "right": ("<div class='layout-sidebar-right'><div class='ad-banner'>Buy {i}</div>", "</div><div class='site-footer'>Foot {i}</div>")}
    rows = [(f"{name}-{n}-{i}", f"http://{name}{n}.example/{i}", (a + body + z).format(i=i), "clash") for name, (a, z) in around.items() for n in (4, 20) for i in range(n)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string, _templates string").withColumn("_host", F.lit("kept"))
    got = W.extract(pages).collect()
    assert {r.page_id: r.text for r in got} == {k: want.format(i=k.split("-")[2]).strip().replace("  ", " ") for k, *_ in rows}
    assert {(r._templates, r._host) for r in got} == {("clash", "kept")}


def test_a_page_reads_alike_on_small_and_large_hosts(spark):
    page = "<body><article><h1>Head {i}</h1><p>" + "Story {i}. " * 9 + "</p><p>Correction: none.</p></article></body>"
    rows = [(n * 100 + i, f"http://h{n}.example/{i}", page.format(i=i)) for n in (4, 20) for i in range(n)]
    got = {r.page_id: r.text for r in W.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert [got[400 + i] for i in range(4)] == [got[2000 + i] for i in range(4)]


def test_tree_matching_against_all_matchings():
    """Every set of pairs that keeps labels, parents and the order of siblings."""
    rng = random.Random(1)

    def tree(n):
        nodes = [[rng.choice("ab"), []] for _ in range(n)]
        for k in range(1, n):
            nodes[rng.randrange(k)][1].append(nodes[k])
        return nodes[0]

    def largest(a, b):
        if a[0] != b[0]:
            return 0
        best = 0
        for k in range(min(len(a[1]), len(b[1])) + 1):
            for x in itertools.combinations(a[1], k):
                for y in itertools.combinations(b[1], k):
                    sizes = [largest(p, q) for p, q in zip(x, y)]
                    best = max(best, sum(sizes))
        return best + 1

    for _ in range(200):
        a, b = tree(rng.randrange(1, 8)), tree(rng.randrange(1, 8))
        assert W.simple_tree_matching(a, b)[0] == largest(a, b)
