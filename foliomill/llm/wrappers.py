"""Main text of web pages by wrapper induction.

Pages of one host mostly come from one template. Each page is parsed into a tree of its block elements;
equal siblings are folded. The frequent trees of a host are its templates, one per layout, and every page of the
host is aligned with the closest by simple tree matching. For each template node the texts of all aligned
pages are counted: a text that nearly all pages have there belongs to the template, other text is the page's own. The main
text of a page is its own text in its content element, outside navigation, adverts
and other parts that are not the article.

Statistics of a node are counts of text hashes, added up before and after the shuffle, so a host of any
size needs no group in one task.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.llm.words import slices, written

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math xmp noembed noframes object video audio canvas select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike "
                   "strong sub sup time tt u var wbr picture map".split())
BREAKS = frozenset(("br", "hr"))
# What an opened block ends: an open p always, and open elements of these kinds.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th"), "option": ("option",)}
WALLS = frozenset(("table", "ul", "ol", "dl", "body", "html", "article", "main", "section", "div", "nav", "aside", "footer", "header"))
SKIPPED_TAGS = frozenset("head nav footer aside form button dialog menu fieldset".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
SKIPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner nav navbar navigation menu menus breadcrumb "
    "breadcrumbs sidebar aside footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup "
    "login comment comments commentlist respond disqus reply replies share sharing social related recommended pagination pager search toolbar skip".split())
SKIPPED_PARTS = frozenset("ad advert advertisement sponsored promo comment comments reply related teaser".split())
CONTENT_TAGS = ("article", "main")
CONTENT_WORDS = frozenset("article content post entry story main body text".split())
# A class of several words that starts like this names an arrangement, not what the element holds.
ARRANGEMENTS = frozenset("has with without no not is layout page body grid wrapper container".split())
ROOT = "#"
DEEPEST = 100


def _words(value: str) -> set[str]:
    return {w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()) if w}


def _names_any(value: str, words: frozenset) -> bool:
    """Whether a class attribute names one of the words: alone, as the last word of a class, or as its first if the last is no word for content."""
    for name in value.split():
        parts = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
        if parts and not ARRANGEMENTS & set(parts[:-1]) and (parts[-1] in words or parts[0] in words and parts[-1] not in CONTENT_WORDS):
            return True
    return False


@lru_cache(maxsize=4096)
def _element(tag: str, attributes: str) -> tuple[str, bool]:
    """``(label, skipped)`` of an element: its tag with its classes, and whether it is no part of an article."""
    found = {}
    for m in ATTRIBUTE.finditer(attributes) if attributes.strip() else ():
        found.setdefault(m[1].lower(), (m[2] or "").strip("\"'"))
    named = _words(found.get("class", "")) | _words(found.get("id", ""))
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I)
    skipped = tag in SKIPPED_TAGS or found.get("role", "").lower() in SKIPPED_ROLES or bool(hidden) or bool(
        tag not in ("html", "body") and _names_any(f"{found.get('class', '')} {found.get('id', '')}", SKIPPED_PARTS if tag in CONTENT_TAGS else SKIPPED_WORDS))
    return ".".join([tag, *sorted(named)]), skipped


class Page:
    """Blocks of text, each with the element that holds it.

    ``nodes[i]`` is ``(parent, label, skipped, fold)``; node 0 is the root. Siblings of one label share a fold: the
    folds are a tree too, the shape of the page. Elements below ``DEEPEST`` levels share the fold of their parent.
    """

    def __init__(self, html: str):
        self.nodes: list[tuple[int, str, bool, int]] = [(-1, ROOT, False, 0)]
        self.labels: list[str] = [ROOT]  # of the folds
        self.children: list[dict[str, int]] = [{}]
        self.blocks: list[tuple[int, str]] = []
        stack: list[tuple[str, int]] = [("", 0)]
        pieces: list[str] = []
        at, end = 0, len(html)

        def flush():
            if pieces:
                text = " ".join(unescape("".join(pieces)).split())
                pieces.clear()
                if text:
                    self.blocks.append((stack[-1][1], text))

        def opened(tag, attributes):
            label, skipped = _element(tag, attributes)
            # The header of an article holds its title, any other the site's.
            skipped = skipped or "header" in label.split(".") and not any(t in CONTENT_TAGS for t, _ in stack)
            parent = stack[-1][1]
            above = self.nodes[parent][3]
            fold = above if len(stack) > DEEPEST else self.children[above].get(label)
            if fold is None:
                fold = self.children[above][label] = len(self.labels)
                self.labels.append(label)
                self.children.append({})
            stack.append((tag, len(self.nodes)))
            self.nodes.append((parent, label, skipped or self.nodes[parent][2], fold))

        while at < end:
            m = TAG.search(html, at)
            if not m:
                pieces.append(html[at:])
                break
            if m.start() > at:
                pieces.append(html[at:m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            tag, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
            if tag in RAW and not closing:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I).search(html, at)
                at = close.end() if close else end
                flush()
                continue
            if tag in INLINE:
                if closing:
                    if any(t == tag for t, _ in stack):
                        flush()
                        while stack.pop()[0] != tag:
                            pass
                elif attributes and _element(tag, attributes)[1]:  # such as a span that is an advert
                    flush()
                    opened(tag, attributes)
                continue
            flush()
            if tag in BREAKS or tag in VOID:
                continue
            if closing:
                if any(t == tag for t, _ in stack):
                    while stack.pop()[0] != tag:
                        pass
                continue
            if stack[-1][0] in INLINE:
                while stack[-1][0] in INLINE:
                    stack.pop()
            if stack[-1][0] == "p":
                stack.pop()
            ends = CLOSES.get(tag)
            if ends:
                k = len(stack) - 1
                while k > 0 and stack[k][0] not in WALLS and stack[k][0] not in ends:
                    k -= 1
                while k > 0 and stack[k][0] in ends:
                    del stack[k:]
                    k -= 1
            if tag in ("html", "body") and any(t == tag for t, _ in stack):
                continue
            opened(tag, attributes)
        flush()

    def skeleton(self) -> str:
        def built(node):
            return [self.labels[node], [built(c) for c in self.children[node].values()]]

        return json.dumps(built(0), ensure_ascii=False, separators=(",", ":"))


def simple_tree_matching(a: list, b: list) -> tuple[int, list[tuple[list, list]]]:
    """The largest matching of two ordered trees ``[label, children]`` that keeps order and ancestry.

    Roots must match. The children are aligned by dynamic programming over the sizes of their matchings.
    """
    if a[0] != b[0]:
        return 0, []
    m, n = len(a[1]), len(b[1])
    inner = {}
    for i, x in enumerate(a[1]):
        for j, y in enumerate(b[1]):
            if x[0] == y[0]:
                inner[i, j] = simple_tree_matching(x, y)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + inner.get((i - 1, j - 1), (0, []))[0])
    pairs, i, j = [(a, b)], m, n
    while i and j:
        if (i - 1, j - 1) in inner and best[i][j] == best[i - 1][j - 1] + inner[i - 1, j - 1][0]:
            pairs += inner[i - 1, j - 1][1]
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[m][n] + 1, pairs


def _numbered(tree: list) -> list[list]:
    """The nodes in depth-first order."""
    out, todo = [], [tree]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += reversed(node[1])
    return out


@lru_cache(maxsize=2048)
def alignment(skeleton: str, template: str) -> dict[int, int]:
    """Depth-first numbers of the skeleton's nodes to those of the template."""
    a, b = json.loads(skeleton), json.loads(template)
    number_a = {id(x): i for i, x in enumerate(_numbered(a))}
    number_b = {id(x): i for i, x in enumerate(_numbered(b))}
    return {number_a[id(x)]: number_b[id(y)] for x, y in simple_tree_matching(a, b)[1]}


def _depth_first(page: Page) -> dict[int, int]:
    """The folds of a page to depth-first numbers."""
    out, todo = {}, [0]
    while todo:
        node = todo.pop()
        out[node] = len(out)
        todo += reversed(page.children[node].values())
    return out


@lru_cache(maxsize=2048)
def _size(tree: str) -> int:
    return len(_numbered(json.loads(tree)))


def _aligned(page: Page, templates: list[str]) -> tuple[int, dict[int, int]]:
    """The number of the closest template, and the folds of a page to its nodes."""
    own = page.skeleton()
    layout = 0
    if len(templates) > 1:
        layout = max(range(len(templates)), key=lambda i: (len(alignment(own, templates[i])) / (_size(own) + _size(templates[i])), -i))
    match = alignment(own, templates[layout])
    return layout, {node: match[k] for node, k in _depth_first(page).items() if k in match}


@lru_cache(maxsize=2048)
def slot_root(template: str, slots: frozenset[int]) -> int:
    """The lowest node of a template above all the slots; of a single slot its parent, unless that is the whole page."""
    numbered = _numbered(json.loads(template))
    number = {id(x): i for i, x in enumerate(numbered)}
    parent = {number[id(c)]: i for i, x in enumerate(numbered) for c in x[1]}
    paths = []
    for slot in slots:
        path = [slot]
        while path[-1]:
            path.append(parent[path[-1]])
        paths.append(path[::-1])
    root = [steps[0] for steps in zip(*paths) if len(set(steps)) == 1][-1]
    above = parent.get(root, 0)
    return above if root in slots and numbered[above][0].split(".")[0] not in (ROOT, "html", "body") else root


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def _texts(page: Page) -> dict[int, str]:
    """The text of each fold that holds text itself, outside of what is skipped anyway."""
    found: dict[int, list[str]] = {}
    for node, text in page.blocks:
        if not page.nodes[node][2]:
            found.setdefault(page.nodes[node][3], []).append(text)
    return {node: "\n".join(parts) for node, parts in found.items()}


def _content(page: Page) -> list[bool]:
    """Whether each node lies in the content element of the page.

    That is the article or main element (all articles, if a page has several), else one named as content, else
    the element whose own children hold most text; elements that are skipped never count.
    """
    size = [0] * len(page.nodes)
    for node, text in page.blocks:
        if not page.nodes[node][2]:
            size[node] += len(text)
    total = list(size)
    for node in range(len(page.nodes) - 1, 0, -1):
        total[page.nodes[node][0]] += total[node]
    roots: list[int] = []
    for tag in CONTENT_TAGS:
        roots = roots or [i for i, (_, label, skipped, _) in enumerate(page.nodes) if not skipped and label.split(".")[0] == tag and total[i]]
    if not roots:
        named = [i for i, (_, label, skipped, _) in enumerate(page.nodes)
                 if not skipped and total[i] * 2 > total[0] and set(label.split(".")[1:]) & CONTENT_WORDS]
        roots = named[-1:]  # the innermost, as children come after their parents
    if not roots:
        direct = list(size)
        for node in range(1, len(page.nodes)):
            direct[page.nodes[node][0]] += size[node]
        roots = [max(range(len(page.nodes)), key=lambda i: (direct[i], -i))]
    inside = [False] * len(page.nodes)
    for root in roots:
        inside[root] = True
    for node in range(1, len(page.nodes)):
        inside[node] = inside[node] or inside[page.nodes[node][0]]
    return inside


def main_text(html: str | None, templates: list[str] | None, constant: frozenset[tuple[int, int, int]],
              slots: frozenset[tuple[int, int]] = frozenset()) -> str:
    """The main text of a page; ``constant`` has the ``(layout, node, hash)`` of the texts that belong to the templates.

    What lies below the common ancestor of the layout's text-rich varying ``slots``, ``(layout, node)``, is content
    too, whatever its tags and class words.
    """
    page = Page(html or "")
    inside = _content(page)
    fixed = set()
    if templates and (constant or slots):
        layout, nodes = _aligned(page, templates)
        rich = frozenset(n for k, n in slots if k == layout)
        if rich:
            root = slot_root(templates[layout], rich)
            inside = [x or nodes.get(node[3]) == root for x, node in zip(inside, page.nodes)]
            for i in range(1, len(inside)):
                inside[i] = inside[i] or inside[page.nodes[i][0]]
        fixed = {fold for fold, own in _texts(page).items() if fold in nodes and (layout, nodes[fold], _hash(own)) in constant}
    return " ".join(text for node, text in page.blocks if inside[node] and not page.nodes[node][2] and page.nodes[node][3] not in fixed)


def host_of(url: Column) -> Column:
    """The host in lower case; pages without one share the empty host."""
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def induce(pages: DataFrame, host: str = "_host", html: str = "html", least_pages: int = 3, common: float = 0.9, frequent: float = 0.1) -> DataFrame:
    """``(host, templates, constant, slots)`` of each host: its templates, the ``(layout, node, hash)`` of constant texts and its slots.

    Templates are the most frequent tree of the host and any other of at least ``least_pages`` pages and a share ``frequent``
    of the host's. A text is constant if ``common`` of the pages with its node have it, and these are at least ``least_pages``
    and half of the layout's, while another node of the template varies: copies of one page tell nothing. ``slots`` are the
    ``(layout, node)`` that vary on as many pages and hold a tenth or more of all such text.
    """
    def counted(batches):
        for part in slices(batches, html):
            found: dict[tuple[str, str], int] = {}
            for name, text in zip(part.column(host).to_pylist(), part.column(html).to_pylist()):
                key = name, Page(text or "").skeleton()
                found[key] = found.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([s for _, s in found], pa.string()),
                                              pa.array(list(found.values()), pa.int64())], ["host", "skeleton", "n"])

    shapes = pages.select(host, html).mapInArrow(counted, "host string, skeleton string, n bigint").groupBy("host", "skeleton").agg(F.sum("n").alias("n"))
    shapes = written(shapes, "shapes")
    totals = shapes.groupBy("host").agg(F.max(F.struct("n", "skeleton")).getField("skeleton").alias("first"), F.sum("n").alias("pages"))
    chosen = (F.col("skeleton") == F.col("first")) | ((F.col("n") >= least_pages) & (F.col("n") >= frequent * F.col("pages")))
    templates = shapes.join(totals, "host").where(chosen).groupBy("host").agg(
        F.reverse(F.sort_array(F.collect_list(F.struct("n", "skeleton")))).getField("skeleton").alias("templates"))
    # Written, so that the optimizer knows its size before the join: a small one is broadcast and no page moves.
    templates = written(templates, "templates")

    def compared(batches):
        for part in slices(batches, html):
            found: dict[tuple[str, int, int, int, int], int] = {}
            for name, text, trees in zip(*(part.column(c).to_pylist() for c in (host, html, "templates"))):
                page = Page(text or "")
                layout, nodes = _aligned(page, trees)
                # Node -1 counts the pages of the layout.
                for key in [(name, layout, -1, 0, 0), *((name, layout, nodes[fold], _hash(own), len(own)) for fold, own in _texts(page).items() if fold in nodes)]:
                    found[key] = found.get(key, 0) + 1
            names, *numbers = zip(*found) if found else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array(x, t) for x, t in zip(numbers, (pa.int32(), pa.int32(), pa.int64(), pa.int64()))],
                                              pa.array(list(found.values()), pa.int64())], ["host", "layout", "node", "hash", "size", "n"])

    joined = pages.select(host, html).join(templates.select(F.col("host").alias(host), "templates"), host)
    texts = joined.mapInArrow(compared, "host string, layout int, node int, hash bigint, size bigint, n bigint").groupBy("host", "layout", "node", "hash", "size").agg(F.sum("n").alias("n"))
    nodes = texts.groupBy("host", "layout", "node").agg(F.max(F.struct("n", "hash")).alias("top"), F.sum("n").alias("n"), F.sum(F.col("size") * F.col("n")).alias("chars"))
    same = F.col("top.n") >= common * F.col("n")
    held = F.struct("node", "n", same.alias("same"), F.col("top.hash").alias("hash"), "chars")
    layouts = nodes.groupBy("host", "layout").agg(
        F.max(F.when(F.col("node") == -1, F.col("n"))).alias("pages"), F.max(~same).alias("varies"), F.collect_list(held).alias("nodes"))
    fixed = F.transform(F.filter("nodes", lambda x: (x["node"] >= 0) & x["same"] & (x["n"] >= least_pages) & (2 * x["n"] >= F.col("pages"))),
                        lambda x: F.struct(F.col("layout"), x["node"].alias("node"), x["hash"].alias("hash")))
    varying = F.filter("nodes", lambda x: (x["node"] >= 0) & ~x["same"] & (x["n"] >= least_pages) & (2 * x["n"] >= F.col("pages")))
    layouts = layouts.where("varies").select("host", "layout", fixed.alias("fixed"), varying.alias("varying"))
    total = F.aggregate("varying", F.lit(0).cast("bigint"), lambda sum_, x: sum_ + x["chars"])
    rich = F.transform(F.filter("varying", lambda x: 10 * x["chars"] >= total), lambda x: F.struct(F.col("layout"), x["node"].alias("node")))
    per_host = layouts.select("host", "fixed", rich.alias("rich")).groupBy("host").agg(*[
        F.sort_array(F.flatten(F.collect_list(c))).alias(name) for c, name in (("fixed", "constant"), ("rich", "slots"))])
    return templates.join(per_host, "host", "left").select("host", "templates", *[F.coalesce(c, F.array()).alias(c) for c in ("constant", "slots")])


def extract(pages: DataFrame, url: str = "url", html: str = "html", out: str = "text", least_pages: int = 3) -> DataFrame:
    """Add ``out``, the main text of each page, and drop the html. NULL html is empty; empty text if there is none.

    Blocks are joined by one blank in page order; white space within a block is one blank. Repeated rows give
    repeated results. A page whose host has no template of use is read by its own structure alone.
    """
    own = [c for c in pages.columns if c not in (html, out)]
    placed = pages.select(F.struct(*own).alias("row"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    wrappers = written(induce(placed, "host", "html", least_pages), "wrappers").withColumnRenamed("host", "its_host")
    schema = placed.select("row", F.lit("").alias("text")).schema

    def task(batches):
        for part in slices(batches, "html"):
            texts = [main_text(h, t, frozenset((x["layout"], x["node"], x["hash"]) for x in c or ()), frozenset((x["layout"], x["node"]) for x in r or ()))
                     for h, t, c, r in zip(*(part.column(x).to_pylist() for x in ("html", "templates", "constant", "slots")))]
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string())], schema.names)

    # One row per host; a host with many pages is split by adaptive execution, or its row is broadcast.
    joined = placed.join(wrappers, F.col("host") == F.col("its_host"), "left")
    found = joined.select("row", "html", "templates", "constant", "slots").mapInArrow(task, schema)
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in own], F.col("text").alias(out))
