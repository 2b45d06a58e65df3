"""Main text of web pages by wrapper induction over the pages of a host.

A page's block elements form a tree.  Siblings of one shape are folded (a list of any length looks
alike), containers of one shape only from the third on, so an article and a comment stay apart even
where both are plain ``div``s.  The folded trees of a host are aligned by simple tree matching and
merged into one wrapper; every block of a page belongs to a node of its host's wrapper.

What the host's pages show at a node decides.  A slot's weight is the text outside links that varies
there from page to page, text that stays counting a quarter.  The main part of a page is the element
that holds the weight and has running text of its own: one goes down from the page, or from its
heaviest ``article`` or ``main``, while a single container holds more than half.  Elements that are by
definition something else (``nav``, ``footer``, ``aside``, ``form`` and such) count nowhere; class
words that name such parts lower their weight, and inside the main part they go if they hold less
than half of it.
Inside the main part, text that stands at its node on most pages is template if the main parts of
those pages differ otherwise; pages that are near copies of each other prove nothing.
"""

from __future__ import annotations

import html as htmllib
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm._common import map_batches
from marlstone.session import materialize, table

#: Text is template if it stands at its node on this share of the pages that have the node, on so many pages
#: at least (two may quote one passage), and if this share of those pages' other main text differs.
CONSTANT, LEAST_PAGES, DIFFERENT = 0.5, 3, 0.3
#: What stands beside the heaviest part is of the article if it is on this share of the pages that have that
#: part, or weighs this share of it.
COMMON, PART = 0.9, 0.25
#: Weight of text that stays, and of parts named like something else; short blocks, under about so many
#: characters, weigh little.
STAYING, NAMED, SHORT = 0.25, 0.25, 30
#: Elements nested deeper are children of the element at this depth; what they stood in marks them.
DEPTH = 150
#: Containers of one shape that stay apart; further ones share the last one's node.
APART = 3
#: Trees merged by one task at once; more distinct trees of a host take further rounds.
MERGE = 256

BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without main text, dropped whole by the scanner.
RAW = "script|style|noscript|template|svg|math|iframe|object|canvas|textarea|select|button|title|audio|video"
#: A start tag of the key closes an open element of the value, if none of the bounds is nearer.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody"}, "tfoot": {"tbody"}}
BOUNDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}}
#: Elements inside which a paragraph may stay open while they are.
PARAGRAPH_BOUNDS = BLOCK - {"p"}

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PLAIN = re.compile(r"[^a-z0-9]+")

#: Words of a class, id or role that name what is not main text (a tie-break, see above).
OUTSIDE = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "footer sidebar aside complementary contentinfo cookie cookies consent gdpr notice notices notification alert alertdialog dialog banner toolbar "
    "newsletter subscribe subscription signup popup modal overlay share sharing social related recommended recommendations comment comments disqus "
    "respond replies pagination pager search searchbox login copyright widget widgets skip hidden".split()
)
OUTSIDE_TAGS = frozenset("nav footer aside form dialog menu search".split())
#: These count only outside an article.
HEADING_AREA = frozenset({"header", "masthead", "topbar"})
MAIN_TAGS = frozenset({"article", "main"})
#: Headings of an article's parts.
HEADINGS = frozenset("h2 h3 h4 h5 h6".split())
#: Elements that may be lists of links.
LISTS = frozenset("ul ol dl table div section details".split())


def _label(tag: str, attrs: str) -> str:
    """Tag with the words of its class, id and role, digits as 0; ``hidden`` marks what isn't shown."""
    if not attrs.strip():
        return tag
    words = []
    for name, value in _ATTR.findall(attrs):
        name = name.lower()
        if name in ("class", "id", "role"):
            words.extend(w for w in _PLAIN.split(re.sub(r"\d+", "0", value.lower())) if w)
        elif name == "hidden" or (name == "aria-hidden" and "true" in value.lower()) or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            words.append("hidden")
    return ".".join([tag, *dict.fromkeys(words)])


def _names(label: str) -> tuple[str, frozenset[str]]:
    tag, *words = label.split(".")
    return tag, frozenset(words)


def parse(page: str | None) -> tuple[str, list[tuple[int, str, int]]]:
    """Folded tree of a page, and its blocks ``(preorder node, text, characters inside links)``.

    Malformed markup is mended as browsers do in the common cases: open paragraphs and items end
    where the next begins, stray end tags are passed over, missing ones are supplied.
    """
    page = page or ""
    labels, parents = ["#"], [-1]
    stack: list[tuple[str, int, str]] = [("#", 0, "")]  # tag, node, marks that what stands deeper takes over
    blocks: list[tuple[int, str, int]] = []
    run: list[str] = []
    links = [0, 0]  # open links, characters inside links

    def flush() -> None:
        if run:
            text = " ".join("".join(run).split())
            if text:
                blocks.append((stack[-1][1], text, min(links[1], len(text))))
            run.clear()
            links[1] = 0

    def put(raw: str) -> None:
        text = htmllib.unescape(raw) if "&" in raw else raw
        run.append(text)
        if links[0]:
            links[1] += len(text.strip())

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            links[0] = 0 if m["end"] else 1
        if tag not in BLOCK:
            if tag in ("br", "hr", "img", "input", "wbr"):
                flush() if tag == "hr" else run.append(" " if tag == "br" else "")
            continue
        flush()
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in ("html", "body"):
            if any(t == tag for t, _, _ in stack):
                continue
        else:
            closing = CLOSES.get(tag)
            bounds = BOUNDS.get(tag, {"table"} if closing and tag[0] == "t" else ())
            for i in range(len(stack) - 1, 0, -1):
                t = stack[i][0]
                if t == "p" or (closing and t in closing):
                    del stack[i:]
                    if t == "p" and closing:
                        continue
                    break
                if t in bounds or (not closing and t in PARAGRAPH_BOUNDS):
                    break
        label, marks = _label(tag, m["attrs"]), stack[-1][2]
        if marks:
            label = f"{label}.{marks}"
        if len(stack) >= DEPTH and not marks:
            words = _names(label)[1]
            marks = "hidden" if tag in OUTSIDE_TAGS or "hidden" in words else ".".join(sorted(words & OUTSIDE))
        labels.append(label)
        parents.append(stack[min(len(stack), DEPTH) - 1][1])
        if not m["attrs"].rstrip().endswith("/") or tag not in VOID:
            stack.append((tag, len(labels) - 1, marks))
    if at < len(page):
        put(page[at:])
    flush()
    tree, folded = fold(labels, parents)
    return tree, [(folded[n], t, x) for n, t, x in blocks]


def fold(labels: list[str], parents: list[int]) -> tuple[str, list[int]]:
    """Text of the tree in which siblings of one shape are one, and the preorder number there of each element.

    Elements come parents first, siblings in order.  Containers of one shape are kept apart up to the
    ``APART``-th.
    """
    n = len(labels)
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        children[parents[i]].append(i)
    shapes: dict[tuple, int] = {}
    shape, nth = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        seen: dict[int, int] = {}
        for c in children[i]:
            k = seen.get(shape[c], 0)
            seen[shape[c]] = k + 1
            nth[c] = min(k, APART - 1) if children[c] else 0
        kinds = tuple(dict.fromkeys((shape[c], nth[c]) for c in children[i]))
        shape[i] = shapes.setdefault((labels[i], kinds), len(shapes))
    node: dict[tuple[int, int, int], int] = {}
    own, kids, names = [0] * n, [[]], [labels[0]]
    for i in range(1, n):
        key = (own[parents[i]], shape[i], nth[i])
        if key not in node:
            node[key] = len(kids)
            kids[key[0]].append(len(kids))
            kids.append([]), names.append(labels[i])
        own[i] = node[key]
    order, text = [0] * len(kids), []
    todo: list[tuple[int, str]] = [(0, "")]
    count = 0
    while todo:
        k, sign = todo.pop()
        if sign:
            text.append(sign)
            continue
        order[k], count = count, count + 1
        text.append(names[k])
        if kids[k]:
            todo.append((0, ")"))
            for j, c in enumerate(reversed(kids[k])):
                todo.append((c, ""))
                todo.append((0, "," if j < len(kids[k]) - 1 else "("))
    return "".join(text), [order[k] for k in own]


# -- trees as text: label(child,child) ----------------------------------------------------------

def read_tree(text: str) -> tuple[str, list]:
    """A tree ``(label, children)`` from its text."""
    root: tuple[str, list] = ("", [])
    path, name = [root], ""
    for token in re.findall(r"[(),]|[^(),]+", text):
        if token == "(":
            path.append(path[-1][1][-1])
        elif token == ")":
            path.pop()
        elif token != ",":
            path[-1][1].append((token, []))
    return root[1][0]


def write_tree(tree: tuple[str, list]) -> str:
    inner = ",".join(map(write_tree, tree[1]))
    return f"{tree[0]}({inner})" if inner else tree[0]


def match(a: tuple[str, list], b: tuple[str, list], memo: dict | None = None) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: size of the largest order-keeping match of two trees with equal roots, and the
    pairs of children it joins."""
    memo = {} if memo is None else memo
    key = (id(a), id(b))
    if key in memo:
        return memo[key]
    if a[0] != b[0]:
        memo[key] = 0, []
        return memo[key]
    n, m = len(a[1]), len(b[1])
    w = [[match(x, y, memo)[0] for y in b[1]] for x in a[1]]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + w[i - 1][j - 1])
    pairs, i, j = [], n, m
    while i and j:
        if w[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + w[i - 1][j - 1]:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    memo[key] = best[n][m] + 1, pairs[::-1]
    return memo[key]


def merge(a: tuple[str, list], b: tuple[str, list], memo: dict | None = None) -> tuple[str, list]:
    """The wrapper of two trees with equal roots: matched children merge, others are kept where they stand.

    A child that only stands in another order joins the unmatched namesake most like it.
    """
    memo = {} if memo is None else memo
    pairs = dict(match(a, b, memo)[1])
    back = {j: i for i, j in pairs.items()}
    joined = {i: merge(a[1][i], b[1][j], memo) for i, j in pairs.items()}
    free = [i for i in range(len(a[1])) if i not in pairs]
    out, put = [], 0
    for j, c in enumerate(b[1]):
        if j in back:
            while put <= back[j]:
                out.append(put)
                put += 1
            continue
        i = max((i for i in free if a[1][i][0] == c[0]), key=lambda i: match(a[1][i], c, memo)[0], default=None)
        if i is None:
            out.append(c)
        else:
            joined[i] = merge(a[1][i], c, memo)
            free.remove(i)
    out.extend(range(put, len(a[1])))
    return a[0], [joined.get(x, a[1][x]) if isinstance(x, int) else x for x in out]


def place(tree: tuple[str, list], wrapper: tuple[str, list]) -> list[int]:
    """For each node of a tree, in preorder, the preorder number of its node in the wrapper, -1 if it has none.

    Children are aligned by simple tree matching; one left over takes the namesake most like it.
    """
    memo: dict = {}
    start: dict[int, int] = {}

    def number(w: tuple[str, list], n: int) -> int:
        start[id(w)] = n
        n += 1
        for c in w[1]:
            n = number(c, n)
        return n

    number(wrapper, 0)
    out: list[int] = []

    def walk(t: tuple[str, list], w: tuple[str, list] | None) -> None:
        out.append(-1 if w is None else start[id(w)])
        pairs = dict(match(t, w, memo)[1]) if w else {}
        for i, c in enumerate(t[1]):
            if i in pairs:
                walk(c, w[1][pairs[i]])
            else:
                walk(c, max((x for x in w[1] if x[0] == c[0]), key=lambda x: match(c, x, memo)[0], default=None) if w else None)

    walk(tree, wrapper)
    return out


def flatten(tree: tuple[str, list]) -> tuple[list[str], list[int]]:
    """Labels and parents of a tree's nodes in preorder; the root's parent is -1."""
    labels, parents = [], []

    def walk(t: tuple[str, list], parent: int) -> None:
        at = len(labels)
        labels.append(t[0]), parents.append(parent)
        for c in t[1]:
            walk(c, at)

    walk(tree, -1)
    return labels, parents


def main_nodes(labels: list[str], parents: list[int], weight: list[float], chars: list[float], linked: list[float], varying: list[float], pages: list[float]) -> list[bool]:
    """Which nodes of a page's tree, in preorder, hold its main text, by what its host shows at them.

    ``weight``, ``chars``, ``linked`` and ``varying`` are a node's own text: its weight, its characters, those
    inside links and those outside that don't stay, on average over the ``pages`` of the host that have it.

    From the top a container is left for its heaviest child only if all that stands beside the child is
    boilerplate: barred or named as something else, mostly links, mostly text that stays, or small and
    missing on other pages, as readers' comments are.
    """
    n = len(labels)
    kids: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        kids[parents[i]].append(i)
    named = [_names(x) for x in labels]
    barred = [tag in OUTSIDE_TAGS or "hidden" in words for tag, words in named]
    inside = [False] * n  # of an article or main element
    for i in range(1, n):
        barred[i] = barred[i] or barred[parents[i]]
        inside[i] = inside[parents[i]] or named[i][0] in MAIN_TAGS

    lowered, low = [False] * n, [False] * n  # low: by its own name
    for i in range(1, n):
        tag, words = named[i]
        low[i] = bool(words & OUTSIDE) or (not inside[i] and (tag == "header" or bool(words & HEADING_AREA)))
        lowered[i] = lowered[parents[i]] or low[i]

    def sums(own: list[float]) -> list[float]:
        out = [0.0 if barred[i] else own[i] for i in range(n)]
        for i in range(n - 1, 0, -1):
            out[parents[i]] += out[i]
        return out

    total = sums([w * NAMED if named_so else w for w, named_so in zip(weight, lowered)])
    semantic = [i for i in range(1, n) if named[i][0] in MAIN_TAGS and total[i] > 0 and total[i] * 10 >= total[0]]
    top = max(semantic, key=lambda i: (total[i], -i), default=0)
    length, link = sums(chars), sums(linked)
    varies, present = sums(varying), list(pages)
    for i in range(n - 1, 0, -1):
        present[parents[i]] = max(present[parents[i]], present[i])

    def part(k: int, best: int) -> bool:
        """Whether what stands at k, beside the heaviest, is main text as well."""
        if barred[k] or low[k] or 2 * link[k] >= length[k] or 2 * varies[k] <= length[k]:
            return False
        return present[k] >= COMMON * present[best] or total[k] >= PART * total[best]

    aside: list[int] = []
    while named[top][0] != "article" and not weight[top]:
        heavy = [k for k in kids[top] if total[k] > 0]
        best = max(heavy, key=lambda k: (total[k], -k), default=None)
        if best is None or not kids[best]:
            break
        if any(part(k, best) for k in heavy if k != best):
            aside = [k for k in kids[top] if k != best and kids[k] and not part(k, best)]
            break
        top = best
    total = sums(weight)
    for i in range(top + 1, n):
        named_out = lowered[i] and not lowered[parents[i]] and 2 * total[i] < total[top]
        barred[i] = barred[i] or barred[parents[i]] or named_out or i in aside
    tops = {top} | ({k for k in kids[parents[top]] if labels[k] == labels[top]} if named[top][0] == "article" else set())
    keep, titled = [False] * n, False
    for i in range(n):
        if barred[i]:
            continue
        if i in tops:
            keep[i] = True
        elif i and keep[parents[i]]:
            menu = not inside[i] and named[i][0] in LISTS and 2 * link[i] > length[i]
            keep[i] = not menu
        titled = titled or (keep[i] and named[i][0] == "h1" and weight[i] > 0)
    if not titled:  # the heading may stand before the main part
        before = [i for i in range(top) if named[i][0] == "h1" and not barred[i] and weight[i] > 0]
        if before:
            keep[before[-1]] = True
    return keep


# -- over tables --------------------------------------------------------------------------------

def scan(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, url, host, tree, blocks)`` of every page; a url without a host belongs to host ''."""

    def run(cols: dict[str, list]) -> dict[str, object]:
        parsed = [parse(h) for h in cols["html"]]
        blocks = [[{"node": n, "text": t, "linked": x} for n, t, x in b] for _, b in parsed]
        return {k: v for k, v in cols.items() if k != "html"} | {"tree": [t for t, _ in parsed], "blocks": blocks}

    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    source = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), host.alias("host"), F.col(html).cast("string").alias("html"))
    return map_batches(source, run, "page_id long, url string, host string, tree string, blocks array<struct<node:int,text:string,linked:int>>")


def induce(trees: DataFrame) -> DataFrame:
    """``(host, wrapper)``: the merged tree of each host from its distinct ``trees(host, tree, n)``.

    Rounds of at most ``MERGE`` trees a task, the most frequent first, until every host has one.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n", "tree"], ascending=[False, True])
        wrapper = read_tree(group["tree"].iloc[0])
        for t in group["tree"].iloc[1:]:
            wrapper = merge(wrapper, read_tree(t))
        return pd.DataFrame({"host": [group["host"].iloc[0]], "tree": [write_tree(wrapper)], "n": [int(group["n"].sum())]})

    while (most := trees.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        parts = max(1, -(-most // MERGE))
        trees = trees.groupBy("host", F.pmod(F.xxhash64("tree"), F.lit(parts)).alias("part")).applyInPandas(run, "host string, tree string, n long")
        trees = materialize(trees, "wrappers")
    return trees.select("host", F.col("tree").alias("wrapper"))


@lru_cache(64)
def _wrapper(text: str) -> tuple[str, list]:
    return read_tree(text)


def align(trees: DataFrame, wrappers: DataFrame) -> DataFrame:
    """``(host, tree, nodes)``: the wrapper node of each node of each distinct tree."""

    def run(cols: dict[str, list]) -> dict[str, object]:
        nodes = [place(read_tree(t), _wrapper(w)) for t, w in zip(cols["tree"], cols["wrapper"])]
        return {"host": cols["host"], "tree": cols["tree"], "nodes": nodes}

    return map_batches(trees.join(wrappers, "host").select("host", "tree", "wrapper"), run, "host string, tree string, nodes array<int>")


#: What a host's pages show at a wrapper node.
SHOWN = ("weight", "chars", "linked", "varying", "pages")


def main_parts(aligned: DataFrame, shown: DataFrame) -> DataFrame:
    """``(host, tree, nodes, main)``: which nodes of each distinct tree are main text.

    ``shown(host, node, *SHOWN)`` says what a host's pages show at a wrapper node.
    """
    slots = shown.groupBy("host").agg(F.collect_list(F.struct("node", *SHOWN)).alias("slots"))  # a row for each wrapper node

    def run(cols: dict[str, list]) -> dict[str, object]:
        out = []
        for tree, nodes, slots in zip(cols["tree"], cols["nodes"], cols["slots"]):
            by = {s["node"]: s for s in slots or ()}
            own = [[by[k][c] if k >= 0 and k in by else 0.0 for k in nodes] for c in SHOWN]
            out.append(main_nodes(*flatten(read_tree(tree)), *own))
        return {k: cols[k] for k in ("host", "tree", "nodes")} | {"main": out}

    joined = aligned.join(slots, "host", "left").select("host", "tree", "nodes", "slots")
    return map_batches(joined, run, "host string, tree string, nodes array<int>, main array<boolean>")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)``: the main text of every page.

    Null or empty html, and pages without main text, give an empty text; repeated rows each get a
    row (and count as one page when template is told from content); a host of one page is judged by
    that page; an empty table gives none.  Texts and pages of any length are read whole.
    """
    scanned = materialize(scan(pages, page_id, url, html), "scanned")
    trees = materialize(scanned.groupBy("host", "tree").agg(F.count("*").alias("n")), "trees")
    aligned = materialize(align(trees, induce(trees)).withColumn("shape", F.xxhash64("tree")), "aligned")
    # aligned and what is made of it have a row for each host and tree; Spark broadcasts them only if their written size is small
    slim = F.transform("blocks", lambda b: F.struct(b["node"].alias("own"), F.xxhash64(b["text"]).alias("key"), F.length(b["text"]).alias("chars"), b["linked"].alias("linked")))
    slim = scanned.select("host", F.xxhash64("tree").alias("shape"), slim.alias("blocks")).withColumn("page", F.xxhash64("shape", "blocks"))
    slim = slim.dropDuplicates(["host", "page"]).join(aligned.select("host", "shape", "nodes"), ["host", "shape"])
    placed = F.transform("blocks", lambda b: F.struct(F.get("nodes", b["own"]).alias("node"), b["own"].alias("own"), b["key"].alias("key"), b["chars"].alias("chars"), b["linked"].alias("linked")))
    slim = materialize(slim.select("host", "shape", F.array_distinct(placed).alias("blocks")), "slim")
    slots = F.array_distinct(F.transform("blocks", lambda b: F.struct(b["node"].alias("node"), b["key"].alias("key"))))
    often = slim.select("host", F.explode(slots).alias("s")).groupBy("host", "s.node", "s.key").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PAGES)
    by_node = slim.select("host", F.explode(F.array_distinct("blocks.node")).alias("node")).groupBy("host", "node").agg(F.count("*").alias("pages"))
    by_node = materialize(by_node, "slots")
    stays = often.join(by_node, ["host", "node"]).where(F.col("n") >= CONSTANT * F.col("pages"))
    stays = materialize(stays.groupBy("host").agg(F.collect_list(F.struct("node", "key")).alias("stays")), "stays")  # 1 / CONSTANT texts a slot on average
    has = lambda c, b: F.coalesce(F.array_contains(c, F.struct(b["node"].alias("node"), b["key"].alias("key"))), F.lit(False))
    flagged = F.transform("blocks", lambda b: F.struct(b["node"].alias("node"), b["own"].alias("own"), b["key"].alias("key"), b["chars"].alias("chars"), b["linked"].alias("linked"), has("stays", b).alias("stays")))
    slim = slim.join(stays, "host", "left").select("host", "shape", flagged.alias("blocks"))
    free = (F.col("b.chars") - F.col("b.linked")).cast("double")
    weight = free * free / (free + SHORT) * F.when(F.col("b.stays"), STAYING).otherwise(1.0)
    sums = slim.select("host", F.explode("blocks").alias("b")).groupBy("host", "b.node").agg(F.sum(weight).alias("weight"), F.sum("b.chars").alias("chars"), F.sum("b.linked").alias("linked"), F.sum(F.when(F.col("b.stays"), 0.0).otherwise(free)).alias("varying"))
    shown = sums.join(by_node, ["host", "node"]).select("host", "node", *[(F.col(c) / F.col("pages")).alias(c) for c in SHOWN[:-1]], F.col("pages").cast("double").alias("pages"))
    parts = materialize(main_parts(aligned, shown).withColumn("shape", F.xxhash64("tree")), "main")
    main = slim.join(parts.select("host", "shape", "main"), ["host", "shape"]).select("host", F.filter("blocks", lambda b: F.get("main", b["own"])).alias("blocks"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, b: n + b["chars"])
    main = main.select("host", "blocks", total(F.col("blocks")).alias("all"), total(F.filter("blocks", lambda b: ~b["stays"])).alias("varying"))
    other = main.select("host", "all", "varying", F.explode(F.filter("blocks", lambda b: b["stays"])).alias("b"))
    share = F.col("varying") / F.greatest(F.col("all") - F.col("b.chars"), F.lit(1))
    fixed = other.groupBy("host", "b.node", "b.key").agg(F.avg(share).alias("share")).where(F.col("share") >= DIFFERENT)
    fixed = fixed.groupBy("host").agg(F.collect_set(F.struct("node", "key")).alias("fixed"))  # some of ``stays``
    known = materialize(parts.join(fixed, "host", "left"), "known")
    chosen = scanned.join(known, ["host", "tree"])
    template = lambda b: F.coalesce(F.array_contains("fixed", F.struct(F.get("nodes", b["node"]).alias("node"), F.xxhash64(b["text"]).alias("key"))), F.lit(False))
    blocks = F.filter("blocks", lambda b: F.get("main", b["node"]) & ~template(b))
    text = F.array_join(F.transform(blocks, lambda b: b["text"]), "\n")
    return chosen.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
