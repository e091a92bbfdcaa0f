"""Main text of web pages by wrapper induction.

Every page becomes a DOM tree and that a skeleton, in which neighbouring siblings of one kind (tag and
class) are one node. The skeletons of a host are aligned with its most frequent one by simple
tree matching. A node whose text is the same on nearly all distinct articles of the host is template, a
node whose text varies is a slot. Where a page marks its main text (<article>, else <main>), that is
where its slots are looked for; elsewhere it is the part of <body> with most of the slots' text.

What is no main text inside it (menus, sidebars, notices, adverts, forms, comments) is told by evidence:
by a tag that is nothing else, by a class that says nothing else, or by a class that only may say so together
with what the alignment or the links say: that its text is template, or is mostly links. Where no
tag marks the main text, template is left out altogether.

Skeletons hold digests, no text. They are all that is joined by host, so a host with a third of all pages
is no burden: its votes are counted before they are shuffled, and the join of its pages is one that
Spark splits. No walk is recursive, so the depth of a page is no limit.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from palimpsest.llm.shared import slices, written

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea title select canvas video audio".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: Elements that hold text of their own: a class word alone takes none of them away.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption caption summary dt dd td th tr table tbody article".split())
#: Elements that are not main text, by their tag; by a word of their class, id or role; by a word that may have another meaning.
NOT_TEXT = frozenset("nav footer aside form button menu dialog head input".split())
NOT_TEXT_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsored promo sidebar navbar navigation breadcrumb breadcrumbs cookie cookies gdpr newsletter disqus pagination pager masthead popup modal complementary contentinfo".split())
PERHAPS_WORDS = frozenset("sponsor promotion banner menu nav footer consent notice overlay subscribe subscription signup share sharing social related recommended recommendations comment commentlist comments reply replies respond widget toolbar login search skip copyright alert dialog".split())
HEAD_WORDS = frozenset("header topbar".split())
#: Words of classes that say where an element is, or of whom or how much, not what.
PLACE_WORDS = frozenset("also article articles blog count email facebook first follow header heading icon label last latest like more news next options popular previous print reader readers recent stories story title tools twitter user users visitor whatsapp you your area bar block body box bottom buttons center clearfix col column container content desktop entry fixed form global grid group icons inner item items js left link links list main media message mobile module outer page panel post posts primary right row secondary section site sticky text thread top wrap wrapper hidden".split())
CLOSES = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>?", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_UNSEEN = re.compile(r"\bstyle\s*=\s*(?:\"[^\"]*?display\s*:\s*none|'[^']*?display\s*:\s*none|display:none)", re.I)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Node:
    """An element: its tag, class words, children (nodes and texts) and parent; ``number`` is that of its skeleton's node, ``member`` its own in the run of that.

    ``near`` is the nearest block (or option) that it is or is in, so that nobody has to walk the inline elements between; ``depth`` counts its ancestors.
    """

    __slots__ = ("tag", "words", "children", "parent", "number", "kind", "member", "near", "depth")

    def __init__(self, tag: str, words: frozenset, kind: str, parent: Node | None) -> None:
        self.tag, self.words, self.kind, self.parent = tag, words, kind, parent
        self.children: list = []
        self.number = self.member = -1
        self.near = self if parent is None or tag in BLOCK or tag == "option" else parent.near
        self.depth = parent.depth + 1 if parent else 0


def parse(source: str) -> Node:
    """The tree of a page. Unclosed elements end where HTML says or with their parent; raw elements are left out."""
    top = node = Node("html", frozenset(), "html", None)
    at, n = 0, len(source)
    opened: dict[str, list[Node]] = defaultdict(list)  # elements of each tag that are open, the innermost last

    def close(x: Node) -> Node:
        y = node
        while y is not x.parent:
            opened[y.tag].pop()
            y = y.parent
        return x.parent

    while at < n:
        m = _TOKEN.search(source, at)
        if not m:
            node.children.append(source[at:])
            break
        if m.start() > at:
            node.children.append(source[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:  # an end tag closes the nearest element of its name, but an inline one none beyond a block
            x = opened[tag][-1] if opened[tag] else top
            block = node.near
            while block.tag == "option":
                block = block.parent.near
            if x is not top and (tag in BLOCK or x.depth > block.depth or block is top):
                node = close(x)
            elif tag == "p":
                node.children.append(Node("p", frozenset(), "p", node))
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                end = re.compile(f"</{tag}[^>]*>", re.I).search(source, at)
                at = end.end() if end else n
            continue
        if tag in ("html", "body") and node is top:
            continue
        if tag in BLOCK or tag in CLOSES:
            closes = CLOSES.get(tag, "").split() or ["p"]
            x, found = node.near, None
            while (opened["p"] or any(opened[c] for c in closes)) and x is not top and (x.tag in closes or x.tag not in BLOCK or x.tag == "p"):
                if x.tag in closes or (x.tag == "p" and tag in BLOCK):
                    found = x
                x = x.parent.near
            if found:
                node = close(found)
        words, kind = frozenset(), tag
        if "=" in m[3] or "hidden" in m[3]:
            attrs = {k.lower(): (a or b or c or "") for k, a, b, c in _ATTR.findall(m[3])}
            words = frozenset(w for k in ("class", "id", "role", "itemprop") if k in attrs for w in _WORDS.findall(attrs[k].lower())) | ({"hidden"} if "hidden" in attrs else frozenset())
            kind = f"{tag}.{attrs.get('class', '')}" if attrs else tag
            if "display" in m[3].lower() and _UNSEEN.search(m[3]):
                words |= {"hidden"}
        new = Node(tag, words, kind, node)
        node.children.append(new)
        if tag not in VOID and not m[3].endswith("/"):
            node = new
            opened[tag].append(new)
    return top


def _all(node: Node) -> Iterator[Node]:
    """The element and those below it, in page order."""
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack += [c for c in reversed(x.children) if isinstance(c, Node)]


def _up(x: Node | None) -> Iterator[Node]:
    while x is not None:
        yield x
        x = x.parent


def text_of(node: Node) -> str:
    """All text below a node, with white space as it is."""
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            stack += reversed(x.children)
    return " ".join(out)


def _links(node: Node) -> bool:
    """Whether half of the text below a node, or more, is that of links."""
    total = linked = 0
    stack = [(node, False)]
    while stack:
        x, inside = stack.pop()
        if isinstance(x, str):
            n = len("".join(x.split()))
            total, linked = total + n, linked + n * inside
        else:
            stack += [(c, inside or x.tag == "a") for c in x.children]
    return total > 0 and 2 * linked >= total


@dataclass
class Page:
    """A parsed page: its tree, the numbers of its template nodes, and the elements that mark its main text (outermost ones)."""

    top: Node
    template: frozenset
    marked: list[Node]
    holds: Counter  # how many marked elements are in an element

    @staticmethod
    def of(top: Node, template: frozenset = frozenset()) -> Page:
        articles = [x for x in _all(top) if x.tag == "article" or "articlebody" in x.words]
        chosen = {id(x): x for x in articles or [x for x in _all(top) if x.tag == "main" or "main" in x.words]}
        outer, holds = [], Counter()
        for x in chosen.values():
            above = []
            for y in _up(x.parent):
                if id(y) in chosen:
                    break
                above.append(id(y))
            else:
                outer.append(x)
                holds.update(above)
        return Page(top, template, outer, holds)

    def excluded(self, x: Node, inside: bool) -> bool:
        """Whether an element is no main text; ``inside`` the main text a header is its own."""
        if x.tag in NOT_TEXT or "hidden" in x.words or (not inside and x.tag == "header"):
            return True
        if not x.words or x.tag in ("html", "body") or (self.marked and self.holds[id(x)] == len(self.marked)):
            return False
        perhaps = PERHAPS_WORDS if inside else PERHAPS_WORDS | HEAD_WORDS
        if not x.words & (NOT_TEXT_WORDS | perhaps):
            return False
        holder = x.tag not in TEXT or x.tag == "article"
        says_nothing_else = x.words <= NOT_TEXT_WORDS | perhaps | PLACE_WORDS
        if holder and (x.words & NOT_TEXT_WORDS or says_nothing_else) or says_nothing_else and x.words & NOT_TEXT_WORDS:
            return True
        return self.constant(x) or _links(x)

    def constant(self, x: Node) -> bool:
        """Whether an element is template, with its run or alone."""
        return x.number in self.template or (x.member + 1) * MEMBER + x.number in self.template

    def kept(self, node: Node, inside: bool, template: bool) -> Iterator[Node | str | None]:
        """What is main text below a node, in page order: texts, elements as they begin, and None where a block ends."""
        stack: list = [node]
        while stack:
            x = stack.pop()
            if isinstance(x, str) or x is None:
                yield x
            elif x is node or not (self.excluded(x, inside) or (template and self.constant(x))):
                yield x
                if x.tag in BLOCK:
                    stack.append(None)
                stack += reversed(x.children)

    def content(self) -> list[tuple[Node, bool]]:
        """The elements that hold the main text, in page order, and whether each marks it itself."""
        marks = set(map(id, self.marked))
        found, stack = [], [self.top]
        while stack:
            x = stack.pop()
            if x is not self.top and self.excluded(x, False):
                continue
            if id(x) in marks:
                found.append((x, True))
            else:
                stack += [c for c in reversed(x.children) if isinstance(c, Node)]
        return found or [(self._densest(), False)]

    def _densest(self) -> Node:
        """The innermost block that still has 0.7 of the text of the one around it, and so on from the page."""
        size: Counter = Counter()
        open_: list[Node] = []
        for x in self.kept(self.top, False, True):
            if isinstance(x, Node):
                if x.tag in BLOCK or x is self.top:
                    open_.append(x)
            elif x is None:
                last = open_.pop()
                if open_:
                    size[id(open_[-1])] += size[id(last)]
            elif open_:
                size[id(open_[-1])] += len(x.strip())
        while len(open_) > 1:
            last = open_.pop()
            size[id(open_[-1])] += size[id(last)]
        node = self.top
        while size[id(node)]:
            inner = [c for c in node.children if isinstance(c, Node) and c.tag in BLOCK and c.tag != "p"]
            best = max(inner, key=lambda c: size[id(c)], default=None)
            if best is None or size[id(best)] < 0.7 * size[id(node)]:
                break
            node = best
        return node

    def blocks(self) -> list[str]:
        """The blocks of the main text."""
        out: list[str] = []
        words: list[str] = []

        def flush() -> None:
            if words:
                if text := _SPACE.sub(" ", entities.unescape("".join(words))).strip():
                    out.append(text)
                words.clear()

        for node, mark in self.content():
            for x in self.kept(node, mark or node is not self.top, not mark):
                if isinstance(x, str):
                    words.append(x)
                elif x is None or x.tag in BLOCK:
                    flush()
                elif x.tag == "br":
                    words.append(" ")
            flush()
        return out


def main_text(source: str, template: frozenset = frozenset()) -> str:
    """The main text of a page, given the numbers of its template nodes."""
    top = parse(source)
    if template:
        skeleton(top)
    return "\n\n".join(Page.of(top, template).blocks())


#: A skeleton in preorder: kind, digest of the text and parent of each node, and the digests of the elements of each run of several.
Skeleton = tuple[list[str], list[int], list[int], list[list[int]]]
MEMBER = 1 << 32  # an element of a run, from 1 on, times this and the number of its run's node is the number of it alone
WIDEST = 64  # children of a node of a skeleton; where there are more, those of a tag are one


def _digest(x: object) -> int:
    return xxhash.xxh3_64_intdigest(json.dumps(x)) >> 1 if x else 0


def skeleton(top: Node) -> Skeleton:
    """The skeleton of a page. Elements of one run get the number of its node."""
    kinds: list[str] = []
    parents: list[int] = []
    texts: list[str] = []
    members: list[list[int]] = []
    stack = [([top], -1)]
    while stack:
        run, parent = stack.pop()
        number = len(kinds)
        kinds.append(run[0].kind)
        parents.append(parent)
        own: list[str] = []
        groups: list[list[Node]] = []
        members.append([_digest(" ".join(text_of(x).split())) for x in run] if len(run) > 1 else [])
        for k, x in enumerate(run):
            x.number, x.member = number, k if len(run) > 1 else -1
            last = None
            for c in x.children:
                if isinstance(c, str):
                    own.append(c)
                elif c.tag not in BLOCK:
                    own.append(text_of(c))
                elif last and last[-1].kind == c.kind:
                    last.append(c)
                else:
                    last = [c]
                    groups.append(last)
        texts.append(" ".join(" ".join(own).split()))
        if len(groups) > WIDEST:
            by_tag: dict = {}
            for g in groups:
                by_tag.setdefault(g[0].tag, []).extend(g)
            groups = list(by_tag.values())
        stack += [(g, number) for g in reversed(groups)]
    below: list[list[int]] = [[] for _ in kinds]
    digests = [0] * len(kinds)
    for i in range(len(kinds) - 1, -1, -1):
        if texts[i] or any(below[i]):
            digests[i] = _digest([texts[i], below[i][::-1]])
        if i:
            below[parents[i]].append(digests[i])
    return kinds, digests, parents, members


def _children(tree: Skeleton) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in tree[0]]
    for i, p in enumerate(tree[2]):
        if p >= 0:
            out[p].append(i)
    return out


def matching(a: Skeleton, b: Skeleton) -> list[tuple[int, int]]:
    """Simple tree matching: pairs of node numbers of ``a`` and ``b`` in a largest mapping that keeps roots, order and kinds."""
    ka, kb, ca, cb = a[0], b[0], _children(a), _children(b)
    if ka[0] != kb[0]:
        return []
    best: dict[tuple[int, int], list[list[int]]] = {}
    weight = lambda x, y: best[x, y][-1][-1] + 1 if ka[x] == kb[y] else 0
    stack = [(0, 0, False)]
    while stack:
        x, y, ready = stack.pop()
        if (x, y) in best:
            continue
        if not ready:
            stack.append((x, y, True))
            stack += [(p, q, False) for p in ca[x] for q in cb[y] if ka[p] == kb[q] and (p, q) not in best]
            continue
        m = [[0] * (len(cb[y]) + 1) for _ in range(len(ca[x]) + 1)]
        for i, p in enumerate(ca[x], 1):
            for j, q in enumerate(cb[y], 1):
                m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + weight(p, q))
        best[x, y] = m
    out, pairs = [], [(0, 0)]
    while pairs:
        x, y = pairs.pop()
        out.append((x, y))
        m, i, j = best[x, y], len(ca[x]), len(cb[y])
        while i and j:
            w = weight(ca[x][i - 1], cb[y][j - 1])
            if w and m[i][j] == m[i - 1][j - 1] + w:
                i, j = i - 1, j - 1
                pairs.append((ca[x][i], cb[y][j]))
            elif m[i][j] == m[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return out


def article(top: Node) -> int:
    """A digest that near copies of an article share: of the first of its highest headings and of its longest block."""
    page = Page.of(top)
    title = ("h9", "")
    for node, mark in page.content():
        for x in page.kept(node, mark or node is not top, not mark):
            if isinstance(x, Node) and x.tag in ("h1", "h2", "h3") and x.tag < title[0]:
                title = x.tag, " ".join(text_of(x).split())
    return _digest([title[1], max(page.blocks(), key=len, default="")])


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 500):
        trees, shapes, articles = [], [], []
        for x in batch.column(2).to_pylist():
            top = parse(x or "")
            tree = skeleton(top)
            trees.append(json.dumps(tree, separators=(",", ":")))
            shapes.append(_digest([tree[0], tree[2]]) if tree[1][0] else None)
            articles.append(article(top))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(trees, pa.string()), pa.array(shapes, pa.int64()), pa.array(articles, pa.int64())], names=["key", "host", "tree", "shape", "article"])


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (host, tree, first tree of the host): for each node that is aligned with one of the first tree its digest, and once each those of its run's elements."""
    for batch in slices(batches, 1000):
        rows = []
        for host, tree, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            tree = json.loads(tree)
            for x, y in matching(tree, json.loads(first)):
                if tree[1][x]:
                    rows.append((host, y, tree[1][x], True))
                    rows += [(host, y, d, False) for d in {*tree[3][x]} - {0}]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.bool_()), strict=True)], names=["host", "node", "digest", "whole"])


def _templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, tree, first tree, [node, digest] of its template): the page's own nodes and elements of runs that are template."""
    for batch in slices(batches, 1000):
        keys, numbers = [], []
        for key, tree, first, constant in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            same = {(c["node"], c["digest"]) for c in constant}
            tree, mine = json.loads(tree), []
            for x, y in matching(tree, json.loads(first)):
                if (y, tree[1][x]) in same:
                    mine.append(x)
                mine += [(k + 1) * MEMBER + x for k, d in enumerate(tree[3][x]) if (y, d) in same]
            if mine:
                keys.append(key)
                numbers.append(mine)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(numbers, pa.list_(pa.int64()))], names=["key", "template"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 500):
        texts = [main_text(x or "", frozenset(t or ())) for x, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def templates(pages: DataFrame, min_pages: int = 10, min_share: float = 0.9) -> DataFrame:
    """key and template (numbers of its skeleton's nodes) of the pages that have template, of rows (key, host, html).

    A node is template when at least ``min_pages`` distinct articles of its host have it and ``min_share`` of
    them with the same text, and so is an element of a run that they all have; copies and near copies of an article count once. Pages without text are
    no layout to align with.
    """
    trees = written(pages.mapInArrow(_skeletons, "key long, host string, tree string, shape long, article long"), "skeletons")
    distinct = trees.groupBy("host", "article").agg(F.min(F.struct("key", "shape")).alias("page")).select("host", "page.*")
    shapes = distinct.where("shape is not null").groupBy("host", "shape").agg(F.count("*").alias("n"), F.min("key").alias("key"))
    first = shapes.groupBy("host").agg(F.max_by("key", F.struct("n", "shape")).alias("key"))
    first = written(trees.join(first.select("key"), "key", "left_semi").groupBy("host").agg(F.min("tree").alias("first")), "first-skeletons")
    votes = trees.join(distinct.select("key"), "key", "left_semi").join(first, "host").select("host", "tree", "first").mapInArrow(_votes, "host string, node int, digest long, whole boolean")
    votes = written(votes.groupBy("host", "node", "digest").agg(F.count("*").alias("most"), F.count_if("whole").alias("whole")), "votes")
    nodes = votes.groupBy("host", "node").agg(F.sum("whole").alias("n")).where(F.col("n") >= min_pages)
    constant = votes.where(F.col("most") >= min_share * min_pages).join(nodes, ["host", "node"]).where(F.col("most") >= min_share * F.col("n")).groupBy("host").agg(F.collect_list(F.struct("node", "digest")).alias("constant"))  # what nearly all pages of a host have
    return trees.join(first.join(constant, "host"), "host").select("key", "tree", "first", "constant").mapInArrow(_templates, "key long, template array<long>")


def extract_pages(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text (empty if there is none), n_chars.

    A null or empty html gives an empty text; a null url is a host of its own; a row with a null page_id, and rows that
    share one, are told from others by their html and url. Character references are decoded, white space inside a
    block is one space, blocks are joined by a blank line. An empty table gives an empty result; other
    columns are not read.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", 1)), F.lit(""))
    rows = rows.withColumn("key", F.xxhash64("page_id", "url", F.crc32(F.coalesce("html", F.lit("")))))
    found = written(templates(rows.select("key", host.alias("host"), "html")), "templates").groupBy("key").agg(F.first("template").alias("template"))
    out = rows.join(found, "key", "left").select("page_id", "url", "html", "template").mapInArrow(_texts, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
