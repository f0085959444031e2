"""Main text of web pages with a site style tree.

Pages of one host are merged into a tree of style nodes: a node is a path of tags with their classes and ids (numbers in
them count as one; beyond ``MAX_DEPTH`` elements a path goes no deeper). Every node of every page is observed, but for code.
What a node says is broken into features: the words of its short blocks, its long blocks as wholes, numbers masked. Over the
pages that have the node, a feature has the entropy of its spread: 1 where it is on all of them, 0 where one page has it.

* The content importance of a branch is the mean of 1 - entropy over the features of all its nodes, by words, bottom-up.
* The presentation importance of a node is the entropy of the sequences of child tags under it.
* The composite importance is their sum with the weights ``CONTENT_WEIGHT`` and 1 - ``CONTENT_WEIGHT``.
* The information of a branch is the sum of 1 - entropy over its features, for each page that has it. The branches with more
  than half of a host's information are nested; the innermost is the host's main branch. Another branch that hangs off the way
  to it, and all within, counts by its information as a share of the main branch's: a menu or an advert that is new on every
  page shares no word with others, but it says little where the articles of the host say much.
* A prior is ``NOISE`` for menus, footers, forms, comments and the like by tag, role or class, else 1. It speaks where pages are
  too few to know (then the other factors count as 1), and for what looks like an article, as long comments do.

The importance is the product of composite, share and prior, and a node below ``LOW`` loses the text that it holds itself.
The main branch and what it stands in are never low, nor are plain elements within it, so copied articles stay; but a paragraph
that stands on ``EVERYWHERE`` of its node's pages is a leaf of no importance. Where all pages of a host say the same, or fewer
than ``MIN_PAGES`` are there, nothing is known; only then do names decide, and an article element is preferred.

Statistics are sums by host and node and need no task that sees a whole host. The low nodes of all hosts are broadcast
up to a size that is checked; beyond it, pages and low nodes join on the host and a salt, so no host falls to one task.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ladderworks.llm.frames import kept, packed, row_field, unpacked

MIN_PAGES = 10
LOW = 0.2
NOISE = 0.15
CONTENT_WEIGHT = 0.9
EVERYWHERE = 0.9
MAX_DEPTH = 64
SHORT_WORDS = 24
HELD_ROWS = 200_000
BROADCAST_BYTES = 32 << 20

_OPENS = re.compile(r"<(?:!--|[!?]|(/?)([A-Za-z][^\s/>]*))")
_TAG_STOP = re.compile(r">|=\s*([\"'])")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_DIGITS = re.compile(r"[0-9]+")
#: Elements by their part in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes template svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that hold no text of a page.
CODE = frozenset("head script style noscript template iframe object svg math button select option textarea input title canvas audio video noembed noframes xmp".split())
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table thead tbody tfoot tr td th caption figure figcaption article main section div".split())
NO_CONTENT = frozenset("head nav footer aside form script style noscript template iframe object svg math button select option textarea input dialog menu title canvas audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_MARKS = "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header hidden login masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion related replies respond review reviews share sharing sidebar signup social sponsor sponsored subscribe teaser toc toolbar widget".split()
_COMMENTS = "comment comments disqus replies respond review reviews".split()
#: Words that say nothing beside a mark.
_NEUTRAL = "area bar block box buttons container inner item items link links list outer page reader section site user widget wrap wrapper".split()
#: Class tokens and ids that consist of marks and neutral words alone, one mark at least, with numbers.
_NAMED, _COMMENT = (
    re.compile(r"(?:(?:{n})[-_])*(?:{w})[-_]?\d*(?:[-_](?:{w}|{n})[-_]?\d*)*".format(w="|".join(w), n="|".join(_NEUTRAL)), re.IGNORECASE) for w in (_MARKS, _COMMENTS)
)
#: Elements that are text, whatever they are called, where an article holds them.
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6".split())
_CONTAINERS = frozenset("article main section div".split())
#: What closes an open paragraph, and elements that close others of their kind.
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": set(), "tbody": {"thead", "tbody", "tr", "td", "th"}}
_WALLS = frozenset("ul ol dl table article main section div body html nav aside footer header form td th".split())


@dataclass(slots=True)
class Node:
    """A style node on a page. ``path`` is a hash of the styles from the root on, ``named`` the depth of the last that has a class, an id or no content tag."""

    tag: str
    path: int
    code: bool
    cut: bool
    prior: float
    within: bool
    framed: bool
    inline: bool
    up: Node | None
    depth: int
    named: int
    children: list[str] = field(default_factory=list)

    def ancestors(self) -> list[int]:
        """The paths from the root to the parent."""
        out, node = [], self.up
        while node:
            out.append(node.path)
            node = node.up
        return out[::-1]


@dataclass(slots=True)
class Block:
    """A text block: its style node and its text."""

    node: Node
    text: str


class _Open:
    """The open elements: the stack, and where in it each tag, the blocks and the walls stand, so that no step searches it."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.by_tag: dict[str, list[int]] = {}
        self.blocks, self.walls, self.row_walls = [0], [0], [0]

    def push(self, node: Node) -> None:
        at = len(self.stack)
        self.stack.append(node)
        self.by_tag.setdefault(node.tag, []).append(at)
        if not node.inline:
            self.blocks.append(at)
        if node.tag in _WALLS:
            self.walls.append(at)
            if node.tag not in ("td", "th"):
                self.row_walls.append(at)

    def last(self, tag: str) -> int:
        places = self.by_tag.get(tag)
        return places[-1] if places else 0

    def cut(self, upto: int) -> None:
        while len(self.stack) > upto:
            at = len(self.stack) - 1
            self.by_tag[self.stack.pop().tag].pop()
            for places in (self.blocks, self.walls, self.row_walls):
                if places[-1] == at:
                    places.pop()


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(source)}


@lru_cache(64)
def _raw_closer(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.IGNORECASE)


def tokens(html: str) -> Iterator[tuple[str, str | None, bool, str]]:
    """(text before, tag or None, whether it closes, attributes) from left to right; every character is passed once or twice.

    A ``>`` within a quoted value doesn't end a tag. Where quotes don't match up to the end of the page, they count no more.
    The content of raw elements (scripts and the like) is no text and left out.
    """
    at, quotes = 0, True
    while True:
        m = _OPENS.search(html, at)
        if not m:
            break
        before, start = html[at : m.start()], m.end()
        if m[2] is None:
            end = html.find("-->", m.start() + 4) if m[0] == "<!--" else html.find(">", start)
            at = len(html) if end < 0 else end + (3 if m[0] == "<!--" else 1)
            yield before, None, False, ""
            continue
        end, look = -1, start
        while quotes:
            stop = _TAG_STOP.search(html, look)
            if not stop:
                quotes = False
            elif stop[1] is None:
                end = stop.start()
                break
            else:
                look = html.find(stop[1], stop.end()) + 1
                quotes = look > 0
        if end < 0:
            end = html.find(">", start)
        if end < 0:  # no tag ends from here on
            yield html[at:], None, False, ""
            return
        tag, at = m[2].lower(), end + 1
        yield before, tag, bool(m[1]), html[start:end]
        if tag in RAW and not m[1] and not (html[end - 1] == "/" and tag in ("svg", "math")):
            closer = _raw_closer(tag).search(html, at)
            at = closer.start() if closer else len(html)
    yield html[at:], None, False, ""


def _chained(parent: int, style: str) -> int:
    return xxhash.xxh64_intdigest(style.encode("utf-8", "surrogatepass"), parent & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def _placed(parent: Node, tag: str, source: str) -> tuple[Node, str]:
    """The node of a start tag, and its style."""
    facts = _attributes(source) if source.strip() else {}
    names = facts.get("class", "").split() + facts.get("id", "").split()
    style = tag
    if names:
        style += "".join(f".{c}" for c in sorted(facts.get("class", "").split())) + (f"#{facts['id']}" if facts.get("id") else "")
        style = _DIGITS.sub("0", style)
    comment = any(_COMMENT.fullmatch(n) for n in names)
    text_of_story = parent.within and tag in _TEXT
    noise = tag in NO_CONTENT or facts.get("role", "").lower() in ROLES or "hidden" in facts or facts.get("aria-hidden") == "true" or (tag == "header" and not parent.within) or (comment and tag not in ("html", "body", "main") and not text_of_story)
    by_name = tag not in ("html", "body", "main") and not text_of_story and any(_NAMED.fullmatch(n) for n in names)
    teaser = by_name and tag == "article"
    framed = parent.framed or (by_name and not noise)
    cut = parent.cut or noise or teaser or (by_name and parent.within)
    within = parent.within or (tag in ("article", "main") and not cut)
    prior = NOISE if cut or (framed and not within) else 1.0
    deep = parent.depth >= MAX_DEPTH
    depth = parent.depth if deep else parent.depth + 1
    named = parent.named if not names and tag in CONTENT else depth
    path, up = (parent.path, parent.up) if deep else (_chained(parent.path, style), parent)
    return Node(tag, path, parent.code or tag in CODE, cut, prior, within, framed, tag in INLINE, up, depth, named), style


def leaf(path: int, text: str) -> int:
    """The text as a leaf of the node, numbers masked."""
    return _masked_leaf(path, _DIGITS.sub("0", text))


def _masked_leaf(path: int, masked: str) -> int:
    return _chained(path, "#" + masked)


def blocks(html: str, low: frozenset[int] | None = None, lines: frozenset[int] = frozenset()) -> tuple[list[Block], list[Node]]:
    """The page's text blocks in order, without those of low nodes and low leaves, and its nodes. Without a tree the priors decide.

    Tags that are never closed end with their parent. The work is linear in the length of the page.
    """
    root = Node("", 0, False, False, 1.0, False, False, False, None, 0, 0)
    is_open = _Open(root)
    out: list[Block] = []
    nodes: list[Node] = [root]
    pending: list[str] = []
    holder = root

    def flush() -> None:
        if pending:
            text = " ".join(unescape("".join(pending)).split())
            pending.clear()
            if text and not holder.code and not (holder.prior < LOW if low is None else holder.path in low) and not (lines and holder.tag in _TEXT and leaf(holder.path, text) in lines):
                out.append(Block(holder, text))

    def close(upto: int) -> None:
        nonlocal holder
        if is_open.blocks[-1] >= upto or is_open.stack[upto] is holder:
            flush()
        is_open.cut(upto)
        holder = is_open.stack[is_open.blocks[-1]]

    for before, tag, closes, source in tokens(html):
        if before:
            pending.append(before)
        if tag is None:
            continue
        if closes:
            k = 0 if tag in VOID else is_open.last(tag)
            if k and not (tag in INLINE and is_open.blocks[-1] > k):
                close(k)
            continue
        if tag == "br":
            pending.append("\n")
            continue
        if tag == "hr":
            flush()
        if tag in VOID:
            continue
        if tag in _CLOSES_P and is_open.last("p") > is_open.walls[-1]:
            close(is_open.last("p"))
        siblings = _SIBLINGS.get(tag)
        if siblings:
            k = max(map(is_open.last, siblings))
            if k > 0 and k >= is_open.row_walls[-1]:
                close(k)
        parent = is_open.stack[-1]
        node, style = _placed(parent, tag, source)
        parent.children.append(style)
        if not node.inline:
            flush()
            nodes.append(node)
        if source.rstrip().endswith("/") and tag in ("svg", "math"):
            continue
        is_open.push(node)
        if not node.inline:
            holder = node
        elif node.prior < parent.prior or (node.code and not parent.code):
            flush()
            holder = node
            nodes.append(node)
    flush()
    return out, nodes


def main_text(html: str, low: frozenset[int] | None = None, lines: frozenset[int] = frozenset(), decided: bool = False) -> str:
    """Blocks that the tree left, joined by new lines.

    Where the tree knows no main branch (``decided`` is false), those of the article and main elements are the text where they
    hold at least as much of what is left as the rest; else all is. An article within an element that is named as no content
    counts only if it holds more than the others: then that element is the page's frame.
    """
    left, _ = blocks(html, low, lines)
    if decided:
        return "\n".join(b.text for b in left)
    size = lambda found: sum(len(b.text) for b in found)
    framed = [b for b in left if b.node.framed]
    article = [b for b in left if b.node.within and not b.node.framed]
    if size(framed) <= size(article):
        left = [b for b in left if not b.node.framed]
    else:
        article = [b for b in left if b.node.within]
    rest = size(left) - size(article)
    return "\n".join(b.text for b in (article if article and size(article) >= rest else left))


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def page_facts(html: str) -> tuple[dict[int, tuple[Node, int]], dict[tuple[int, int], tuple[int, int]], set[tuple[int, int]]]:
    """Of a page: its style nodes by path with a hash of the child tags under them; its features by path and hash with the words
    that each stands for and how often it occurs; its short paragraphs and headings as leaves, which the long ones are anyway."""
    found, nodes = blocks(html, frozenset())
    shapes: dict[int, tuple[Node, list[str]]] = {}
    for n in nodes:
        if not n.code:
            shapes.setdefault(n.path, (n, []))[1].extend(n.children)
    features: dict[tuple[int, int], tuple[int, int]] = {}
    lines = set()
    for b in found:
        path, masked = b.node.path, _DIGITS.sub("0", b.text)
        if masked.count(" ") >= SHORT_WORDS:
            features[path, _masked_leaf(path, masked)] = (masked.count(" ") + 1, 1)
            continue
        for w in masked.lower().split(" "):
            key = path, xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) - (1 << 63)
            known = features.get(key)
            features[key] = (1, known[1] + 1) if known else (1, 1)
        if b.node.tag in _TEXT:
            lines.add((path, _masked_leaf(path, masked)))
    return {path: (n, _hash(" ".join(children))) for path, (n, children) in shapes.items()}, features, lines


#: What a node is to the tree: an element that may hold the main branch, another one, or one that is never low.
_CONTAINER, _OTHER, _WHOLE = range(3)
_SHAPE, _FEATURE, _LINE = range(3)
_OBSERVED = pa.schema(
    [("host", pa.string()), ("path", pa.int64()), ("kind", pa.int32()), ("value", pa.int64()), ("words", pa.int64()), ("c", pa.int64()), ("s", pa.float64())]
    + [("prior", pa.float64()), ("framed", pa.bool_()), ("named", pa.int32()), ("role", pa.int32()), ("above", pa.list_(pa.int64()))]
)
_OBSERVED_DDL = "host string, path bigint, kind int, value bigint, words bigint, c bigint, s double, prior double, framed boolean, named int, role int, above array<bigint>"


def _role(n: Node) -> int:
    if n.tag in ("", "html", "body"):
        return _WHOLE
    return _OTHER if n.tag in CONTENT and n.tag not in _CONTAINERS else _CONTAINER


def _observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shapes, features and leaves of style nodes, counted up to ``HELD_ROWS`` of them; ``s`` sums c ln c over pages."""
    counts: dict[tuple, list] = {}
    nodes: dict[tuple, tuple] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        """The shapes with the facts of their nodes, then the others without."""
        for shapes in (True, False):
            found = [(*key, *tally) for key, tally in counts.items() if (key[2] == _SHAPE) == shapes]
            columns = list(zip(*found, strict=True)) if found else [[]] * 7
            columns += (list(zip(*(nodes[r[:2]] for r in found), strict=True)) if found else [[]] * 5) if shapes else [None] * 5
            arrays = [pa.nulls(len(found), f.type) if c is None else pa.array(c, f.type) for c, f in zip(columns, _OBSERVED, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=_OBSERVED)
        counts.clear()
        nodes.clear()

    def count(key: tuple, words: int, n: int) -> None:
        tally = counts.get(key)
        if tally is None:
            tally = counts[key] = [words, 0, 0.0]
        tally[1] += n
        if n > 1:
            tally[2] += n * math.log(n)

    for batch in batches:
        for host, html in zip(batch.column("host").to_pylist(), batch.column("_text").to_pylist(), strict=True):
            shapes, features, lines = page_facts(html or "")
            for path, (n, shape) in shapes.items():
                count((host, path, _SHAPE, shape), 0, 1)
                known = nodes.get((host, path))
                if known is None or n.prior < known[0]:
                    nodes[host, path] = (n.prior, n.framed, n.named, _role(n), n.ancestors())
            for (path, value), (words, n) in features.items():
                count((host, path, _FEATURE, value), words, n)
            for path, value in lines:
                count((host, path, _LINE, value), 0, 1)
            if len(counts) > HELD_ROWS:
                yield from rows()
    yield from rows()


def _statistics(pages: DataFrame, html_col: str, url_col: str, min_pages: int) -> DataFrame:
    """Sums of each style node of a host, in a row of its own for each leaf (``line``) that is on enough pages to be low."""
    own = packed(pages, html_col, host=_host(url_col)).select("host", "_text")
    seen = own.mapInArrow(_observed, _OBSERVED_DDL)
    facts = ["prior", "framed", "named", "role", "above"]
    counts = seen.groupBy("host", "path", "kind", "value").agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.max("words").alias("words"), *[F.min(f).alias(f) for f in facts])
    of = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value))
    c = F.col("c").cast("double")
    spread = F.greatest(F.lit(0.0), F.log(c) - F.col("s") / c)
    whole = (F.col("kind") == _LINE) | ((F.col("kind") == _FEATURE) & (F.col("words") > SHORT_WORDS))
    line = F.when(whole & (c >= EVERYWHERE * min_pages), F.col("value"))
    sums = [of(_SHAPE, F.col("c")).alias("pages"), of(_SHAPE, c * F.log(c)).alias("shapes"), of(_FEATURE, F.col("words")).alias("words"), of(_FEATURE, F.col("words") * spread).alias("spread")]
    return kept(counts.withColumn("line", line).groupBy("host", "path", "line").agg(*sums, F.sum("c").alias("c"), *[F.min(f).alias(f) for f in facts]))


def _tree(statistics: DataFrame, min_pages: int, low: float, names: bool) -> DataFrame:
    m, span = F.col("pages").cast("double"), F.greatest(F.log(F.col("pages").cast("double")), F.lit(1e-9))
    facts = [F.min(f).alias(f) for f in ("prior", "framed", "named", "role", "above")]
    whole = statistics.groupBy("host", "path").agg(*[F.sum(f).alias(f) for f in ("pages", "shapes", "words", "spread")], *facts)
    nodes = whole.where("pages IS NOT NULL").select(
        "host", "path", "pages", "named", "role", "framed", "above",
        (F.col("prior") if names else F.lit(1.0)).alias("prior"),
        F.when(F.col("pages") > 1, F.greatest(F.lit(0.0), (F.log(m) - F.col("shapes") / m) / F.log(m))).otherwise(1.0).alias("presentation"),
        F.coalesce("words", F.lit(0)).alias("words"),
        F.greatest(F.lit(0.0), F.coalesce(F.col("words") - F.when(F.col("pages") > 1, F.col("spread") / span).otherwise(0.0), F.lit(0.0))).alias("own"),
    )
    ways = F.concat("above", F.array("path"))
    sums = nodes.where("words > 0").select("host", F.explode(ways).alias("path"), "words", "own").groupBy("host", "path").agg(F.sum("words").alias("branch_words"), F.sum("own").alias("branch"))
    tree = nodes.join(sums, ["host", "path"], "left").withColumn("content", F.when(F.col("branch_words") > 0, F.col("branch") / F.col("branch_words")).otherwise(1.0))
    root = tree.where("path = 0").select("host", F.col("branch").alias("_all"), ((F.col("pages") >= min_pages) & (F.col("content") >= low)).alias("_known"))
    tree = tree.join(root, "host")
    heads = tree.where(F.col("_known") & (F.col("role") == _CONTAINER) & (F.col("pages") >= min_pages) & (2 * F.col("branch") > F.col("_all")))
    way = F.struct(F.size("above").alias("depth"), (F.col("branch") / F.col("pages")).alias("information"), ways.alias("way"))
    tree = tree.join(heads.groupBy("host").agg(F.max(way).alias("main")), "host", "left")
    off = F.filter(ways, lambda p: ~F.array_contains(F.col("main.way"), p))
    inside = F.array_contains(ways, F.element_at("main.way", -1))
    beside = F.col("main").isNotNull() & ~inside & (F.size(off) > 0)
    tree = tree.withColumn("_beside", F.when(beside, F.element_at(off, 1))).withColumn("_inside", F.coalesce(inside, F.lit(False)))
    tops = tree.where("_beside = path").select("host", F.col("path").alias("_beside"), F.when(F.col("pages") >= min_pages, F.least(F.lit(1.0), F.coalesce(F.col("branch") / F.col("pages"), F.lit(0.0)) / F.col("main.information"))).alias("_share"))
    tree = tree.join(tops, ["host", "_beside"], "left")
    composite = CONTENT_WEIGHT * F.col("content") + (1 - CONTENT_WEIGHT) * F.col("presentation")
    plain = F.col("_inside") & (F.col("named") <= F.col("main.depth"))
    on_way = F.col("main").isNotNull() & (F.size(off) == 0)
    by_tree = F.when(plain | on_way | (F.col("role") == _WHOLE), 1.0).when(F.col("_known") & (F.col("pages") >= min_pages), composite).otherwise(1.0)
    share = F.coalesce("_share", F.lit(1.0))
    prior = F.when(on_way | (F.col("role") == _WHOLE), 1.0).when(F.col("_beside").isNotNull() & F.col("framed") & F.lit(names), F.least("prior", F.lit(NOISE))).otherwise(F.col("prior"))
    return tree.select("host", "path", "pages", prior.alias("prior"), "presentation", "content", share.alias("share"), (prior * by_tree * share).alias("importance"), F.col("main").isNotNull().alias("decided"), "_inside")


def style_tree(pages: DataFrame, html_col: str = "html", url_col: str = "url", min_pages: int = MIN_PAGES, low: float = LOW, names: bool = True) -> DataFrame:
    """(host, path, pages, prior, presentation, content, share, importance, decided) of the style nodes of each host.

    Without ``names`` all priors are 1. ``decided`` tells the hosts that have a main branch.
    """
    return _tree(_statistics(pages, html_col, url_col, min_pages), min_pages, low, names).drop("_inside")


def _host(url_col: str) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(f"`{url_col}`").cast("string"), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = (batch.column(c).to_pylist() for c in ("_text", "low", "lines", "decided"))
        texts = [main_text(html or "", frozenset(low or ()), frozenset(lines or ()), bool(decided)) for html, low, lines, decided in zip(*sides, strict=True)]
        yield pa.RecordBatch.from_pydict({"_row": batch.column("_row"), "text": pa.array(texts, pa.string())})


def extract_main_text(pages: DataFrame, html_col: str = "html", url_col: str = "url", min_pages: int = MIN_PAGES, low: float = LOW, names: bool = True, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The pages without their html, and ``text``.

    A style node's own text is removed where the tree's importance of it is below ``low``. Without ``names`` no tag, role or
    class has a say in it, only the tree's entropies.

    * A null or empty html has an empty text; pages without a URL or host count as one host.
    * White space within a block is one space, blocks are joined by a new line; nothing else is changed or cut.
    * Repeated rows each have their own result; an empty table gives an empty table.
    * Input columns of the names of the results are replaced.
    """
    statistics = _statistics(pages, html_col, url_col, min_pages)
    tree = _tree(statistics, min_pages, low, names)
    frequent = statistics.where("line IS NOT NULL").select("host", "path", "line", F.col("c").alias("_on"))
    lines = frequent.join(tree.where("_inside"), ["host", "path"]).where(F.col("_on") >= EVERYWHERE * F.greatest("pages", F.lit(min_pages)))
    found = tree.select("host", "decided", F.when(F.col("importance") < low, F.col("path")).alias("path"), F.lit(None).cast("bigint").alias("line"))
    found = found.union(lines.select("host", "decided", F.lit(None).cast("bigint"), "line"))
    weak = found.groupBy("host").agg(F.collect_set("path").alias("low"), F.collect_set("line").alias("lines"), F.max("decided").alias("decided"))
    weak = kept(weak)
    own = packed(pages, html_col, host=_host(url_col))
    size = weak.agg(F.sum(8 * (F.size("low") + F.size("lines")) + F.octet_length("host") + 96)).first()[0] or 0
    if size <= broadcast_bytes:
        joined = own.join(F.broadcast(weak), "host", "left")
    else:
        salts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        salted = weak.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = own.withColumn("salt", F.pmod(F.xxhash64("_text"), F.lit(salts)).cast("int")).join(salted, ["host", "salt"], "left")
    joined = joined.select("_row", "_text", "low", "lines", "decided")
    found = joined.mapInArrow(_extract, T.StructType([row_field(pages, html_col), T.StructField("text", T.StringType())]))
    return unpacked(found, pages, html_col, None, text=F.col("text"))
