"""HTML extraction by wrapper induction.

A page becomes a tree of its block elements; runs of neighbouring siblings with one label are one repeating node, so
the tree of a page is as small as its layout. Per host the most frequent tree is the reference, and simple tree
matching aligns the tree of every page with it. The texts at each reference node over all pages of the host then tell
template from content: a node whose texts recur from page to page (a constant is the extreme case) is template, a node
whose texts vary is content. Pages with equal texts at all nodes that can be content count once, so copies of a page are no
evidence, whatever their menus, adverts or footers are.

Some things are template by their kind on any page, with or without same-host pages: page headers and footers, menus,
sidebars, notices, adverts, forms, scripts, styles, hidden parts and reader comments, known by element, role or class
name. Where a page marks its article (``article``, else ``main``; ``main`` too where the articles have less than ``SMALL`` of its
text), content is taken from there alone; inside, a node is template only if it is constant on nearly all of many pages.

Parsing is a small tokenizer in the tasks; trees, texts and counts are aggregated by Spark. For induction trees and
numbers per (host, tree, node, text hash) are shuffled; a host's wrapper is as large as its reference tree, and pages meet
their host's wrapper by a join, which moves them only where the wrappers are too many to be sent to all. A host with a
third of all pages is summed in every task first. Alignment walks equal subtrees once and keeps no table beyond
``TABLE`` entries, so a page of tens of thousands of blocks takes seconds and bounded memory.

Defined results: null and empty pages have an empty text and no blocks. Repeated rows are extracted one by one. A null
url belongs to the host ''. Very long pages are read whole. Trees of one count go by their text. An empty table gives an
empty result. The row stands in a struct, so names of other columns cannot clash. Elements nested deeper than ``DEPTH`` count as children of the last level, with all text;
the text of those that are template by their kind stays with them.
"""

from __future__ import annotations

import html
import json
import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from lapidary.llm.common import written
from lapidary.llm.url_filter import host

MIN_PAGES, RECURRING = 8, 0.5
MIN_PAGES_INSIDE, CONSTANT_INSIDE = 20, 0.95
#: Articles that have less than this share of the text of the main parts are cards, not the text.
SMALL = 0.5
DEPTH = 100
ALIGNED = 5000  # alignments a worker remembers
TABLE = 1 << 24  # entries of an alignment table that is kept

BLOCKS = set(
    "html head body title nav header footer aside main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption "
    "thead tbody tfoot tr td th form fieldset legend blockquote pre figure figcaption address details summary hgroup "
    "script style noscript template iframe svg math object select option button textarea label dialog menu center hr".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "xmp", "noembed"}
#: What an opening element closes when it is open: paragraphs, and the like of itself.
CLOSES_P = BLOCKS - set("html head body title script style noscript template iframe svg math object select option button textarea label td th tr tbody thead tfoot caption legend".split())
ITEMS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
         "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

NEVER = set("head title nav footer aside form script style noscript template iframe svg math object select button textarea dialog menu".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion promos nav navbar "
    "navigation menu menus breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe subscription paywall share sharing social comment comments commentlist replies respond disqus related "
    "recommended widget widgets toolbar pagination pager login signup masthead skip".split()
)

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z/][^>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Node:
    __slots__ = ("label", "tag", "out", "children", "parts")

    def __init__(self, label: str, tag: str, out: bool):
        self.label, self.tag, self.out = label, tag, out
        self.children: list[_Node] = []
        self.parts: list = []  # strings and child nodes in page order


def _node(tag: str, attributes: str, inside: bool) -> _Node:
    """``inside``: within an article or main part, where a header belongs to the text."""
    found = {}
    if attributes and not attributes.isspace():
        for name, *values in _ATTRIBUTE.findall(attributes):
            found.setdefault(name.lower(), "".join(values))
    names = re.split(r"[\s_-]+", f"{found.get('class', '')} {found.get('id', '')}".lower())
    out = (
        tag in NEVER
        or (tag == "header" and not inside)
        or found.get("role", "").lower() in ROLES
        or not NAMES.isdisjoint(names)
        or "hidden" in found
        or found.get("aria-hidden") == "true"
        or bool(_HIDDEN.search(found.get("style", "")))
    )
    label = " ".join([tag, *sorted({re.sub(r"\d+", "0", n) for n in names if n})])
    return _Node(label, tag, out)


def parse(page: str | None) -> _Node:
    """The tree of block elements; inline elements are part of the text around them."""
    page = page or ""
    root = _Node("#", "#", False)
    stack, at, size = [root], 0, len(page)
    # Open elements below DEPTH: name and the element that takes the text if it is out by kind; places by name.
    below: list[tuple[str, _Node | None]] = []
    places: dict[str, list[int]] = {}

    def top() -> _Node:
        return below and below[-1][1] or stack[-1]

    def text(piece: str) -> None:
        if piece:
            top().parts.append(piece)

    def last(tags, other: bool = False) -> int:
        """Place of the last open element below DEPTH with one of the names, or with another one; -1 without."""
        return max((p[-1] for t, p in places.items() if p and (t in tags) != other), default=-1)

    def shut(place: int, level: int | None = None) -> None:
        """Ends the elements below DEPTH from a place on, and those of the stack from a level on."""
        while len(below) > place:
            places[below.pop()[0]].pop()
        if level is not None:
            del stack[level:]

    while at < size:
        found = _TAG.search(page, at)
        if not found:
            text(page[at:])
            break
        text(page[at : found.start()])
        at = found.end()
        closing, name, attributes = (found[1] or found[4], found[2] or found[5], found[3] if found[2] else found[6])
        if not name:
            continue
        tag = name.lower()
        if closing:
            if places.get(tag):
                shut(places[tag][-1])
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    shut(0, i)
                    break
            continue
        if tag not in BLOCKS and tag not in RAW:
            if tag in ("br", "img", "wbr"):
                text(" " if tag != "wbr" else "")
            continue
        if tag in CLOSES_P or tag == "p":
            open_p, between = (last("p"), last(("p", "label", "center"), other=True)) if below else (-1, -1)
            if open_p > between:
                shut(open_p)
            for i in range(len(stack) - 1, 0, -1) if max(open_p, between) < 0 else ():
                if stack[i].tag == "p":
                    shut(0, i)
                    break
                if stack[i].tag not in ("label", "center"):
                    break
        if tag in ITEMS:
            like, until = ITEMS[tag]
            item, holder = (last(like), last(until)) if below else (-1, -1)
            if item > holder:
                shut(item)
            for i in range(len(stack) - 1, 0, -1) if max(item, holder) < 0 else ():
                if stack[i].tag in until:
                    break
                if stack[i].tag in like:
                    shut(0, i)
                    break
        node = _node(tag, attributes, any(n.tag in ("article", "main") for n in stack) or bool(below) and last(("article", "main")) >= 0)
        over = top()
        node.out = node.out or over.out
        over.parts.append(node)
        over.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            if tag == "textarea" or tag == "title":
                node.parts.append(page[at : end.start() if end else size])
            at = end.end() if end else size
        elif tag not in VOID and not attributes.rstrip().endswith("/") or tag in ("p", "div"):
            if len(stack) < DEPTH:
                stack.append(node)
            else:
                places.setdefault(tag, []).append(len(below))
                below.append((tag, below and below[-1][1] or (node if node.out else None)))
    return root


def _collapse(nodes: list[_Node]) -> list:
    """Trees [label, children] of runs of equal labels, with the nodes of each run."""
    runs: list[tuple[str, list[_Node]]] = []
    for node in nodes:
        if runs and runs[-1][0] == node.label:
            runs[-1][1].append(node)
        else:
            runs.append((node.label, [node]))
    return [[label, run, _collapse([c for n in run for c in n.children])] for label, run in runs]


def _runs(node: _Node) -> list[str]:
    """Texts between the child blocks of a node: references decoded, white space one blank, trimmed."""
    found, piece = [], []
    for part in [*node.parts, None]:
        if isinstance(part, str):
            piece.append(part)
        else:
            if piece and (line := " ".join(html.unescape("".join(piece)).split())):
                found.append(line)
            piece = []
    return found


class Page:
    """A parsed page: ``tree`` as JSON, its nodes in the order of the tree, and their texts."""

    def __init__(self, source: str | None):
        self.root = parse(source)
        self.nodes: list[list[_Node]] = []
        self.tree = json.dumps(self._plain([["#", [self.root], _collapse(self.root.children)]])[0], ensure_ascii=False, separators=(",", ":"))

    def _plain(self, runs: list) -> list:
        found = []
        for label, nodes, below in runs:
            self.nodes.append(nodes)
            found.append([label, self._plain(below)])
        return found

    def hashes(self) -> list[int]:
        """A hash of the texts of each node; 0 without text or where all of it is template by its kind."""
        found = []
        for nodes in self.nodes:
            texts = [t for n in nodes if not n.out for t in _runs(n)]
            found.append(xxhash.xxh64_intdigest("\n".join(texts)) - (1 << 63) if texts else 0)
        return found

    def content(self) -> int:
        """A hash of all text that is not template by its kind, however elements that are cut it."""
        return xxhash.xxh64_intdigest(" ".join(self._taken(self.root, set()))) - (1 << 63)

    def blocks(self, template: set[int]) -> list[str]:
        """Texts of content blocks in page order, given the places of template nodes."""
        template_nodes = {id(n) for place in template for n in self.nodes[place]}
        containers = {tag: [] for tag in ("article", "main")}
        self._find(self.root, containers)
        article, main = ([t for top in containers[tag] for t in self._taken(top, template_nodes)] for tag in ("article", "main"))
        if sum(map(len, article)) < SMALL * sum(map(len, main)):
            article = []
        return article or main or self._taken(self.root, template_nodes)

    def _taken(self, top: _Node, template: set[int]) -> list[str]:
        found: list[str] = []
        self._take(top, template, found)
        return found

    def _find(self, node: _Node, containers: dict[str, list[_Node]]) -> None:
        for child in node.children:
            if child.out:
                continue
            if child.tag in containers:
                containers[child.tag].append(child)
            if child.tag != "article":
                self._find(child, containers)

    def _take(self, node: _Node, template: set[int], found: list[str]) -> None:
        own, piece = id(node) not in template, []
        for part in [*node.parts, None]:
            if isinstance(part, str):
                piece.append(part)
                continue
            if piece and own and (line := " ".join(html.unescape("".join(piece)).split())):
                found.append(line)
            piece = []
            if part is not None and not part.out:
                self._take(part, template, found)


def _best_pairs(left: np.ndarray, right: np.ndarray, worth: np.ndarray) -> list[tuple[int, int]]:
    """Pairs in order, of most worth together, between two lists of classes; ``worth`` of two classes, 0 for no match.

    Rows of the usual table are arrays. A table beyond ``TABLE`` entries is not kept: the left list is halved and the
    cut of the right one is where the sums of both halves are most.
    """

    def sums(rows: np.ndarray, columns: np.ndarray, keep: bool) -> np.ndarray:
        row, kept = np.zeros(len(columns) + 1, np.int64), []
        for kind in rows:
            paired = row.copy()
            np.maximum(paired[1:], row[:-1] + worth[kind, columns], out=paired[1:])
            row = np.maximum.accumulate(paired)
            kept += [row] if keep else []
        return np.array([np.zeros_like(row), *kept]) if keep else row

    if not len(left) or not len(right):
        return []
    if len(left) * len(right) > TABLE and len(left) > 1:
        half = len(left) // 2
        cut = int((sums(left[:half], right, False) + sums(left[half:][::-1], right[::-1], False)[::-1]).argmax())
        later = _best_pairs(left[half:], right[cut:], worth)
        return _best_pairs(left[:half], right[:cut], worth) + [(i + half, j + cut) for i, j in later]
    table, pairs, i, j = sums(left, right, True), [], len(left), len(right)
    while i and j:
        gain = worth[left[i - 1], right[j - 1]]
        if gain and table[i, j] == table[i - 1, j - 1] + gain:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif table[i, j] == table[i - 1, j]:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


def align(tree: list, reference: list) -> dict[int, int]:
    """Simple tree matching: places of ``tree`` (in its own order) to places of ``reference``.

    Equal subtrees are one class and match whole, so a tree is walked once for itself; equal children at both ends of
    two nodes are paired at once, which never loses a match; what is left between them is compared by class.
    """
    classes: dict[tuple, int] = {}
    sizes: list[int] = []
    members: list[tuple] = []

    def class_of(node: list) -> int:
        key = (node[0], tuple(map(class_of, node[1])))
        if key not in classes:
            classes[key] = len(sizes)
            sizes.append(1 + sum(sizes[c] for c in key[1]))
            members.append(key)
        return classes[key]

    matched: dict[tuple[int, int], tuple[int, list]] = {}

    def match(a: int, b: int) -> tuple[int, list]:
        """Matched nodes below and at two classes, and the matched children."""
        if a == b:
            return sizes[a], []
        if members[a][0] != members[b][0]:
            return 0, []
        if (a, b) not in matched:
            left, right = members[a][1], members[b][1]
            head = next((i for i, (x, y) in enumerate(zip(left, right)) if x != y), min(len(left), len(right)))
            rest = min(len(left), len(right)) - head
            tail = next((i for i, (x, y) in enumerate(zip(left[::-1], right[::-1])) if x != y), rest)
            tail = min(tail, rest)
            between = (left[head : len(left) - tail], right[head : len(right) - tail])
            pairs = [(i, i) for i in range(head)]
            if all(between):
                names = [list(dict.fromkeys(x)) for x in between]
                worth = np.array([[match(x, y)[0] for y in names[1]] for x in names[0]], np.int64)
                kinds = [np.array(list(map({c: i for i, c in enumerate(n)}.get, x))) for n, x in zip(names, between)]
                pairs += [(i + head, j + head) for i, j in _best_pairs(*kinds, worth)]
            pairs += [(len(left) - tail + i, len(right) - tail + i) for i in range(tail)]
            matched[a, b] = 1 + sum(match(left[i], right[j])[0] for i, j in pairs), pairs
        return matched[a, b]

    found: dict[int, int] = {}

    def walk(a: int, b: int, at: int, to: int) -> None:
        if a == b:
            found.update(zip(range(at, at + sizes[a]), range(to, to + sizes[a])))
            return
        score, pairs = match(a, b)
        if not score:
            return
        found[at] = to
        starts, targets = ([first + 1, *(first + 1 + n for n in accumulate(sizes[c] for c in members[x][1]))] for x, first in ((a, at), (b, to)))
        for i, j in pairs:
            walk(members[a][1][i], members[b][1][j], starts[i], targets[j])

    walk(class_of(tree), class_of(reference), 0, 0)
    return found


_alignments: dict[tuple[str, str], dict[int, int]] = {}


def aligned(tree: str, reference: str) -> dict[int, int]:
    if len(_alignments) > ALIGNED:
        _alignments.clear()
    if (tree, reference) not in _alignments:
        _alignments[tree, reference] = align(json.loads(tree), json.loads(reference))
    return _alignments[tree, reference]


def _inside(tree: list, at: int, within: bool, found: dict[int, bool]) -> int:
    """Marks the places within an article or main part; gives the next place."""
    within = within or tree[0].split(" ")[0] in ("article", "main")
    found[at] = within
    at += 1
    for child in tree[1]:
        at = _inside(child, at, within, found)
    return at


def induce(pages: DataFrame) -> DataFrame:
    """``host, reference, template``: each host's reference tree and its template places; ``pages`` has ``host, html``."""

    def read(batches):
        for batch in batches:
            seen = [Page(x) for x in batch.column("html").to_pylist()]
            columns = [
                pa.array([p.tree for p in seen], pa.string()), pa.array([p.hashes() for p in seen], pa.list_(pa.int64())),
                pa.array([p.content() for p in seen], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("host"), *columns], ["host", "tree", "hashes", "content"])

    parsed = pages.select("host", "html").mapInArrow(read, "host string, tree string, hashes array<long>, content long")
    # Of pages with one content the one of the least shape counts.
    shaped = parsed.select("host", "content", F.struct(F.xxhash64("tree").alias("shape"), "tree", "hashes").alias("page"))
    distinct = written(shaped.groupBy("host", "content").agg(F.min("page").alias("page")).select("host", "page.*"), "trees")
    shapes = distinct.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.min("tree").alias("tree"))
    references = shapes.groupBy("host").agg(F.max_by("tree", F.struct("n", "tree")).alias("reference"))

    def match(batches):
        for batch in batches:
            rows = batch.to_pydict()
            for name, shape, tree, reference in zip(*(rows[c] for c in ("host", "shape", "tree", "reference"))):
                inside: dict[int, bool] = {}
                _inside(json.loads(reference), 0, False, inside)
                pairs = [(a, b) for a, b in aligned(tree, reference).items()]
                columns = [
                    pa.array([name] * len(pairs), pa.string()), pa.array([shape] * len(pairs), pa.int64()),
                    pa.array([a for a, _ in pairs], pa.int32()), pa.array([b for _, b in pairs], pa.int32()),
                    pa.array([inside[b] for _, b in pairs], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["host", "shape", "place", "slot", "inside"])

    slots = shapes.join(references, "host").select("host", "shape", "tree", "reference")
    slots = slots.mapInArrow(match, "host string, shape long, place int, slot int, inside boolean")
    texts = distinct.select("host", "shape", F.posexplode("hashes").alias("place", "hash")).filter("hash != 0")
    counted = texts.groupBy("host", "shape", "place", "hash").agg(F.count(F.lit(1)).alias("n"))
    by_slot = counted.join(slots, ["host", "shape", "place"]).groupBy("host", "slot", "inside", "hash").agg(F.sum("n").alias("n"))
    judged = by_slot.groupBy("host", "slot", "inside").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"), F.max("n").alias("most")
    )
    recurring = (F.col("n") >= MIN_PAGES) & (F.col("texts") <= RECURRING * F.col("n"))
    constant = (F.col("n") >= MIN_PAGES_INSIDE) & (F.col("most") >= CONSTANT_INSIDE * F.col("n"))
    template = judged.filter(F.when(F.col("inside"), constant).otherwise(recurring)).groupBy("host").agg(F.collect_list("slot").alias("template"))
    return references.join(template, "host", "left")


def extract(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``keep`` of ``pages``, else all) and ``blocks``; ``pages`` has ``url, html``."""
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep or pages.columns]).alias("row"), host(F.col("url")).alias("host"), "html")
    wrappers = written(induce(rows), "wrappers")

    def run(batches):
        for batch in batches:
            found = []
            for source, reference, template in zip(*(batch.column(c).to_pylist() for c in ("html", "reference", "template"))):
                page = Page(source)
                slots = set(template or ())
                places = {a for a, b in aligned(page.tree, reference).items() if b in slots} if slots else set()
                found.append(page.blocks(places))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.list_(pa.string()))], ["row", "blocks"])

    joined = rows.join(wrappers, "host", "left").select("row", "html", "reference", "template")
    return joined.mapInArrow(run, StructType([joined.schema["row"]]).add("blocks", ArrayType(StringType())))
