"""Rendered pages to quote items.

Python only tokenises the HTML of one page at a time; sections, categories and
text rules are column expressions (``lapidary.plans.extraction``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from lapidary import fixed

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES_P = frozenset("p div ul ol dl h1 h2 h3 h4 h5 h6 table pre form hr blockquote fieldset address".split())
_CLOSES_OWN = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
_BLOCKS = _CLOSES_P | frozenset("html body article section main nav header footer li dd dt td th tr tbody".split())


@dataclass(frozen=True)
class PageRules:
    """Where quotes stand on a page.

    Direct children of the root are read in order: a heading, or a ``div``
    holding one, opens a section; every ``list_tag`` child gives its direct
    ``item_tag`` children as items. Without ``list_tag`` the root's own
    ``item_tag`` children are the items.
    """

    root_tag: str = "div"
    root_class: str | None = fixed.PAGE_ROOT_CLASS
    headings: tuple[str, ...] = fixed.HEADING_TAGS
    list_tag: str | None = "ul"
    item_tag: str = "li"
    skipped_in_item: tuple[str, ...] = ("ul", "dl")


class _Node:
    __slots__ = ("tag", "css", "children")

    def __init__(self, tag: str, css: str = "") -> None:
        self.tag, self.css, self.children = tag, css, []

    def elements(self) -> list[_Node]:
        return [child for child in self.children if isinstance(child, _Node)]

    def walk(self) -> Iterator[_Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.elements()))

    def text(self, skipped: tuple[str, ...] = ()) -> str:
        """Text in document order, without the direct children of the skipped tags."""
        parts, stack = [], [c for c in reversed(self.children) if isinstance(c, str) or c.tag not in skipped]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                parts.append(item)
            else:
                stack.extend(reversed(item.children))
        return "".join(parts)


class _Tree(HTMLParser):
    """Element tree with the usual implied end tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.top = _Node("")
        self.open = [self.top]

    def _close_up_to(self, tag: str, limits: tuple[str, ...] | frozenset[str]) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            name = self.open[depth].tag
            if name == tag:
                del self.open[depth:]
                return
            if name in limits:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _CLOSES_P:
            self._close_up_to("p", _BLOCKS - {"p"})
        if tag in _CLOSES_OWN:
            self._close_up_to(tag, _CLOSES_OWN[tag])
        node = _Node(tag, dict(attrs).get("class") or "")
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._close_up_to(tag, frozenset() if tag in _BLOCKS else _BLOCKS)

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def _root(tree: _Tree, rules: PageRules) -> _Node:
    for node in tree.top.walk():
        if node.tag == rules.root_tag and (rules.root_class is None or rules.root_class in node.css):
            return node
    elements = tree.top.elements()
    stray_text = any(isinstance(c, str) and c.strip() for c in tree.top.children)
    return elements[0] if len(elements) == 1 and not stray_text else tree.top


def page_items(html: str, rules: PageRules) -> list[tuple[str, str]]:
    """(section heading as written, item text as written) of one page, in page order."""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    section, items = fixed.TOP_SECTION, []
    for child in _root(tree, rules).elements():
        if child.tag in rules.headings:
            section = child.text()
            continue
        if child.tag == "div":
            heading = next((n for n in child.walk() if n is not child and n.tag in rules.headings), None)
            if heading is not None:
                section = heading.text()
                continue
        if rules.list_tag is None and child.tag == rules.item_tag:
            items.append((section, child.text(rules.skipped_in_item)))
        elif rules.list_tag is not None and child.tag == rules.list_tag:
            items.extend((section, li.text(rules.skipped_in_item)) for li in child.elements() if li.tag == rules.item_tag)
    return items


def read_items(pages: DataFrame, keys: list[str], html: str, rules: PageRules = PageRules()) -> DataFrame:
    """Items of all pages: the key columns, ``item_no``, ``section`` and ``item``.

    The section travels with the item, so no later window has to carry it
    forward and pages need no shuffle. Output leaves in slices, whatever the
    number of items on a page.
    """
    types = {f.name: f.dataType.simpleString() for f in pages.schema}
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "item_no int", "section string", "item string"])

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for *key, source in batch[[*keys, html]].itertuples(index=False, name=None):
                if source is None:
                    continue
                rows.extend((*key, i, *item) for i, item in enumerate(page_items(source, rules)))
                if len(rows) >= 10_000:
                    yield pd.DataFrame(rows, columns=[*keys, "item_no", "section", "item"])
                    rows = []
            yield pd.DataFrame(rows, columns=[*keys, "item_no", "section", "item"])

    return pages.select(*keys, html).mapInPandas(convert, schema)
