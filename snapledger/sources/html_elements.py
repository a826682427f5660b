"""HTML text to element rows. The only HTML parsing in the package; decisions are made on the rows.

Elements are numbered in document order: ``pos`` is an element's own number, ``last`` the largest below it. So x contains y
when x.pos < y.pos <= x.last, and ``under`` answers questions about ancestors with one running maximum per page. A page's text is
kept once; an element's text is a slice of it. Work and rows are linear in the page as long as ``chain`` is off and ``texts`` and
``peer_chars`` ask for no more than the caller reads; only nested elements that are all asked for their text repeat it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from snapledger.staging import spread

# Elements without content, and which open element an opening tag closes.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES = {
    "a": ("a",), "li": ("li",), "p": ("p",), "tr": ("td", "th", "tr"), "td": ("td", "th"),
    "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",),
}
_SCOPE = frozenset("ul ol table dl div section article body html select".split())

_UNSEEN = frozenset(("script", "style", "template", "noscript"))


def _hidden(attrs: dict) -> bool:
    style = attrs.get("style", "").replace(" ", "")
    return (
        "hidden" in attrs or attrs.get("aria-hidden") == "true"
        or "display:none" in style or "visibility:hidden" in style
    )


ELEMENT_FIELDS = [
    T.StructField("pos", T.IntegerType()),
    T.StructField("last", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("text", T.StringType()),
    T.StructField("raw", T.StringType()),
    T.StructField("peer", T.StringType()),
    T.StructField("titles", T.ArrayType(T.StringType())),
    T.StructField(
        "chain",
        T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), T.StructField("attrs", T.StringType())])),
    ),
]

_NAMES = [f.name for f in ELEMENT_FIELDS]


@dataclass(frozen=True)
class Want:
    """Elements by tag, or by an attribute (with a pattern found in its value, or any value)."""

    tags: frozenset[str] = frozenset()
    attrs: dict[str, str | None] = field(default_factory=dict)

    def __call__(self, node: _Node) -> bool:
        if node.tag in self.tags:
            return True
        return bool(node.attrs) and any(
            name in node.attrs and (pattern is None or re.search(pattern, node.attrs[name]))
            for name, pattern in self.attrs.items()
        )


class _Node:
    __slots__ = ("attrs", "children", "depth", "last", "parent", "pos", "start", "stop", "tag")

    def __init__(self, tag: str, attrs: dict, parent: _Node | None, pos: int, start: int) -> None:
        self.tag, self.attrs, self.parent, self.pos, self.children = tag, attrs, parent, pos, []
        self.last, self.start, self.stop = pos, start, start
        self.depth = parent.depth + 1 if parent is not None else 0

    def raw(self) -> str:
        parts, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                parts.append(node)
            else:
                stack.extend(reversed(node.children))
        return "".join(parts)

    def visible(self) -> str:
        """Text without scripts, styles, templates and hidden elements."""
        parts, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                parts.append(node)
            elif node.tag not in _UNSEEN and not _hidden(node.attrs):
                stack.extend(reversed(node.children))
        return " ".join(" ".join(parts).split())

    def child(self, tag: str) -> _Node | None:
        return next((c for c in self.children if not isinstance(c, str) and c.tag == tag), None)

    def marks(self) -> str:
        return " ".join(self.attrs.get(name) or "" for name in ("class", "id", "role"))


# Plain markup: text, a doctype, an end tag, a start tag whose attributes are quoted and hold no references.
_PLAIN = re.compile(
    r"""([^<]+)|<(?:/([a-zA-Z][a-zA-Z0-9]*)|([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\r\n]+[a-zA-Z][a-zA-Z0-9-]*="[^"&<>]*")*)[ \t\r\n]*(/?)"""
    r"""|!(?i:doctype)[^>]*)>"""
)
_ATTRIBUTE = re.compile(r'([a-zA-Z][a-zA-Z0-9-]*)="([^"]*)"')
# Elements whose content the parser reads by other rules.
_OWN_RULES = frozenset((*HTMLParser.CDATA_CONTENT_ELEMENTS, *getattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS", ()), "plaintext"))


class _Tree(HTMLParser):
    """Tree of a page. Open elements are kept by tag, so that no tag has to search the whole depth."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.top = self.here = _Node("", {}, None, -1, 0)
        self.nodes: list[_Node] = []
        self.open: dict[str, list[_Node]] = {}
        self.words: list[str] = []
        self.length = 0
        self.text = ""

    def read(self, html: str) -> None:
        """Feeds the whole page. Plain markup is told by one pattern; from the first other piece on the parser reads the rest."""
        at, match = 0, _PLAIN.match
        while found := match(html, at):
            data, end, start, attrs, closed = found.groups()
            if data:
                self.handle_data(unescape(data) if "&" in data else data)
            elif end:
                self.handle_endtag(end.lower())
            elif start:
                start = start.lower()
                if start in _OWN_RULES:
                    break
                told = [(k.lower(), v) for k, v in _ATTRIBUTE.findall(attrs)] if attrs else []
                (self.handle_startendtag if closed else self.handle_starttag)(start, told)
            at = found.end()
        if at < len(html):
            self.feed(html[at:])
        self.close()

    def _innermost(self, tags) -> _Node | None:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), key=lambda n: n.depth, default=None)

    def _close(self, node: _Node) -> None:
        """Ends ``node`` and all that is open inside it."""
        here = self.here
        while here is not node.parent:
            here.last, here.stop = len(self.nodes) - 1, self.length
            if here is not self.top:
                self.open[here.tag].pop()
            here = here.parent
        self.here = here

    def handle_starttag(self, tag: str, attrs: list) -> None:
        ended = self._innermost(_CLOSES[tag]) if tag in _CLOSES else None
        if ended is not None:
            scope = None if tag == "a" else self._innermost(_SCOPE)
            if scope is None or scope.depth < ended.depth:
                self._close(ended)
        node = _Node(tag, {k: v or "" for k, v in reversed(attrs)} if attrs else {}, self.here, len(self.nodes), self.length)
        self.nodes.append(node)
        self.here.children.append(node)
        if tag not in _VOID:
            self.open.setdefault(tag, []).append(node)
            self.here = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.open.get(tag):
            self._close(self.open[tag][-1])

    def handle_data(self, data: str) -> None:
        self.here.children.append(data)
        words = data.split()
        if words:
            piece = " ".join(words) + " "
            self.words.append(piece)
            self.length += len(piece)

    def close(self) -> None:
        super().close()
        self._close(self.top)
        self.text, self.words = "".join(self.words), []

    def drop(self) -> None:
        """Takes the links between the nodes away, which only the collector of cycles could free."""
        for node in self.nodes:
            node.parent = node.children = None
        self.top = self.here = None

    def text_of(self, node: _Node | None) -> str | None:
        return None if node is None else self.text[node.start : max(node.start, node.stop - 1)]


# What may stand between a label and its value.
_BETWEEN = re.compile(r"[\s:\-–—]*")


class _Peers:
    """Text that belongs with an element: its definition, its cell, or its surroundings."""

    def __init__(self, tree: _Tree, chars: int | None) -> None:
        self.tree, self.chars = tree, chars
        self.next_dd: dict[int, dict[int, _Node]] = {}

    def _cut(self, node: _Node | None, label: int = 0) -> str | None:
        """Text of ``node``, in full or up to ``chars`` characters behind a label of the given length."""
        if node is None:
            return None
        stop = max(node.start, node.stop - 1)
        if self.chars is not None:
            behind = min(node.start + label, stop)
            stop = min(stop, _BETWEEN.match(self.tree.text, behind, stop).end() + self.chars + 2)
        return self.tree.text[node.start : stop]

    def _definition(self, node: _Node) -> _Node | None:
        parent = node.parent
        if parent.pos not in self.next_dd:
            found, after = {}, None
            for child in reversed(parent.children):
                if not isinstance(child, str):
                    if child.tag == "dt":
                        found[child.pos] = after
                    elif child.tag == "dd":
                        after = child
            self.next_dd[parent.pos] = found
        return self.next_dd[parent.pos][node.pos]

    def __call__(self, node: _Node) -> str | None:
        if node.tag == "body":
            return node.visible()
        if node.tag == "dt":
            return self._cut(self._definition(node))
        if node.tag == "tr":
            return self._cut(node.child("td"))
        if node.tag in ("a", "strong", "b"):
            return self._cut(node.parent, max(0, node.stop - 1 - node.start))
        return None


def element_rows(
    html: str, rows: Want | None = None, texts: Want | None = None, peer_chars: int | None = None, chain: bool = True
) -> Iterator[dict]:
    """Rows of one page, in document order, of the wanted elements (None: all); text, peer and titles of those in ``texts``."""
    for row in _rows(html, rows, texts, peer_chars, chain):
        yield dict(zip(_NAMES, row, strict=True))


def _rows(html: str, rows: Want | None, texts: Want | None, peer_chars: int | None, chain: bool) -> Iterator[tuple]:
    tree = _Tree()
    tree.read(html)
    peer_of = _Peers(tree, peer_chars)
    for node in tree.nodes:
        if rows is not None and not rows(node):
            continue
        path, up = [], node if chain else None
        while up is not None and up.pos >= 0:
            path.append({"tag": up.tag, "attrs": up.marks()})
            up = up.parent
        titles = text = peer = None
        if texts is None or texts(node):
            if node.tag == "a":
                below = (n for n in tree.nodes[node.pos + 1 : node.last + 1])
                titles = [
                    tree.text_of(n) for n in below
                    if n.stop > n.start and "title" in (n.attrs.get("class", "") + n.attrs.get("id", "")).lower()
                ]
            text = tree.text_of(node.child("th") if node.tag == "tr" else node)
            peer = peer_of(node)
        raw = node.raw() if node.tag in ("script", "textarea") else None
        yield (node.pos, node.last, node.tag, list(node.attrs.items()), text, raw, peer, titles, path if chain else None)
    tree.drop()


def _want(given: tuple[str, ...] | Want | None) -> Want | None:
    return Want(frozenset(given)) if isinstance(given, tuple) else given


def html_elements(
    pages: DataFrame, keys: list[str], html: str = "html", tags: tuple[str, ...] | Want | None = None, *,
    texts: tuple[str, ...] | Want | None = None, peer_chars: int | None = None, chain: bool = True,
) -> DataFrame:
    """One row per wanted element: keys, _page, pos, last, tag, attrs, text, raw, peer, titles, chain (self to root).

    ``texts`` names the elements whose rows carry text, peer and titles (None: all), ``peer_chars`` how many characters of a peer
    the caller reads, behind the element's own text (None: all); without ``chain`` ancestors are asked by ``under``. ``_page`` tells
    pages of equal keys apart. Null or empty HTML gives no rows.
    """
    rows, told = _want(tags), _want(texts)
    source = spread(
        pages.select(*keys, F.xxhash64(html).alias("_page"), F.coalesce(F.col(html), F.lit("")).alias("_html")), *keys, "_page"
    )
    schema = T.StructType([source.schema[k] for k in (*keys, "_page")] + ELEMENT_FIELDS)
    arrow = to_arrow_schema(schema)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in schema.fields]
            for record in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                found = list(_rows(record[-1], rows, told, peer_chars, chain))
                for out, value in zip(columns, record[:-1], strict=False):
                    out.extend([value] * len(found))
                for out, values in zip(columns[len(record) - 1 :], zip(*found, strict=True), strict=False):
                    out.extend(values)
                if len(columns[0]) >= 20_000:
                    yield _to_batch(columns, arrow)
                    columns = [[] for _ in schema.fields]
            yield _to_batch(columns, arrow)

    return source.mapInArrow(parse, schema)


def under(nodes: DataFrame, keys: list[str], flags: dict[str, Column], *, own: bool = False) -> DataFrame:
    """Adds to every row, per flag, whether an ancestor (with ``own``: or the element itself) among the rows meets the condition.

    Elements nest, so one that began before and ends at or behind ``pos`` contains it. The window holds the rows of one page.
    """
    before = Window.partitionBy(*keys, "_page").orderBy("pos").rangeBetween(
        Window.unboundedPreceding, Window.currentRow if own else -1
    )
    return nodes.withColumns(
        {name: F.coalesce(F.max(F.when(flag, F.col("last"))).over(before) >= F.col("pos"), F.lit(False)) for name, flag in flags.items()}
    )


def _to_batch(columns: list[list], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
