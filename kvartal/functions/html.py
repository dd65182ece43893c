"""Text of marked-up pages, by class names, for cards and detail pages.

Spark has no HTML functions, so a small reader turns a page into the texts the
column expressions work on. It runs on Arrow batches and looks at one page at a
time; everything after the texts is plain Spark.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate, chain, islice

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
SILENT = frozenset(("script", "style", "template"))
# Mark-up of the crawled site.
LINK_PART = "/a/show/"
CARD_CLASSES = ("a-card", "offer")
SUBTITLE = "a-card__subtitle"
NEAR = 6
DOTTED = re.compile(r"\.(?<=\d\d\.)\d{2}\.\d{4}")

_TEXT = T.StringType()
CARD = T.StructType(
    [T.StructField(n, _TEXT) for n in ("href", "title", "price_text", "subtitle", "details")]
)
PAIR = T.StructType([T.StructField("label", _TEXT), T.StructField("value", _TEXT)])
DETAIL = T.StructType(
    [
        *[
            T.StructField(n, _TEXT)
            for n in (
                "title", "price_text", "address", "page_title", "detail_text", "full_text",
                "description", "time_attr", "test_attr",
            )
        ],
        T.StructField("params", T.ArrayType(PAIR)),
    ]
)
EMBEDDED = T.StructType([T.StructField(n, _TEXT) for n in ("owner_json", "agency_json")])


class Node:
    __slots__ = ("tag", "attrs", "classes", "parent", "children", "subtitles")

    def __init__(self, tag: str, attrs: dict, classes: list[str], parent: Node | None) -> None:
        self.tag, self.attrs, self.classes, self.parent = tag, attrs, classes, parent
        self.children: list[Node | str] = []
        self.subtitles = 0  # nodes inside that carry a card's subtitle

    def walk(self) -> Iterator[Node]:
        """Descendants in document order (no recursion: pages nest deeply)."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def around(self) -> Iterator[Node]:
        """Enclosing nodes, innermost first."""
        box = self.parent
        while box is not None:
            yield box
            box = box.parent

    @property
    def is_card_box(self) -> bool:
        names = self.attrs.get("class")
        return bool(names) and _names_card(names)

    def strings(self) -> Iterator[str]:
        stack: list[Node | str] = self.children[::-1]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                item = item.strip()
                if item:
                    yield item
            elif item.tag not in SILENT:
                stack.extend(item.children[::-1])

    def text(self, joiner: str = " ") -> str | None:
        inside = self.children
        if len(inside) == 1 and isinstance(inside[0], str):
            return inside[0].strip() or None
        return joiner.join(self.strings()) or None


@lru_cache(maxsize=4096)
def _names_card(names: str) -> bool:
    names = names.lower()
    return any(name in names for name in CARD_CLASSES)


class _Reader(HTMLParser):
    """Builds the tree and lists its nodes in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {}, [], None)
        self.here = self.root
        self.nodes: list[Node] = []

    def _add(self, tag: str, attrs: list) -> Node:
        found = dict(reversed(attrs))
        node = Node(tag, found, (found.get("class") or "").split(), self.here)
        self.here.children.append(node)
        self.nodes.append(node)
        if SUBTITLE in node.classes:
            for box in node.around():
                box.subtitles += 1
        return node

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = self._add(tag, attrs)
        if tag not in VOID:
            self.here = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._add(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        node = self.here
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.here = node.parent

    def handle_data(self, data: str) -> None:
        self.here.children.append(data)


class Index:
    """Nodes of a page or card by class, tag and test attribute, in order."""

    def __init__(self, nodes: Iterator[Node] | list[Node]) -> None:
        self.by_class: dict[str, list[Node]] = {}
        self.by_tag: dict[str, list[Node]] = {}
        self.by_test: dict[str, list[Node]] = {}
        for node in nodes:
            self.by_tag.setdefault(node.tag, []).append(node)
            classes = node.classes
            for name in classes if len(classes) < 2 else dict.fromkeys(classes):
                self.by_class.setdefault(name, []).append(node)
            if not node.attrs:
                continue
            test = node.attrs.get("data-test")
            if test:
                self.by_test.setdefault(test, []).append(node)

    def class_text(self, name: str) -> str | None:
        return _first_text(self.by_class.get(name))

    def tag_text(self, name: str) -> str | None:
        return _first_text(self.by_tag.get(name))

    def test_text(self, name: str) -> str | None:
        return _first_text(self.by_test.get(name))


def _first_text(nodes: list[Node] | None) -> str | None:
    return nodes[0].text() if nodes else None


# Mark-up without oddities, on which every reader agrees: what stands between "<" and ">" is a start
# tag (name, attributes, slash), an end tag or a doctype; all else only the full reader understands.
_GAP = r"[ \t\n\r]"
_ATTR = r"""[a-zA-Z_][\w-]*(?:=(?:"[^"]*"|'[^']*'|[\w.-]+(?=[ \t\n\r]|\Z)))?"""
_HEAD = re.compile(
    rf"([a-zA-Z][a-zA-Z0-9]*)((?:{_GAP}+{_ATTR})*){_GAP}*(/?)|/([a-zA-Z][a-zA-Z0-9]*){_GAP}*|(!(?i:doctype) [a-zA-Z]+)",
    re.ASCII,
)
_START, _END = 3, 4
_ATTRS = re.compile(r"""([a-zA-Z_][\w-]*)(?:=(?:"([^"]*)"|'([^']*)'|([\w.-]+)))?""", re.ASCII)
#: Content of these is one raw text up to the end tag.
_RAW = frozenset(("script", "style", "title"))
#: Readers differ on what stands inside.
_SPECIAL = frozenset("textarea xmp iframe noembed noframes noscript plaintext".split())
#: What cards and detail pages ask for, by tag, class (with a dot) and test attribute (with a hash).
_ASKED = frozenset(
    "h1 h2 h3 title dl dt dd time .a-card__title .a-card__price .a-card__text-preview .a-card__subtitle .offer__price"
    " .offer__parameters .offer__title .offer__address .offer__info .offer__info-title .offer__advert-short-info"
    " .offer__description .js-description .text #price #offer-price #address #published-at".split()
)
_LINK = "link"
#: Attributes that are asked for.
_READ = frozenset("class data-test href datetime".split())
#: What a head is for a page without a tree.
_OPEN, _CLOSE, _IGNORED, _ASKED_VOID, _OTHER = range(5)
#: Heads without quotes or with few characters between them come again; others are worked out each time.
_HEADS: dict[str, tuple] = {}
KEPT_HEADS, KEPT_HEAD = 16384, 40


@lru_cache(maxsize=4096)
def _refers(text: str) -> bool:
    return unescape(text) != text


@lru_cache(maxsize=4096)
def _quoted(shape: str) -> tuple | None:
    """(tag, attribute names, empty) of a start tag whose values all stand in double quotes and were emptied."""
    found = _HEAD.fullmatch(shape)
    if found is None or found.lastindex != _START:
        return None
    names = [part[1].lower() for part in _ATTRS.finditer(found[2])]
    return (found[1].lower(), names, bool(found[3])) if 2 * len(names) == shape.count('"') else None


@lru_cache(maxsize=4096)
def _names_of(tag: str, classes: str, test: str | None) -> tuple[list[str], tuple[str, ...]]:
    """Classes, and the names under which a node is asked for."""
    listed = classes.split()
    names = [tag, *[f".{c}" for c in listed], f"#{test}"]
    return listed, tuple(name for name in dict.fromkeys(names) if name in _ASKED)


@lru_cache(maxsize=16384)
def _head(text: str) -> tuple | None:
    """(tag, start, empty, attributes, classes, names asked for) of what stands between angle brackets; None if odd.

    A doctype has no tag. Odd are values that hold character references, too.
    """
    parts = text.split('"')
    quoted = _quoted('""'.join(parts[::2])) if len(parts) % 2 and len(parts) > 1 and "'" not in text else None
    if quoted is not None:
        tag, names, slash = quoted
        given = zip(names, parts[1::2], strict=True)
    else:
        found = _HEAD.fullmatch(text)
        if found is None:
            return None
        if found.lastindex == _END:
            return found[4].lower(), False, False, None, None, ()
        if found.lastindex != _START:
            return "", False, False, None, None, ()
        tag, slash = found[1].lower(), bool(found[3])
        given = [(p[1].lower(), None if p.lastindex == 1 else p[p.lastindex]) for p in _ATTRS.finditer(found[2])]
    attrs: dict[str, str | None] = {}
    for name, value in given:
        if value and "&" in value and _refers(value[value.index("&") :]):
            return None
        attrs.setdefault(name, value)
    if tag in _SPECIAL or (tag in _RAW and slash):
        return None
    classes, asked = _names_of(tag, attrs.get("class") or "", attrs.get("data-test"))
    if tag == "a" and LINK_PART in (attrs.get("href") or ""):
        asked = (*asked, _LINK)
    return tag, True, slash or tag in VOID, attrs, classes, asked


@lru_cache(maxsize=4096)
def _shape(shape: str) -> tuple | None:
    """(tag, empty, places of the attributes that are asked for) of a start tag whose values were emptied."""
    quoted = _quoted(shape)
    if quoted is None or quoted[0] in _SPECIAL or quoted[0] in _RAW or quoted[0] == "template":
        return None
    tag, names, slash = quoted
    return tag, slash or tag in VOID, [(name, names.index(name)) for name in dict.fromkeys(names) if name in _READ]


def _flat(tag: str, empty: bool, attrs: dict, classes: list[str], names: tuple[str, ...]) -> tuple:
    """(kind, tag, names asked for, attributes, classes, card box) of a start tag."""
    kind = (_ASKED_VOID if names else _IGNORED) if empty else _OPEN
    return kind, tag, names, attrs, classes, _names_card(attrs.get("class") or "")


@lru_cache(maxsize=4096)
def _flat_names(tag: str, empty: bool, names: str, test: str | None, link: bool) -> tuple:
    classes, asked = _names_of(tag, names, test)
    return _flat(tag, empty, {"class": names}, classes, (*asked, _LINK) if link else asked)


def _flat_head(text: str) -> tuple | None:
    """As ``_flat`` of what stands between angle brackets, only with attributes that are asked for; None if odd."""
    if text.count('"') > 1 and "'" not in text:
        parts = text.split('"')
        told = _shape('""'.join(parts[::2])) if len(parts) % 2 else None
        if told is not None:
            values = parts[1::2]
            if "&" in text and any("&" in v and _refers(v[v.index("&") :]) for v in values):
                return None
            tag, empty, places = told
            attrs = {name: values[i] for name, i in places}
            link = tag == "a" and LINK_PART in attrs.get("href", "")
            kind, _, names, _, classes, boxed = _flat_names(tag, empty, attrs.get("class", ""), attrs.get("data-test"), link)
            return kind, tag, names, attrs, classes, boxed
    about = _head(text)
    if about is None:
        return None
    tag, start, empty, attrs, classes, names = about
    if not start:
        return (_CLOSE if tag else _IGNORED), tag, (), {}, [], False
    if tag in _RAW or tag == "template":
        return _OTHER, tag, names, attrs, classes, False
    return _flat(tag, empty, attrs, classes, names)


def _comment_rest(piece: str, pieces: Iterator[str]) -> str | None:
    """What follows the comment that begins with ``piece``; None where readers differ on its end."""
    body = piece[3:]
    if body.startswith((">", "->")):
        return None
    while "--" not in body:
        body = next(pieces, "--")
    body = body[body.index("--") + 2 :]
    return body[1:] if body.startswith(">") else None


def _raw_rest(tag: str, text: str, pieces: Iterator[str]) -> tuple[str, str] | None:
    """Raw text of an element and what follows its end tag; None where readers differ on its end."""
    end = f"/{tag}>"
    for piece in pieces:
        if piece[: len(end)].lower() == end:
            return text, piece[len(end) :]
        if tag == "title" or piece.startswith(("/", "!")):
            return None
        text = f"{text}<{piece}"
    return None


def _read_plain(html: str) -> tuple[Node, list[Node]] | None:
    """What ``_Reader`` builds, cut at the angle brackets; None for a page with anything odd in it."""
    if "\0" in html:
        return None
    root = here = Node("", {}, [], None)
    nodes: list[Node] = []
    pieces = iter(html.split("<"))
    text = next(pieces)
    if text:
        root.children.append(unescape(text) if "&" in text else text)
    for piece in pieces:
        if piece.startswith("!--"):
            text = _comment_rest(piece, pieces)
            if text is None:
                return None
        else:
            head, closed, text = piece.partition(">")
            about = _head(head) if closed else None
            if about is None:
                return None
            tag, start, empty, attrs, classes, _ = about
            if start:
                node = Node(tag, attrs, classes, here)
                here.children.append(node)
                nodes.append(node)
                if SUBTITLE in classes:
                    for box in node.around():
                        box.subtitles += 1
                if tag in _RAW:
                    raw = _raw_rest(tag, text, pieces)
                    if raw is None:
                        return None
                    inside, text = raw
                    if inside:
                        node.children.append(unescape(inside) if tag == "title" else inside)
                elif not empty:
                    here = node
            elif tag:
                node = here
                while node.parent is not None and node.tag != tag:
                    node = node.parent
                if node.parent is not None:
                    here = node.parent
        if text:
            here.children.append(unescape(text) if "&" in text else text)
    return root, nodes


class Flat:
    """A plain page without a tree: its nodes are numbers in document order, ``-1`` is the page.

    A node's inside are the nodes up to ``last`` and the texts from ``begin`` to ``till``, which are
    decoded and stripped when asked for; those of scripts and styles are left out.
    """

    __slots__ = ("heads", "parent", "last", "begin", "till", "texts", "asked")

    def __init__(self) -> None:
        self.heads: list[tuple] = []
        self.parent: list[int] = []
        self.last: list[int] = []
        self.begin: list[int] = []
        self.till: list[int] = []
        self.texts: list[str] = []
        self.asked: dict[str, list[int]] = {}

    def attrs(self, node: int) -> dict:
        return self.heads[node][3]

    def inside(self, node: int, name: str) -> list[int]:
        """Nodes of a name that was asked for inside a node."""
        found = self.asked.get(name)
        if not found or node < 0:
            return found or []
        return found[bisect_right(found, node) : bisect_left(found, self.last[node])]

    def text(self, node: int, joiner: str = " ") -> str | None:
        texts = self.texts if node < 0 else self.texts[self.begin[node] : self.till[node]]
        if len(texts) == 1:
            text = texts[0]
            return (unescape(text) if "&" in text else text).strip() or None
        stripped = [(unescape(text) if "&" in text else text).strip() for text in texts]
        return joiner.join([text for text in stripped if text]) or None

    def first_text(self, *names: str, node: int = -1) -> str | None:
        """Text of the first node of a name, of the first name that has one."""
        for name in names:
            found = self.asked.get(name)
            if found:
                at = bisect_right(found, node)
                if at < len(found) and (node < 0 or found[at] < self.last[node]):
                    text = self.text(found[at])
                    if text:
                        return text
        return None

    def holds_one(self, node: int, name: str) -> bool:
        """Whether just one node of a name that was asked for lies inside a node."""
        found = self.asked.get(name)
        if not found:
            return False
        at, end = bisect_right(found, node), self.last[node]
        return at < len(found) and found[at] < end and (at + 1 == len(found) or found[at + 1] >= end)


def scan(html: str) -> Flat | None:
    """A plain page without a tree; None where ``read`` has to look at it."""
    if "\0" in html:
        return None
    page, here = Flat(), -1
    heads, parent, last, begin, till, texts, asked = (
        page.heads, page.parent, page.last, page.begin, page.till, page.texts, page.asked
    )
    known = _HEADS
    pieces = iter(html.split("<"))
    text = next(pieces)
    if text:
        texts.append(text)
    for piece in pieces:
        head, closed, text = piece.partition(">")
        about = known.get(head) if closed else None
        if about is None:
            about = None if not closed or head.startswith("!--") else _flat_head(head)
            if about is None:
                text = _comment_rest(piece, pieces) if piece.startswith("!--") else None
                if text is None:
                    return None
                if text:
                    texts.append(text)
                continue
            if len(head) <= KEPT_HEAD:
                if len(known) >= KEPT_HEADS:
                    known.clear()
                known[head] = about
        kind = about[0]
        if kind == _CLOSE:
            tag, node = about[1], here
            while node >= 0 and heads[node][1] != tag:
                node = parent[node]
            if node >= 0:
                out = parent[node]
                while here != out:
                    last[here] = len(heads)
                    till[here] = len(texts)
                    here = parent[here]
        elif kind != _IGNORED:
            node = len(heads)
            heads.append(about)
            parent.append(here)
            begin.append(len(texts))
            names = about[2]
            for name in names:
                if name in asked:
                    asked[name].append(node)
                else:
                    asked[name] = [node]
            if kind == _OPEN:
                here = node
            elif kind == _OTHER:
                tag = about[1]
                raw = None if tag == "template" else _raw_rest(tag, text, pieces)
                if raw is None or (names and tag != "title"):
                    return None
                inside, text = raw
                if inside and tag == "title":
                    texts.append(inside)
            last.append(node + 1)
            till.append(len(texts))
        if text:
            texts.append(text)
    while here >= 0:
        last[here], till[here] = len(heads), len(texts)
        here = parent[here]
    return page


def read(html: str) -> tuple[Node, list[Node]]:
    """Root and all nodes in document order."""
    plain = _read_plain(html)
    if plain is not None:
        return plain
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return reader.root, reader.nodes


def _card_of(link: Node) -> Node:
    """The box that is the link's card: with one subtitle if there is one, else the widest."""
    boxes = [box for box in islice(link.around(), NEAR) if box.is_card_box]
    single = [box for box in boxes if box.subtitles == 1]
    return [*single[:1], *boxes[::-1], link][0]


def _tree_cards(html: str) -> list[tuple[str | None, ...]]:
    out, seen = [], {}
    for link in read(html)[1]:
        href = link.attrs.get("href")
        if link.tag != "a" or not href or LINK_PART not in href:
            continue
        box = _card_of(link)
        if id(box) not in seen:
            seen[id(box)] = Index(box.walk())
        card = seen[id(box)]
        out.append(
            (
                href,
                card.class_text("a-card__title") or card.tag_text("h2") or card.tag_text("h3") or link.text(),
                card.class_text("a-card__price") or card.class_text("offer__price") or card.test_text("price"),
                card.class_text(SUBTITLE),
                card.class_text("a-card__text-preview") or card.class_text("offer__parameters"),
            )
        )
    return out


def _flat_card_of(page: Flat, link: int) -> int:
    parent, heads, name = page.parent, page.heads, f".{SUBTITLE}"
    box, node, near = link, parent[link], NEAR
    while node >= 0 and near:
        if heads[node][5]:
            if page.holds_one(node, name):
                return node
            box = node
        node, near = parent[node], near - 1
    return box


def _flat_cards(page: Flat) -> list[tuple[str | None, ...]]:
    out, seen = [], {}
    for link in page.asked.get(_LINK, ()):
        box = _flat_card_of(page, link)
        if box not in seen:
            seen[box] = (
                page.first_text(".a-card__title", "h2", "h3", node=box),
                page.first_text(".a-card__price", ".offer__price", "#price", node=box),
                page.first_text(f".{SUBTITLE}", node=box),
                page.first_text(".a-card__text-preview", ".offer__parameters", node=box),
            )
        title, *rest = seen[box]
        out.append((page.attrs(link)["href"], title or page.text(link), *rest))
    return out


def _card_rows(html: str | None) -> list[tuple[str | None, ...]]:
    """Texts of the card around every listing link, in page order, as the fields of ``CARD``."""
    if html is None or LINK_PART not in html:
        return []
    page = scan(html)
    return _tree_cards(html) if page is None else _flat_cards(page)


def cards(html: str | None) -> list[dict]:
    """Texts of the card around every listing link, in page order."""
    return [dict(zip(CARD.names, row, strict=True)) for row in _card_rows(html)]


_JSON = json.JSONDecoder()
_KEYED = {key: re.compile(rf'"{key}"\s*:\s*(?={{)') for key in ("owner", "agency")}


def _objects(html: str, key: str) -> Iterator[dict]:
    """Objects that stand as JSON under ``key`` anywhere in a page."""
    named = f'"{key}"'
    at = html.find(named)
    while at >= 0:
        found = _KEYED[key].match(html, at)
        if found is None:
            at = html.find(named, at + 1)
            continue
        with suppress(json.JSONDecodeError, RecursionError):
            yield _JSON.raw_decode(html, found.end())[0]
        at = html.find(named, found.end())


_WRITTEN = json.JSONEncoder(ensure_ascii=False).encode


def _embedded(html: str, key: str, marker: str) -> str | None:
    """First embedded object under ``key`` that carries ``marker``, as JSON."""
    for value in _objects(html, key):
        if marker in value:
            return _WRITTEN(value)
    return None


def _params(page: Index) -> list[dict]:
    """Label and value pairs: definition lists first, then info rows."""
    out = []
    for block in page.by_tag.get("dl", []):
        items = list(block.walk())
        terms = [n for n in items if n.tag == "dt"]
        values = [n for n in items if n.tag == "dd"]
        out += zip(terms, values, strict=False)
    for label in page.by_class.get("offer__info-title", []):
        if label.parent is not None:
            row = next((n for n in label.parent.walk() if "offer__advert-short-info" in n.classes), None)
            if row is not None:
                out.append((label, row))
    pairs = [{"label": (a.text() or "").lower(), "value": b.text() or ""} for a, b in out]
    return [p for p in pairs if p["label"] and p["value"]]


def _about(page: Index) -> Node | None:
    """The free description, not the parameter block."""
    found = page.by_class.get("js-description")
    if found:
        return found[0]
    for box in page.by_class.get("offer__description", []):
        inner = Index(box.walk()).by_class.get("text")
        if inner:
            return inner[0]
    return None


def _stamp(attrs: list[dict]) -> str | None:
    return next((a["datetime"] for a in attrs if "datetime" in a), None)


def _tree_detail(html: str, dated: bool) -> dict:
    root, nodes = read(html)
    page = Index(nodes)
    heads = page.by_tag.get("h1", [])
    offer_heads = [n for n in heads if "offer__title" in n.classes]
    about = _about(page)
    return {
        "title": _first_text(offer_heads) or _first_text(heads),
        "price_text": page.class_text("offer__price") or page.test_text("offer-price"),
        "address": page.class_text("offer__address") or page.test_text("address"),
        "page_title": page.tag_text("title"),
        "detail_text": page.class_text("offer__parameters")
        or page.class_text("offer__info")
        or root.text(),
        "full_text": root.text() if dated else None,
        "description": None if about is None else about.text("\n"),
        "time_attr": _stamp([n.attrs for n in page.by_tag.get("time", [])]),
        "test_attr": _stamp([n.attrs for n in page.by_test.get("published-at", [])]),
        "params": _params(page),
    }


def _flat_detail(page: Flat, dated: bool) -> dict:
    asked = page.asked
    heads = asked.get("h1", ())
    offer_head = next((n for n in heads if "offer__title" in page.heads[n][4]), None)
    abouts = asked.get(".js-description") or [
        n for box in asked.get(".offer__description", ()) for n in page.inside(box, ".text")[:1]
    ]
    named = []
    for dl in asked.get("dl", ()):
        named += zip(page.inside(dl, "dt"), page.inside(dl, "dd"), strict=False)
    for label in asked.get(".offer__info-title", ()):
        named += [(label, row) for row in page.inside(page.parent[label], ".offer__advert-short-info")[:1]]
    pairs = [((page.text(a) or "").lower(), page.text(b)) for a, b in named]
    return {
        "title": (None if offer_head is None else page.text(offer_head)) or (page.text(heads[0]) if heads else None),
        "price_text": page.first_text(".offer__price", "#offer-price"),
        "address": page.first_text(".offer__address", "#address"),
        "page_title": page.first_text("title"),
        "detail_text": page.first_text(".offer__parameters", ".offer__info") or page.text(-1),
        "full_text": page.text(-1) if dated else None,
        "description": page.text(abouts[0], "\n") if abouts else None,
        "time_attr": _stamp([page.attrs(n) for n in asked["time"]]) if "time" in asked else None,
        "test_attr": _stamp([page.attrs(n) for n in asked["#published-at"]]) if "#published-at" in asked else None,
        "params": [{"label": label, "value": value} for label, value in pairs if label and value],
    }


def _texts(html: str) -> dict:
    """Texts of a detail page."""
    # the whole text is only ever searched for a dotted date
    dated = DOTTED.search(html) is not None or "&#" in html
    page = scan(html)
    return _tree_detail(html, dated) if page is None else _flat_detail(page, dated)


def _json(html: str) -> dict:
    """Objects that stand as JSON in a detail page."""
    return {"owner_json": _embedded(html, "owner", "isOwner"), "agency_json": _embedded(html, "agency", "name")}


def detail(html: str | None) -> dict | None:
    return None if html is None else _texts(html) | _json(html)


def _lists(rows: list[list[tuple] | None], names: list[str]) -> pa.Array:
    """Lists of structs of texts, put together by columns."""
    ends = list(accumulate((len(r or ()) for r in rows), initial=0))
    starts = [None if r is None else at for r, at in zip(rows, ends, strict=False)]
    columns = list(zip(*chain.from_iterable(r or () for r in rows), strict=True)) or [()] * len(names)
    texts = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], names)
    return pa.ListArray.from_arrays(pa.array([*starts, ends[-1]], pa.int32()), texts)


@F.arrow_udf(T.ArrayType(CARD))
def card_texts(html: pa.Array) -> pa.Array:
    return _lists([_card_rows(h) for h in html.to_pylist()], CARD.names)


def _columns(html: pa.Array, read: Callable[[str], dict], fields: T.StructType) -> pa.Array:
    """Structs of what is read of every page; all of a page that is null is null."""
    rows = [{} if h is None else read(h) for h in html.to_pylist()]
    params = [None if "params" not in r else [(p["label"], p["value"]) for p in r["params"]] for r in rows]
    columns = [
        _lists(params, PAIR.names) if name == "params" else pa.array([r.get(name) for r in rows], pa.string())
        for name in fields.names
    ]
    return pa.StructArray.from_arrays(columns, fields.names)


@F.arrow_udf(DETAIL)
def detail_texts(html: pa.Array) -> pa.Array:
    return _columns(html, _texts, DETAIL)


@F.arrow_udf(EMBEDDED)
def detail_json(html: pa.Array) -> pa.Array:
    """Apart from the texts, so that who asks for these alone reads no mark-up."""
    return _columns(html, _json, EMBEDDED)
