"""Nodes of a lexicon: parse, serialize, shred.

Parsing keeps all that the content model does not know as residue: attributes, and nodes with their child index.
A repeated singleton is residue too, so nothing is lost when an entry is written again.
"""

from __future__ import annotations

import hashlib
import io
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable, Iterator
from datetime import date, datetime

from .spec import EMPTY, KINDS, MANY, MIXED, SLOTS


DECLARATION = b"".join([b"<?xml ", b'version="1.0" ', b'encoding="UTF-8"', b"?>\n"])


class LiftError(Exception):
    """Any failure of this package on its input."""


class LiftParseError(LiftError):
    """Not well formed, not a lexicon, or not version 0.13."""


_BLANK: dict[str, dict[str, object]] = {k: {a: "" if (k, a) in EMPTY else None for a, _, _ in kind.attrs} for k, kind in KINDS.items()}


class Node:
    """One element: typed attributes, children by tag, residue; text and spans have fragments instead of children."""

    __slots__ = ("tag", "kind", "attrs", "kids", "frags", "xattrs", "xnodes", "raw")

    def __init__(self, tag: str, kind: str):
        self.tag, self.kind = tag, kind
        self.attrs: dict[str, object] = _BLANK[kind].copy()
        self.kids: dict[str, list[Node]] = {}
        self.frags: list[str | Node] = []
        self.xattrs: dict[str, str] = {}
        self.xnodes: list[tuple[str, str, int]] = []
        self.raw: dict[str, str] = {}

    def all(self, tag: str) -> list[Node]:
        return self.kids.get(tag, [])

    def one(self, tag: str) -> Node | None:
        return next(iter(self.kids.get(tag, ())), None)

    def add(self, node: Node) -> Node:
        self.kids.setdefault(node.tag, []).append(node)
        return node

    def text(self) -> str:
        """Flat text of a form, text or span."""
        if self.kind == "form":
            t = self.one("text")
            return t.text() if t is not None else ""
        return "".join(f if isinstance(f, str) else f.text() for f in self.frags)

    def form(self, lang: str, tag: str = "form") -> str | None:
        """The first form's text in a language."""
        return next((f.text() for f in self.all(tag) if f.attrs["lang"] == lang), None)

    def set_form(self, lang: str, text: str, tag: str = "form") -> None:
        """Replace the first form in a language, or append one."""
        f = next((f for f in self.all(tag) if f.attrs["lang"] == lang), None)
        if f is None:
            f = self.add(Node(tag, "form"))
            f.attrs["lang"] = lang
        t = Node("text", "text")
        t.frags = [text]
        f.kids["text"] = [t]

    def keys(self, tag: str = "form") -> list[str]:
        """Languages of the forms that have one, in order."""
        return [k for k, _ in self.items(tag)]

    def values(self, tag: str = "form") -> list[str]:
        return [v for _, v in self.items(tag)]

    def items(self, tag: str = "form") -> list[tuple[str, str]]:
        return [(f.attrs["lang"], f.text()) for f in self.all(tag) if f.attrs["lang"] is not None]

    def __contains__(self, lang: object) -> bool:
        return lang in self.keys()

    def __iter__(self) -> Iterator[str]:
        return iter(self.keys())

    def __getitem__(self, lang: str) -> str:
        """The first form's text in a language."""
        if lang not in self:
            raise KeyError(lang)
        return self.form(lang)

    def __setitem__(self, lang: str, text: str) -> None:
        self.set_form(lang, text)

    def __delitem__(self, lang: str) -> None:
        """Without the first form in a language."""
        at = next((i for i, f in enumerate(self.all("form")) if lang is not None and f.attrs["lang"] == lang), None)
        if at is None:
            raise KeyError(lang)
        del self.kids["form"][at]

    def residue(self) -> str:
        """What the content model does not know, to be read: a line for each attribute, then the nodes."""
        return "\n".join([f"@{k}={v!r}" for k, v in self.xattrs.items()] + [x for _, x, _ in self.xnodes])

    def add_element(self, id: str, *, parent: str | None = None, guid: str | None = None) -> Node:
        """A new element at the end of a range."""
        if self.kind != "range":
            raise LiftError(f"a {self.kind} has no range elements")
        e = self.add(Node("range-element", "range-element"))
        e.attrs |= {"id": id, "parent": parent, "guid": guid}
        return e

    def __repr__(self) -> str:
        more = f", residue of {len(self.xattrs)} attributes and {len(self.xnodes)} nodes" if self.xattrs or self.xnodes else ""
        return f"<{self.tag} {dict((k, v) for k, v in self.attrs.items() if v is not None)}{more}>"

    def walk(self) -> Iterator[Node]:
        """This node and all below it, in document order of slots."""
        yield self
        for tag in SLOTS[self.kind]:
            for k in self.all(tag):
                yield from k.walk()

    def filled(self) -> bool:
        return any(self.kids.values()) or bool(self.xattrs or self.xnodes)


# --- parsing

def tree(data: bytes | str) -> ET.Element:
    """A tree with comments and processing instructions; external entities stay off, unknown ones are refused."""
    builder = ET.TreeBuilder(insert_comments=True, insert_pis=True)
    try:
        return ET.fromstring(data, ET.XMLParser(target=builder))
    except (ET.ParseError, ValueError, LookupError) as e:
        raise LiftParseError(f"not well-formed XML: {e}") from e


def typed_date(raw: str) -> date | datetime:
    v = raw.strip()
    if "T" not in v:
        try:
            return date.fromisoformat(v)
        except ValueError:
            pass
    return datetime.fromisoformat(v)


def date_text(v: date | datetime) -> str:
    s = v.isoformat()
    return s[:-6] + "Z" if s.endswith("+00:00") else s


_TYPES = {"date": typed_date, "int": lambda s: int(s.strip())}
_CONVERT = {k: {a: _TYPES.get(t) for a, t, _ in kind.attrs} for k, kind in KINDS.items()}


def below() -> dict[str, frozenset[str]]:
    """Of every kind the tags that can stand anywhere below it."""
    out = {k: set(s) for k, s in SLOTS.items()}
    while any([len(out[k]) < len(out[k].update(*(out[child] for child, _ in s.values())) or out[k]) for k, s in SLOTS.items()]):
        pass
    return {k: frozenset(v) for k, v in out.items()}


BELOW = below()


def needed(tags: Iterable[str]) -> dict[str, frozenset[str]]:
    """Of every kind the child tags on the way to nodes with these tags."""
    tags = frozenset(tags)
    return {k: frozenset(t for t, (child, _) in s.items() if t in tags or BELOW[child] & tags) for k, s in SLOTS.items()}


def _residue(el: ET.Element, index: int) -> tuple[str, str, int]:
    kind = "comment" if el.tag is ET.Comment else "pi" if el.tag is ET.ProcessingInstruction else "element"
    tail, el.tail = el.tail, None
    xml = "<?" + (el.text or "") + "?>" if kind == "pi" else ET.tostring(el, encoding="unicode") if "{" in str(el.tag) else write(el)
    el.tail = tail
    return kind, xml, index


def parse(el: ET.Element, kind: str, need: dict[str, frozenset[str]] | None = None) -> Node:
    """A node with all below it; with ``need`` (of every kind the child tags, see ``needed``) without other children, for reading alone."""
    node = Node(el.tag, kind)
    types = _CONVERT[kind]
    for name, value in el.attrib.items():
        if name not in types:
            node.xattrs[name] = value
        elif (convert := types[name]) is None:
            node.attrs[name] = value
        else:
            try:
                node.attrs[name] = convert(value)
                node.raw[name] = value
            except ValueError:
                node.xattrs[name] = value
    if kind in MIXED:
        _mixed(el, node, node)
        return node
    slots, kids, take = SLOTS[kind], node.kids, None if need is None else need[kind]
    passed: set[str] = set()
    if el.text and el.text.strip():
        node.xnodes.append(("text", el.text, 0))
    for i, child in enumerate(el):
        tag = child.tag
        slot = slots.get(tag) if isinstance(tag, str) else None
        if slot is None or (slot[1] != MANY and (tag in passed or len(kids.get(tag, ())) >= slot[1])):
            node.xnodes.append(_residue(child, i))
        elif take is not None and tag not in take:
            passed.add(tag)
            if slot[0] == "text" and len(child):
                _mixed(child, Node("text", "text"), node)
        elif slot[0] == "text":
            t = node.add(Node("text", "text"))
            t.xattrs = dict(child.attrib)
            _mixed(child, t, node)
        elif tag in kids:
            kids[tag].append(parse(child, slot[0], need))
        else:
            kids[tag] = [parse(child, slot[0], need)]
        if child.tail and child.tail.strip():
            node.xnodes.append(("text", child.tail, i + 1))
    return node


def _mixed(el: ET.Element, node: Node, host: Node) -> None:
    """Text and spans in order; anything else goes to the host's residue."""
    if el.text:
        node.frags.append(el.text)
    for i, child in enumerate(el):
        if child.tag != "span":
            host.xnodes.append(_residue(child, i))
        else:
            node.frags.append(parse(child, "span"))
        if child.tail:
            node.frags.append(child.tail)


# --- serializing

def _esc(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\r", "&#13;")


def _attr(s: str) -> str:
    return _esc(s).replace('"', "&quot;").replace("\n", "&#10;").replace("\t", "&#9;")


def write(el: ET.Element) -> str:
    """XML text of a tree without its tail; names in Clark notation get declared prefixes."""
    out = io.StringIO()
    _write(el, out, {})
    return out.getvalue()


def _name(name: str, known: dict[str, str]) -> str:
    if not name.startswith("{"):
        return name
    uri, _, local = name[1:].partition("}")
    if uri == "http://www.w3.org/XML/1998/namespace":
        return f"xml:{local}"
    return f"{known.setdefault(uri, f'ns{len(known)}')}:{local}"


def _write(el: ET.Element, out: io.StringIO, known: dict[str, str]) -> None:
    if el.tag is ET.Comment:
        out.write(f"<!--{el.text or ''}-->")
    elif el.tag is ET.ProcessingInstruction:
        out.write(f"<?{el.text or ''}?>")
    elif el.tag == _RAW:
        out.write(el.text or "")
    else:
        here = dict(known)
        tag, attrs = _name(el.tag, here), [(_name(k, here), v) for k, v in el.attrib.items()]
        new = [(f"xmlns:{p}", u) for u, p in here.items() if u not in known]
        out.write(f"<{tag}" + "".join(f' {k}="{_attr(v)}"' for k, v in [*new, *attrs]))
        if not el.text and not len(el):
            out.write("/>")
            return
        out.write(">" + _esc(el.text or ""))
        for c in el:
            _write(c, out, here)
            out.write(_esc(c.tail or ""))
        out.write(f"</{tag}>")


_RAW = "\0raw"


def _put_text(el: ET.Element, at: int, text: str) -> None:
    if len(el) and at > 0:
        last = el[min(at, len(el)) - 1]
        last.tail = (last.tail or "") + text
    else:
        el.text = f"{el.text or ''}{text}"


def _put_residue(el: ET.Element, node: Node) -> None:
    for kind, xml, at in sorted(node.xnodes, key=lambda n: (n[2], n[0] != "text")):
        if kind == "text":
            _put_text(el, at, xml)
            continue
        if kind == "element" and "xmlns" not in xml:
            child = tree(xml)
        else:
            child = ET.Element(_RAW)
            child.text = xml
        el.insert(min(at, len(el)), child)


def element(node: Node) -> ET.Element:
    el = ET.Element(node.tag)
    for a, _, _ in KINDS[node.kind].attrs:
        v = node.attrs[a]
        if v is not None:
            el.set(a, date_text(v) if isinstance(v, date) else str(v))
    for a, v in node.xattrs.items():
        if el.get(a) is None:
            el.set(a, v)
    if node.kind in MIXED:
        for f in node.frags:
            if not isinstance(f, str):
                el.append(element(f))
            elif f:
                _put_text(el, len(el), f)
    elif node.kind == "form" and node.one("text") is None:
        ET.SubElement(el, "text")
    for tag, (child, _) in SLOTS[node.kind].items():
        for k in node.all(tag):
            if child not in ("multitext", "ranges", "fields") or k.filled():
                el.append(element(k))
    _put_residue(el, node)
    return el


def _indent(el: ET.Element, depth: int) -> None:
    if el.tag in (*MIXED, _RAW) or not isinstance(el.tag, str) or not len(el) or (el.text or "").strip():
        return
    inner, outer = "\n" + "  " * (depth + 1), "\n" + "  " * depth
    el.text = inner
    for i, c in enumerate(el):
        if not (c.tail or "").strip():
            c.tail = inner if i + 1 < len(el) else outer
        _indent(c, depth + 1)


def canonical(node: Node) -> str:
    """Canonical XML of a node, indented by two spaces, with a line feed."""
    out: list[str] = []
    _emit(node, 0, out.append)
    out.append("\n")
    return "".join(out)


def _by_tree(node: Node, depth: int) -> str:
    """The same of a subtree by way of elements, for text among its residue and for names in Clark notation."""
    el = element(node)
    _indent(el, depth)
    return write(el)


_PLAIN = re.compile(r'[&<>"\r\n\t]')
_OPTIONAL = {"multitext", "ranges", "fields"}
_CLOSE = {k: [(tag, child in _OPTIONAL) for tag, (child, _) in s.items()] for k, s in SLOTS.items()}


def _emit(node: Node, depth: int, put: Callable[[str], object]) -> None:
    """What ``_by_tree`` gives, without a tree of elements."""
    kind, tag, attrs = node.kind, node.tag, node.attrs
    if node.xattrs or node.xnodes:
        if any(a[0] == "{" for a in node.xattrs) or any(k == "text" for k, _, _ in node.xnodes) or (node.xnodes and kind in MIXED):
            put(_by_tree(node, depth))
            return
    put(f"<{tag}")
    for a in _BLANK[kind]:
        v = attrs[a]
        if v is not None:
            v = v if type(v) is str else date_text(v) if isinstance(v, date) else str(v)
            put(f' {a}="{_attr(v) if _PLAIN.search(v) else v}"')
    for a, v in node.xattrs.items():
        if attrs.get(a) is None or a not in _BLANK[kind]:
            put(f' {a}="{_attr(v)}"')
    if kind in MIXED:
        frags = [f for f in node.frags if f != ""]
        if not frags:
            put("/>")
            return
        put(">")
        for f in frags:
            if isinstance(f, str):
                put(_esc(f) if _PLAIN.search(f) else f)
            else:
                _emit(f, depth + 1, put)
        put(f"</{tag}>")
        return
    kids = node.kids
    items: list = [None] if kind == "form" and not kids.get("text") else []
    for t, optional in _CLOSE[kind]:
        if own := kids.get(t):
            items += [k for k in own if k.filled()] if optional else own
    for what, xml, at in sorted(node.xnodes, key=lambda n: n[2]):
        child = tree(xml) if what == "element" and "xmlns" not in xml else xml
        items.insert(min(at, len(items)), child)
    if not items:
        put("/>")
        return
    put(">")
    inner = "\n" + "  " * (depth + 1)
    for k in items:
        put(inner)
        if isinstance(k, Node):
            _emit(k, depth + 1, put)
        elif k is None:
            put("<text/>")
        elif isinstance(k, str):
            put(k)
        else:
            _indent(k, depth + 1)
            put(write(k))
    put(f"{inner[:-2]}</{tag}>")


def digest(node: Node) -> str:
    return hashlib.sha256(canonical(node).encode()).hexdigest()


_OPEN_TAG = re.compile(rb"<(?![?!])")


def parse_fragment(root_open: bytes, fragment: bytes, kind: str, need: dict[str, frozenset[str]] | None = None) -> Node:
    """A root child by itself, under the root tag's namespace declarations."""
    name = re.match(rb"<([^\s/>]+)", root_open)
    if name is None:
        raise LiftParseError("no root element")
    head = root_open.rstrip()
    head = head[:-2] + b">" if head.endswith(b"/>") else head
    for child in tree(head + fragment + b"</" + name[1] + b">"):
        if isinstance(child.tag, str):
            return parse(child, kind, need)
    raise LiftParseError("no element in fragment")
