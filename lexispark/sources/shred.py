"""Entries to rows: one row for each node, with its path, its owner sense and flat text."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator
from datetime import date

import pyarrow as pa

from .nodes import BELOW, Node, date_text, needed
from .spec import SLOTS

NODES = (
    "doc string, entry_pos long, path string, idx array<int>, parent string, depth int, tag string, kind string, label string, pos int, is_leaf boolean, "
    "sense string, sense_id string, lifo array<int>, entry_id string, entry_guid string, entry_line int, "
    "id string, guid string, `order` long, type string, ref string, name string, value string, href string, lang string, source string, who string, "
    "date_created string, date_modified string, date_deleted string, `when` string, text string, extra map<string,string>, residue array<struct<kind:string,xml:string,index:int>>"
)
NAMES = [c.split()[0].strip("`") for c in NODES.replace("struct<kind:string,xml:string,index:int>", "s").replace("map<string,string>", "m").split(", ")]
_MULTI = {"pronunciation", "variant", "note", "example", "translation", "etymology", "reversal", "main"}


def label_of(node: Node) -> str | None:
    """The name of the multitext that a node's forms make, if they make one."""
    if node.kind == "multitext":
        return node.tag
    if node.kind in ("field", "annotation", "field-definition"):
        return "content"
    return "forms" if node.kind in _MULTI else None


class At:
    """A node and where it stands: its path, slots and positions, the path above, its place among its like, the multitext it is part of, and (path, id, positions from the last) of its sense."""

    __slots__ = ("node", "path", "idx", "parent", "pos", "label", "sense", "sense_id", "lifo")

    def __init__(self, node, path, idx, parent, pos, label, sense, sense_id, lifo):
        self.node, self.path, self.idx, self.parent, self.pos, self.label, self.sense, self.sense_id, self.lifo = node, path, idx, parent, pos, label, sense, sense_id, lifo


@functools.lru_cache(64)
def _routes(want: frozenset[str] | None) -> dict[str, list[tuple[int, str]]]:
    """Of every kind the slots that hold or lead to nodes with these tags."""
    return {k: [(s, t) for s, (t, (child, _)) in enumerate(slots.items()) if t != "text" and (want is None or t in want or BELOW[child] & want)] for k, slots in SLOTS.items()}


def visit(root: Node, tags: Iterable[str] | None = None) -> list[At]:
    """A node and all below it, in document order of slots; with ``tags`` only nodes that have one of them."""
    want = None if tags is None else frozenset(tags)
    out: list[At] = []
    _visit(root, "", [], None, 0, None, None, None, None, want, _routes(want), out)
    return out


def _visit(n: Node, path: str, idx: list[int], parent: str | None, at: int, label: str | None, sense: str | None, sense_id: str | None, lifo: list[int] | None, want: frozenset[str] | None, routes: dict[str, list[tuple[int, str]]], out: list[At]) -> None:
    if n.kind == "sense":
        sense, sense_id, lifo = path, n.attrs["id"], [*(lifo or ()), -at]
    if want is None or n.tag in want:
        out.append(At(n, path, idx, parent, at, label, sense, sense_id, lifo))
    kids = n.kids
    if not kids:
        return
    name, start = label_of(n), f"{path}/" if path else ""
    for s, tag in routes[n.kind]:
        if own := kids.get(tag):
            form = name if tag == "form" else None
            for i, k in enumerate(own):
                _visit(k, f"{start}{tag}[{i}]", [*idx, s, i], path, i, form, sense, sense_id, lifo, want, routes, out)


def _date(name: str) -> Callable[[At], str | None]:
    return lambda x: date_text(v) if isinstance(v := x.node.attrs.get(name), date) else None


def _order(x: At) -> int | None:
    v = x.node.attrs.get("order")
    return v if isinstance(v, int) and abs(v) < 1 << 63 else None


def _attr(name: str) -> Callable[[At], object]:
    return lambda x: x.node.attrs.get(name)


#: What each column that follows from a node alone has.
_OF: dict[str, Callable[[At], object]] = {
    "depth": lambda x: len(x.idx) // 2, "tag": lambda x: x.node.tag, "kind": lambda x: x.node.kind, "is_leaf": lambda x: x.node.kind != "sense" or not x.node.all("subsense"),
    **{c: (lambda c: lambda x: getattr(x, c))(c) for c in "path idx parent pos label sense sense_id lifo".split()},
    **{c: _attr(c) for c in "id guid ref name value href lang source who".split()},
    "order": _order, "type": lambda x: x.node.attrs.get("type", x.node.attrs.get("tag")),
    "date_created": _date("dateCreated"), "date_modified": _date("dateModified"), "date_deleted": _date("dateDeleted"), "when": _date("when"),
    "text": lambda x: x.node.text() if x.node.kind in ("form", "text", "span") else None,
    "extra": lambda x: list(x.node.xattrs.items()), "residue": lambda x: x.node.xnodes,
}


def need(tags: Iterable[str] | None, columns: Iterable[str]) -> dict[str, frozenset[str]] | None:
    """What has to be parsed for these columns of nodes with these tags."""
    if tags is None:
        return None
    own = needed([*tags, *(["subsense"] if "is_leaf" in columns else [])])
    return {k: v | {"text"} if k == "form" and "text" in columns else v for k, v in own.items()}


def shredder(columns: list[str], tags: Iterable[str] | None = None) -> Callable[..., Iterator[tuple]]:
    """A function of an entry's tree, its document, place and line that gives its rows."""
    tags = None if tags is None else frozenset(tags)
    of = [_OF.get(c) for c in columns]
    spare = [k for k, f in enumerate(of) if f is None]
    which = [("doc", "entry_pos", "entry_line", "entry_id", "entry_guid").index(columns[k]) for k in spare]

    def rows(root: Node, doc: str, pos: int | None, line: int | None) -> Iterator[tuple]:
        own = (root.attrs.get("id"), root.attrs.get("guid")) if root.kind == "entry" else (None, None)
        known = (doc, pos, line, *own)
        fixed = [known[i] for i in which]
        for x in visit(root, tags):
            row = [f(x) if f is not None else None for f in of]
            for k, v in zip(spare, fixed, strict=True):
                row[k] = v
            yield tuple(row)

    return rows


def shred(root: Node, doc: str, pos: int | None, line: int | None) -> Iterator[tuple]:
    """Rows of a node and all below it, in document order of slots."""
    return _WHOLE(root, doc, pos, line)


_WHOLE = shredder(NAMES)


class Batches:
    """Rows to Arrow batches of a bounded size, however many rows an entry has."""

    def __init__(self, schema: pa.Schema, rows: int = 2048, weight: int = 2 << 20):
        self.schema, self.most, self.heavy = schema, rows, weight
        self.out: list[tuple] = []
        self.weight = 0

    def full(self, weight: int = 0) -> bool:
        self.weight += weight
        return len(self.out) >= self.most or (self.weight >= self.heavy and bool(self.out))

    def take(self) -> pa.RecordBatch:
        columns = zip(*self.out, strict=True) if self.out else [()] * len(self.schema)
        got = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, self.schema.types, strict=True)], schema=self.schema)
        self.out, self.weight = [], 0
        return got
