"""Byte spans of a document's root children, by one pass of expat in constant memory."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO
from xml.parsers import expat

from .nodes import LiftParseError

MIXED_ENCODINGS = {"utf-8", "us-ascii", "ascii", ""}


@dataclass
class Span:
    """A root child: an element, comment or processing instruction."""

    tag: str
    start: int
    end: int
    line: int
    index: int


@dataclass
class Document:
    """The root's tag and attributes, byte positions, and whether bytes can be reused."""

    root: str = ""
    attrs: dict[str, str] = field(default_factory=dict)
    root_start: int = 0
    root_end: int = 0
    close: int = 0
    size: int = 0
    empty_tag: bool = False
    encoding: str = ""
    doctype: bool = False
    splits: list = field(default_factory=list)
    last: int = 0

    @property
    def reusable(self) -> bool:
        return self.encoding.lower() in MIXED_ENCODINGS and not self.doctype and not self.empty_tag


class _Window:
    """What was fed since the last event, to find where a token ends."""

    def __init__(self) -> None:
        self.data, self.base, self.last = b"", 0, 0

    def feed(self, block: bytes) -> None:
        self.data, self.base = self.data[self.last - self.base :] + block, self.last

    def after(self, start: int, ends: bytes) -> int:
        """Position after the first ``ends`` at or after ``start``."""
        return self.base + self.data.index(ends, start - self.base) + len(ends)

    def empty(self, start: int) -> bool:
        """Whether the element at ``start`` is one empty-element tag; no event came since it began."""
        return self.last == start and self.data.endswith(b"/>", 0, self.tag_end(start) - self.base)

    def tag_end(self, start: int) -> int:
        """Position after a start tag, whose quoted values may hold any sign but their quote."""
        return self.base + _TAG.match(self.data, start - self.base).end()


_TAG = re.compile(rb"""<(?:[^"'>]|"[^"]*"|'[^']*')*>""")


def spans(f: BinaryIO, doc: Document, step: int = 1 << 20) -> Iterator[Span]:
    """Spans in document order; ``doc`` is filled in on the way.  Raises at the first error, after what came before it."""
    p, w = expat.ParserCreate(), _Window()
    p.ordered_attributes = True
    depth, count, done = 0, 0, []
    open_span: Span | None = None

    def begin(tag: str, attrs: list[str]) -> None:
        nonlocal depth, open_span, count
        w.last = p.CurrentByteIndex
        if depth == 0:
            doc.root, doc.root_start = tag, p.CurrentByteIndex
            doc.attrs = dict(zip(attrs[::2], attrs[1::2], strict=True))
            doc.root_end = w.tag_end(doc.root_start)
        elif depth == 1:
            open_span = Span(tag, p.CurrentByteIndex, -1, p.CurrentLineNumber, count)
            count += 1
        depth += 1

    def finish(_: str) -> None:
        nonlocal depth
        depth -= 1
        if depth == 1:
            start = open_span.start
            open_span.end = w.tag_end(start) if w.empty(start) else w.after(p.CurrentByteIndex, b">")
            done.append(open_span)
        elif depth == 0:
            doc.close = p.CurrentByteIndex
            doc.empty_tag = w.empty(doc.root_start)

    def leaf(tag: str, ends: bytes) -> None:
        nonlocal count
        if depth == 1:
            at = p.CurrentByteIndex
            done.append(Span(tag, at, w.after(at, ends), p.CurrentLineNumber, count))
            count += 1

    p.StartElementHandler, p.EndElementHandler = begin, finish
    p.CommentHandler = lambda _: leaf("#comment", b"-->")
    p.ProcessingInstructionHandler = lambda *_: leaf("#pi", b"?>")
    p.XmlDeclHandler = lambda _, enc, __: setattr(doc, "encoding", enc or "")
    p.StartDoctypeDeclHandler = lambda *_: setattr(doc, "doctype", True)
    try:
        while chunk := f.read(step):
            doc.size += len(chunk)
            w.feed(chunk)
            p.Parse(chunk, False)
            yield from done
            done.clear()
        p.Parse(b"", True)
    except (expat.ExpatError, ValueError, LookupError) as e:
        yield from done
        raise LiftParseError(f"not well-formed XML: {e}") from e
    yield from done


def check_root(doc: Document, root: str = "lift") -> None:
    if doc.root != root:
        raise LiftParseError(f"root element is <{doc.root}>, not <{root}>")
    if root == "lift" and doc.attrs.get("version") != "0.13":
        raise LiftParseError(f"unsupported LIFT version {doc.attrs.get('version')!r}")
