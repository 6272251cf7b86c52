"""A reader and a writer that hold one entry at a time."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

from ..sources import nodes as N
from ..sources.scan import Document, check_root, spans


class LiftReader:
    """Iterate over entries.  The header is read at once if it comes first, else when the iteration meets it."""

    def __init__(self, path: os.PathLike | str):
        self._scan, self._data = open(path, "rb"), open(path, "rb")
        self._doc = Document()
        self._spans = spans(self._scan, self._doc)
        self.header: N.Node | None = None
        self._held = next(self._spans, None)
        try:
            check_root(self._doc)
        except N.LiftParseError:
            self.close()
            raise
        self._data.seek(self._doc.root_start)
        self._head = self._data.read((self._doc.root_end or self._doc.size) - self._doc.root_start)
        while self._held is not None and self._held.tag != "entry":
            self._take(self._held)
            self._held = next(self._spans, None)

    @property
    def producer(self) -> str | None:
        return self._doc.attrs.get("producer")

    def _take(self, s) -> None:
        if s.tag == "header" and self.header is None:
            self.header = N.parse_fragment(self._head, self._bytes(s), "header")

    def _bytes(self, s) -> bytes:
        self._data.seek(s.start)
        return self._data.read(s.end - s.start)

    def __iter__(self) -> Iterator[N.Node]:
        s = self._held
        while s is not None:
            if s.tag == "entry":
                yield N.parse_fragment(self._head, self._bytes(s), "entry")
            else:
                self._take(s)
            s = self._held = next(self._spans, None)

    def close(self) -> None:
        self._scan.close()
        self._data.close()

    def __exit__(self, *_: object) -> None:
        self.close()

    def __enter__(self):
        return self


class LiftWriter:
    """Write the header at once, each entry canonically, the companion on a clean close.  After an error the file is left without its end tag."""

    def __init__(self, path: os.PathLike | str, producer: str | None = None, header: N.Node | None = None, ranges=None):
        self._path = Path(path)
        head, self._ranges = header, ranges
        if ranges is not None:
            name = self._path.stem + ".lift-ranges"
            head = N.parse(N.element(header), "header") if header is not None else N.Node("header", "header")
            host = head.one("ranges") or head.add(N.Node("ranges", "ranges"))
            have = {r.attrs["id"] for r in host.all("range")}
            for r in ranges.ranges:
                if r.attrs["id"] not in have:
                    ref = host.add(N.Node("range", "range"))
                    ref.attrs["id"], ref.attrs["href"] = r.attrs["id"], name
        self._f = self._path.open("wb")
        extra = f' producer="{N._attr(producer)}"' if producer is not None else ""
        self._f.write(N.DECLARATION + f'<lift version="0.13"{extra}>\n'.encode())
        if head is not None and head.filled():
            self._f.write(N.canonical(head).encode())

    def write(self, entry: N.Node) -> None:
        self._f.write(N.canonical(entry).encode())

    def close(self) -> None:
        if not self._f.closed:
            self._f.write(b"</lift>\n")
            self._f.close()
            if self._ranges is not None:
                self._ranges.save(self._path.parent / (self._path.stem + ".lift-ranges"))

    def __enter__(self):
        return self

    def __exit__(self, kind: object, *_: object) -> None:
        if kind is None:
            self.close()
        else:
            self._f.close()


def open_reader(path: str | os.PathLike) -> LiftReader:
    return LiftReader(path)


def open_writer(path: str | os.PathLike, **options) -> LiftWriter:
    return LiftWriter(path, **options)
