"""Python data source ``lift``: a document's root children, split by byte ranges.

``read_document`` finds the splits in one pass of constant memory and keeps one row for each; tasks find the children of
their own range.  Documents in other encodings or with a DOCTYPE, whose parts do not stand alone, are listed child by
child instead.  Options: ``path`` (a file; several are separated by commas), ``split`` (bytes of a partition), ``splits``
(what ``read_document`` found).  Rows: doc, index, entry_pos (entries only), tag, line, byte_start, byte_end, prev_end (of
the entry before), gap (bytes before it), raw.
"""

from __future__ import annotations

import base64
import io
import json
import os
import re
import shutil
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .nodes import DECLARATION, LiftParseError
from .scan import Document, Span, check_root, spans
from .shred import Batches

CHILDREN = "doc string, index long, entry_pos long, tag string, line int, byte_start long, byte_end long, prev_end long, gap binary, raw binary"

_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
_ARROW = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in CHILDREN.split(", ")])


@dataclass
class Range(InputPartition):
    """Bytes of a document, and where its first child stands; ``rows`` only where the children are listed."""

    path: str
    gap: int = 0
    start: int = 0
    stop: int = 0
    index: int = 0
    pos: int = 0
    line: int = 1
    prev: int = 0
    head: tuple[int, int] = (0, 0)
    rows: list[tuple[int, str, int, int, int]] | None = None


def local_file(uri: str) -> Path:
    """The path of a file URI."""
    from urllib.parse import unquote, urlparse

    u = urlparse(uri)
    if u.scheme not in ("", "file"):
        raise ValueError(f"{uri} is not on a mounted file system")
    return Path(unquote(u.path))


class Splits:
    """Collects the ranges of a document while its children go by."""

    def __init__(self, path: str, size: int, entry: str, listed: bool = False):
        self.path, self.size, self.entry, self.listed = path, size, entry, listed
        self.out: list[Range] = []
        self.now: Range | None = None
        self.pos, self.end, self.last = 0, 0, 0

    def add(self, s: Span, doc: Document) -> None:
        if self.now is None:
            self.end, self.last = self.end or doc.root_end, self.last or doc.root_end
            self.now = Range(self.path, self.end, s.start, s.end, s.index, self.pos, s.line, self.last, (doc.root_start, doc.root_end), [] if self.listed else None)
        if self.listed:
            self.now.rows.append((s.index, s.tag, s.line, s.start, s.end))
        self.now.stop = self.end = s.end
        if s.tag == self.entry:
            self.pos, self.last = self.pos + 1, s.end
        if s.end - self.now.start >= self.size:
            self.close()

    def close(self) -> list[Range]:
        if self.now is not None:
            self.out.append(self.now)
            self.now = None
        return self.out


class LiftReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = [p for p in options["path"].split(",") if p]
        self.split = int(options.get("split", 8 << 20))
        self.root = options.get("root", "lift")
        self.entry = "entry" if self.root == "lift" else "range"
        self.splits = options.get("splits")

    def partitions(self) -> list[Range]:
        if self.splits is not None:
            out = [Range(self.paths[0], *x[:-1], head=tuple(x[-1])) for x in json.loads(self.splits)]
        else:
            out = [r for p in self.paths for r in read_document(p, self.root, self.split)[0].splits]
        return out or [Range("")]

    def read(self, part: Range) -> Iterator[tuple]:
        if not part.path:
            return
        name, at, pos, prev = os.path.basename(part.path), part.gap, part.pos, part.prev
        with open(part.path, "rb") as f:
            f.seek(part.gap)
            for index, tag, line, a, e in part.rows if part.rows is not None else _within(part):
                gap = f.read(a - at)
                entry = tag == self.entry
                yield name, index, pos if entry else None, tag, line, a, e, prev, gap, f.read(e - a)
                at = e
                if entry:
                    pos, prev = pos + 1, e


class BatchReader(LiftReader):
    """The same rows in batches of few, so that a worker holds little beside its range's bytes."""

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        made = Batches(_ARROW, 256, 1 << 20)
        for row in super().read(part):
            made.out.append(row)
            if made.full(len(row[8]) + len(row[9])):
                yield made.take()
        if made.out:
            yield made.take()


def _within(part: Range) -> Iterator[tuple[int, str, int, int, int]]:
    """(index, tag, line, start, end) of the children in a range, read under the root's open tag."""
    with open(part.path, "rb") as f:
        f.seek(part.head[0])
        head = f.read(part.head[1] - part.head[0])
        f.seek(part.start)
        raw = f.read(part.stop - part.start)
    shift, above = part.start - len(head), part.line - 1 - head.count(b"\n")
    close = b"</" + re.match(rb"<([^\s/>]+)", head)[1] + b">"
    for s in spans(io.BytesIO(head + raw + close), Document()):
        yield part.index + s.index, s.tag, s.line + above, s.start + shift, s.end + shift


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str


class LiftWriter(DataSourceArrowWriter):
    """Entries (column ``raw``) to one document, in order of partitions: sort by a range, then write.

    Tasks write parts beside the target, which must be on a file system that all tasks share; the commit joins them
    and moves the result over the target, an abort removes them.  Each row gets a line of its own, unless ``exact`` is
    set; what stands before and after the rows is ``prolog`` and ``epilog`` (base 64) or a root of its own.
    """

    def __init__(self, options: dict[str, str]):
        self.path, self.exact = options["path"], "exact" in options
        self.prolog, self.epilog = base64.b64decode(options.get("prolog", "")), base64.b64decode(options.get("epilog", ""))
        if not self.prolog:
            self.prolog, self.epilog = DECLARATION + options.get("head", '<lift version="0.13">').encode() + b"\n", b"</lift>\n"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        t = TaskContext.get()
        path = f"{self.path}.{t.partitionId():08d}-{t.taskAttemptId()}.part"
        with open(path, "wb") as f:
            for b in batches:
                for raw in b.column("raw"):
                    f.write(raw.as_py() if self.exact else raw.as_py().rstrip(b"\n") + b"\n")
        return Part(t.partitionId(), path)

    def commit(self, messages: list[Part | None]) -> None:
        done = sorted((m for m in messages if m), key=lambda m: m.partition)
        with open(self.path + ".part", "wb") as out:
            out.write(self.prolog)
            out.flush()
            for m in done:  # a part goes when it is joined, so the document is not there twice
                _append(m.path, out)
                os.remove(m.path)
            out.write(self.epilog)
        os.replace(self.path + ".part", self.path)
        self.abort(done)

    def abort(self, messages: list[Part | None]) -> None:
        for m in messages:
            if m and os.path.exists(m.path):
                os.remove(m.path)


def _append(path: str, out: BinaryIO) -> None:
    """A file's bytes to the end of another, by the kernel where it can."""
    with open(path, "rb") as f:
        left = os.fstat(f.fileno()).st_size
        try:
            while left > 0 and (n := os.copy_file_range(f.fileno(), out.fileno(), min(left, 1 << 30))):
                left -= n
        except (AttributeError, OSError):
            f.seek(os.lseek(f.fileno(), 0, os.SEEK_CUR))
        shutil.copyfileobj(f, out, 1 << 20)
        out.flush()


def write_rows(rows: DataFrame, path: str | os.PathLike, prolog: bytes, epilog: bytes, exact: bool) -> None:
    """Rows (column ``raw``) between two pieces, in order of partitions, by the tasks that have them."""
    rows.sparkSession.dataSource.register(LiftSource)
    out = rows.select("raw").write.format("lift").mode("overwrite")
    for k, v in (("prolog", prolog), ("epilog", epilog)):
        out = out.option(k, base64.b64encode(v).decode())
    (out.option("exact", "1") if exact else out).save(os.fspath(path))


class LiftSource(DataSource):
    """Register with ``spark.dataSource.register(LiftSource)``; then ``spark.read.format("lift")``."""

    @classmethod
    def name(cls) -> str:
        return "lift"

    def schema(self) -> str:
        return CHILDREN

    def reader(self, schema) -> BatchReader:
        return BatchReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> LiftWriter:
        options = dict(self.options)
        if not overwrite and os.path.exists(options["path"]):
            raise FileExistsError(options["path"])
        return LiftWriter(options)


def children(spark: SparkSession, path: str, root: str = "lift", split: int = 8 << 20, doc: Document | None = None) -> DataFrame:
    """Root children of a document as rows; ``doc``, if it was read before, has the splits."""
    spark.dataSource.register(LiftSource)
    read = spark.read.format("lift").option("root", root).option("split", str(split))
    if doc is not None and doc.reusable:
        read = read.option("splits", json.dumps([[r.gap, r.start, r.stop, r.index, r.pos, r.line, r.prev, r.head] for r in doc.splits]))
    return read.load(os.fspath(path))


def read_document(path: str, root: str = "lift", split: int = 8 << 20) -> tuple[Document, list[Span], bytes]:
    """Document facts with its splits, the root children that are not entries, and the root's open tag."""
    doc, kept = Document(), []
    with open(path, "rb") as f:
        found = Splits(path, split, "entry" if root == "lift" else "range")
        for s in spans(f, doc):
            if not found.pos and found.now is None and not found.out:
                found.listed = not doc.reusable
            found.add(s, doc)
            if s.tag != "entry" or root != "lift":
                kept.append(s)
        check_root(doc, root)
        doc.splits, doc.last = found.close(), found.last or doc.root_end
        f.seek(doc.root_start)
        head = f.read(max(0, (doc.root_end or doc.size) - doc.root_start))
    return doc, kept, head


#: Bytes of a document from which tasks look for its splits, and of what one of them reads.
BY_TASKS, CHUNK = 64 << 20, 32 << 20


class _Piece:
    """A root's open tag, the bytes of a document between two places, and its close tag, as one file."""

    def __init__(self, f: BinaryIO, head: bytes, start: int, stop: int, close: bytes):
        self.f, self.left, self.head, self.close, self.lines, self.cr = f, stop - start, head, close, 0, False
        f.seek(start)

    def read(self, n: int) -> bytes:
        if self.head:
            out, self.head = self.head, b""
            return out
        if self.left > 0:
            out = self.f.read(min(n, self.left))
            self.left = self.left - len(out) if out else 0
            self.lines += _lines(out) - (self.cr and out[:1] == b"\n")
            self.cr = out[-1:] == b"\r"
            return out
        out, self.close = self.close, b""
        return out


def _lines(data: bytes) -> int:
    return data.count(b"\n") + data.count(b"\r") - data.count(b"\r\n")


def _next(f: BinaryIO, at: int, tag: bytes, size: int) -> int:
    """Where the first start tag of that name at or after a place is, or the document's end."""
    pattern, keep = re.compile(rb"<" + tag + rb"[\s/>]"), len(tag) + 1
    f.seek(at)
    data = b""
    while block := f.read(1 << 20):
        data += block
        if m := pattern.search(data):
            return at + m.start()
        at, data = at + max(0, len(data) - keep), data[-keep:]
    return size


def _piece(path: str, k: int, facts: dict, split: int) -> dict | None:
    """The splits and other children of one piece, counted from its start; None if it is no sequence of whole root children."""
    a, tag, size = facts["root_end"], facts["entry"].encode(), facts["size"]
    with open(path, "rb") as f:
        f.seek(facts["root_start"])
        head = f.read(a - facts["root_start"])
        start = a if k == 0 else _next(f, a + k * facts["chunk"], tag, size)
        stop = _next(f, a + (k + 1) * facts["chunk"], tag, size) if a + (k + 1) * facts["chunk"] < size else size
        if start >= stop:
            return {"empty": True}
        close = b"" if stop == size else b"</" + re.match(rb"<([^\s/>]+)", head)[1] + b">"
        piece, doc, none = _Piece(f, head, start, stop, close), Document(), Document(root_end=-1)
        shift, above = start - len(head), _lines(head) + 1
        found, kept, count = Splits(path, split, facts["entry"]), [], 0
        try:
            for s in spans(piece, doc):
                s.start, s.end, s.line = s.start + shift, s.end + shift, s.line - above
                found.add(s, none)
                count += 1
                if s.tag != "entry" or facts["root"] != "lift":
                    kept.append([s.tag, s.start, s.end, s.line, s.index])
        except LiftParseError:
            return None
    if stop < size and doc.close + shift != stop:
        return None
    rows = [[r.gap, r.start, r.stop, r.index, r.pos, r.line, r.prev] for r in found.close()]
    return {"splits": rows, "kept": kept, "count": count, "entries": found.pos, "end": found.end, "last": found.last, "lines": piece.lines, "close": doc.close + shift}


def read_document_by_tasks(spark: SparkSession, path: str, root: str = "lift", split: int = 8 << 20, least: int = BY_TASKS, chunk: int = CHUNK) -> tuple[Document, list[Span], bytes]:
    """What ``read_document`` gives, a large document in pieces that tasks read.

    A piece begins at what looks like an entry's start tag.  If a piece that begins at a root child is well formed
    under the root's tag, it ends where the next begins, at a root child; so all pieces are right if all are well formed.
    Else the document is read in one pass, which raises what is to be raised.
    """
    size = os.path.getsize(path)
    if size < least:
        return read_document(path, root, split)
    doc = Document()
    with open(path, "rb") as f:
        try:
            next(spans(f, doc), None)
        except LiftParseError:
            return read_document(path, root, split)
        f.seek(doc.root_start)
        head = f.read(doc.root_end - doc.root_start)
    check_root(doc, root)
    if not doc.reusable or not doc.root_end:
        return read_document(path, root, split)
    facts = {"root_start": doc.root_start, "root_end": doc.root_end, "entry": "entry" if root == "lift" else "range", "root": root, "size": size, "chunk": chunk}
    pieces = -(-(size - doc.root_end) // chunk)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b["id"].to_pylist():
                yield pa.RecordBatch.from_pydict({"id": [k], "found": [json.dumps(_piece(path, k, facts, split))]})

    found = [json.loads(r.found) for r in sorted(spark.range(0, pieces, 1, pieces).mapInArrow(step, "id long, found string").collect())]
    if any(x is None for x in found):
        return read_document(path, root, split)
    kept, doc.splits, doc.size = [], [], size
    index = pos = 0
    end = last = doc.root_end
    with open(path, "rb") as f:
        line = 1 + _lines(f.read(doc.root_end))
    for x in found:
        if "empty" in x:
            continue
        for gap, start, stop, i, p, at, prev in x["splits"]:
            doc.splits.append(Range(path, end if gap < 0 else gap, start, stop, index + i, pos + p, line + at, last if prev < 0 else prev, (doc.root_start, doc.root_end)))
        kept += [Span(tag, a, e, line + at, index + i) for tag, a, e, at, i in x["kept"]]
        end, last = (x["end"] if x["end"] > 0 else end), (x["last"] if x["last"] > 0 else last)
        index, pos, line, doc.close = index + x["count"], pos + x["entries"], line + x["lines"], x["close"]
    doc.last = last
    return doc, kept, head
