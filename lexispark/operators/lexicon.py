"""A lexicon as DataFrames: load, query, edit, sort, save."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import shared_dir, ship, stored
from ..sources import nodes as N
from ..sources.lift_source import children, local_file, read_document, read_document_by_tasks, write_rows
from ..sources.shred import NAMES, NODES, Batches, need, shredder
from . import relational as R

ENTRIES = "doc string, entry_pos long, line int, byte_start long, byte_end long, prev_end long, raw binary, touched boolean"
COLUMNS = [c.split()[0] for c in ENTRIES.split(", ")]
_TYPES = {n: c for n, c in zip(NAMES, NODES.replace(",string>", ";string>").replace(",xml", ";xml").replace(",index", ";index").split(", "), strict=True)}
_TYPES = {n: c.replace(";", ",") for n, c in _TYPES.items()}


class RangesFile:
    """A companion of range vocabularies."""

    def __init__(self, path: Path | None = None):
        self.path, self.ranges, self.source = path, [], None
        self.xattrs: dict[str, str] = {}
        self.xnodes: list[tuple[str, str, int]] = []

    @classmethod
    def load(cls, path: str | os.PathLike) -> RangesFile:
        doc, kept, head = read_document(os.fspath(path), "lift-ranges")
        out, data = cls(Path(path)), Path(path).read_bytes()
        out.xattrs = dict(doc.attrs)
        spans = []
        for s in kept:
            raw = data[s.start : s.end]
            if s.tag == "range":
                r = N.parse_fragment(head, raw, "range")
                out.ranges.append(r)
                spans.append((s.start, s.end, N.digest(r), r))
            else:
                out.xnodes.append(("element" if s.tag[0] != "#" else s.tag[1:].replace("#", ""), raw.decode("utf-8", "replace"), s.index))
        out.source = (data, spans) if doc.reusable else None
        return out

    def find(self, id: str) -> N.Node | None:
        return next((r for r in self.ranges if r.attrs["id"] == id), None)

    def add_range(self, r: N.Node) -> N.Node:
        self.ranges.append(r)
        return r

    def sort(self) -> None:
        """Ranges, and elements in them, by case-folded id; stable."""
        for r in self.ranges:
            sort_range(r)
        self.ranges.sort(key=lambda r: r.attrs["id"].casefold())

    def render(self) -> bytes:
        """Original bytes of untouched ranges where the order is the same; else canonical."""
        if self.source and [s[3] for s in self.source[1]] == self.ranges:
            data, at, out = self.source[0], 0, []
            for a, e, digest, r in self.source[1]:
                out += [data[at:a], data[a:e] if N.digest(r) == digest else N.canonical(r).rstrip("\n").encode()]
                at = e
            return b"".join([*out, data[at:]])
        attrs = "".join(f' {k}="{N._attr(v)}"' for k, v in self.xattrs.items())
        chunks = [N.canonical(r) for r in self.ranges]
        for _, xml, at in sorted(self.xnodes, key=lambda n: n[2]):
            chunks.insert(min(at, len(chunks)), xml + "\n")
        return N.DECLARATION + f"<lift-ranges{attrs}>\n{''.join(chunks)}</lift-ranges>\n".encode()

    def save(self, path: str | os.PathLike | None = None) -> None:
        target = path or self.path
        if target is None:
            raise ValueError("no path to save to")
        replace(Path(target), [self.render()])


def sort_range(r: N.Node) -> None:
    r.kids.get("range-element", []).sort(key=lambda e: e.attrs["id"].casefold())


def replace(path: Path, chunks) -> None:
    """Write beside the target, then move over it."""
    part = path.with_name(path.name + ".part")
    with part.open("wb") as f:
        for c in chunks:
            f.write(c)
    part.replace(path)


def local_path(href: str) -> str | None:
    """A relative path, or None for remote, absolute and drive hrefs."""
    if "://" in href or re.match(r"https?:|file:|[/\\]|[A-Za-z]:", href):
        return None
    return href.replace("\\", "/")


class Lexicon:
    """Entries stay in a DataFrame of bytes; every table is shredded from it, so edits show at once."""

    def __init__(self, spark: SparkSession, entries: DataFrame, path: Path | None = None):
        ship(spark)
        self.spark, self.entries, self.path = spark, entries, path
        self.header = N.Node("header", "header")
        self.attrs: dict[str, str] = {"version": "0.13"}
        self.companions: dict[str, RangesFile] = {}
        self.root_open = b'<lift version="0.13">'
        self.source: dict | None = None
        self.residue: list[tuple[int, bytes]] = []
        self._nodes: DataFrame | None = None
        self._moved: tuple[Lexicon, DataFrame] | None = None
        self._roots: DataFrame | None = None
        self.staged: object = None

    # --- loading

    @classmethod
    def read(cls, spark: SparkSession, path: str | os.PathLike, resolve_ranges: bool = True, split: int = 8 << 20) -> Lexicon:
        """A .lift file with its companions, or a .zip of its folder, which is extracted to the shared folder for as long as the lexicon lives."""
        p, staged = Path(path), None
        if p.suffix.lower() == ".zip":
            from ..sources.archive import stage

            base = local_file(shared_dir(spark, "zip"))
            base.mkdir(parents=True)
            staged = tempfile.TemporaryDirectory(prefix="lexicon-", dir=base)
            p = stage(p, Path(staged.name))
        ship(spark)
        doc, kept, head = read_document_by_tasks(spark, os.fspath(p), split=split)
        rows = children(spark, os.fspath(p), split=split, doc=doc).where("entry_pos is not null")
        lex = cls(spark, rows.withColumn("touched", F.lit(False)).select(*COLUMNS), p)
        lex.staged = staged
        lex.attrs = dict(doc.attrs)
        lex.root_open = head if head else lex.root_open
        found = None
        with p.open("rb") as f:
            for s in kept:
                f.seek(s.start)
                raw = f.read(s.end - s.start)
                if s.tag == "header" and found is None:
                    lex.header, found = N.parse_fragment(head, raw, "header"), s
                else:
                    lex.residue.append((s.index, raw))
        lex.source = {"doc": doc, "header": (found.start, found.end, N.digest(lex.header)) if found else None, "attrs": dict(doc.attrs), "residue": list(lex.residue), "path": p, "order": True} if doc.reusable else None
        if resolve_ranges:
            for c in lex._companion_paths():
                lex.companions[c.name] = RangesFile.load(c)
        return lex

    def _companion_paths(self) -> list[Path]:
        base = self.path.parent
        tries = [base / (self.path.stem + ".lift-ranges")]
        for r in self.ranges_of_header():
            href = r.attrs["href"] or ""
            rel = local_path(href)
            tries += [base / rel] if rel else []
            last = re.split(r"[/\\]", href)[-1]
            tries += [base / last] if last else []
        out: dict[Path, Path] = {}
        for t in tries:
            if t.is_file() and t.suffix == ".lift-ranges":
                out.setdefault(t.resolve(), t)
        return list(out.values())

    def ranges_of_header(self) -> list[N.Node]:
        r = self.header.one("ranges")
        return r.all("range") if r is not None else []

    # --- tables

    @property
    def nodes(self) -> DataFrame:
        """One row per node of every entry; parsed anew for each plan, unless ``parsed`` has stored them."""
        return self._nodes if self._nodes is not None else self._shredded(None, NAMES)

    def _shredded(self, tags: tuple[str, ...] | None, columns: list[str]) -> DataFrame:
        if self._moved is not None:
            base, order = self._moved
            inner = [*columns, *(["entry_pos"] if "entry_pos" not in columns else [])]
            t = base._shredded(tags, inner).join(order.select("entry_pos", "place"), "entry_pos")
            return t.withColumn("entry_pos", F.col("place")).select(*columns)
        head, only, rows = self.root_open, need(tags, columns), shredder(columns, tags)

        def f(e: Entry) -> Iterator[tuple]:
            return rows(N.parse_fragment(head, e.raw, "entry", only), e.doc, e.entry_pos, e.line)

        return self._each(f, ", ".join(_TYPES[c] for c in columns))

    def _each(self, f: Callable[[Entry], Iterable[tuple]], schema: str | StructType) -> DataFrame:
        """The rows that ``f`` gives of every entry."""
        return each(self.entries.select(*Entry._fields), f, schema)

    def rows(self, f: Callable[[N.Node, int], Iterable[tuple]], schema: str | StructType, tags: Iterable[str] | None = None) -> DataFrame:
        """The rows that ``f`` gives of every entry's tree and place; with ``tags`` of trees that lead to nodes with these tags alone."""
        head, only = self.root_open, None if tags is None else N.needed(tags)
        return self._each(lambda e: f(N.parse_fragment(head, e.raw, "entry", only), e.entry_pos), schema)

    def parsed(self) -> Lexicon:
        """The same lexicon with its nodes in a stored table: for several plans, one parse, and scans of single columns."""
        out = self._with(self.entries, order=True)
        out._nodes = self._nodes if self._nodes is not None else stored(self.nodes, "nodes")
        return out

    def table(self, *tags: str, columns: Iterable[str] | None = None) -> DataFrame:
        """Rows of the nodes with these tags: senses and subsenses, forms, traits and so on; with ``columns`` only what these need is parsed."""
        names = NAMES if columns is None else list(columns)
        if self._nodes is not None:
            return self._nodes.where(F.col("tag").isin(*tags)).select(*names)
        if self._roots is not None and set(tags) == {"entry"} and set(names) <= set(self._roots.columns):
            return self._roots.select(*names)
        return self._shredded(tags, names)

    def range_rows(self) -> DataFrame:
        """(file, priority, range_pos, range_id, range_guid, elements, pos, id, parent, guid): a row for each element, or one of nulls."""
        rows = []
        for k, (name, ranges) in enumerate([*[(n, f.ranges) for n, f in self.companions.items()], (None, self.ranges_of_header())]):
            for i, r in enumerate(ranges):
                kids = r.all("range-element")
                for j, e in enumerate(kids or [None]):
                    rows.append((name, k, i, r.attrs["id"], r.attrs["guid"], len(kids), j if e else None, *((e.attrs["id"], e.attrs["parent"], e.attrs["guid"]) if e else (None, None, None))))
        return self.spark.createDataFrame(rows, "file string, priority int, range_pos int, range_id string, range_guid string, elements int, pos int, id string, parent string, guid string")

    def all_ranges(self) -> DataFrame:
        """The merged view: of each range the header's if it lists elements or is alone, else the first companion's."""
        rows = self.range_rows()
        head = F.col("file").isNull()
        own = rows.select("range_id", "file", "priority", "range_pos", "elements").distinct()
        pick = R.first_by_priority(own, ["range_id"], [F.when(head & (F.col("elements") > 0), 0).when(~head, 1).otherwise(2), "priority", "range_pos"])
        return rows.join(pick.select("range_id", "priority", "range_pos"), ["range_id", "priority", "range_pos"], "left_semi")

    def find(self, *, guid: str | None = None, id: str | None = None):
        """The first entry row with this id and guid, or None."""
        if guid is None is id:
            raise ValueError("find needs an id or a guid")
        e = self.table("entry", columns=["entry_pos", "id", "guid"])
        for c, v in (("id", id), ("guid", guid)):
            e = e.where(F.col(c) == v) if v is not None else e
        return e.orderBy("entry_pos").first()

    def node(self, entry_pos: int) -> N.Node:
        """One entry as a tree."""
        row = self.entries.where(F.col("entry_pos") == entry_pos).first()
        if row is None:
            raise KeyError(entry_pos)
        return N.parse_fragment(self.root_open, bytes(row.raw), "entry")

    def media_refs(self) -> DataFrame:
        """entry_pos, seq, kind, href, entry_id, entry_guid, sense_id: sounds first, then pictures with senses last to first."""
        n = self.table("media", "illustration", columns="entry_pos tag idx lifo sense sense_id href entry_id entry_guid".split())
        sound = F.col("tag") == "media"
        seq = F.struct((~sound).cast("int").alias("k"), F.when(sound, F.col("idx")).otherwise(F.col("lifo")).alias("a"), "idx")
        keep = n.where((sound & F.col("sense").isNull()) | (~sound))
        return keep.select("entry_pos", seq.alias("seq"), F.col("tag").alias("kind"), "href", "entry_id", "entry_guid", F.when(~sound, F.col("sense_id")).alias("sense_id"))

    def media_files(self) -> DataFrame:
        """(path): files below audio and pictures, relative to the lexicon."""
        if self.path is None:
            return self.spark.createDataFrame([], "path string")
        base = os.fspath(self.path.parent)
        tops = [(d,) for d in ("audio", "pictures") if os.path.isdir(os.path.join(base, d))]

        def below(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for d in f["path"]:
                    for at, _, names in os.walk(os.path.join(base, d)):
                        found = [os.path.relpath(os.path.join(at, n), base).replace(os.sep, "/") for n in names if os.path.isfile(os.path.join(at, n))]
                        if found:
                            yield pd.DataFrame({"path": found})

        def there(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                rel = [local_path(h or "") for h in f["href"]]
                found = [os.path.normpath(r).replace(os.sep, "/") for r in rel if r and os.path.isfile(os.path.join(base, r))]
                if found:
                    yield pd.DataFrame({"path": found})

        out = self.spark.createDataFrame(tops, "path string").mapInPandas(below, "path string")
        return out.union(self.media_refs().select("href").distinct().mapInPandas(there, "path string")).distinct()

    def _candidates(self) -> DataFrame:
        from ..functions import clean_href

        folder = F.when(F.col("kind") == "media", F.lit("audio/")).otherwise(F.lit("pictures/"))
        m = self.media_refs().withColumn("path", clean_href(F.col("href"))).where("path is not null and path <> ''")
        return m.withColumn("ref_id", F.struct("entry_pos", "seq")).withColumn("paths", F.array("path", F.concat(folder, "path"))).drop("path")

    def missing_media(self) -> DataFrame:
        """Local references whose file is neither there nor in its folder."""
        return R.anti_paths(self._candidates(), F.col("paths"), self.media_files(), "path").drop("paths", "ref_id")

    def orphan_media(self) -> DataFrame:
        """Files in the media folders that nothing refers to."""
        folders = self.media_files().where("path like 'audio/%' or path like 'pictures/%'")
        return R.unreferenced(folders, self._candidates(), F.col("paths"), "path")

    # --- edits

    def edit(self, f: Callable[[N.Node], object]) -> Lexicon:
        """Apply ``f`` to every entry's tree; entries that it leaves as they were keep their bytes."""
        head = self.root_open

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _slices(batches):
                raw, touched = [], []
                for x, was in zip(b["raw"].to_pylist(), b["touched"].to_pylist(), strict=True):
                    n = N.parse_fragment(head, x, "entry")
                    before = N.canonical(n)
                    f(n)
                    new = N.canonical(n)
                    raw.append(x if new == before else new.rstrip("\n").encode())
                    touched.append(bool(was) or new != before)
                yield b.set_column(COLUMNS.index("raw"), "raw", pa.array(raw, pa.binary())).set_column(COLUMNS.index("touched"), "touched", pa.array(touched))

        return self._with(self.entries.select(*COLUMNS).mapInArrow(step, ENTRIES), order=True)

    def _with(self, entries: DataFrame, order: bool) -> Lexicon:
        out = Lexicon(self.spark, entries, self.path)
        out.header, out.attrs, out.companions, out.root_open, out.residue, out.staged = self.header, self.attrs, self.companions, self.root_open, list(self.residue), self.staged
        out.source = {**self.source, "order": self.source["order"] and order} if self.source else None
        return out

    def where(self, condition) -> Lexicon:
        """The entries that meet a condition on entry columns (id, guid, date_deleted and so on)."""
        head, names = self.root_open, [c for c in NAMES if c not in COLUMNS]
        only, rows = need(("entry",), names), shredder(names, ("entry",))
        schema = ENTRIES + ", " + ", ".join(_TYPES[c] for c in names)

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _slices(batches):
                made = Batches(own)
                for doc, pos, line, raw in zip(*(b[c].to_pylist() for c in Entry._fields), strict=True):
                    made.out += rows(N.parse_fragment(head, raw, "entry", only), doc, pos, line)
                more = made.take()
                yield pa.RecordBatch.from_arrays([*b.columns, *more.columns], [*b.schema.names, *more.schema.names])

        own = arrow_schema(", ".join(_TYPES[c] for c in names))
        kept = self.entries.select(*COLUMNS).mapInArrow(step, schema).where(condition).select(*COLUMNS)
        return self._with(kept, order=False)

    def append(self, new: list[N.Node]) -> Lexicon:
        """With more entries at the end."""
        at = (self.entries.agg(F.max("entry_pos")).first()[0] or 0) + 1
        rows = [("", at + i, None, None, None, None, N.canonical(n).rstrip("\n").encode(), True) for i, n in enumerate(new)]
        return self._with(self.entries.unionByName(self.spark.createDataFrame(rows, ENTRIES)), order=False)

    def sort(self) -> Lexicon:
        """Canonical order: case-folded guid, then id, then place; null first, and the header's ranges and fields."""
        keys = self.rows(lambda n, pos: [(pos, n.attrs["id"], n.attrs["guid"], (n.attrs["guid"] or "").casefold(), (n.attrs["id"] or "").casefold())], "entry_pos long, id string, guid string, g string, i string", ["entry"])
        order = ranked(keys, ["g", "i", "entry_pos"]).withColumnRenamed("rank", "place")
        out = self.reorder(order)
        out._roots = order.select(F.col("place").cast("long").alias("entry_pos"), "id", "guid")
        self._sort_header()
        return out

    def reorder(self, order: DataFrame) -> Lexicon:
        """The entries that ``order`` (entry_pos, place) lists, at the places that it gives them."""
        moved = self.entries.join(order.select("entry_pos", "place"), "entry_pos").drop("entry_pos").withColumnRenamed("place", "entry_pos").select(*COLUMNS)
        out = self._with(moved, order=False)
        if self._nodes is None:
            out._moved = (self, order.select("entry_pos", F.col("place").cast("long").alias("place")))
        return out

    def insert(self, entry_pos: int, new: list[N.Node]) -> Lexicon:
        """With more entries before the one at ``entry_pos``."""
        moved = self.entries.withColumn("entry_pos", F.col("entry_pos") + F.when(F.col("entry_pos") >= entry_pos, len(new)).otherwise(0)).select(*COLUMNS)
        rows = [("", entry_pos + i, None, None, None, None, N.canonical(n).rstrip("\n").encode(), True) for i, n in enumerate(new)]
        return self._with(moved.unionByName(self.spark.createDataFrame(rows, ENTRIES)), order=False)

    def entry_at(self, lines: DataFrame) -> DataFrame:
        """(line, entry_pos): the last entry that begins at or before each line; null before the first."""
        starts = self.entries.where("line is not null").select(F.col("line").cast("long").alias("line"), "entry_pos")
        return R.as_of(lines.select("line"), starts, [], "line", ["entry_pos"], buckets=64)

    def _sort_header(self) -> None:
        for r in self.ranges_of_header():
            sort_range(r)
        for tag, sub, key in (x.split() for x in ("ranges range id", "fields field tag")):
            c = self.header.one(tag)
            if c is not None:
                c.kids.get(sub, []).sort(key=lambda x: x.attrs[key].casefold())

    def add_ranges_file(self, name: str, ranges: RangesFile) -> None:
        """Attach a companion and give the header a reference to each of its ranges that it lacks."""
        self.companions[name] = ranges
        have = {r.attrs["id"] for r in self.ranges_of_header()}
        host = self.header.one("ranges") or self.header.add(N.Node("ranges", "ranges"))
        for r in ranges.ranges:
            if r.attrs["id"] not in have:
                ref = host.add(N.Node("range", "range"))
                ref.attrs["id"], ref.attrs["href"] = r.attrs["id"], name
                have.add(r.attrs["id"])

    # --- writing

    def _open_tag(self) -> str:
        named = {k: self.attrs[k] for k in ("version", "producer") if self.attrs.get(k) is not None}
        text = self.root_open.decode("utf-8", "replace")
        spaces = "".join(f" {m}" for m in re.findall(r'xmlns(?::[\w.-]+)?\s*=\s*(?:"[^"]*"|\'[^\']*\')', text))
        rest = {k: v for k, v in self.attrs.items() if k not in named and not k.startswith("xmlns")}
        return "<lift" + "".join(f' {k}="{N._attr(v)}"' for k, v in {**named, **rest}.items()) + spaces + ">"

    def chunks(self, canonical: bool = False) -> Iterator[bytes]:
        """The document's bytes.  Untouched parts keep theirs: all but edited nodes if order and residue are the source's."""
        entries = self.entries.select("entry_pos", "byte_start", "byte_end", "raw")
        rows = (canonical_entries(entries, self.root_open) if canonical else entries).orderBy("entry_pos")
        head = N.canonical(self.header).encode()
        s = self.source
        known = s is not None and not canonical
        if known and s["order"] and self.residue == s["residue"]:
            yield from self._passthrough(rows, head)
            return
        yield N.DECLARATION + self._open_tag().encode() + b"\n"
        at, residue = 0, sorted(self.residue, key=lambda r: r[0])

        def before(k: int) -> Iterator[bytes]:
            while residue and residue[0][0] <= k:
                yield residue.pop(0)[1] + b"\n"

        yield from before(at)
        if self.header.filled():
            if known and s["header"] and N.digest(self.header) == s["header"][2]:
                with s["path"].open("rb") as f:
                    f.seek(s["header"][0])
                    head = f.read(s["header"][1] - s["header"][0]) + b"\n"
            yield head
            at += 1
        for r in rows.toLocalIterator(prefetchPartitions=True):
            yield from before(at)
            yield bytes(r.raw) + b"\n"
            at += 1
        yield from (x + b"\n" for _, x in residue)
        yield b"</lift>\n"

    def _passthrough(self, rows: DataFrame, head: bytes) -> Iterator[bytes]:
        """The source's bytes, but for an edited root tag, header and entries."""
        s = self.source
        header = s["header"] if s["header"] and N.digest(self.header) != s["header"][2] else None
        with s["path"].open("rb") as f:

            def copy(a: int, e: int) -> Iterator[bytes]:
                if header and a <= header[0] < e:
                    yield from copy_plain(a, header[0])
                    yield head.rstrip(b"\n")
                    a = header[1]
                yield from copy_plain(a, e)

            def copy_plain(a: int, e: int) -> Iterator[bytes]:
                f.seek(a)
                while a < e and (block := f.read(min(1 << 20, e - a))):
                    a += len(block)
                    yield block

            doc = s["doc"]
            if self.attrs == s["attrs"]:
                yield from copy_plain(0, doc.root_end)
            else:
                yield from copy_plain(0, doc.root_start)
                yield self._open_tag().encode()
            if s["header"] is None and self.header.filled():
                yield b"\n" + head.rstrip(b"\n")
            at = doc.root_end
            for r in rows.toLocalIterator(prefetchPartitions=True):
                yield from copy(at, r.byte_start)
                yield bytes(r.raw)
                at = r.byte_end
            yield from copy(at, doc.size)

    def _write(self, target: Path) -> None:
        """The bytes of ``chunks``, written by the tasks that have the entries; by the driver only where root children beside the header and entries have to be placed anew."""
        s = self.source
        if s is not None and s["order"] and self.residue == s["residue"]:
            whole = _Copy(s, N.canonical(self.header).rstrip("\n").encode() if s["header"] and N.digest(self.header) != s["header"][2] else None)
            doc = s["doc"]
            prolog = b"".join(whole(0, doc.root_end)) if self.attrs == s["attrs"] else b"".join(whole(0, doc.root_start)) + self._open_tag().encode()
            if s["header"] is None and self.header.filled():
                prolog += b"\n" + N.canonical(self.header).rstrip("\n").encode()

            def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for f in frames:
                    yield pd.DataFrame({"raw": [b"".join(whole(int(a), int(e))) + bytes(raw) for a, e, raw in zip(f["prev_end"], f["byte_start"], f["raw"], strict=True)]})

            write_rows(self.entries.select("prev_end", "byte_start", "raw").mapInPandas(step, "raw binary"), target, prolog, b"".join(whole(doc.last, doc.size)), exact=True)
        elif self.residue:
            replace(target, self.chunks())
        else:
            rows = self.entries if s is not None and s["order"] else in_order(self.entries)
            write_rows(rows, target, self._prolog(), b"</lift>\n", exact=False)

    def _prolog(self, canonical: bool = False) -> bytes:
        """What stands before the entries of a new document."""
        s, head = self.source, N.canonical(self.header).encode() if self.header.filled() else b""
        if head and s is not None and not canonical and s["header"] and N.digest(self.header) == s["header"][2]:
            with s["path"].open("rb") as f:
                f.seek(s["header"][0])
                head = f.read(s["header"][1] - s["header"][0]) + b"\n"
        return N.DECLARATION + self._open_tag().encode() + b"\n" + head

    def save(self, path: str | os.PathLike | None = None) -> None:
        """Write the document and its companions; companions follow to a new folder."""
        target = self.path if path is None else Path(path)
        if target is None:
            raise ValueError("no path to save to")
        if target.suffix.lower() == ".zip":
            raise ValueError("save to a .zip with save_zip")
        self._write(target)
        for name, c in self.companions.items():
            here = c.path is not None and self.path is not None and c.path.parent.resolve() == self.path.parent.resolve()
            c.save(target.parent / name if here or c.path is None else c.path)
        self.__dict__ = Lexicon.read(self.spark, target).__dict__  # later reads start from what was written

    def save_zip(self, path: str | os.PathLike, wrap: bool | str = True) -> None:
        """The lexicon's whole folder as an archive, with the document and companions as they are now."""
        import shutil

        from ..sources.archive import zip_folder

        base = local_file(shared_dir(self.spark, "zip"))
        base.mkdir(parents=True)
        with tempfile.TemporaryDirectory(prefix="lexicon-", dir=base) as d:
            folder = Path(d) / "lexicon"
            if self.path is not None:
                shutil.copytree(self.path.parent, folder, ignore=lambda _, names: [n for n in names if n.endswith(".zip")])
            else:
                folder.mkdir()
            self._write(folder / (self.path.name if self.path else "lexicon.lift"))
            for name, c in self.companions.items():
                c.save(folder / name)
            zip_folder(folder, Path(path), wrap)


class Entry(NamedTuple):
    """An entry as it is read: its document, place, line and bytes."""

    doc: str | None
    entry_pos: int | None
    line: int | None
    raw: bytes


def arrow_schema(schema: str | StructType) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    """Few rows at a time: a task holds what it makes of these."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
    pa.default_memory_pool().release_unused()  # workers live on between tasks
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (AttributeError, OSError):
        pass


def each(entries: DataFrame, f: Callable[[Entry], Iterable[tuple]], schema: str | StructType) -> DataFrame:
    """The rows that ``f`` gives of every entry (doc, entry_pos, line, raw), in batches of a bounded size."""
    arrow = arrow_schema(schema)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Batches(arrow)
        for b in _slices(batches):
            for e in map(Entry._make, zip(*(b[c].to_pylist() for c in Entry._fields), strict=True)):
                out.weight += len(e.raw)
                for row in f(e):
                    out.out.append(row)
                    if len(out.out) >= out.most:
                        yield out.take()
                if out.full():
                    yield out.take()
        if out.out:
            yield out.take()

    return entries.mapInArrow(step, schema)


def canonical_entries(entries: DataFrame, head: bytes) -> DataFrame:
    """Entries written anew, in the tasks that hold them."""

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(raw=[N.canonical(N.parse_fragment(head, b, "entry")).rstrip("\n").encode() for b in f["raw"]])

    return entries.mapInPandas(step, entries.schema)


def ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``rank`` from 0: a range-partitioned sort, and each partition's rank offset; no single-task window.

    The numbered partitions are stored: bounds are sampled anew by every plan, so counts of another run would not be theirs.
    """
    spark = df.sparkSession
    df = stored(df, "unranked")  # the sample that bounds come from would run the plan once more
    parts = df.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), *order).withColumn("__p", F.spark_partition_id())
    from pyspark.sql import Window

    here = stored(parts.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(*order))), "ranked")
    size = here.groupBy("__p").agg(F.count("*").alias("__n"))
    before = size.withColumn("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return here.join(F.broadcast(before.drop("__n")), "__p").withColumn("rank", F.col("__r") + F.col("__b") - 1).drop("__p", "__r", "__b")


def in_order(entries: DataFrame) -> DataFrame:
    """Entries in order of partitions.  Bounds come from places alone, so that bytes are made, read or joined once."""
    n = max(1, int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted(set(entries.select("entry_pos").approxQuantile("entry_pos", [k / n for k in range(1, n)], 0.1 / n))) if n > 1 else []
    part = F.size(F.filter(F.array(*[F.lit(int(b)) for b in bounds]), lambda b: b <= F.col("entry_pos"))) if bounds else F.lit(0)
    return entries.repartitionById(len(bounds) + 1, part.cast("int")).sortWithinPartitions("entry_pos")


def canonicalize(spark: SparkSession, source: str | os.PathLike, target: str | os.PathLike) -> None:
    """A canonically sorted and serialized copy; companions are not read."""
    for p in (source, target):
        if Path(p).suffix.lower() == ".zip":
            raise N.LiftError("sort takes a .lift file, not an archive")
    lex = Lexicon.read(spark, source, resolve_ranges=False)
    if lex.residue:
        replace(Path(target), lex.sort().chunks(canonical=True))
        return
    head = lex.root_open

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for pos, raw in zip(f["entry_pos"], f["raw"], strict=True):
                n = N.parse_fragment(head, raw, "entry")
                out.append(((n.attrs["guid"] or "").casefold(), (n.attrs["id"] or "").casefold(), pos, N.canonical(n).encode()))
            yield pd.DataFrame(out, columns=["g", "i", "entry_pos", "raw"])

    rows = stored(lex.entries.select("entry_pos", "raw").mapInPandas(step, "g string, i string, entry_pos long, raw binary"), "canonical")
    lex._sort_header()
    write_rows(rows.repartitionByRange("g", "i", "entry_pos").sortWithinPartitions("g", "i", "entry_pos"), target, lex._prolog(canonical=True), b"</lift>\n", exact=False)


class _Copy:
    """Bytes of the source between two places, its header replaced where it was edited; in the driver and in tasks."""

    def __init__(self, source: dict, header: bytes | None):
        self.path, self.header = os.fspath(source["path"]), header
        self.at = source["header"][:2] if source["header"] else None

    def __call__(self, a: int, e: int) -> Iterator[bytes]:
        with open(self.path, "rb") as f:
            if self.header is not None and a <= self.at[0] < e:
                f.seek(a)
                yield f.read(self.at[0] - a)
                yield self.header
                a = self.at[1]
            f.seek(a)
            yield f.read(max(0, e - a))


def element_tree(raw: bytes, head: bytes) -> ET.Element:
    """An entry's element under its root's declarations."""
    name = re.match(rb"<([^\s/>]+)", head)[1]
    return next(c for c in N.tree(head + raw + b"</" + name + b">") if isinstance(c.tag, str))
