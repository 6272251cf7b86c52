"""Validation: findings as rows, in a fixed order.

What an entry shows by itself is found in the task that reads it; guids, ids and references go to plans over narrow tables.
"""

from __future__ import annotations

import re
import unicodedata
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path
from xml.parsers import expat

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nfc, py_repr
from ..session import stored
from ..sources import nodes as N
from ..sources.shred import visit
from . import relational as R
from .lexicon import Entry, Lexicon, element_tree, local_path
from .schema_check import violations

PROBLEMS = "seq array<long>, level string, code string, message string, file string, entry_id string, guid string, line long"
STABLE = "(needed for re-import " + "by a stable id)"


@dataclass(frozen=True)
class Problem:
    """One finding."""

    level: str
    code: str
    message: str
    line: int | None = None
    guid: str | None = None
    file: str | None = None
    entry_id: str | None = None

    def __str__(self) -> str:
        at = "" if self.line is None else f":{self.line}"
        where = (self.file or "<memory>") + at
        owner = self.entry_id or self.guid
        head = " ".join([self.level, f"[{self.code}]", where])
        return head + (f" (entry {owner})" if owner else "") + f": {self.message}"


class LiftValidationError(N.LiftError):
    """The first finding of level error."""

    def __init__(self, problem: Problem):
        self.problem = problem
        super().__init__(f"{problem}")


def _elements(raw: bytes) -> Iterator[tuple[int, dict[str, str]]]:
    """(line within the fragment, attributes) of every element."""
    p, out = expat.ParserCreate(), []
    p.StartElementHandler = lambda _, a: out.append((p.CurrentLineNumber - 1, a))
    p.Parse(raw, True)
    return iter(out)


def _uri_reason(v: str) -> str | None:
    if " " in v:
        return "contains an unencoded space"
    if "\\" in v:
        return "contains backslashes (not a URI path separator)"
    drive = v.startswith("file://") and v[7:8].isalpha() and v[8:9] == ":"
    return "Windows drive letter used as URI authority" if drive else None


def fragment_problems(raw: bytes, head: bytes, kind: str, line: int | None, el: ET.Element | None = None, codes: Iterable[str] = ("uri-not-rfc", "schema")) -> Iterator[tuple[int, str, str, str, int | None]]:
    """(0 for URIs, 1 for the schema; level, code, message, line) of one root child."""
    if "uri-not-rfc" in codes and b"href" in raw:
        spaces = head.rstrip()[:-1] + b">" if not head.rstrip().endswith(b"/>") else head.rstrip()[:-2] + b">"
        name = spaces[1:].split(None, 1)[0].rstrip(b">")
        above = spaces.count(b"\n")
        for k, a in list(_elements(spaces + raw + b"</" + name + b">"))[1:]:
            reason = _uri_reason(a["href"]) if "href" in a else None
            if reason:
                yield 0, "warning", "uri-not-rfc", f"href {a['href']!r} {reason}", line + k - above if line is not None else None
    if "schema" in codes:
        for m in violations(element_tree(raw, head) if el is None else el, kind):
            yield 1, "error", "schema", m, line


#: Findings that an entry has by itself, and those that depend on others.
_LOCAL = ("uri-not-rfc", "schema", "missing-id", "duplicate-form-lang", "undefined-range-value")
_SHARED = ("duplicate-guid", "dangling-ref")
FACTS = "what string, " + PROBLEMS.replace("file string, ", "") + ", `key` string"
_BELOW = -(1 << 40)
_IN_VARIANT = re.compile(r"variant\[[0-9]+\]")


def _facts(head: bytes, codes: frozenset[str], values: dict[str, set[str]]) -> Callable[[Entry], Iterator[tuple]]:
    """A function of an entry that gives its own findings, and its guid, ids and references where findings of other entries need them."""
    tags = {"missing-id": ("sense", "subsense"), "duplicate-form-lang": ("form",), "undefined-range-value": ("grammatical-info", "trait"), "dangling-ref": ("sense", "subsense", "variant", "relation")}
    want = sorted({t for c, own in tags.items() if c in codes for t in own})
    only, text = N.needed(want), codes & {"uri-not-rfc", "schema"}
    langs = "duplicate-form-lang" in codes
    values = {k: set(v) for k, v in values.items()}

    def facts(x: Entry) -> Iterator[tuple]:
        el, pos, line = element_tree(x.raw, head), x.entry_pos, x.line
        if text:
            for i, (block, level, code, message, at) in enumerate(fragment_problems(x.raw, head, "entry", line, el, text)):
                own = (el.get("id"), el.get("guid")) if block else (None, None)
                yield "problem", [block, 1, pos, i], level, code, message, *own, at, None
        if not codes - text:
            return
        e = N.parse(el, "entry", only)
        id, guid = e.attrs["id"], e.attrs["guid"]
        if "missing-id" in codes and guid is None:
            yield "problem", [10, pos, 0], "error", "missing-id", "entry has no guid " + STABLE, id, None, line, None
        if "duplicate-guid" in codes and guid is not None:
            yield "guid", [pos], None, None, f"entry {id!r}" if id != "" and id is not None else f"entry #{pos}", id, guid, line, guid
        if "dangling-ref" in codes:
            yield from (("target", None, None, None, None, None, None, None, t) for t in (id, guid) if t)
        seen: dict[tuple[str, str], list] = {}
        for at in visit(e, want):
            n, kind = at.node, at.node.kind
            if kind == "sense":
                if "missing-id" in codes and n.attrs["id"] is None:
                    yield "problem", [10, pos, 1, *at.lifo, _BELOW], "error", "missing-id", "sense has no id " + STABLE, id, guid, line, None
                if "dangling-ref" in codes and n.attrs["id"]:
                    yield "target", None, None, None, None, None, None, None, n.attrs["id"]
            elif kind == "form":
                if langs and at.label is not None and (lang := n.attrs["lang"]) is not None:
                    seen.setdefault((at.parent, lang), [at.label, at.idx[:-2], 0])[2] += 1
            elif kind in ("variant", "relation"):
                top = at.parent == ""
                if "dangling-ref" in codes and n.attrs["ref"] and (kind == "variant" or top or (at.sense is None and _IN_VARIANT.fullmatch(at.parent)) or at.parent == at.sense):
                    rank = 0 if kind == "relation" and top else 1 if kind == "variant" else 2 if at.sense is None else 3
                    yield "ref", [12, pos, rank, *(at.lifo or ()), _BELOW, *at.idx, _BELOW], None, None, None, id, guid, line, n.attrs["ref"]
            elif "undefined-range-value" in codes and kind in ("grammatical-info", "trait"):
                k = int(kind == "trait")
                name, value = n.attrs["name"] if k else kind, n.attrs["value"]
                if value and name in values and (value if value.isascii() else unicodedata.normalize("NFC", value)) not in values[name]:
                    what = f"trait {name!r}" if k else kind
                    yield "problem", [16, pos, k, *at.idx, _BELOW], "warning", "undefined-range-value", f"{what} value {value!r} is not defined in the range", id, guid, line, None
        for (_, lang), (label, idx, n) in seen.items():
            if n > 1:
                yield "problem", [13, pos, *idx, _BELOW], "warning", "duplicate-form-lang", f"{label} has more than one form with lang {lang!r}", id, guid, line, None

    return facts


def _driver_problems(lex: Lexicon) -> list[tuple]:
    """Header, root and companions: small parts that the driver holds anyway."""
    out, file = [], lex.path.name if lex.path else None
    if lex.header.filled():
        raw = N.canonical(lex.header).encode()
        for i, (block, level, code, message, _) in enumerate(fragment_problems(raw, b"<lift>", "header", None)):
            out.append(([block, 0, 0, i], level, code, message, file, None, None, None))
    for i, a in enumerate(a for a in lex.attrs if a not in ("version", "producer") and not a.startswith("xmlns")):
        out.append(([1, 0, -1, i], "error", "schema", f"element lift has invalid attribute {a}", file, None, None, None))
    for i, (_, raw) in enumerate(lex.residue):
        if not raw.startswith((b"<!--", b"<?")):
            out.append(([1, 2, 0, i], "error", "schema", "element is not allowed in lift", file, None, None, None))
    for k, (name, c) in enumerate(lex.companions.items()):
        for j, r in enumerate(c.ranges):
            for i, (block, level, code, message, _) in enumerate(fragment_problems(N.canonical(r).encode(), b"<lift-ranges>", "range", None)):
                out.append(([2, 2 * k + block, j, i], level, code, message, name, None, None, None))
    return out


def problems(lex: Lexicon, require_ids: bool = False, codes: Iterable[str] | None = None) -> DataFrame:
    """All findings, or those with ``codes``; order by ``seq`` for the order of the report.

    Entries are read once: what they have by themselves are rows of the result, what depends on others goes to a
    stored table of guids, ids and references, which is all that is shuffled.
    """
    spark, name = lex.spark, lex.path.name if lex.path else None
    file = F.lit(name).cast("string")
    known = {*_LOCAL, *_SHARED, "range-parent", _HREF, "missing-media"} - (set() if require_ids else {"missing-id"})
    want = known if codes is None else known & set(codes)
    owner, last = _Steps("seq.a"), _Steps("seq.idx")
    names = [c.split()[0] for c in PROBLEMS.split(", ")]

    def out(df: DataFrame, seq: Column, level: str, code: str, message: Column, where: Column, guid: str) -> DataFrame:
        return df.select(seq.alias("seq"), F.lit(level).alias("level"), F.lit(code).alias("code"), message.alias("message"), where.alias("file"), "entry_id", F.col(guid).alias("guid"), F.col("line").cast("long").alias("line"))

    driver = [p for p in _driver_problems(lex) + _dangling_hrefs(lex) if p[2] in want]
    parts = [spark.createDataFrame(driver, PROBLEMS)]
    merged = lex.all_ranges().where("id is not null") if want & {"undefined-range-value", "range-parent"} else None

    of_entries = want & {*_LOCAL, *_SHARED}
    if of_entries:
        values: dict[str, set[str]] = {}
        if "undefined-range-value" in want:
            for r in merged.select("range_id", nfc(F.col("id")).alias("v")).where("range_id is not null").distinct().collect():
                values.setdefault(r.range_id, set()).add(r.v)
        facts = lex._each(_facts(lex.root_open, frozenset(of_entries), values), FACTS)
        if want & {*_SHARED}:
            facts = stored(facts, "facts", "what")
        parts.append(facts.where("what = 'problem'").withColumn("file", file).select(*names))

    if "duplicate-guid" in want:  # entries and inline ranges are one scope, each companion another
        e = facts.where("what = 'guid'").select(F.lit(None).cast("string").alias("file"), F.struct(F.lit(0).alias("k"), F.col("seq")[0].alias("a"), F.lit(-1).cast("long").alias("b")).alias("at"), F.col("key").alias("guid"), F.col("message").alias("label"), F.lit(-1).alias("priority"), "entry_id", F.col("line").cast("long").alias("line"))
        rr = lex.range_rows().withColumn("priority", F.when(F.col("file").isNull(), -1).otherwise(F.col("priority")))
        none = [F.lit(None).cast("string").alias("entry_id"), F.lit(None).cast("long").alias("line")]
        place = lambda b: F.struct(F.lit(1).alias("k"), F.col("range_pos").cast("long").alias("a"), b.cast("long").alias("b")).alias("at")
        top = rr.where("range_guid is not null and coalesce(pos, 0) = 0").select("file", place(F.lit(-1)), F.col("range_guid").alias("guid"), F.concat(F.lit("range "), py_repr(F.col("range_id"))).alias("label"), "priority", *none)
        inner = rr.where("guid is not null").select("file", place(F.col("pos")), "guid", F.concat(F.lit("range-element "), py_repr(F.col("id")), F.lit(" (range "), py_repr(F.col("range_id")), F.lit(")")).alias("label"), "priority", *none)
        scoped = e.unionByName(top).unionByName(inner).withColumn("scope", F.coalesce("file", F.lit("")))
        d = R.duplicates(scoped, ["scope"], "guid", ["at"], "label")
        seq = F.array(*[c.cast("long") for c in (F.lit(11), F.col("priority"), F.col("at.k"), F.col("at.a"), F.col("at.b"))])
        parts.append(out(d, seq, "error", "duplicate-guid", F.concat(F.lit("guid "), "guid", F.lit(" already used by "), "first_label"), F.coalesce("file", file), "guid"))

    if "dangling-ref" in want:
        bad = R.dangling(facts.where("what = 'ref'"), "key", facts.where("what = 'target'").select("key"), "key")
        parts.append(out(bad, F.col("seq"), "error", "dangling-ref", F.concat(F.lit("ref "), py_repr(F.col("key")), F.lit(" matches no entry id/guid or sense id")), file, "guid"))

    none = F.lit(None).cast("string")
    if "range-parent" in want:
        orphan = R.missing_parents(merged, ["range_id"], "id", "parent").withColumn("entry_id", none).withColumn("no_guid", none).withColumn("line", F.lit(None).cast("long"))
        message = F.concat(F.lit("range "), py_repr(F.col("range_id")), F.lit(": range-element "), py_repr(F.col("id")), F.lit(" has parent "), py_repr(F.col("parent")), F.lit(" which is not a sibling id"))
        parts.append(out(orphan, F.array(F.lit(14).cast("long"), F.col("range_pos").cast("long"), F.col("pos").cast("long")), "error", "range-parent", message, file, "no_guid"))
    if "missing-media" in want and lex.path is not None:
        m = lex.missing_media().withColumn("line", F.lit(None).cast("long"))
        seq = F.concat(F.array(F.lit(17).cast("long"), F.col("entry_pos"), F.col("seq.k").cast("long")), owner.column(), last.column())
        parts.append(out(m, seq, "warning", "missing-media", F.concat(F.col("kind"), F.lit(" file not found: "), py_repr(F.col("href"))), file, "entry_guid"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every


class _Steps:
    """A whole path as part of an order: its steps, then what is below every step, so that a path comes before those it begins."""

    def __init__(self, name: str):
        self.name = name

    def column(self) -> Column:
        steps = F.coalesce(F.col(self.name), F.array().cast("array<int>"))
        return F.concat(F.transform(steps, lambda x: x.cast("long")), F.array(F.lit(-(1 << 40)).cast("long")))


_HREF = "dangling-ranges-href"


def _dangling_hrefs(lex: Lexicon) -> list[tuple]:
    """Relative header references that no companion supplies: one file probe for each."""
    if lex.path is None:
        return []
    supplied = {r.attrs["id"] for c in lex.companions.values() for r in c.ranges if r.all("range-element")}
    out = []
    for i, r in enumerate(lex.ranges_of_header()):
        href = r.attrs["href"]
        rel = local_path(href) if href else None
        if rel and not r.all("range-element") and r.attrs["id"] not in supplied and not (lex.path.parent / rel).is_file():
            out.append(([15, i], "warning", _HREF, f"header range {r.attrs['id']!r} references {href!r} but no companion file was found", lex.path.name, None, None, None))
    return out


def findings(found: DataFrame, check_media: bool = True) -> Iterator[Problem]:
    """Findings in order, a partition at a time."""
    found = found if check_media else found.where("code <> 'missing-media'")
    return map(_problem, found.orderBy("seq", "message").toLocalIterator(prefetchPartitions=True))


def report(found: DataFrame, check_media: bool = True) -> list[Problem]:
    """The same as a list."""
    return list(findings(found, check_media))


def _problem(r) -> Problem:
    return Problem(**{k: r[k] for k in Problem.__dataclass_fields__})


def validate_file(spark, path: str | Path) -> None:
    """Raise on the first finding of level error."""
    first = problems(Lexicon.read(spark, path)).where("level = 'error'").orderBy("seq", "message").first()
    if first:
        raise LiftValidationError(_problem(first))
