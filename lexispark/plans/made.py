"""A lexicon made from the test tables: a document is an entry, each of its lines a sense.

The kinds of nodes that an entry has follow from the document's number, so that SQL over the same tables says what
every operator must find.  Entries are made and parsed in tasks; ranges come from ``nation`` and ``region`` (25 and 5 rows).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date, datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lexicon import COLUMNS, Lexicon, RangesFile
from ..sources import nodes as N

#: What SQL sees of the same entries: documents, and their lines as senses.
SQL = """d as (select doc_id as n, 'd' || doc_id as id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text,
    string_split(coalesce(text, ''), chr(10)) as lines, case when doc_id % 7 <> 3 then md5(coalesce(text, '')) end as guid from documents),
s as (select n, id, lang, source, k - 1 as k, lines[k] as line, case when (n + k - 1) % 13 <> 5 then id || 's' || (k - 1) end as sense_id, 'N' || (length(lines[k]) % 6) as gi
    from (select *, unnest(range(1, len(lines) + 1)) as k from d))"""


def legal(s: str) -> str:
    """Without the characters that XML cannot hold."""
    return re.sub("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]", "", s)


def _add(host: N.Node, tag: str, kind: str | None = None, /, **attrs) -> N.Node:
    n = host.add(N.Node(tag, kind or tag))
    n.attrs |= {k.rstrip("_"): v for k, v in attrs.items()}
    return n


def entry(n: int, text: str, lang: str, source: str) -> N.Node:
    """The entry of a document."""
    e, id = N.Node("entry", "entry"), f"d{n}"
    e.attrs |= {"id": id, "guid": hashlib.md5(text.encode()).hexdigest() if n % 7 != 3 else None, "dateCreated": date(2020, 1, 1) + timedelta(days=n % 1000)}
    if n % 4 == 1:
        e.attrs["dateModified"] = datetime(2021, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=n)
    if n % 11 == 0:
        e.attrs["dateDeleted"] = date(2022, 2, 2)
    unit = _add(e, "lexical-unit", "multitext")
    unit.set_form(lang, text)
    if n % 6 == 0:
        span = N.Node("span", "span")
        span.attrs |= {"lang": "fr", "class": "x"}
        span.frags = [text]
        unit.one("form").one("text").frags = ["see ", span, " end"]
    if n % 8 == 0:
        again = N.Node("form", "form")
        again.attrs["lang"] = lang
        unit.add(again)
    _add(e, "citation", "multitext").set_form(lang, id)
    if n % 3 == 0:
        p = _add(e, "pronunciation")
        p.set_form("ipa", f"p{n}")
        _add(_add(p, "media", "urlref", href=f"a{n % 50}.wav"), "label", "multitext").set_form("en", "sound")
    if n % 5 == 1:
        v = _add(e, "variant", ref=f"d{n + 1}")
        v.set_form(lang, f"v{n}")
        _add(v, "relation", type="alt", ref=f"d{2 * n}s0")
    for k, line in enumerate(text.split("\n")):
        _sense(e, n, k, line, lang, source)
    _add(e, "note", type=source).set_form(lang, source)
    _add(e, "relation", type="see", ref=f"d{3 * n}", order=1)
    if n % 9 == 4:
        y = _add(e, "etymology", type="proto", source=lang)
        y.set_form("la", f"e{n}")
        y.set_form("en", "from", "gloss")
    t = _add(e, "trait", name="source", value=source)
    _add(t, "annotation", name="conf", value="high", who="me", when=date(2023, 3, 3))
    _add(e, "field", type="cv").set_form("en", f"f{n}")
    if n % 10 == 7:
        e.xattrs["odd"] = "1"
        e.xnodes.append(("element", "<extra/>", 0))
    return e


def _sense(e: N.Node, n: int, k: int, line: str, lang: str, source: str) -> None:
    s = _add(e, "sense", id=f"d{n}s{k}" if (n + k) % 13 != 5 else None, order=k)
    _add(s, "grammatical-info", value=f"N{len(line) % 6}")
    s.set_form(lang, line, "gloss")
    s.set_form("xx", str(len(line)), "gloss")
    _add(s, "definition", "multitext").set_form(lang, f"def {k}")
    if k % 6 == 5:
        _add(s, "relation", type="syn", ref=f"d{n}s{k + 1}")
    if k % 7 == 6:
        _add(s, "note", type="n").set_form(lang, f"n{k}")
    if k % 4 == 2:
        x = _add(s, "example", source=source)
        x.set_form(lang, line)
        _add(x, "translation", type="free").set_form("en", "tr")
    if k % 5 == 3:
        r = _add(s, "reversal", type="en")
        r.set_form("en", f"r{k}")
        m = _add(r, "main")
        m.set_form("en", "m")
        _add(m, "grammatical-info", value="N0")
    if k == 0 and n % 4 == 0:
        _add(s, "illustration", "urlref", href=f"pictures\\p{n % 20}.png")
    if k % 3 == 1:
        sub = _add(s, "subsense", "sense", id=f"d{n}s{k}a")
        sub.set_form("xx", "sub", "gloss")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of all documents, as ``Lexicon`` holds them; their lines are numbered by tens."""
    return written(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("n"), "text", "lang", "source"), lambda n, t, g, s: entry(n, legal(t or ""), g or "", s or ""))


def written(rows: DataFrame, make: Callable[..., N.Node | str]) -> DataFrame:
    """Entries from rows whose first column is their number; ``make`` gives a tree, or text as someone wrote it.

    Bytes are made only in plans that need them: a column of its own, which Catalyst prunes.
    """
    names = rows.columns
    number = F.col(names[0])

    @F.pandas_udf("binary")
    def raw(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for p in parts:
            made = (make(*r) for r in zip(*(p if isinstance(p, tuple) else (p,)), strict=True))
            yield pd.Series([(x if isinstance(x, str) else N.canonical(x)).rstrip("\n").encode() for x in made], dtype=object)

    null = F.lit(None).cast("long")
    values = [F.lit("made"), number.cast("long"), (number * 10).cast("int"), null, null, null, raw(*(F.col(c) for c in names)), F.lit(False)]
    return rows.select(*[v.alias(c) for v, c in zip(values, COLUMNS, strict=True)])


def lexicon(spark: SparkSession, sf_dir: str) -> Lexicon:
    """The entries under a header with two ranges and a field, and a companion with the nations of each region."""
    lex = Lexicon(spark, entries(spark, sf_dir))
    ranges = _add(lex.header, "ranges")
    gi = _add(ranges, "range", id="grammatical-info")
    for k in range(4):
        _add(gi, "range-element", id=f"N{k}", parent=f"N{k - 1}" if k else None).add(N.Node("label", "multitext")).set_form("en", f"noun {k}")
    _add(ranges, "range", id="ASIA", href="made.lift-ranges")
    _add(_add(lex.header, "fields"), "field", "field-definition", tag="cv").set_form("en", "pattern")
    lex.companions["made.lift-ranges"] = nations(spark, sf_dir)
    return lex


def nations(spark: SparkSession, sf_dir: str) -> RangesFile:
    """A range for each region, its nations as elements; the first has each later one for its parent's child, the last a parent that is not there."""
    out = RangesFile()
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").join(F.broadcast(spark.read.parquet(f"{sf_dir}/region.parquet")), F.col("n_regionkey") == F.col("r_regionkey"))
    by: dict[str, list] = {}
    for r in sorted(rows.select("r_name", "n_name", "n_nationkey").collect()):
        by.setdefault(r.r_name, []).append(r)
    for name, own in by.items():
        host = out.add_range(N.Node("range", "range"))
        host.attrs |= {"id": name, "guid": f"g-{name}"}
        for r in own:
            x = _add(host, "range-element", id=r.n_name, guid=f"g-{r.n_nationkey % 20}", parent=own[0].n_name if r is not own[0] else "nowhere")
            x.add(N.Node("description", "multitext")).set_form("en", f"{r.n_name} in {name}")
    return out
