"""Scan, parse, serialize, stream: no cluster needed."""

import io
import xml.etree.ElementTree as ET
from datetime import date, datetime, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexispark.operators.schema_check import valid, violations
from lexispark.sources import nodes as N
from lexispark.sources.scan import Document, spans
from lexispark.sources.spec import KINDS, MIXED, SLOTS
from lexispark.streaming import open_reader, open_writer
from tests.lift_data import LIFT, doc, el, folder, form


def scanned(text):
    data, facts = text.encode(), Document()
    return data, facts, list(spans(io.BytesIO(data), facts, 7))


def test_spans_are_exact():
    data, facts, found = scanned(LIFT)
    assert [s.tag for s in found] == ["header", "#comment", "entry", "entry", "entry"]
    for s in found:
        raw = data[s.start : s.end]
        assert raw.startswith(b"<") and raw.endswith(b">") and data[: s.start].count(b"\n") + 1 == s.line
        if s.tag[0] != "#":
            assert raw.endswith(f"</{s.tag}>".encode())
    assert data[facts.root_start : facts.root_end].endswith(b"'urn:q'>") and facts.reusable and facts.size == len(data)


@pytest.mark.parametrize("text,tags", [
    (el("lift", el("entry", a="&gt;>"), el("entry", "<![CDATA[", el("entry", " "), "]]>")), ["entry", "entry"]),
    ("<lift>t<entry/><!-- <entry/> --><?p <entry?></lift>", ["entry", "#comment", "#pi"]),
    ("<lift/>", []),
    ("﻿<lift><entry><entry/></entry></lift>", ["entry"]),
])
def test_spans_of_odd_documents(text, tags):
    data, facts, found = scanned(text)
    assert [s.tag for s in found] == tags
    for s in found:
        if s.tag == "entry":
            ET.fromstring(data[s.start : s.end])
    assert facts.empty_tag == (text == "<lift/>")


@pytest.mark.parametrize("text", ["<lift><entry></lift>", "<lift>", "", "<lift></lift><x/>", "<lift>&nope;</lift>"])
def test_broken_documents(text):
    with pytest.raises(N.LiftParseError):
        scanned(text)


def entry(xml):
    return N.parse(N.tree(xml), "entry")


def test_typed_attributes_and_residue():
    kids = [el("lexical-unit", form("b", "1")), el("lexical-unit", form("a", "2")), "t<!--c--><?p d?>"]
    n = entry(el("entry", *kids, order=" 7 ", dateCreated="2011-12-13 14:15:16", dateModified="1990", x="1"))
    assert n.attrs["order"] == 7 and n.attrs["dateCreated"].isoformat() == "2011-12-13T14:15:16"
    assert n.xattrs == {"dateModified": "1990", "x": "1"}
    assert [k for k, _, _ in n.xnodes] == ["element", "text", "comment", "pi"]
    assert N.date_text(datetime(2020, 1, 1, tzinfo=timezone.utc)) == "2020-01-01T00:00:00Z" and N.typed_date("2020-01-01") == date(2020, 1, 1)
    out = N.canonical(n)
    assert "<text>2</text>" in out and "<!--c-->" in out and "<?p d?>" in out and 'dateModified="1990"' in out
    assert N.canonical(entry(out)) == out


def test_canonical_layout():
    mixed = "a " + el("span", "b")
    got = N.canonical(entry(el("entry", el("trait", value="v", name="n"), el("lexical-unit", form("l", mixed)), el("citation"), guid="g", id="i"))).split("\n")
    assert got[0] == '<entry id="i" guid="g">' and got[-2:] == ["</entry>", ""]
    assert got[1:4] == ["  <lexical-unit>", '    <form lang="l">', "      " + el("text", mixed)] and got[-3] == '  <trait name="n" value="v"/>'
    got = N.canonical(entry(el("entry", el("sense", el("gloss", lang="x"))))).split("\n")
    assert got[2:5] == ['    <gloss lang="x">', "      <text/>", "    </gloss>"]
    assert N.canonical(entry('<entry id="&#10;&quot;&lt;"/>')) == '<entry id="&#10;&quot;&lt;"/>\n'


def test_forms():
    n = entry(el("entry", el("lexical-unit", form("a", "1"), form("a", "2")))).one("lexical-unit")
    assert n.form("a") == "1" and n.form("b") is None
    n.set_form("a", "3")
    n.set_form("b", "4")
    assert [f.text() for f in n.all("form")] == ["3", "2", "4"]


_TEXT = st.text(st.characters(min_codepoint=32, max_codepoint=0x2FF, exclude_characters="\x7f"), max_size=8)


@st.composite
def trees(draw, kind="entry", depth=0):
    n = N.Node(kind, kind)
    return draw(filled(n, depth))


@st.composite
def filled(draw, n, depth):
    for a, t, needed in KINDS[n.kind].attrs:
        if needed or draw(st.booleans()):
            n.attrs[a] = draw(st.integers(0, 99)) if t == "int" else date(2000, 1, draw(st.integers(1, 28))) if t == "date" else draw(_TEXT)
    if n.kind in MIXED:
        n.frags = [x for x in draw(st.lists(_TEXT, max_size=1)) if x]
        if depth < 6 and draw(st.booleans()):
            n.frags.append(draw(filled(N.Node("span", "span"), depth + 2)))
        return n
    for tag, (child, most) in SLOTS[n.kind].items():
        count = draw(st.integers(0, min(most, 2))) if depth < 4 and draw(st.integers(0, 3)) == 0 else 0
        for _ in range(1 if tag == "text" else count):
            n.add(draw(filled(N.Node(tag, child), depth + 1)))
    return n


@settings(max_examples=60, deadline=None)
@given(trees())
def test_canonical_fixpoint(n):
    once = N.canonical(n)
    again = N.canonical(entry(once))
    assert again == once
    assert not [v for v in violations(N.tree(once), "entry") if "invalid value" not in v and "lacks attribute lang" not in v]


def test_violations():
    kids = [el("sense", el("grammatical-info"), el("definition"), el("definition"), el("gloss", lang="a")), el("relation", type="t"), el("what"), "text"]
    kids.append(el("trait", el("annotation", name="m", when="2020-01-01T10:00:00"), name="n", value="v"))
    bad = N.tree(el("entry", *kids, id="1", foo="x", order="z", dateCreated="2020-02-30"))
    got = list(violations(bad, "entry"))
    for want in ("invalid attribute foo", "order has invalid value", "dateCreated has invalid value", "grammatical-info lacks attribute value", "more than one definition", "gloss lacks element text", "relation lacks attribute ref", "what is not allowed", "text where none"):
        assert sum(want in g for g in got) == 1, (want, got)
    assert len(got) == 9
    assert valid("date", " 2020-02-29 ") and not valid("date", "2019-02-29") and valid("date", "2020-01-01T00:00:00.5+05:30") and not valid("int", "1_0")


def test_streaming_reader_and_writer(tmp_path):
    p = folder(tmp_path)
    with open_reader(p) as r:
        assert r.producer == "maker 1" and len(r.header.one("ranges").all("range")) == 2
        entries = list(r)
    assert [e.attrs["id"] for e in entries] == ["b", "a", "c"]
    out = tmp_path / "out.lift"
    with open_writer(out, producer="p & q", header=r.header) as w:
        for e in entries:
            w.write(e)
    with open_reader(out) as r2:
        assert r2.producer == "p & q" and [N.canonical(e) for e in r2] == [N.canonical(e) for e in entries]
    with pytest.raises(RuntimeError), open_writer(out) as w:
        w.write(entries[0])
        raise RuntimeError
    assert not out.read_bytes().endswith(b"</lift>\n")
    late = tmp_path / "late.lift"
    late.write_text(doc(el("entry", id="x"), el("header", el("description", form("e", "d"))), el("entry", id="y")))
    with open_reader(late) as r:
        assert r.header is None and [e.attrs["id"] for e in r] == ["x", "y"] and r.header is not None
    for text in ("<nolift/>", '<lift version="0.12"/>'):
        late.write_text(text)
        with pytest.raises(N.LiftParseError):
            open_reader(late)
    late.write_text(doc(el("entry", id="x"), "<entry").removesuffix("</lift>"))
    with pytest.raises(N.LiftParseError), open_reader(late) as r:
        assert len(list(r)) == 1


def test_forms_as_a_mapping():
    m = N.Node("definition", "multitext")
    m["en"], m["fr"] = "one", "deux"
    m.add(N.Node("form", "form"))  # without a language: neither a key nor a value
    assert m.keys() == ["en", "fr"] == list(m) and m.values() == ["one", "deux"] and m.items() == [("en", "one"), ("fr", "deux")]
    assert "en" in m and "de" not in m and None not in m and m["fr"] == "deux"
    m["en"] = "uno"
    assert m["en"] == "uno" and len(m.all("form")) == 3
    del m["en"]
    assert m.keys() == ["fr"]
    for f in (lambda: m["en"], lambda: m.__delitem__("en")):
        with pytest.raises(KeyError):
            f()


def test_residue_and_range_elements():
    n = N.parse(N.tree('<entry id="a" odd="x"><extra k="1"/><!-- c --></entry>'), "entry")
    assert n.residue() == "@odd='x'\n<extra k=\"1\"/>\n<!-- c -->" and "1 attributes and 2 nodes" in repr(n)
    r = N.Node("range", "range")
    e = r.add_element("Noun", parent="Word", guid="g")
    assert r.all("range-element") == [e] and (e.attrs["id"], e.attrs["parent"], e.attrs["guid"]) == ("Noun", "Word", "g")
    with pytest.raises(N.LiftError):
        n.add_element("x")


def test_writer_saves_the_companion_on_a_clean_close(tmp_path):
    from lexispark.operators.lexicon import RangesFile
    from lexispark.streaming.entries import LiftWriter

    ranges = RangesFile()
    ranges.add_range(N.Node("range", "range")).attrs["id"] = "status"
    with pytest.raises(ZeroDivisionError), LiftWriter(tmp_path / "a.lift", ranges=ranges) as w:
        w.write(N.Node("entry", "entry"))
        raise ZeroDivisionError
    assert not (tmp_path / "a.lift-ranges").exists()
    with LiftWriter(tmp_path / "a.lift", ranges=ranges):
        assert not (tmp_path / "a.lift-ranges").exists()
    assert (tmp_path / "a.lift-ranges").exists() and b'href="a.lift-ranges"' in (tmp_path / "a.lift").read_bytes()


@pytest.mark.parametrize("size", [1, 60, 10_000])
def test_splits_give_the_children_of_the_whole(tmp_path, size):
    from lexispark.sources import lift_source as S
    from tests.lift_data import LIFT

    p = tmp_path / "w.lift"
    p.write_text(LIFT.replace("<!-- between -->", "<!-- <entry id='no'> -->\n<?pi <entry?>"), encoding="utf-8")
    doc, kept, head = S.read_document(str(p), split=size)
    read = S.LiftReader({"path": str(p), "split": str(size)})
    parts = read.partitions()
    rows = [r for x in parts for r in read.read(x)]
    data = p.read_bytes()
    assert len(parts) == len(doc.splits) and (size < 10_000) == (len(parts) > 1)
    assert data[doc.root_end : doc.last] == b"".join(r[8] + r[9] for r in rows)
    with open(p, "rb") as f:
        want = list(S.spans(f, S.Document()))
    assert [(r[1], r[3], r[4], r[5], r[6]) for r in rows] == [(s.index, s.tag, s.line, s.start, s.end) for s in want]
    assert [r[2] for r in rows if r[2] is not None] == [0, 1, 2] and [r[7] for r in rows if r[2] is not None] == [doc.root_end, *[r[6] for r in rows if r[2] is not None][:-1]]
