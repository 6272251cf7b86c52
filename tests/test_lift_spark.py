"""Lexicons as DataFrames."""

import json
import zipfile

import pytest

from lexispark.cli import main
from lexispark.operators import report, validate
from lexispark.operators.lexicon import Lexicon, RangesFile, canonicalize
from lexispark.sources import nodes as N
from lexispark.sources.generate import entries
from lexispark.sources.lift_source import LiftSource
from lexispark.sources.archive import lift_path
from tests.lift_data import LIFT, doc, el, folder, form


@pytest.fixture
def lift(tmp_path):
    return folder(tmp_path)


def test_tables(spark, lift):
    lex = Lexicon.read(spark, lift, split=200)
    assert lex.entries.rdd.getNumPartitions() > 1
    senses = [(r.entry_pos, r.path, r.is_leaf) for r in lex.table("sense", "subsense").orderBy("entry_pos", "idx").collect()]
    assert senses == [(0, "sense[0]", True), (0, "sense[1]", False), (0, "sense[1]/subsense[0]", True), (0, "sense[1]/subsense[1]", True), (2, "sense[0]", True)]
    form = lex.table("form").where("entry_pos = 0 and label = 'lexical-unit'").first()
    assert form.text == "be b&<ein tail" and form.lang == "qaa"
    e = lex.table("entry").where("id = 'a'").first()
    assert e.date_deleted == "2019-01-01" and [x.kind for x in e.residue] == ["element"]
    assert lex.find(id="a").entry_pos == 1 and lex.find(guid="2222").entry_pos == 0 and lex.find(id="a", guid="2222") is None
    with pytest.raises(ValueError):
        lex.find()
    ranges = {(r.range_id, r.id) for r in lex.all_ranges().collect()}
    assert ("status", "ok") in ranges and ("lost", None) in ranges and ("grammatical-info", "Noun") in ranges and ("grammatical-info", None) not in ranges


def test_untouched_save_is_identical(spark, lift, tmp_path):
    lex = Lexicon.read(spark, lift, split=150)
    assert b"".join(lex.chunks()) == LIFT.encode()
    lex.save()
    assert lift.read_text(encoding="utf-8") == LIFT
    (tmp_path / "new").mkdir()
    lex.save(tmp_path / "new" / "words.lift")
    assert (tmp_path / "new" / "words.lift-ranges").read_bytes() == (tmp_path / "words.lift-ranges").read_bytes()


def test_edit_rewrites_only_what_it_touched(spark, lift):
    def f(n):
        for s in n.all("sense"):
            for g in s.all("gloss"):
                if g.attrs["lang"] == "en":
                    g.one("text").frags = [g.text().upper()]

    lex = Lexicon.read(spark, lift, split=150).edit(f)
    assert [r.entry_pos for r in lex.entries.where("touched").collect()] == [0]
    out = b"".join(lex.chunks()).decode()
    assert "INSECT" in out and "<unknown-thing" in out and "<!-- between -->" in out
    assert LIFT[LIFT.index("<entry id='a'") :] == out[out.index("<entry id='a'") :]
    assert LIFT[: LIFT.index("<entry ")] == out[: out.index("<entry ")]
    lex.save()
    again = Lexicon.read(spark, lift)
    assert again.entries.count() == 3 and b"".join(again.chunks()).decode() == out
    lex.header.one("ranges").all("range")[0].attrs["href"] = "other"
    lex.attrs["producer"] = "me"
    out = b"".join(lex.chunks()).decode()
    assert 'producer="me"' in out and 'href="other"' in out and out.endswith("<!-- after -->\n") and "<!-- before -->" in out


def test_filter_append_sort(spark, lift):
    lex = Lexicon.read(spark, lift)
    live = lex.where("date_deleted is null")
    assert live.entries.count() == 2 and b"id='a'" not in b"".join(live.chunks())
    n = N.parse(N.tree('<entry id="z" guid="0"/>'), "entry")
    more = lex.append([n]).sort()
    ids = [r.id for r in more.table("entry").orderBy("entry_pos").collect()]
    assert ids == ["z", "a", "b", "c"]
    text = b"".join(more.chunks()).decode()
    assert N.tree(text).findall("entry")[1].get("id") == "a" and "<!-- between -->" in text


def test_canonicalize_is_idempotent(spark, lift, tmp_path):
    one, two = tmp_path / "1.lift", tmp_path / "2.lift"
    canonicalize(spark, lift, one)
    canonicalize(spark, one, two)
    assert one.read_bytes() == two.read_bytes() and one.read_bytes() != lift.read_bytes()
    with pytest.raises(N.LiftError):
        canonicalize(spark, lift, tmp_path / "x.zip")


def test_problems(spark, lift):
    found = validate.report(validate.problems(Lexicon.read(spark, lift, split=150), require_ids=True))
    codes = [p.code for p in found]
    assert codes == sorted(codes, key=["uri-not-rfc", "schema", "missing-id", "duplicate-guid", "dangling-ref", "duplicate-form-lang", "range-parent", "dangling-ranges-href", "undefined-range-value", "missing-media"].index)
    by = {c: [p for p in found if p.code == c] for c in codes}
    assert [p.line for p in by["uri-not-rfc"]] == [LIFT[: LIFT.index("<illustration")].count("\n") + 1]
    assert {p.message for p in by["schema"]} >= {"element unknown-thing is not allowed in entry", "element entry has invalid attribute {urn:q}mark", "element relation attribute order has invalid value '2x'", "element reversal is not allowed in entry"}
    assert [p.message for p in by["missing-id"]] == ["sense has no id " + validate.STABLE]
    assert [p.message for p in by["duplicate-guid"]] == ["guid 2222 already used by entry 'b'", "guid g-ok already used by range-element 'ok' (range 'status')"]
    assert [p.message for p in by["dangling-ref"]] == ["ref 'gone' matches no entry id/guid or sense id", "ref 'missing' matches no entry id/guid or sense id"]
    assert [p.message for p in by["duplicate-form-lang"]] == ["definition has more than one form with lang 'en'"]
    assert [p.message for p in by["range-parent"]] == ["range 'grammatical-info': range-element 'Adj' has parent 'nowhere' which is not a sibling id"]
    assert [p.message for p in by["undefined-range-value"]] == ["grammatical-info value 'Pronoun' is not defined in the range"]
    assert [p.message for p in by["missing-media"]] == ["media file not found: 'b.wav'"]
    assert len(by["dangling-ranges-href"]) == 1
    assert str(by["dangling-ref"][0]).startswith("error [dangling-ref] words.lift:8 (entry b): ref")
    with pytest.raises(validate.LiftValidationError):
        validate.validate_file(spark, lift)


def test_media_stats_export(spark, lift):
    lex = Lexicon.read(spark, lift)
    assert [r.path for r in lex.orphan_media().collect()] == ["audio/stray.wav"]
    assert [r.href for r in lex.missing_media().collect()] == ["b.wav"]
    s = report.stats(lex)
    assert (s.entries, s.senses, s.examples, s.media_refs) == (3, 5, 1, 2)
    assert s.languages == ["en", "fr", "qaa"] and s.traits == {"status": 2} and s.top == [("status", 2)]
    rows = list(report.export_rows(lex))
    assert " ".join(rows[0]) == "entry_id entry_guid sense_id lexeme pos gloss_en definition_en gloss_fr definition_fr"
    assert rows[1] == ["b", "2222", "b1", "be b&<ein tail", "Noun", "insect", "a bee", "", ""]
    assert [r[2] for r in rows[1:]] == ["b1", "b2a", "b2b", "c1"] and rows[2][7] == "abeille"
    assert next(report.export_rows(lex, ["fr", "fr"]))[5:] == ["gloss_fr", "definition_fr"] * 2


def test_companions(spark, lift, tmp_path):
    f = RangesFile.load(tmp_path / "words.lift-ranges")
    assert f.render() == (tmp_path / "words.lift-ranges").read_bytes() and f.find("status").attrs["guid"] == "g-status" and f.find("x") is None
    f.sort()
    assert [e.attrs["id"] for e in f.ranges[0].all("range-element")] == ["Adj", "Noun", "Verb"]
    lex = Lexicon.read(spark, lift, resolve_ranges=False)
    new = RangesFile()
    new.add_range(N.parse(N.tree('<range id="fresh"><range-element id="1"/></range>'), "range"))
    lex.add_ranges_file("extra.lift-ranges", new)
    (tmp_path / "o").mkdir()
    lex.save(tmp_path / "o" / "w.lift")
    back = Lexicon.read(spark, tmp_path / "o" / "w.lift")
    assert "extra.lift-ranges" in back.companions and {r.range_id for r in back.all_ranges().collect()} >= {"fresh", "lost"}
    with pytest.raises(ValueError):
        RangesFile().save()


def test_zip(spark, lift, tmp_path):
    z = tmp_path / "pack.zip"
    Lexicon.read(spark, lift).save_zip(z)
    assert "pack/words.lift" in zipfile.ZipFile(z).namelist() and "pack/pictures/b.jpg" in zipfile.ZipFile(z).namelist()
    with lift_path(z) as p:
        assert p.read_text(encoding="utf-8") == LIFT and len(Lexicon.read(spark, p).companions) == 1
    for name in ("../x.lift", "/x.lift"):
        with zipfile.ZipFile(tmp_path / "bad.zip", "w") as f:
            f.writestr(name, "x")
        with pytest.raises(N.LiftParseError), lift_path(tmp_path / "bad.zip"):
            pass
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as f:
        f.writestr("a.lift", "x")
        f.writestr("__MACOSX/b.lift", "x")
        f.writestr("c/b.lift", "x")
    with pytest.raises(N.LiftParseError), lift_path(tmp_path / "two.zip"):
        pass


def test_cli(spark, lift, tmp_path, capsys):
    assert main(["validate", str(lift), "--format", "json"], spark) == 1
    assert json.loads(capsys.readouterr().out)["summary"]["errors"] > 3
    assert main(["stats", str(lift)], spark) == 0 and "entries:   3" in capsys.readouterr().out
    assert main(["export", "--tsv", "--langs=en", "-o", f"{tmp_path}/o.tsv", str(lift)], spark) == 0
    assert (tmp_path / "o.tsv").read_bytes().startswith(b"entry_id\tentry_guid") and b"\r\n" in (tmp_path / "o.tsv").read_bytes()
    assert main(["check-media", str(lift)], spark) == 1 and "1 missing, 1 orphaned" in capsys.readouterr().out
    assert main(["sort", str(lift), "-o", str(tmp_path / "s.lift")], spark) == 0
    assert main(["stats", str(tmp_path / "no.lift")], spark) == 2
    (tmp_path / "w.lift").write_text('<lift version="0.12"/>')
    assert main(["validate", str(tmp_path / "w.lift")], spark) == 2


def test_clean_lexicon_has_no_problems(spark, tmp_path):
    p = tmp_path / "c.lift"
    p.write_text(doc(el("entry", el("sense", form("en", "x", "gloss"), id="s"), id="a", guid="1")))
    assert main(["validate", str(p), "--require-ids", "--strict"], spark) == 0
    p.write_text('<lift version="0.13"/>')
    lex = Lexicon.read(spark, p)
    assert lex.entries.count() == 0 and report.stats(lex).entries == 0 and main(["validate", str(p)], spark) == 0
    assert N.tree(b"".join(lex.chunks())).tag == "lift"


def test_generated_lexicon_through_the_data_source(spark, tmp_path):
    spark.dataSource.register(LiftSource)
    p = tmp_path / "big.lift"
    made = entries(spark, 300, parts=3)
    made.write.format("lift").mode("overwrite").save(str(p))
    assert [x.name for x in tmp_path.iterdir()] == ["big.lift"]
    lex = Lexicon.read(spark, p, split=20_000)
    assert lex.entries.rdd.getNumPartitions() > 3
    assert [bytes(r.raw) for r in lex.entries.orderBy("entry_pos").collect()] == [bytes(r.raw).rstrip(b"\n") for r in made.orderBy("entry_pos").collect()]
    s = report.stats(lex)
    assert s.entries == 300 and s.languages == ["en", "fr", "qaa"] and s.traits == {"status": 300}
    found = validate.report(validate.problems(lex))
    assert {f.code for f in found} == {"missing-media"} and len(found) == 60
    assert report.gloss_langs(lex).where("langs = array('en', 'fr')").count() == 300
    lines = {r.entry_pos: r.line for r in lex.entries.collect()}
    assert p.read_text().splitlines()[lines[299] - 1].startswith("<entry")
    with pytest.raises(Exception, match="Exists"):
        made.write.format("lift").mode("append").save(str(p))


def test_findings_in_order_of_nested_senses(spark, tmp_path):
    deep = el("sense", el("relation", type="r", ref="x0"), el("relation", type="r", ref="x1"), el("subsense", el("relation", type="r", ref="x00"), el("subsense", el("relation", type="r", ref="x000"))), el("subsense", el("relation", type="r", ref="x01")))
    p = tmp_path / "n.lift"
    p.write_text(doc(el("entry", deep, el("sense", el("relation", type="r", ref="y0")), el("relation", type="r", ref="e"), id="a", guid="1")))
    found = [f.message.split("'")[1] for f in validate.report(validate.problems(Lexicon.read(spark, p))) if f.code == "dangling-ref"]
    assert found == ["e", "y0", "x0", "x1", "x01", "x00", "x000"]


def test_insert_reorder_and_lines(spark, lift):
    lex = Lexicon.read(spark, lift)
    new = N.parse(N.tree('<entry id="z" guid="0"/>'), "entry")
    more = lex.insert(1, [new])
    ids = lambda x: [r.id for r in x.table("entry").orderBy("entry_pos").collect()]
    assert ids(more) == ["b", "z", "a", "c"]
    assert ids(more.reorder(spark.createDataFrame([(3, 0), (0, 1), (1, 2)], "entry_pos long, place long"))) == ["c", "b", "z"]
    lines = {r.entry_pos: r.line for r in lex.entries.collect()}
    at = {r.line: r.entry_pos for r in lex.entry_at(spark.createDataFrame([(lines[1],), (lines[1] - 1,), (10**6,), (1,)], "line long")).collect()}
    assert at == {lines[1]: 1, lines[1] - 1: 0, 10**6: 2, 1: None}


def test_read_a_zip(spark, lift, tmp_path):
    z = tmp_path / "pack.zip"
    Lexicon.read(spark, lift).save_zip(z)
    lex = Lexicon.read(spark, z)
    assert [r.href for r in lex.missing_media().collect()] == ["b.wav"] and len(lex.companions) == 1
    kept = lex.path
    lex = lex.edit(lambda n: n.attrs.update(order=1))
    lex.save(tmp_path / "out.lift")
    assert kept.is_file() or Lexicon.read(spark, tmp_path / "out.lift").entries.count() == 3
