"""What keeps the lexicon's operators within bounds: one parse, no shuffled bytes, batches of few rows, large files by tasks."""

import os
from datetime import date

import pytest
from hypothesis import given, settings
from pyspark.sql import functions as F

from lexispark.operators import report, validate
from lexispark.operators.lexicon import Lexicon, arrow_schema, in_order
from lexispark.plans import made
from lexispark.session import shared_dir
from lexispark.sources import lift_source as S
from lexispark.sources import nodes as N
from lexispark.sources.lift_source import local_file
from lexispark.sources.shred import NAMES, Batches, visit
from tests.lift_data import LIFT, doc, el, folder, form
from tests.test_lift_core import trees

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def stored_now(spark) -> int:
    root = local_file(shared_dir(spark, "x")).parent
    return len(os.listdir(root)) if root.exists() else 0


@pytest.fixture
def lex(spark):
    return made.lexicon(spark, DATA)


@settings(max_examples=60, deadline=None)
@given(trees())
def test_serializer_equals_the_one_by_trees(n):
    assert N.canonical(n) == N._by_tree(n, 0) + "\n"


@pytest.mark.parametrize("kids,attrs", [
    ("t<!--c--><?p d?><x><y/></x>", {}), ("<sense>t<gloss lang='a'><text>x<b/>y</text></gloss></sense>", {}), ("<x xmlns='u'/><sense><k/></sense>", {}),
    ("<citation><odd/></citation><lexical-unit/><lexical-unit/>", {"odd": "&lt;", "order": "x"}), ("<sense><!--a--><definition><form/></definition><x> t </x></sense>", {}),
])
def test_serializer_of_residue(kids, attrs):
    n = N.parse(N.tree(el("entry", kids, **attrs)), "entry")
    n.attrs["dateCreated"] = date(2020, 1, 2)
    assert N.canonical(n) == N._by_tree(n, 0) + "\n"


def test_a_part_of_a_tree_has_the_whole_ones_nodes_and_residue(spark, tmp_path, lex):
    for x in (Lexicon.read(spark, folder(tmp_path)), lex):
        rows = lambda df: sorted(map(str, df.select(*NAMES).collect()))
        whole = x.parsed()
        for tags in (["entry"], ["sense", "subsense"], ["gloss"], ["form"], ["trait", "annotation"], ["main"]):
            assert rows(x.table(*tags, columns=NAMES)) == rows(whole.nodes.where(F.col("tag").isin(tags)))


def test_canonical_rank_reads_entries_once(lex):
    """places are ranked from stored keys, and the sorted lexicon's ids are not parsed again."""
    out = lex.sort().table("entry", columns=["entry_pos", "id"])
    assert "MapIn" not in plan(out) and "raw" not in plan(out)
    assert [r.id for r in out.orderBy("entry_pos").collect()] == [r.id for r in lex.sort().entries.withColumn("id", F.regexp_extract(F.col("raw").cast("string"), 'id="([^"]*)"', 1)).orderBy("entry_pos").collect()]


def test_filter_is_one_pass(lex):
    """no join of entries with keys, so their bytes are made once and not shuffled."""
    kept = lex.where("date_deleted is null")
    assert "Join" not in plan(kept.entries) and plan(kept.entries).count("raw(") == 1
    assert sorted(r.entry_pos for r in kept.entries.select("entry_pos").collect()) == [n for n in sorted(r.entry_pos for r in lex.entries.select("entry_pos").collect()) if n % 11]


def test_lines_need_no_bytes(spark, lex):
    """entries are not written out to look up lines, and lines beyond the last entry are not one task's."""
    lines = spark.range(0, 100_000, 1, 4).select(F.col("id").alias("line"))
    found = lex.entry_at(lines)
    assert "raw" not in plan(found) and "MapIn" not in plan(found)
    starts = sorted(r.line for r in lex.entries.select("line").collect())
    got = found.withColumn("task", F.spark_partition_id()).collect()
    assert all(r.entry_pos == (r.line // 10 if r.line <= starts[-1] else starts[-1] // 10) for r in got)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    beyond = lex.entry_at(lines).withColumn("task", F.spark_partition_id()).where(F.col("line") > starts[-1]).groupBy("task").count().collect()
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(beyond) > 1


def test_exports_store_and_shuffle_nothing(spark, lex):
    """an export's rows are made where their entry is."""
    before = stored_now(spark)
    out = report.export(lex, ["en", "xx"])
    assert "Join" not in plan(out) and "Aggregate" not in plan(out) and stored_now(spark) == before
    assert out.count() == sum(1 for r in lex.entries.collect() for x in visit(N.parse_fragment(b"<lift>", bytes(r.raw), "entry")) if x.node.kind == "sense" and not x.node.all("subsense"))


def test_languages_of_an_export_are_found_in_one_plan(spark, tmp_path, lex):
    """a language may have no text, and one of a sense with subsenses does not count."""
    p = tmp_path / "w.lift"
    p.write_text(doc(el("entry", el("sense", form("a", "x", "gloss"), el("definition", form("", "y")), id="s"), el("sense", form("no", "x", "gloss"), el("subsense", form("b", "", "gloss"))))))
    before = stored_now(spark)
    assert report.export_languages(Lexicon.read(spark, p)) == ["", "a", "b"] and report.export_languages(lex)[-1] == "xx" and stored_now(spark) == before


def test_statistics_are_one_plan(spark, lex):
    """counts, languages and traits come from one pass over the entries, without a stored table."""
    before = stored_now(spark)
    s = report.stats(lex)
    assert stored_now(spark) == before and s.traits == {"source": s.entries}


def test_findings_of_single_entries_store_nothing(spark, lex):
    """findings with one code are those of all with it, and only what that code needs is read."""
    whole = {}
    for r in validate.problems(lex, require_ids=True).collect():
        whole.setdefault(r.code, []).append(str(r))
    before = stored_now(spark)
    for code in ("missing-id", "duplicate-form-lang", "undefined-range-value", "schema", "uri-not-rfc", "range-parent"):
        found = validate.problems(lex, require_ids=True, codes=[code])
        assert sorted(map(str, found.collect())) == sorted(whole[code]) and stored_now(spark) == before
    for code in ("duplicate-guid", "dangling-ref"):
        assert sorted(map(str, validate.problems(lex, require_ids=True, codes=[code]).collect())) == sorted(whole[code])
    assert validate.problems(lex, codes=["missing-id"]).count() == 0


def test_batches_are_bounded_however_long_an_entry(spark):
    """An entry of 20,000 lines leaves a task in batches of 2,048 rows."""
    lex = Lexicon(spark, made.written(spark.range(1, 3).select("id", F.lit("x\n" * 20_000).alias("text")), lambda n, t: made.entry(n, t, "en", "s")))
    made_of = arrow_schema("a long, b string")
    out, sizes = Batches(made_of), []
    for k in range(5_000):
        out.out.append((k, "x"))
        if out.full():
            sizes.append(out.take().num_rows)
    assert sizes == [2048, 2048] and out.take().num_rows == 5_000 - 4096
    seen = lex.table("gloss", columns=["lang"]).mapInArrow(lambda bs: (b.slice(0, 0).from_pydict({"n": [b.num_rows]}) for b in bs), "n long").collect()
    assert sum(r.n for r in seen) == 2 * (2 * 20_001 + len(range(1, 20_001, 3)))
    assert [r.langs for r in report.gloss_langs(lex).collect()] == [["en", "xx"]] * 2


@pytest.mark.parametrize("text", [LIFT.replace("<!-- between -->", "<!-- <entry id='no'> -->\r\n<?pi <entry?>"), doc(*(el("entry", "\n", el("sense"), id=f"e{k}") + "\r\n" for k in range(40)), "<!-- <entry> -->"), doc(el("entry", "<![CDATA[<entry >]]>", id="a"), el("entry", id="b")), doc("<!-- none -->")])
@pytest.mark.parametrize("chunk", [30, 100, 100_000])
def test_large_files_are_scanned_by_tasks(spark, tmp_path, text, chunk):
    """F8: pieces that tasks scan give the splits' children, other children and places that one pass gives; what looks like an entry in a comment does not mislead."""
    p = tmp_path / "w.lift"
    p.write_bytes(text.encode())
    want, kept, head = S.read_document(str(p), split=60)
    got, kept_too, head_too = S.read_document_by_tasks(spark, str(p), split=60, least=0, chunk=chunk)
    facts = lambda d: (d.root, d.attrs, d.root_start, d.root_end, d.close, d.size, d.last, d.reusable)
    assert facts(got) == facts(want) and kept == kept_too and head == head_too
    read = S.LiftReader({"path": str(p)})
    assert [r for x in got.splits for r in read.read(x)] == [r for x in want.splits for r in read.read(x)]


@pytest.mark.parametrize("text", [doc(el("entry", id="a"), el("entry", id="b"))[:-7], doc(el("entry", id="a")) + el("entry", id="b"), doc(el("entry", id="a"), "<entry id='b'></lift>")])
def test_broken_files_are_refused_by_tasks_too(spark, tmp_path, text):
    p = tmp_path / "w.lift"
    p.write_text(text)
    with pytest.raises(N.LiftParseError):
        S.read_document_by_tasks(spark, str(p), least=0, chunk=20)


def test_entries_are_ordered_by_bounds_of_places_alone(spark, lex):
    """F8: no sample of whole entries, each of them in its range."""
    out = in_order(lex.entries.repartition(3)).withColumn("p", F.spark_partition_id())
    assert "rangepartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.select("p", "entry_pos").collect()
    assert [(r.p, r.entry_pos) for r in rows] == sorted((r.p, r.entry_pos) for r in rows) and [r.entry_pos for r in rows] == sorted(r.entry_pos for r in lex.entries.select("entry_pos").collect())
    assert len({r.p for r in rows}) > 1
