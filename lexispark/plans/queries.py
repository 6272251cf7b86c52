"""Queries of the lexicon operators over the test tables, each with its SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import clean_href, nfc
from ..operators import relational as R
from . import adapters as A
from . import engine_queries, made  # noqa: F401
from .registry import ORACLE, QUERIES, query

__all__ = ["ORACLE", "QUERIES"]


_HREFS = r"""h as (
  select page_id, pos, raw, case when page_id % 5 = 0 then x || ' ' else x end as href from (
    select page_id, pos, raw, case when page_id % 3 = 0 then replace(raw, '/', '\') else raw end as x from (
      select page_id, unnest(range(1, len(l) + 1)) as pos, unnest(l) as raw from (
        select page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) as l from pages))))"""


@query("""
select doc_id as entry_pos, 'd' || doc_id as id, md5(coalesce(text, '')) as guid, first_label from (
  select *, row_number() over w as rn, first_value('d' || doc_id) over w as first_label from documents
  window w as (partition by md5(coalesce(text, '')) order by doc_id)) where rn > 1""")
def duplicate_guid(spark, sf_dir):
    """Entries whose guid an earlier entry has, with the earlier one's label."""
    return R.duplicates(A.entries(spark, sf_dir), [], "guid", ["entry_pos"], "id").select("entry_pos", "id", "guid", "first_label")


@query("""
select event_id, 'c' || (user_id * 20) as ref from events
where 'c' || (user_id * 20) not in (select 'c' || c_custkey from customer)""")
def dangling_ref(spark, sf_dir):
    """References to customers that are not there."""
    refs = A.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("c"), F.col("user_id") * 20).alias("ref"))
    ids = A.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    return R.dangling(refs, "ref", ids, "id").select("event_id", "ref")


@query("""
select o_orderkey, o_orderpriority as value from orders
where o_orderpriority not in ('1-URGENT', '2-HIGH', '3-MEDIUM') and o_orderpriority <> ''""")
def undefined_range_value(spark, sf_dir):
    """Values that the range does not list."""
    v = A.table(spark, sf_dir, "orders").select("o_orderkey", F.lit("priority").alias("range_id"), F.col("o_orderpriority").alias("value"))
    allowed = spark.createDataFrame([("priority", x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM")], "range_id string, id string")
    return R.undefined_values(v, "range_id", "value", allowed, "id").select("o_orderkey", "value")


@query(r"""
with w as (select doc_id, lang, lower(string_split(coalesce(text, ''), ' ')[1]) as value from documents),
a as (select distinct value from w where value <> '' and lang = 'en')
select doc_id, value from w where value <> '' and nfc_normalize(value) not in (select nfc_normalize(value) from a)""")
def undefined_range_value_nfc(spark, sf_dir):
    """First words that no document in English begins with; the values are decomposed and compared in normal form C."""
    word = F.lower(F.substring_index(F.coalesce("text", F.lit("")), " ", 1))
    w = A.table(spark, sf_dir, "documents").select("doc_id", "lang", F.lit("r").alias("range_id"), word.alias("word"))
    v = w.select("doc_id", "range_id", "word", nfc(F.col("word")).alias("value"))
    allowed = w.where("lang = 'en' and word <> ''").select("range_id", nfc(F.col("word")).alias("id"))
    return R.undefined_values(v, "range_id", "value", allowed, "id").select("doc_id", F.col("word").alias("value"))


@query("""
select n_nationkey, n_name, (n_regionkey + 1)::varchar as parent from nation
where n_regionkey + 1 not in (select r_regionkey from region)""")
def range_parent(spark, sf_dir):
    """Elements whose parent is no sibling."""
    r = A.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("int").alias("n_nationkey"), F.lit(None).cast("string").alias("n_name"), F.lit("geo").alias("range_id"))
    n = A.table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), (F.col("n_regionkey") + 1).cast("string").alias("parent"), "n_nationkey", "n_name", F.lit("geo").alias("range_id"))
    return R.missing_parents(r.unionByName(n), ["range_id"], "id", "parent").select("n_nationkey", "n_name", "parent")






@query(rf"""
with {_HREFS}, u as (select page_id, 0::bigint as pos, url as href from pages union all select page_id, pos, ltrim(raw, '/') from h
  union all select page_id, -pos, './' || replace(ltrim(raw, '/'), 'e', '\') from h)
select page_id, pos, href, case when not (contains(href, '://') or regexp_matches(href, '^(https?:|file:)|^[/\\]|^[A-Za-z]:'))
  then regexp_replace(regexp_replace(regexp_replace(replace(href, '\', '/'), '/+', '/', 'g'), '/(\./)+', '/', 'g'), '^(\./)+', '') end as path
from u""")
def normalize_href(spark, sf_dir):
    """Relative paths of hrefs; null for remote and absolute ones."""
    h, bare = A.hrefs(spark, sf_dir), F.expr("ltrim('/', raw)")
    u = A.table(spark, sf_dir, "pages").select("page_id", F.lit(0).cast("long").alias("pos"), F.col("url").alias("href"))
    u = u.unionByName(h.select("page_id", "pos", bare.alias("href")))
    u = u.unionByName(h.select("page_id", (-F.col("pos")).alias("pos"), F.concat(F.lit("./"), F.replace(bare, F.lit("e"), F.lit("\\"))).alias("href")))
    return u.select("page_id", "pos", "href", clean_href(F.col("href")).alias("path"))


_MEDIA = rf"""
with {_HREFS}, m as (select page_id, pos, ltrim(raw, '/') as path from h),
f as (select distinct ltrim(raw, '/') as path from h where pos = 1 union select distinct 'audio/' || ltrim(raw, '/') from h where pos = 2 union select distinct 'pictures/' || page_id || '.png' from pages)"""


def _media(spark, sf_dir):
    """Every link as a reference; as files what pages link first, what they link second in the audio folder, and a picture of each page."""
    h = A.hrefs(spark, sf_dir).withColumn("path", F.expr("ltrim('/', raw)"))
    refs = h.select("page_id", "pos", "path", F.struct("page_id", "pos").alias("ref_id"))
    pictures = A.table(spark, sf_dir, "pages").select(F.concat(F.lit("pictures/"), "page_id", F.lit(".png")).alias("path"))
    files = h.where("pos = 1").select("path").union(h.where("pos = 2").select(F.concat(F.lit("audio/"), "path"))).union(pictures).distinct()
    return refs, files


@query(_MEDIA + "select page_id, pos, path from m where path not in (select path from f) and 'audio/' || path not in (select path from f)")
def missing_media(spark, sf_dir):
    """References to media that are neither where they say nor in the audio folder."""
    refs, files = _media(spark, sf_dir)
    refs = refs.withColumnRenamed("path", "href")
    return R.anti_paths(refs, F.array("href", F.concat(F.lit("audio/"), "href")), files, "path").select("page_id", "pos", F.col("href").alias("path"))


@query(_MEDIA + "select path from f where path not in (select path from m) and path not in (select 'audio/' || path from m)")
def orphan_media(spark, sf_dir):
    """Files that nothing refers to."""
    refs, files = _media(spark, sf_dir)
    return R.unreferenced(files, refs, F.array("path", F.concat(F.lit("audio/"), "path")), "path")


_MERGED = """
select id, source, n from (
  select *, row_number() over (partition by id order by has desc, priority, pos) as rn from (
    select r_name as id, 'header' as source, 0 as priority, r_regionkey as pos, 0::bigint as n, 0 as has from region
    union all
    select r_name, 'file' || (n_nationkey % 2), 1, min(n_nationkey), count(*), 1 from nation join region on n_regionkey = r_regionkey where n_regionkey <> 2 group by 1, 2))
where rn = 1"""


@query(_MERGED)
def merged_ranges(spark, sf_dir):
    """One definition of each range: a listing source before an empty header, the first source among equals."""
    n, r = A.table(spark, sf_dir, "nation"), A.table(spark, sf_dir, "region")
    head = r.select(F.col("r_name").alias("id"), F.lit("header").alias("source"), F.lit(0).alias("priority"), F.col("r_regionkey").alias("pos"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("has"))
    ext = n.where("n_regionkey <> 2").join(r, n.n_regionkey == r.r_regionkey).groupBy(F.col("r_name").alias("id"), F.concat(F.lit("file"), F.col("n_nationkey") % 2).alias("source")).agg(F.lit(1).alias("priority"), F.min("n_nationkey").alias("pos"), F.count("*").alias("n"), F.lit(1).alias("has"))
    return R.first_by_priority(head.unionByName(ext), ["id"], [F.desc("has"), "priority", "pos"]).select("id", "source", "n")











































# --- real XML, made in the task that reads it

def _entry_bytes(text: str | None, lang: str | None, pos: int) -> bytes:
    from ..sources import nodes as N

    n = N.Node("entry", "entry")
    n.attrs["id"] = f"d{pos}"
    n.add(N.Node("lexical-unit", "multitext")).set_form(lang or "", made.legal(text or ""))
    for k, line in enumerate(made.legal(text or "").split("\n")):
        s = n.add(N.Node("sense", "sense"))
        s.attrs["id"], s.attrs["order"] = f"d{pos}s{k}", k
        s.set_form(lang or "", line, "gloss")
    return N.canonical(n).encode()



@query("select doc_id as entry_pos, true as fixpoint, true as text_kept from documents")
def lift_roundtrip(spark, sf_dir):
    """Documents as entries: written, parsed and written again; equal bytes and equal text."""
    from ..sources import nodes as N

    def step(frames):
        for f in frames:
            same, kept = [], []
            for pos, text, lang in zip(f["entry_pos"], f["text"], f["lang"], strict=True):
                once = _entry_bytes(text, lang, pos)
                n = N.parse_fragment(b'<lift version="0.13">', once, "entry")
                same.append(N.canonical(n).encode() == once)
                kept.append((n.one("lexical-unit").form(lang or "") or "") == made.legal(text or ""))
            yield f[["entry_pos"]].assign(fixpoint=same, text_kept=kept)

    return A.entries(spark, sf_dir).select("entry_pos", "text", "lang").mapInPandas(step, "entry_pos long, fixpoint boolean, text_kept boolean")


@query("select doc_id as entry_pos, coalesce(lang, '') = 'en' as touched, coalesce(lang, '') <> 'en' as same_bytes from documents")
def passthrough_untouched(spark, sf_dir):
    """An edit of English entries: all others keep their bytes, layout included."""
    from ..sources import nodes as N

    def step(frames):
        for f in frames:
            touched, same = [], []
            for pos, text, lang in zip(f["entry_pos"], f["text"], f["lang"], strict=True):
                raw = _entry_bytes(text, lang, pos).replace(b"\n  <", b"\n\t <")
                n = N.parse_fragment(b'<lift version="0.13">', raw, "entry")
                before = N.digest(n)
                if n.one("lexical-unit").form("en") is not None:
                    n.attrs["guid"] = f"g{pos}"
                out = raw if N.digest(n) == before else N.canonical(n).encode()
                touched.append(out != raw)
                same.append(out == raw)
            yield f[["entry_pos"]].assign(touched=touched, same_bytes=same)

    return A.entries(spark, sf_dir).select("entry_pos", "text", "lang").mapInPandas(step, "entry_pos long, touched boolean, same_bytes boolean")




@query("""
select doc_id as entry_pos, k - 1 as sense, lines[k] as gloss from (
  select doc_id, lines, unnest(range(1, len(lines) + 1)) as k from (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents))""")
def shred_senses(spark, sf_dir):
    """Glosses of every sense, shredded from XML."""
    from ..sources import nodes as N

    def step(frames):
        for f in frames:
            out = []
            for pos, text, lang in zip(f["entry_pos"], f["text"], f["lang"], strict=True):
                n = N.parse_fragment(b'<lift version="0.13">', _entry_bytes(text, lang, pos), "entry")
                out += [(pos, s.attrs["order"], s.form(lang or "", "gloss")) for s in n.all("sense")]
            yield pd.DataFrame(out, columns=["entry_pos", "sense", "gloss"])

    return A.entries(spark, sf_dir).select("entry_pos", "text", "lang").mapInPandas(step, "entry_pos long, sense long, gloss string")
