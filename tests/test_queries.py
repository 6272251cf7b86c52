"""Registered queries against their SQL, and operators on edge cases."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from lexispark.operators import relational as R

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer orders events documents pages conversations labels".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.parametrize("name", sorted(k for k in E.oracle_sql() if not k.startswith("op")))
def test_query_equals_sql(spark, con, name):
    got = E.queries()[name](spark, DATA)
    want = con.sql(E.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = sorted(str([r[c] for c in cols]) for r in got.collect())
    order = [want.columns.index(c) for c in cols]
    assert rows == sorted(str([r[i] for i in order]) for r in want.fetchall())


def test_as_of_edge_cases(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 3), ("c", None), (None, 4)], "g string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 5, "z"), ("b", 4, "w"), (None, 1, "n")], "g string, t int, v string")
    for buckets in (0, 3):
        got = {(r.g, r.t): r.v for r in R.as_of(left, right, ["g"], "t", ["v"], buckets).collect()}
        assert got[("a", 5)] == "z" and got[("a", 1)] is None and got[("b", 3)] is None and got[("c", None)] is None
    empty = right.limit(0)
    assert R.as_of(left, empty, ["g"], "t", ["v"], 4).count() == 5


def test_anti_joins_on_nulls(spark):
    refs = spark.createDataFrame([("x",), ("",), (None,), ("y",)], "ref string")
    targets = spark.createDataFrame([("y",), (None,), ("",)], "id string")
    assert [r.ref for r in R.dangling(refs, "ref", targets, "id").collect()] == ["x"]
    dup = spark.createDataFrame([(1, "k"), (2, "k"), (3, None), (4, None), (5, "")], "pos int, key string")
    assert [r.pos for r in R.duplicates(dup, [], "key", ["pos"], "pos").collect()] == [2]


def test_ranks_beside_other_columns(spark):
    """Bounds of ranges are samples here: 20,000 rows, another column beside the order."""
    from pyspark.sql import functions as F

    from lexispark.operators.lexicon import ranked

    got = ranked(spark.range(0, 20_000, 1, 8).select(F.array(F.lit(10), F.xxhash64("id")).alias("k"), "id"), ["k"]).collect()
    assert sorted(r.id for r in got) == list(range(20_000))
    assert [r["rank"] for r in sorted(got, key=lambda r: r.k)] == list(range(20_000))


def test_every_line_is_a_sense(spark, con):
    """Against brute force, beyond line 50 of a text."""
    from lexispark.plans.made import legal

    want = sorted((d, k, line) for d, t in con.sql("select doc_id, text from documents").fetchall() for k, line in enumerate(legal(t or "").split("\n")))
    got = sorted((r.entry_pos, r.sense, r.gloss or "") for r in E.queries()["shred_senses"](spark, DATA).collect())
    assert got == want and max(k for _, k, _ in want) >= 50


def test_entry_runs(spark):
    assert E.entry(spark).count() >= 0
