"""Every operator on nulls, repeated rows, ties, an empty table, and columns whose names it uses itself."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from lexispark.llm import exact_dedup, katz, licenses, mixing, mjpeg, near_dedup, packing, secrets, tokens, toxicity
from tests.llm.data import documents

NAMES = "__p __source __topic __lang __grp __blk grp blk uid row weight n digest sketch ids cell salt hash owner run keys".split()
ROWS = [(i, t, "en", "s", 0, i) for i, t in enumerate(["a b c d e f g", "a b c d e f g", "", None, "mit license x", "token = abcdef99", "one two three four five six"])]
ROWS += [ROWS[0], ROWS[3], (None, "a b c d e f g", None, None, None, None), (None, None, None, None, None, None), (7, "é 日本 " * 300, "de", "t", 0, 0)]


@pytest.fixture(scope="module")
def df(spark):
    out = documents(spark, ROWS)
    for k, name in enumerate(NAMES):
        out = out.withColumn(name, F.lit(f"own {k}"))
    return out


SCAN = {
    "op1": (katz.katz_scores, len(ROWS)),
    "op2": (exact_dedup.exact_groups, len(ROWS)),
    "op3": (mixing.mixed, len(ROWS)),
    "op4": (lambda d: tokens.section_tokens(d).groupBy("doc_id").count(), 9),
    "op6": (mjpeg.encode_documents, len(ROWS)),
    "op7": (near_dedup.near_groups, len(ROWS)),
    "op8": (lambda d: packing.pack(d).where("start = 0"), len(ROWS)),
    "op9": (secrets.secret_spans, None),
    "op10": (licenses.license_spans, None),
}


@pytest.mark.parametrize("op", SCAN)
def test_rows(df, op):
    f, want = SCAN[op]
    assert want is None or f(df).count() == want
    if want is None:
        assert {r.doc_id for r in f(df).collect()} == ({5} if op == "op9" else {4})
    assert f(df.limit(0)).count() == 0


@pytest.mark.parametrize("f", [exact_dedup.exact_dedup, near_dedup.near_dedup, mixing.mix, lambda d: mixing.mix(d, mixing.Plan(most=1, rounds=2))])
def test_whole_rows(df, f):
    out = f(df)
    assert out.columns == df.columns
    for r in out.collect():
        assert all(r[name] == f"own {k}" for k, name in enumerate(NAMES) if name != "blk" or True)


def test_chain(spark, df):
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (None, 1, 1), (5, None, 1), (4, 0, None)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(df, labels)
    out = toxicity.drop_toxic(df, chain)
    assert out.columns == df.columns and out.count() == len(ROWS) and toxicity.scores(df, chain).count() == len(ROWS)


def test_pipeline(spark, df, tmp_path):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    pieces = P.run(spark, str(tmp_path)).collect()
    assert pieces and {r.doc_id for r in pieces} <= {r[0] for r in ROWS}
