"""One text far beyond a chunk among short ones, through every operator."""

import hashlib

import numpy as np
import pytest

from lexispark.llm import exact_dedup, katz, licenses, mixing, mjpeg, near_dedup, packing, secrets, tokens, toxicity
from tests.llm.data import documents

WORDS = 220_000
LONG = " ".join(f"w{i % 9973}" for i in range(WORDS)) + "\nMIT License password=abcdef123456"


@pytest.fixture(scope="module")
def df(spark):
    return documents(spark, [(0, LONG, "en", "s", 0, 0), (1, "a b", None, None, None, None), (2, None, "en", "s", 0, 0), (3, LONG, "en", "s", 0, 0)])


def by_id(rows):
    return {r.doc_id: r for r in rows.collect()}


def test_models(df):
    k = by_id(katz.katz_scores(df))
    assert k[0].n_tokens == WORDS + 4 and k[2].n_tokens == 1 and k[0].score == pytest.approx(k[3].score)
    n = by_id(near_dedup.near_groups(df))
    assert n[3].component_id == 0 and not n[3].kept and n[0].n_shingles == 9973 + 3 and n[2].n_shingles == 0
    chain = toxicity.Chain([toxicity.Linear(np.zeros(0, np.uint64), np.zeros(0), np.zeros(j), -1.0) for j in range(2)], 0.0)
    assert toxicity.scores(df, chain).where("kept").count() == 4
    assert mixing.mixed(df).count() == 4


def test_bytes(df):
    e = by_id(exact_dedup.exact_groups(df))
    assert e[3].keep_id == 0 and e[0].group_size == 2 and e[0].text_sha256 == hashlib.sha256(LONG.replace("\n", " ").encode()).hexdigest()
    m = by_id(df.select("doc_id", "text").mapInArrow(mjpeg._digest, mjpeg.DIGEST))
    assert m[0].n_bytes == len(LONG) and m[0].media_sha256 == m[3].media_sha256 and m[2].payload_bytes == 64
    s = by_id(df.select("doc_id", "text").mapInArrow(secrets._digest, secrets.DIGEST))
    assert s[0].n_assign == 1 and s[1].spans == ""
    c = by_id(df.select("doc_id", "text").mapInArrow(licenses._digest, licenses.DIGEST))
    assert (c[0].n_words, c[0].n_base, c[0].first_word) == (WORDS + 4, 1, WORDS)


def test_tokens(df):
    t = tokens.section_tokens(df).groupBy("doc_id").agg({"tokens": "sum", "doc_tokens": "max"}).collect()
    assert all(r["sum(tokens)"] == r["max(doc_tokens)"] for r in t) and len(t) == 4
    p = packing.pack(df, digest=True).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert all(r["sum(length)"] == r["max(doc_tokens)"] for r in p) and len(p) == 4
