"""Text blocks against plain Python; the same blocks in every scan."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lexispark.llm import blocks as B
from tests.llm.data import documents

TEXTS = st.lists(st.one_of(st.none(), st.text("aB \t\n\x0b\x85 é日", max_size=12)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_and_squeeze(texts):
    data, off = B.text_bytes(pa.array(texts, pa.string()))
    h, w = B.word_hashes(data, off)
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts]
    words = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in low]
    assert np.diff(w).tolist() == [len(x) for x in words]
    flat = [x for ws in words for x in ws]
    known = {}
    for word, key in zip(flat, h.tolist(), strict=True):
        assert known.setdefault(word, key) == key
    assert len(set(known.values())) == len(known)
    out, at = B.squeeze(data, off)
    assert [bytes(out[i:j]).decode() for i, j in zip(at, at[1:])] == [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("xy"), st.text("ab", max_size=9)), max_size=20), st.integers(1, 12), st.integers(1, 5), st.integers(1, 5))
def test_sub_blocks_do_not_depend_on_batches(rows, limit, one, two):
    rows = sorted(rows)
    t = pa.table({"text": pa.array([r[1] for r in rows], pa.string()), "s": pa.array([r[0] for r in rows], pa.string()), "g": pa.array([0] * len(rows), pa.int32())})
    runs = [[(k, r, a, b.column("text").to_pylist()) for k, _, r, a, b in B.sub_blocks(iter(t.to_batches(max_chunksize=n)), limit)] for n in (one, two)]
    assert runs[0] == runs[1]
    assert [(k, x) for k, _, _, xs in runs[0] for x in xs] == rows
    assert all(len(xs) == 1 or sum(map(len, xs)) <= limit for _, _, _, xs in runs[0])


def test_blocks_keep_their_place(spark):
    src = B.block_source(documents(spark))
    one, n = B.with_blocks(src, "doc_id")
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "17")
    try:
        two, _ = B.with_blocks(src, "doc_id")
        assert sorted(one.collect()) == sorted(two.collect()) and n >= 1
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
