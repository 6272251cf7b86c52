"""The pipeline on planted rows, and without data."""

import hashlib
import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from lexispark.llm import mixing, toxicity
from tests.llm import test_models, test_near
from tests.llm.data import documents, empty


def test_stages(spark, tmp_path):
    base = [" ".join(f"w{(i * 7919 + j * 31) % 4001}" for j in range(80)) for i in range(40)]
    rows = [(i, t, "en", f"src{i % 2}", len(t), i) for i, t in enumerate(base)]
    rows += [(100 + i, t + " tail", "en", "src0", 0, 0) for i, t in enumerate(base[:5])] + [(200 + i, t.replace(" ", "\n", 1), "en", "src0", 0, 0) for i, t in enumerate(base[:7])]
    rows += [(300 + i, f"{t} nasty{i % 2}", "en", "src1", 0, 0) for i, t in enumerate(base[20:36])] + [(400, None, None, None, None, None), (401, "", "de", "src0", 0, 0)]
    spark.createDataFrame([(i, 1, int(i >= 300)) for i in [*range(40), *range(300, 316)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    at, seen = docs, {}
    for k, (name, f) in enumerate(P.STAGES):
        out = f(spark, at, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        at = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = {r.doc_id for r in at.select("doc_id").collect()}
        if name != "packing":
            assert at.columns == docs.columns
    assert seen["toxicity"] == {i for i, *_ in rows if not 300 <= i < 400}
    assert seen["exact_dedup"] == {i for i in seen["toxicity"] if i < 200} | {400}
    assert seen["near_dedup"] == set(range(40)) | {400}
    assert seen["mixing"] <= seen["near_dedup"] and seen["packing"] == seen["mixing"]
    assert {r.doc_id for r in P.run(spark, str(tmp_path)).collect()} == seen["packing"]


def plain_share(rows):
    """Probabilities of (source, lang, topic, tokens) rows: raked, then scaled by halving."""
    cells = {}
    for *k, t in rows:
        cells[tuple(k)] = cells.get(tuple(k), 0) + t
    m = dict(cells)
    for _ in range(mixing.ROUNDS):
        for i, side in enumerate(mixing.SIDES):
            has, now = {}, {}
            for k, t in cells.items():
                has[k[i]] = has.get(k[i], 0) + t
                now[k[i]] = now.get(k[i], 0) + m[k]
            want = {v: t ** mixing.POWERS[side] for v, t in has.items()}
            scale = sum(cells.values()) / sum(want.values())
            m = {k: x * want[k[i]] * scale / now[k[i]] for k, x in m.items()}
    lo, hi = 0.0, 1e9
    for _ in range(200):
        s = (lo + hi) / 2
        lo, hi = (s, hi) if sum(t * min(1, s * m[k] / t) for k, t in cells.items()) < mixing.SHARE * sum(cells.values()) else (lo, s)
    return {k: min(1, hi * m[k] / t) for k, t in cells.items()}


def test_stages_against_brute_force(spark, tmp_path):
    """On the documents of the smallest test data: what each stage keeps of what the one before kept."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept, at = {}, docs
    for k, (name, f) in enumerate(P.STAGES):
        f(spark, at, folder).write.parquet(f"{tmp_path}/{k}")
        at = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = at.collect()
    rows = {r.doc_id: r for r in docs.collect()}
    ids = lambda name: {r.doc_id for r in kept[name]}

    chain = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    weights = [dict(zip(m.keys.tolist(), m.weights.tolist(), strict=True)) for m in chain.models]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r.text for r in rows.values()])], names=["text"])
    stay = set()
    for i, j, row, key in toxicity._keys(batch):
        for x in range(i, j):
            have, logits = set(key[row == x - i].tolist()), []
            for m, w in zip(chain.models, weights, strict=True):
                logits.append(m.bias + sum(w.get(y, 0) for y in have) + sum(a * b for a, b in zip(logits, m.dense, strict=True)))
            if logits[-1] <= chain.cut:
                stay.add(list(rows)[x])
    assert ids("toxicity") == stay

    first = {}
    for d in sorted(stay):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[d].text or ""), d)
    assert ids("exact_dedup") == set(first.values())

    left = [(d, rows[d].text) for d in sorted(first.values())]
    found, _ = test_near.brute(left)
    assert ids("near_dedup") == {int(d) for d, _, comp, *_ in found if d == comp}

    keyed = {r.doc_id: (r.source, r.lang, r.topic, r.tokens) for r in mixing.keyed(docs).collect()}
    here = ids("near_dedup")
    p = plain_share([keyed[d] for d in sorted(here)])
    fate = {d: int(hashlib.md5(str(d).encode()).hexdigest()[:8], 16) / 2**32 for d in here}
    assert all(abs(fate[d] - p[keyed[d][:3]]) > 1e-9 for d in here)
    assert ids("mixing") == {d for d in here if fate[d] < p[keyed[d][:3]]}

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert ids("packing") == ids("mixing")
    test_models.check_pieces(kept["packing"], {d: [*t.encode(rows[d].text or "", add_special_tokens=False).ids, 1] for d in ids("mixing")})


def test_empty(spark, tmp_path):
    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
