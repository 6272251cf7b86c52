"""Mixing, token attribution, toxicity and packing."""

import zlib

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexispark.llm import mixing, packing, tokens, toxicity
from tests.llm.data import documents, empty, texts


@pytest.fixture(scope="module")
def reference():
    """Special tokens as ordinary text."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False)


@pytest.fixture(scope="module")
def contract():
    """As op8 is defined: the tokenizer as its file has it."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda s: t.encode(s, add_special_tokens=False)


# --- mixing

def test_raking_meets_marginals():
    cells = [(f"s{i}", lang, t, 10.0 + 7 * i + 3 * len(lang) + len(t)) for i in range(4) for lang in ("en", "de") for t in ("a", "bb", "ccc")]
    t = np.array([c[3] for c in cells])
    given = {"source": {"s0": 0.4, "s1": 0.3, "s9": 0.2}, "lang": {"en": 0.75, "de": 0.25}}
    for targets in ({}, given):
        m = mixing._fit_here(cells, mixing.Plan(targets=targets, rounds=50)) * t
        for i, k in enumerate(mixing.SIDES):
            names, at = np.unique([c[i] for c in cells], return_inverse=True)
            has = np.bincount(at, t)
            want = has ** mixing.POWERS[k]
            if targets and k == "source":
                want = np.array([0.4, 0.3, *(0.3 * has[2:] / has[2:].sum())])
            if targets and k == "lang":
                want = np.array([0.25, 0.75])
            assert np.bincount(at, m) / m.sum() == pytest.approx(want / want.sum(), rel=1e-6)
    with pytest.raises(ValueError):
        mixing.wanted("lang", {"en": 1.0}, mixing.Plan(targets={"lang": {"en": 0.0}}))


def test_scale_meets_the_share():
    r = np.random.default_rng(3)
    for share in (0.01, 0.3, 0.6, 0.99, 1.0):
        t, w = r.integers(1, 10**6, 40).astype(float), r.random(40) ** 4
        w[:5] = w[0]
        t[6], w[6] = 1, 1e9  # one tiny cell does not thin out the others
        s = mixing.scale_of(t, w, share)
        assert (t * np.minimum(1, s * w)).sum() == pytest.approx(share * t.sum(), rel=1e-9) or (share == 1 and s >= 1 / w.min() * 0.999)


def test_mixing(spark):
    rows = [(i, t, None if i % 9 == 0 else ("en", "de")[i % 2], None if i % 7 == 0 else f"src{i % 3}", 0, 0) for i, t in enumerate(texts(60))] * 2
    df = documents(spark, [*rows, (None, None, None, None, None, None)])
    got = mixing.mixed(df).collect()
    assert len(got) == df.count() and all(0 < r.p <= 1 for r in got)
    assert sum(r.tokens * r.p for r in got) == pytest.approx(mixing.SHARE * sum(r.tokens for r in got))
    stay = mixing.mix(df)
    assert stay.columns == df.columns and stay.count() == sum(r.sampled for r in got)
    plan = mixing.Plan(most=1, rounds=3)
    many, few = mixing.cell_weights(df, plan)
    here = {tuple(r)[:3]: (r.weight, r.p) for r in mixing.cell_weights(df, mixing.Plan(rounds=3))[0].collect()}
    assert not few and {tuple(r)[:3]: (pytest.approx(r.weight, rel=1e-9), pytest.approx(r.p, rel=1e-6)) for r in many.collect()} == here
    every = mixing.mix(df, plan)
    assert every.columns == df.columns and sorted(map(str, every.collect())) == sorted(map(str, mixing.mix(df, mixing.Plan(rounds=3)).collect()))
    only = mixing.Plan(targets={"lang": {"de": 1.0, "en": 0.0, "": 0.0}}, share=0.1, topic_col="source", tokens_col="n_chars")
    assert {r.lang for r in mixing.mixed(df.withColumn("n_chars", F.length("text")), only).where("sampled").collect()} <= {"de"}
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0


# --- tokens

def brute(enc, text, spans, rule):
    """Tokens of character spans by a loop over bytes."""
    owner = [-1] * len(text.encode())
    char = [len(text[:i].encode()) for i in range(len(text) + 1)]
    for k, (a, e) in enumerate(spans):
        owner[char[a] : char[e]] = [k] * (char[e] - char[a])
    got, at = {}, 0
    vocab = tokens.encoder(tokens.vocabulary())[1]
    for i in enc(text).ids:
        own = owner[at : at + int(vocab[i])]
        at += len(own)
        order = sorted(set(own), key=own.index)
        if rule == "split":
            for o in order:
                got[o] = got.get(o, 0) + own.count(o) / len(own)
        else:
            o = own[0] if rule == "start" else max(order, key=own.count)
            got[o] = got.get(o, 0) + 1
    return got


@pytest.mark.parametrize("rule", tokens.RULES)
def test_sections(spark, reference, rule):
    ts = [*texts(30), "one\n\n# two\n- three é\n", "a\nb", "\n", "日本語\ntext ç"]
    df = documents(spark, [(i, t, "en", "s", 0, 0) for i, t in enumerate(ts)])
    got = {}
    for r in tokens.section_tokens(df, rule).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(ts):
        t, rows = t or "", sorted(got[i], key=lambda r: r.section)
        assert rows[0].doc_tokens == len(reference(t).ids) == pytest.approx(sum(r.tokens for r in rows))
        assert "".join(t[r.first : r.end] for r in rows) == t
        want = brute(reference, t, [(r.first, r.end) for r in rows], rule)
        assert [r.tokens for r in rows] == pytest.approx([want.get(k, 0) for k in range(len(rows))])
    assert tokens.section_tokens(empty(spark)).count() == 0


def test_given_sections(spark, reference):
    text = "The quick brown föx jumps over"
    spans = [(2, 5), (5, 6), (12, 19)]
    df = spark.createDataFrame([(1, text, [("t", a, e) for a, e in spans]), (2, None, None)], "doc_id long, text string, s array<struct<kind:string,first:int,end:int>>")
    for rule in tokens.RULES:
        got = {r.section: r.tokens for r in tokens.section_tokens(df, rule, sections_col="s").where("doc_id = 1").collect()}
        want = brute(reference, text, spans, rule)
        assert {k: v for k, v in got.items() if v} == pytest.approx(want)
    with pytest.raises(ValueError):
        tokens.allocate(np.array([3, 3]), np.array([0, 2]), np.array([4, 6]), "start")


# --- toxicity

def test_chain_held_out_accuracy(spark):
    r = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(900):
        words = [f"w{x}" for x in r.integers(0, 400, 60)]
        toxic = int(r.random() < 0.2)
        if toxic:
            words[int(r.integers(60))] = ["badword", "badly", "vile", "Vileness"][int(r.integers(4))]
        rows.append((i, " ".join(words), "en", "s", 0, 0))
        if i < 600:
            labels.append((i, int(r.random() < 0.5), toxic))
        else:
            labels.append((i, None, toxic))
    df = documents(spark, rows)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = toxicity.train(df, lab)
    got = {x.doc_id: x.toxic for x in toxicity.scores(df, chain).collect()}
    assert np.mean([got[i] == bool(t) for i, _, t in labels[600:]]) > 0.95
    stay = toxicity.drop_toxic(df, chain)
    assert stay.columns == df.columns and stay.count() == sum(not v for v in got.values())


def plain_fit(x, extra, y, rounds=200):
    """Dense and step by step: which features are kept, then accelerated gradient steps."""
    n, width = x.shape
    rate = (y.sum() + 0.5) / (n + 1)
    w, bias0 = [0.0] * width, np.log(rate / (1 - rate))
    if y.min() == y.max():
        return np.array(w), np.zeros(extra.shape[1]), bias0
    kept = []
    for j in range(width):
        c, o = x[:, j].sum(), (x[:, j] * y).sum()
        odds = np.log((o + 0.5) / (y.sum() + 1)) - np.log((c - o + 0.5) / (n - y.sum() + 1))
        z = abs(odds) / np.sqrt(1 / (o + 0.5) + 1 / (c - o + 0.5))
        if c >= toxicity.LEAST and z > 0:
            kept.append((-z, j))
    kept = sorted(j for _, j in sorted(kept)[: toxicity.FEATURES])
    mean, scale = extra.mean(0), np.where(extra.std(0) > 1e-6, extra.std(0), 1.0)
    full = np.column_stack([x[:, kept], (extra - mean) / scale, np.ones(n)])
    free = np.array([0.3 / n] * (full.shape[1] - 1) + [0.0])
    step = 4.0 / (x[:, kept].sum(1).mean() + 1 + extra.shape[1])
    now = ahead = np.append(np.zeros(full.shape[1] - 1), bias0)
    t = 1.0
    for _ in range(rounds):
        g = full.T @ (1 / (1 + np.exp(-full @ ahead)) - y) / n + free * ahead
        after = ahead - step * g
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, now, t = after + (t - 1) / t2 * (after - now), after, t2
    out = np.zeros(width)
    out[kept] = now[: len(kept)]
    dense = now[len(kept) : -1] / scale
    return out, dense, now[-1] - mean @ dense


def test_chain_equals_plain_chain():
    r = np.random.default_rng(12)
    n, width = 240, 30
    x = (r.random((n, width)) < 0.15).astype(float)
    y = np.column_stack([(x[:, 0] + x[:, 1] + r.random(n) > 1.1), (x[:, 2] + x[:, 0] * 0.5 + r.random(n) > 1.2)]).astype(float)
    fold = r.integers(0, toxicity.FOLDS, n)
    row, col = np.nonzero(x)
    known = np.arange(width, dtype=np.uint64) * np.uint64(1 << 50) + np.uint64(7)
    chain = toxicity.fit_chain(n, row, col, known, y, fold)
    extra, seen = np.zeros((n, 0)), np.zeros((n, 0))
    for j in range(2):
        out = np.zeros(n)
        for f in range(toxicity.FOLDS):
            w, d, b = plain_fit(x[fold != f], extra[fold != f], y[fold != f, j])
            out[fold == f] = x[fold == f] @ w + extra[fold == f] @ d + b
        w, d, b = plain_fit(x, extra, y[:, j])
        seen = np.column_stack([seen, x @ w + seen @ d + b])
        extra = np.column_stack([extra, out])
    assert chain.logits(n, row, known[col]) == pytest.approx(seen, abs=1e-6)
    cuts = [c for c in extra[:, 1] if (hit := y[extra[:, 1] >= c, 1].sum()) >= toxicity.LEAST and hit / (extra[:, 1] >= c).sum() >= (1 + y[:, 1].mean()) / 2]
    f1 = lambda c: 2 * y[extra[:, 1] >= c, 1].sum() / ((extra[:, 1] >= c).sum() + y[:, 1].sum())
    assert f1(chain.cut) == pytest.approx(max(map(f1, cuts)))


@pytest.mark.parametrize("n", [2, 6, 9, 60])
def test_few_labels_reject_nothing(spark, n):
    df = documents(spark, [(i, f"a few words number {i}", "en", "s", 0, 0) for i in range(60)])
    chain = toxicity.train(df, spark.createDataFrame([(i, 1, int(i == 0)) for i in range(n)], "doc_id long, quality int, toxic int"))
    assert chain.cut == np.inf and toxicity.drop_toxic(df, chain).count() == 60


def test_chain_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = documents(spark)
    chain = toxicity.train(df, none)
    assert toxicity.scores(df, chain).where("kept").count() == df.count()
    assert toxicity.train(empty(spark), none).cut == np.inf and toxicity.drop_toxic(empty(spark), chain).count() == 0
    one = spark.createDataFrame([(i, 1, 1) for i in range(5)], "doc_id long, quality int, toxic int")
    assert toxicity.scores(df, toxicity.train(df, one)).count() == df.count()


# --- packing

def check_pieces(rows, ids_of, window=packing.WINDOW):
    docs, seqs = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    for d, ids in ids_of.items():
        at = 0
        for r in sorted(docs[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            got = np.frombuffer(r.ids, "<u4").tolist()
            assert got == ids[at : at + r.length]
            at += r.length
        assert at == len(ids)
    for rs in seqs.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return sum(1 for rs in seqs.values() if sum(r.length for r in rs) < window)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.just("<|endoftext|>"), st.text(max_size=12), st.text(" \t\n\r'stmlr0129aZé日\x85\u2003<|>", max_size=8)), max_size=6).map("".join))
def test_ids_are_those_of_the_tokenizer(contract, text):
    enc, _ = tokens.encoder(tokens.vocabulary())
    assert tokens._ids(enc, text, packing.SPECIAL) == contract(text).ids


def test_packing(spark, contract):
    reference = contract
    ts = [*texts(80), "word " * 9000, "<|endoftext|> 's it's  \n\n x <|endoftext|><|endoftext|>y"]
    df = documents(spark, [(i, t, "en", "s", 0, 0) for i, t in enumerate(ts)])
    ids_of = {i: [*reference(t or "").ids, 1] for i, t in enumerate(ts)}
    assert check_pieces(packing.pack(df).collect(), ids_of) == 1
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in packing.pack(df, digest=True).collect()}
    assert crc[0, 0] == zlib.crc32(np.array([1], "<u4").tobytes())
    assert packing.pack(empty(spark)).count() == 0


def test_packing_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 7)
    size = spark.range(60).select("id").selectExpr("id as uid", "0 as grp", "'b' as blk", "id as row", "id as n")
    graph = spark.createDataFrame([(u, [(8, 0)] if u else [(8, 1)]) for u in range(30)], "u long, near array<struct<score:int,v:long>>")
    got = packing.shards(size, graph, 7).groupBy("shard").count().collect()
    assert sum(r["count"] for r in got) == 60 and max(r["count"] for r in got) < 30


def test_regions_cut_fewer_edges_than_chance(spark):
    """Groups of eight that know each other only."""
    size = spark.range(400).selectExpr("id as uid", "0 as grp", "'b' as blk", "id as row", "id as n")
    graph = spark.createDataFrame([(u, [(8 - k, u // 8 * 8 + (u + k) % 8) for k in range(1, 5)]) for u in range(400)], "u long, near array<struct<score:int,v:long>>")
    placed = packing.shards(size, graph, 100)
    assert packing.edges_cut(placed) < 0.5 * (1 - 1 / 4) and placed.count() == 400


def test_neighbours_equal_brute_force(spark):
    """Few values, so that large groups branch: every document has neighbours of the highest agreements."""
    r = np.random.default_rng(8)
    s = r.integers(0, [3, 2, 5, 40, 40, 9, 200, 4], (1500, 8)).astype(np.uint32)
    s[:120] = s[0]
    df = spark.createDataFrame([(u, bytearray(x.tobytes())) for u, x in enumerate(s)], "uid long, sketch binary")
    got = {x.u: x.near for x in packing.neighbours(df, 5).collect()}
    for u in range(len(s)):
        score = (s == s[u]).sum(1)
        assert [n.score for n in got[u]] == [score[n.v] for n in got[u]] and len({n.v for n in got[u]} - {u}) == packing.NEAR
        score[u] = 0
        assert [n.score for n in got[u]] == sorted(score.tolist())[: -packing.NEAR - 1 : -1]


def test_walk_follows_neighbours():
    assert packing.walk([[1], [2, 0], [1], []]) == [3, 0, 1, 2]
    assert packing.walk([]) == []
