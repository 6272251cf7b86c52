"""Katz scores against dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexispark.llm import katz
from tests.llm.data import documents, empty, texts


def plain_discounts(counts):
    """Good-Turing discounts as a function of a count, from all counts of a level."""
    n = Counter(counts)
    for k in range(5, 0, -1):
        if any(n[r] == 0 for r in range(1, k + 2)):
            continue
        a = (k + 1) * n[k + 1] / n[1]
        if a == 1:
            continue
        d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) for r in range(1, k + 1)}
        if all(0 < x <= 1 for x in d.values()):
            return lambda c: d.get(c, 1.0)  # noqa: B023
    cut = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    return lambda c: (c - cut) / c if 0 < c <= 5 else 1.0


class Plain:
    """A Katz model of tuples of words, by its definition."""

    def __init__(self, texts, order):
        self.order, self.grams = order, [Counter() for _ in range(order)]
        for t in texts:
            full = ["<s>", *t]
            for i in range(1, len(full)):
                for k in range(1, order + 1):
                    if i - k + 1 >= 0:
                        self.grams[k - 1][tuple(full[i - k + 1 : i + 1])] += 1
        self.d = [plain_discounts(g.values()) for g in self.grams]
        self.total = sum(self.grams[0].values())
        self.after = [defaultdict(dict) for _ in range(order)]
        for k, g in enumerate(self.grams):
            for x, c in g.items():
                self.after[k][x[:-1]][x[-1]] = c
        self.weights = {}
        left = sum(c * (1 - self.d[0](c)) for c in self.grams[0].values())
        self.den = self.total if left > 1e-9 else self.total + 1
        self.unknown = (left if left > 1e-9 else 1) / self.den

    def unigram(self, w):
        c = self.grams[0][(w,)]
        return c * self.d[0](c) / self.den if c else self.unknown

    def p(self, h, w):
        h = tuple(h)[-(self.order - 1) :] if self.order > 1 else ()
        if not h:
            return self.unigram(w)
        own = self.after[len(h)].get(h)
        if not own:
            return self.p(h[1:], w)
        if h not in self.weights:
            c, d = sum(own.values()), self.d[len(h)]
            left = sum(x * (1 - d(x)) for x in own.values())
            den = c if left > 1e-9 else c + 1
            self.weights[h] = den, (left if left > 1e-9 else 1) / den / (1 - sum(self.p(h[1:], x) for x in own))
        den, alpha = self.weights[h]
        return own[w] * self.d[len(h)](own[w]) / den if w in own else alpha * self.p(h[1:], w)


def tokens_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]


def brute(rows, order=2):
    toks = [tokens_of(t) for _, t in rows]
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    m = Plain([t for t, ok in zip(toks, train, strict=True) if ok], order)
    uni = m.grams[0]
    v = len(uni)
    for k in range(order):
        for h in list(m.after[k])[:20]:
            assert abs(sum(m.p(h, w) for (w,) in uni) + m.p(h, "\0unknown") - 1) < 1e-9
    out = []
    for (i, _), t, ok in zip(rows, toks, train, strict=True):
        full = ["<s>", *t]
        score = sum(math.log10(m.p(full[max(0, j - order + 1) : j], full[j])) for j in range(1, len(full)))
        out.append((str(i), not ok, len(t), sum(uni[(w,)] > 0 for w in t), m.total, sum(math.log10((uni[(w,)] + 1) / (m.total + v + 1)) for w in t), score))
    return sorted(out, key=str)


def check(got, rows, order=2):
    got = sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=str)
    want = brute(rows, order)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


def test_scores(spark):
    rows = list(enumerate(texts())) + [(None, "a b"), (3, "a")]
    df = documents(spark, [(i, t, "en", "s", 0, 0) for i, t in rows])
    check(katz.katz_scores(df).collect(), rows)


def test_scores_with_varied_counts(spark):
    r = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{int(x)}" for x in r.zipf(1.4, 200) % 300)) for i in range(80)]
    df = documents(spark, [(i, t, "en", "s", 0, 0) for i, t in rows])
    check(katz.katz_scores(df).collect(), rows)


def test_held_out_gain_where_words_depend_on_the_last(spark):
    r = np.random.default_rng(6)
    follow, rows = r.integers(0, 200, (200, 3)), []
    for i in range(80):
        w = [0]
        for x in r.integers(0, 3, 150):
            w.append(int(follow[w[-1], x]))
        rows.append((i, " ".join(f"w{x}" for x in w)))
    got = katz.katz_scores(documents(spark, [(i, t, "en", "s", 0, 0) for i, t in rows])).collect()
    check(got, rows)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("order", [1, 3, 4])
def test_other_orders(spark, order):
    r = np.random.default_rng(order)
    rows = [(i, " ".join(f"w{int(x)}" for x in r.zipf(1.3, int(r.integers(0, 60))) % 25)) for i in range(150)] + [(1000 + i, "same words again and again") for i in range(40)] + [(2000, None), (2001, "w1")]
    df = documents(spark, [(i, t, "en", "s", 0, 0) for i, t in rows])
    check(katz.katz_scores(df, order=order).collect(), rows, order)


def test_kept_model_scores_other_texts(spark, tmp_path):
    r = np.random.default_rng(9)
    make = lambda n: [(i, " ".join(f"w{int(x)}" for x in r.zipf(1.3, 30) % 40)) for i in range(n)]
    learn, other = make(120), [*make(30), (99, None), (100, "never seen words w1 w2")]
    df = lambda rows: documents(spark, [(i, t, "en", "s", 0, 0) for i, t in rows])
    katz.fit(df(learn), order=3).save(spark, f"file://{tmp_path}/model")
    got = {x.doc_id: x for x in katz.scores(df(other), katz.Model.load(spark, f"file://{tmp_path}/model")).collect()}
    m = Plain([tokens_of(t) for _, t in learn], 3)
    for i, t in other:
        full = ["<s>", *tokens_of(t)]
        assert got[i].score == pytest.approx(sum(math.log10(m.p(full[max(0, j - 2) : j], full[j])) for j in range(1, len(full))), rel=1e-9)
        assert got[i].held_out and got[i].train_tokens == m.total


def test_nothing_to_learn_from(spark):
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    check(katz.katz_scores(documents(spark, [(only, "a b", None, None, 0, 0)])).collect(), [(only, "a b")])
    assert katz.katz_scores(empty(spark)).count() == 0
