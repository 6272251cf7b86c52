"""Near-duplicate components against all pairs."""

import random
import re

import numpy as np
import pytest

from lexispark.llm import near_dedup as N
from tests.llm.data import documents, empty, texts


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    near = [set() for _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 70 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
                if sets[i] != sets[j]:
                    near[i].add(frozenset(sets[j]))
                    near[j].add(frozenset(sets[i]))
    comp = {}
    for i, (d, _) in enumerate(rows):
        comp.setdefault(find(i), []).append(d)
    low = {k: min((d for d in v if d is not None), default=None) for k, v in comp.items()}
    size = [sum(t == s for t in sets) if s else 1 for s in sets]
    return sorted((str(d), len(sets[i]), str(low[find(i)]), size[i], len(near[i])) for i, (d, _) in enumerate(rows)), len(comp)


def check(spark, rows):
    df = documents(spark, [(i, t, "en", "s", 0, 0) for i, t in rows])
    got = N.near_groups(df).collect()
    want, groups = brute(rows)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.class_size, r.n_links) for r in got) == want
    assert sum(r.kept for r in got) == groups
    return df, groups


def test_small(spark):
    rows = list(enumerate(texts())) + [(None, "one two three four"), (4, "one two three four"), (None, None)]
    df, groups = check(spark, rows)
    stay = N.near_dedup(df)
    assert stay.columns == df.columns and stay.count() == groups
    assert N.near_dedup(empty(spark)).count() == 0


@pytest.mark.parametrize("limit,levels", [(48, 3), (3, 2), (2, 1)])
def test_clusters_and_large_nodes(spark, monkeypatch, limit, levels):
    """Families of edited copies; small limits force branching and tiles."""
    monkeypatch.setattr(N, "LIMIT", limit)
    monkeypatch.setattr(N, "LEVELS", levels)
    monkeypatch.setattr(N, "TILE_CLASSES", 5 * limit)
    r = random.Random(limit)
    rows = []
    for f in range(6):
        base = [f"w{r.randrange(5000)}" for _ in range(r.choice([30, 80, 200]))]
        for _ in range(14):
            w = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 4, 8])):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    check(spark, rows)


def test_minwise_estimates_similarity():
    r = np.random.default_rng(2)
    a = np.unique(r.integers(0, 1 << 62, 3000).astype(np.uint64))
    b = np.concatenate([a[: len(a) * 4 // 5], np.unique(r.integers(0, 1 << 62, 300).astype(np.uint64))])
    s = N.signatures([np.sort(a), np.sort(b), np.zeros(0, np.uint64)])
    j = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
    assert abs((s[0] == s[1]).mean() - j) < 0.2 and (s[2] == 0xFFFFFFFF).all()


def test_cut_hashes_lose_no_link():
    """Two bytes a hash move with a proposed pair; what is linked on full sets stays, most of the rest goes."""
    r = np.random.default_rng(3)
    gone = tried = 0
    for n in (1, 2, 7, 60, 400, 4000, 4097, 5500):
        for share in (0.3, 0.5, 0.6, 0.7, 0.8, 0.83, 0.9, 1.0):
            a = r.integers(0, 1 << 63, n).astype(np.uint64)
            b = np.unique(np.concatenate([a[: int(share * n)], r.integers(0, 1 << 63, max(1, n // 9)).astype(np.uint64)]))
            a = np.unique(a)
            both = len(np.intersect1d(a, b))
            linked = 100 * both >= 70 * (len(a) + len(b) - both)
            x, y = N.cut_hashes(a), N.cut_hashes(b)
            assert len(x) <= (2 if n <= N.NARROW else 4) * len(a)
            assert not linked or (N.may_link(x, y) and N.may_link(y, x))
            tried += not linked
            gone += not linked and not N.may_link(x, y)
    assert gone >= 0.9 * tried > 0
