"""Toxicity by a classifier chain.

Each category of the chain has a linear model over the presence of words and word beginnings and over the log-odds
of the categories before it.  For training those log-odds are out-of-fold predictions, for scoring the predictions
of the models fitted on all rows.  The models are fitted in the driver on at most ``SAMPLE`` labelled documents,
those with the smallest hash of their id; every document is scored.  Folds follow from a hash of the text, so copies
share a fold.  The cut of the last category is the one with the best F1 of its out-of-fold predictions among those with
``LEAST`` true ones at least and a precision half way from the base rate to 1; if there is none, nothing is rejected.

Defined cases: a null or empty text has no words; a very long text is read whole; labels that are null are not used, of
repeated labels each counts; with no labels, or one class, a model predicts the share that it saw (0 without labels) and
nothing is rejected; a null id has no label and is scored; repeated rows are scored each; ties of features are broken by
their key; an empty table gives no rows; other columns of the table, whatever their names, are kept by ``drop_toxic``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

SAMPLE, CANDIDATES, FOLDS, FEATURES, LEAST = 12_000, 5000, 3, 2000, 4
CHAIN = ("low_quality", "toxic")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _keys(b: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end, row of each feature, its 64-bit key): words of letters, and their beginnings of 4 to 6 bytes."""
    data, off = B.text_bytes(b.column("text"))
    for i, j, d, o in B.chunks(data, off):
        low = B.lower_ascii(d)
        s, e, w = B.runs(_LETTER[low], o)
        row = np.repeat(np.arange(j - i), np.diff(w))
        hashed = B.SpanHash(low)
        parts = [hashed(s, e)]
        rows = [row]
        for k in (4, 5, 6):
            long = e - s > k
            parts.append(B.mix(hashed(s[long], s[long] + k) + np.uint64(k)))
            rows.append(row[long])
        yield i, j, np.concatenate(rows), np.concatenate(parts)


class Linear:
    """A logistic model over sparse presences and a few dense columns."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, dense: np.ndarray, bias: float):
        self.keys, self.weights, self.dense, self.bias = keys, weights, dense, bias

    def logit(self, n: int, row: np.ndarray, key: np.ndarray, extra: np.ndarray) -> np.ndarray:
        out = np.full(n, self.bias) + extra @ self.dense if extra.shape[1] else np.full(n, self.bias)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            pair = np.unique(row[hit].astype(np.int64) * len(self.keys) + at[hit])
            out += np.bincount(pair // len(self.keys), self.weights[pair % len(self.keys)], n)
        return out


def z_score(ones, count, positive, n):
    """How many standard errors the log-odds of a feature are from none."""
    o, q = ones + 0.5, count - ones + 0.5
    return np.log(o / (positive + 1)) - np.log(q / (n - positive + 1)), np.sqrt(1 / o + 1 / q)


def fit(n: int, row: np.ndarray, col: np.ndarray, width: int, extra: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """(weights, dense weights, bias): the features with the largest scores, and accelerated gradient steps on the penalised log loss."""
    rate = (y.sum() + 0.5) / (n + 1) if n else 1e-9
    out, bias0 = np.zeros(width), float(np.log(rate / (1 - rate)))
    if not n or not width or y.min() == y.max():
        return out, np.zeros(extra.shape[1]), bias0
    count, ones = np.bincount(col, minlength=width), np.bincount(col, y[row], width)
    odds, error = z_score(ones, count, y.sum(), n)
    worth = np.where(count >= LEAST, np.abs(odds) / error, 0)
    best = np.sort(np.argsort(-worth, kind="stable")[:FEATURES])
    best = best[worth[best] > 0]
    slot = np.full(width, -1, np.int32)
    slot[best] = np.arange(len(best))
    at = slot[col]
    r, c, k = row[at >= 0], at[at >= 0], len(best)
    mean, scale = extra.mean(0), np.where(extra.std(0) > 1e-6, extra.std(0), 1.0)
    x = (extra - mean) / scale
    w, z, bias, zb, d, zd = np.zeros(k), np.zeros(k), bias0, bias0, np.zeros(x.shape[1]), np.zeros(x.shape[1])
    t, step, penalty = 1.0, 4.0 / (np.bincount(r, minlength=n).mean() + 1 + x.shape[1]), 0.3 / n
    for _ in range(rounds):
        g = 1 / (1 + np.exp(-np.clip(zb + np.bincount(r, z[c], n) + x @ zd, -30, 30))) - y
        w2, b2, d2 = z - step * (np.bincount(c, g[r], k) / n + penalty * z), zb - step * g.mean(), zd - step * (x.T @ g / n + penalty * zd)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        f = (t - 1) / t2
        z, zb, zd = w2 + f * (w2 - w), b2 + f * (b2 - bias), d2 + f * (d2 - d)
        w, bias, d, t = w2, b2, d2, t2
    out[best] = w
    return out, d / scale, float(bias - mean @ (d / scale))


class Chain:
    """Models in order, and the cut of the last."""

    def __init__(self, models: list[Linear], cut: float):
        self.models, self.cut = models, cut
        self.some = np.zeros(1 << 20, bool)
        for m in models:
            self.some[m.keys >> np.uint64(44)] = True

    def logits(self, n: int, row: np.ndarray, key: np.ndarray) -> np.ndarray:
        maybe = self.some[key >> np.uint64(44)]
        row, key = row[maybe], key[maybe]
        out = np.zeros((n, 0))
        for m in self.models:
            out = np.column_stack([out, m.logit(n, row, key, out)])
        return out


def fit_chain(n: int, row: np.ndarray, col: np.ndarray, known: np.ndarray, y: np.ndarray, fold: np.ndarray, folds: int = FOLDS) -> Chain:
    """``col``: places in the sorted keys ``known``.  ``y`` has a column for each category, in order; ``fold`` a number of each row."""
    width = len(known)
    models, extra = [], np.zeros((n, 0))
    for j in range(y.shape[1]):
        out = np.zeros(n)
        for f in range(folds):
            test = fold == f
            new, use = np.cumsum(~test) - 1, ~test[row]
            w, dense, bias = fit(int((~test).sum()), new[row[use]], col[use], width, extra[~test], y[~test, j])
            mine = ~use
            out += np.where(test, np.bincount(row[mine], w[col[mine]], n) + bias + extra @ dense, 0)
        w, dense, bias = fit(n, row, col, width, extra, y[:, j])
        used = np.flatnonzero(w)
        models.append(Linear(known[used], w[used], dense, bias))
        extra = np.column_stack([extra, out])
    return Chain(models, best_cut(extra[:, -1], y[:, -1]) if y.shape[1] and n else np.inf)


def best_cut(score: np.ndarray, y: np.ndarray) -> float:
    """The log-odds with the best F1 among the cuts that tell the positives apart (see above); infinite if there is none."""
    if not len(y) or not y.any():
        return np.inf
    order = np.argsort(-score, kind="stable")
    ranked, many = score[order], np.arange(1, len(y) + 1)
    hit = np.cumsum(y[order])
    ok = (hit >= LEAST) & (hit / many >= (1 + y.mean()) / 2) & np.append(ranked[1:] < ranked[:-1], True)
    if not ok.any():
        return np.inf
    k = int(np.argmax(np.where(ok, 2 * hit / (many + y.sum()), -1)))
    low = ranked[k + 1] if k + 1 < len(y) else ranked[k] - 1
    return float((ranked[k] + low) / 2)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, candidates: int = CANDIDATES) -> Chain:
    """A chain of low quality, then toxicity, from at most ``sample`` labelled documents.

    The features of these are counted in Spark; the driver gets the presences of the ``candidates`` that tell most
    about each category, so what it holds is bounded by the two parameters.
    """
    usable = labels.where("doc_id is not null and quality is not null and toxic is not null")
    some = usable.select("doc_id", (1 - F.col("quality")).cast("int").alias("low_quality"), F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id", "low_quality", "toxic").limit(sample)
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), "text").join(F.broadcast(some), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, row, key in _keys(b):
                keys = pa.array(_split(row, key, j - i), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in ("doc_id", "hash", *CHAIN)), keys], names=["doc_id", "hash", *CHAIN, "keys"])

    rows = B.stored(rows.mapInArrow(B.tidy(features), "doc_id long, hash long, low_quality int, toxic int, keys array<long>"), "labelled")
    n, *sums = rows.agg(F.count("*"), *[F.coalesce(F.sum(c), F.lit(0)) for c in CHAIN]).first()
    seen = rows.select(F.explode("keys").alias("key"), *CHAIN).groupBy("key").agg(F.count("*").alias("c"), *[F.sum(c).alias(c) for c in CHAIN]).where(F.col("c") >= LEAST)
    seen, known = B.stored(seen, "counted"), set()
    for c, total in zip(CHAIN, sums, strict=True):
        o, q = F.col(c) + 0.5, F.col("c") - F.col(c) + 0.5
        z = F.abs(F.log(o / (total + 1)) - F.log(q / (n - total + 1))) / F.sqrt(1 / o + 1 / q)
        known |= {r.key for r in seen.select("key", z.alias("z")).orderBy(F.desc("z"), "key").limit(candidates).select("key").collect()}
    known = np.array(sorted(known), np.int64)

    def presences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [_places(known, np.array(k, np.int64)).tobytes() for k in b.column("keys").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "hash", *CHAIN)), pa.array(sets, pa.binary())], names=["doc_id", "hash", *CHAIN, "hits"])

    got = rows.mapInArrow(B.tidy(presences), "doc_id long, hash long, low_quality int, toxic int, hits binary").toArrow().sort_by([(c, "ascending") for c in ("hash", "doc_id", *CHAIN)])
    sets = [np.frombuffer(x, np.uint32) for x in got.column("hits").to_pylist()]
    y = np.column_stack([got.column(c).to_numpy().astype(float) for c in CHAIN]) if len(sets) else np.zeros((0, len(CHAIN)))
    row = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets]) if sets else np.zeros(0, np.int32)
    place = np.argsort(known.view(np.uint64))
    back = np.empty(len(known), np.int32)
    back[place] = np.arange(len(known))
    col = back[np.concatenate(sets)] if sets else np.zeros(0, np.int32)
    fold = got.column("hash").to_numpy() % FOLDS if len(sets) else np.zeros(0, np.int64)
    return fit_chain(len(sets), row, col, known.view(np.uint64)[place], y, fold)


def _places(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where sorted ``known`` has any of the keys."""
    at = np.searchsorted(known, keys)
    at, keys = at[at < len(known)], keys[at < len(known)]
    return at[known[at] == keys].astype(np.uint32)


def _split(row: np.ndarray, key: np.ndarray, n: int) -> list[np.ndarray]:
    """Distinct keys of each row, as signed integers."""
    order = np.argsort(row, kind="stable")
    key, at = key[order], np.searchsorted(row[order], np.arange(n + 1))
    return [np.unique(key[i:j]).view(np.int64) for i, j in zip(at, at[1:])]


OUT = "doc_id long, p_low_quality double, p_toxic double, toxic boolean, kept boolean"


def _logits(b: pa.RecordBatch, chain: Chain) -> np.ndarray:
    return np.concatenate([chain.logits(j - i, row, key) for i, j, row, key in _keys(b)]) if b.num_rows else np.zeros((0, len(CHAIN)))


def scores(docs: DataFrame, chain: Chain) -> DataFrame:
    """Probabilities of each category and whether the document is toxic."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _logits(b, chain)
            p, bad = 1 / (1 + np.exp(-np.clip(x, -60, 60))), x[:, -1] > chain.cut
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(bad), pa.array(~bad)], names=["doc_id", "p_low_quality", "p_toxic", "toxic", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(B.tidy(step), OUT)


def drop_toxic(docs: DataFrame, chain: Chain) -> DataFrame:
    """The documents that are not toxic, with all their columns."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_logits(b, chain)[:, -1] <= chain.cut))

    return docs.mapInArrow(B.tidy(step), docs.schema)


def op5_toxicity(spark, sf_dir):
    """The chain's probabilities for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scores(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLE: dict[str, str] = {}
