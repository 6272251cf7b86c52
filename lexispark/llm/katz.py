"""Katz backoff scores with Good-Turing discounts and exactly normalised backoff weights, of any order.

Words are hashed to 64 bits.  Level 1: blocks of texts send their distinct words with training counts to the owners of
hash ranges; an owner sums them, numbers the known words, and replies with numbers and counts.  Level k: blocks send
their distinct k-grams, each as the number of its first k - 1 words and the number of its last word, Golomb-Rice coded,
to the owners of the histories; these count them, number those seen, store the model's part of that level, and reply.
After the last level a scan scores every token, from the longest history down:

    P(w | h) = d(c(h,w)) c(h,w) / c(h)      if the k-gram was seen in training
             = alpha(h) P(w | h')           otherwise, h' being h without its first word; P(w | h') if h was not seen
    alpha(h) = (1 - sum of seen P(w | h)) / (1 - sum of P(w | h') over seen w)

P(w) is discounted likewise; what that leaves goes to one unknown word.  ``d`` are Good-Turing discounts of a level for
counts up to k; k is lowered from 5 until all lie in (0, 1], else absolute discounting is used.  Where discounts
leave nothing, the denominator is one larger, so every distribution still sums to 1.  A text begins with one start
symbol: its first word has that as history, its second has (start, first word), whatever the order.

A reply has what its block cannot know: which k-grams of held-out texts were seen, counts, numbers where a level
follows, of each history which small counts its followers have, and for histories in held-out texts their numbers and
the sum that the backoff weight needs.  Replies go to the tasks that scan a block again, and are removed with them.

The model is a table for each level, partitioned by owner: k-grams with their counts, histories with their figures.
``fit`` makes it, ``Model.save`` and ``Model.load`` keep it, and ``scores(docs, model)`` scores other texts: the same exchange,
in which owners answer from their part of the table.

Histories with more than 1/owners of all tokens are split over all owners by follower; their figures, at most one row
per owner, are summed and go to the scoring tasks with the closure.  Nothing else is broadcast.

Defined cases: a null or empty text has one token, the end; a very long text is counted and scored whole; repeated rows
count each; a null id is the text "None" for the hold-out rule; equal scores are possible and need no order; an empty
table gives no rows; other columns of the table, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import json
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B

KMAX, ORDER = 5, 2
LIMIT = 5 << 20  # bytes of text that a task holds as tokens
END = np.uint64(0xE0D0E0D0E0D0E0D1)
U64 = np.uint64
_ASK = pa.schema([("owner", pa.int32()), ("grp", pa.int32()), ("blk", pa.string()), ("run", pa.int32()), ("hot", pa.bool_()), ("keys", pa.binary()), ("rest", pa.binary())])
_SAID = pa.schema([("kind", pa.string()), ("owner", pa.int32()), ("grp", pa.int32()), ("blk", pa.string()), ("run", pa.int32()), ("hot", pa.bool_()), ("payload", pa.binary())])
ASK = "owner int, grp int, blk string, run int, hot boolean, keys binary, rest binary"
SAID = "kind string, owner int, grp int, blk string, run int, hot boolean, payload binary"
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def discounts(n: np.ndarray) -> np.ndarray:
    """d[r] for r = 0..KMAX from counts of counts n[r] for r = 0..KMAX+1 (n[0] unused); 1 above k."""
    n = np.asarray(n, float)
    for k in range(KMAX, 0, -1):
        if not (n[1 : k + 2] > 0).all():
            continue
        a = (k + 1) * n[k + 1] / n[1]
        r = np.arange(1, k + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            d = ((r + 1) * n[2 : k + 2] / (r * n[1 : k + 1]) - a) / (1 - a)
        if np.isfinite(d).all() and (d > 0).all() and (d <= 1).all():
            return np.concatenate([[1.0], d, np.ones(KMAX - k)])
    cut = n[1] / (n[1] + 2 * n[2]) if n[1] > 0 else 0.5
    r = np.arange(1, KMAX + 1)
    return np.concatenate([[1.0], (r - cut) / r])


class Unigrams:
    """P(w) as a function of a word's training count."""

    def __init__(self, total: int, n: np.ndarray):
        self.total, self.n, self.d = total, n, discounts(n)
        r = np.arange(KMAX + 1)
        left = float((np.asarray(n, float)[: KMAX + 1] * r * (1 - self.d)).sum())
        self.den = total if left > 0 else total + 1
        self.unknown = (left if left > 0 else 1.0) / self.den if self.den else 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        out = c * self.d[np.where(c <= KMAX, c, 0)] / max(1, self.den)
        return np.where(c > 0, out, self.unknown)


def _sequence(b: pa.RecordBatch, fold: tuple[int, int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Tokens of a block with an end after each text, offsets, training flags (none without a fold) and ids."""
    data, off = B.text_bytes(b.column("text"))
    hs, ns = [], []
    for _, _, d, o in B.chunks(data, off):
        h, w = B.word_hashes(d, o)
        hs.append(h)
        ns.append(np.diff(w))
    n = np.concatenate(ns)
    at = np.concatenate([[0], np.cumsum(n + 1)])
    tok = np.full(int(at[-1]), END, np.uint64)
    word = np.ones(len(tok), bool)
    word[at[1:] - 1] = False
    tok[word] = np.concatenate(hs)
    ids = b.column("doc_id").to_pylist()
    train = B.crc_text(b.column("doc_id")) % fold[0] != fold[1] if fold else np.zeros(len(ids), bool)
    return tok, at, train, ids


@dataclass
class Level:
    """What every task knows of one level: where each owner's numbers begin, the discounts, and the hot histories' figures."""

    first: np.ndarray
    d: np.ndarray
    hot: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None  # histories, counts of their followers' small counts, lower sums
    path: str = ""

    @property
    def size(self) -> int:
        return int(self.first[-1])


@dataclass
class Model:
    """Levels 1 to ``order``, by ``m`` owners each."""

    order: int
    m: int
    total: int = 0
    texts: int = 0
    uni: Unigrams | None = None
    levels: list[Level] = field(default_factory=list)

    @property
    def v(self) -> int:
        return self.levels[0].size

    def histories(self, k: int) -> int:
        """How many numbers histories of level k have; at level 2 one more, the start of a text."""
        return self.levels[k - 2].size + (k == 2)

    def owner(self, i: np.ndarray, n: int) -> np.ndarray:
        return (i.astype(U64) * U64(self.m) // U64(max(1, n))).astype(np.int64)

    def lowest(self, n: int) -> np.ndarray:
        """The least number of each owner, of ``n`` in equal ranges."""
        return np.array([-(-o * n // self.m) for o in range(self.m + 1)], np.int64)

    @property
    def hot(self) -> int:
        return max(1, self.total // self.m)

    def save(self, spark: SparkSession, path: str) -> None:
        """Figures and the places of the levels' tables; the tables stay where ``fit`` wrote them."""
        body = base64.b64encode(pickle.dumps((self.order, self.m, self.total, self.texts, self.uni.n, [(x.first, x.d, x.hot, x.path) for x in self.levels]))).decode()
        spark.createDataFrame([(json.dumps({"order": self.order, "words": self.v, "tokens": self.total}), body)], "about string, body string").coalesce(1).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        """What ``save`` wrote; its body is trusted."""
        order, m, total, texts, n, levels = pickle.loads(base64.b64decode(spark.read.parquet(path).first().body))
        return cls(order, m, total, texts, Unigrams(total, n), [Level(*x) for x in levels])


def _count_of_counts(c: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(c, KMAX + 2), minlength=KMAX + 3)[: KMAX + 2]


class Part:
    """An owner's part of a level: sorted keys with counts; of histories the followers' small counts and the lower sum."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, ctx: np.ndarray, figures: np.ndarray, lower: np.ndarray):
        self.keys, self.counts, self.ctx, self.figures, self.lower = keys, counts, ctx, figures, lower

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray, ctx_of: np.ndarray, low: np.ndarray) -> Part:
        ctx, at = np.unique(ctx_of, return_inverse=True)
        small = np.minimum(counts, KMAX + 1)
        figures = np.stack([np.bincount(at[small == r], minlength=len(ctx)) for r in range(1, KMAX + 1)], 1) if len(ctx) else np.zeros((0, KMAX), np.int64)
        return cls(keys, counts, ctx, figures.astype(np.int64), np.bincount(at, low, len(ctx)) if len(ctx) else np.zeros(0))

    def packed(self) -> bytes:
        return pickle.dumps((B.rice_encode(self.keys), B.pack(self.counts), B.rice_encode(self.ctx.astype(U64)), B.pack(self.figures.ravel()), B.pack(self.lower)))

    @classmethod
    def unpacked(cls, b: bytes) -> Part:
        keys, counts, ctx, figures, lower = pickle.loads(b)
        return cls(B.rice_decode(keys), B.unpack(counts)[0].astype(np.int64), B.rice_decode(ctx).astype(np.int64), B.unpack(figures)[0].astype(np.int64).reshape(-1, KMAX), B.unpack(lower)[0])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys, -1 where they are not."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        k = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[k] == keys, k, -1)


def _stored_part(path: str, owner: int, hot: bool) -> Part:
    """In a task: an owner's part of a level's table."""
    import pyarrow.dataset as ds
    import pyarrow.fs as pfs

    fs, root = pfs.FileSystem.from_uri(f"{path}/kind=model/owner={owner}")
    for f in fs.get_file_info(pfs.FileSelector(root, allow_not_found=True)):
        if f.path.endswith(".parquet"):
            for r in ds.dataset(f.path, filesystem=fs).to_table(columns=["hot", "payload"]).to_pylist():
                if r["hot"] == hot:
                    return Part.unpacked(r["payload"])
    return Part.of(np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


# --- level 1

def _ask_words(m: int, fold: tuple[int, int] | None):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blk, grp, run, _, b in B.sub_blocks(batches, LIMIT):
            tok, at, train, _ = _sequence(b, fold)
            u, inv = np.unique(tok, return_inverse=True)
            c = np.bincount(inv[np.repeat(train, np.diff(at))], minlength=len(u))
            yield B.rows(_ASK, [(o, grp, blk, run, False, B.rice_encode(u[i:j]), B.pack(c[i:j])) for o, i, j in B.owner_slices(u, m)])

    return step


def _own_words(path: str | None):
    def step(t: pa.Table) -> pa.Table:
        owner, out = t.column("owner")[0].as_py(), []
        keys = [B.rice_decode(x) for x in t.column("keys").to_pylist()]
        if path is None:
            u, inv = np.unique(np.concatenate(keys), return_inverse=True)
            tot = np.bincount(inv, np.concatenate([B.unpack(x)[0] for x in t.column("rest").to_pylist()]), len(u)).astype(np.int64)
            ok = tot > 0
            part = Part.of(u[ok], tot[ok], np.zeros(0, np.int64), np.zeros(0))
            out += [("model", owner, None, None, None, False, part.packed()), ("stats", owner, None, None, None, False, B.pack(np.array([ok.sum(), tot.sum(), tot[u == END].sum()]), _count_of_counts(tot)))]
        else:
            part = _stored_part(path, owner, False)
        for g, k, r, a in zip(*(t.column(c).to_pylist() for c in ("grp", "blk", "run")), keys, strict=True):
            p = part.find(a)
            p, ok = p[p >= 0], p >= 0
            out.append(("reply", owner, g, k, r, False, B.pack(np.packbits(ok), np.diff(p, prepend=0), part.counts[p])))
        return pa.Table.from_batches([B.rows(_SAID, out)])

    return step


# --- a block's tokens

@dataclass
class _Side:
    """The distinct k-grams of a block whose histories are hot, or are not: sorted by owner, then by the key at that owner."""

    hot: bool
    at: np.ndarray  # positions
    back: np.ndarray  # each position's k-gram
    key: np.ndarray  # keys at the owner
    history: np.ndarray
    cut: np.ndarray  # each owner's range


class _Tokens:
    """A run's tokens: at each the number and count of the longest k-gram so far that ends there, and its probability."""

    def __init__(self, b: pa.RecordBatch, run: int, replies: list[dict], model: Model, fold: tuple[int, int] | None):
        tok, self.at, self.train, self.ids = _sequence(b, fold)
        self.model, n = model, np.diff(self.at)
        self.seen = np.repeat(self.train, n)
        self.place = np.arange(len(tok)) - np.repeat(self.at[:-1], n)
        u, inv = np.unique(tok, return_inverse=True)
        num, cnt, first = np.full(len(u), -1, np.int64), np.zeros(len(u), np.int64), model.levels[0].first
        for o, i, j in B.owner_slices(u, model.m):
            bits, gap, c = B.unpack(replies[0][run, o, False])
            k = i + np.flatnonzero(np.unpackbits(bits, count=j - i))
            num[k] = first[o] + np.cumsum(gap.astype(np.int64))
            cnt[k] = c
        self.w = self.num = num[inv]
        self.c1 = self.cnt = cnt[inv]
        self.den = np.full(len(tok), float(max(1, model.uni.den)))
        self.p = model.uni.p(self.c1)
        for k in range(2, len(replies) + 1):
            self._take(k, run, replies[k - 1])

    def history(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Number of each position's history at level k, -1 without one, and its count."""
        h, c = np.full(len(self.w), -1, np.int64), np.zeros(len(self.w), np.int64)
        h[1:], c[1:] = self.num[:-1], self.cnt[:-1]
        start = self.at[:-1]
        h[start], c[start] = (self.model.v if k == 2 and self.model.texts else -1), (self.model.texts if k == 2 else 0)
        return h, c

    def sides(self, k: int, h: np.ndarray, is_hot: np.ndarray) -> Iterator[_Side]:
        both, n, v = (h >= 0) & (self.w >= 0), self.model.histories(k), self.model.v + 1
        for hot in (False, True):
            at = np.flatnonzero(both & (is_hot == hot))
            x, y, most, base = (self.w, h, v, n) if hot else (h, self.w, n, v)
            xs, rank = np.unique(x[at], return_inverse=True)
            key, back = np.unique(rank.astype(U64) * U64(base) + y[at].astype(U64), return_inverse=True)
            mine, other = xs[(key // U64(base)).astype(np.int64)] if len(key) else np.zeros(0, np.int64), (key % U64(base)).astype(np.int64)
            own = self.model.owner(mine, most)
            local = (mine - self.model.lowest(most)[own]).astype(U64) * U64(base) + other.astype(U64)
            yield _Side(hot, at, back, local, other if hot else mine, np.searchsorted(own, np.arange(self.model.m + 1)))

    def held_out(self, k: int, h: np.ndarray, is_hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Histories that stand in held-out texts, and each owner's range of them."""
        ctx = np.unique(h[(h >= 0) & ~is_hot & ~self.seen])
        return ctx, np.searchsorted(self.model.owner(ctx, self.model.histories(k)), np.arange(self.model.m + 1))

    def asks(self, k: int, grp: int, blk: str, run: int) -> Iterator[list[tuple]]:
        """What to ask the owners of level k."""
        h, hc = self.history(k)
        is_hot = hc > self.model.hot
        ctx, ctx_cut = self.held_out(k, h, is_hot)
        least = self.model.lowest(self.model.histories(k))
        for s in self.sides(k, h, is_hot):
            c = np.bincount(s.back[self.seen[s.at]], minlength=len(s.key))
            low = np.zeros(len(s.key), np.int64)
            low[s.back] = self.cnt[s.at]
            out = []
            for o in range(self.model.m):
                i, j = int(s.cut[o]), int(s.cut[o + 1])
                p, q = (0, 0) if s.hot else (int(ctx_cut[o]), int(ctx_cut[o + 1]))
                if j > i or q > p:
                    own = c[i:j]
                    out.append((o, grp, blk, run, s.hot, B.rice_encode(s.key[i:j]), B.pack(own, low[i:j][own > 0], np.diff(ctx[p:q] - least[o], prepend=0))))
            yield out

    def _take(self, k: int, run: int, said: dict) -> None:
        """Go on to level k with what its owners replied."""
        level, m = self.model.levels[k - 1], self.model.m
        h, hc = self.history(k)
        is_hot = hc > self.model.hot
        ctx, ctx_cut = self.held_out(k, h, is_hot)
        figures, lower = np.zeros((len(ctx), KMAX), np.int64), np.zeros(len(ctx))
        num, cnt = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        flags = np.zeros(len(h), np.uint8)
        for s in self.sides(k, h, is_hot):
            own = np.bincount(s.back[self.seen[s.at]], minlength=len(s.key))
            c, n, f = np.zeros(len(s.key), np.int64), np.full(len(s.key), -1, np.int64), np.zeros(len(s.key), np.uint8)
            for o in range(m):
                got = said.get((run, o, s.hot))
                if got is None:
                    continue
                bits, counts, gaps, masks, *rest = B.unpack(got)
                i, j = int(s.cut[o]), int(s.cut[o + 1])
                seen = own[i:j] > 0
                seen[~seen] = np.unpackbits(bits, count=int((~seen).sum())).astype(bool)
                at = i + np.flatnonzero(seen)
                c[at] = counts
                if len(gaps):
                    n[at] = level.first[o] + np.cumsum(gaps.astype(np.int64))
                if not s.hot:
                    x = s.history[at]
                    f[at] = masks[np.cumsum(np.diff(x, prepend=x[:1]) != 0)] if len(x) else 0
                    p, q = int(ctx_cut[o]), int(ctx_cut[o + 1])
                    if q > p:
                        figures[p:q] = np.stack(rest[:KMAX], 1)
                        lower[p:q] = rest[KMAX + 1][rest[KMAX]]
            cnt[s.at], num[s.at], flags[s.at] = c[s.back], n[s.back], f[s.back]
        d, p = level.d, self.p
        den = self._den(hc, flags, d)
        alpha = np.ones(len(h))
        cold = np.flatnonzero((h >= 0) & ~is_hot & ~self.seen)
        k_of = np.searchsorted(ctx, h[cold])
        den[cold], alpha[cold] = self._weights(hc[cold], figures[k_of], lower[k_of], self.den[cold], d)
        warm = np.flatnonzero((h >= 0) & is_hot)
        if len(warm):
            k_of = np.searchsorted(level.hot[0], h[warm])
            den[warm], alpha[warm] = self._weights(hc[warm], level.hot[1][k_of], level.hot[2][k_of], self.den[warm], d)
        own = cnt * d[np.where(cnt <= KMAX, cnt, 0)] / den
        self.p = np.where(h < 0, p, np.where(cnt > 0, own, alpha * p))
        self.den = np.where(h < 0, self.den, den)
        self.num, self.cnt = num, cnt

    @staticmethod
    def _den(c: np.ndarray, flags: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Denominators of seen histories: one larger where no follower's count is discounted."""
        some = np.zeros(256, bool)
        for r in range(1, KMAX + 1):
            if d[r] < 1:
                some |= (np.arange(256) >> (r - 1) & 1) > 0
        return np.maximum(1, np.where(some[flags], c, c + 1)).astype(float)

    @staticmethod
    def _weights(c: np.ndarray, f: np.ndarray, lower: np.ndarray, lower_den: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Denominator and backoff weight of histories from count, counts of small counts, and the seen words' lower sum."""
        left = (f * (np.arange(1, KMAX + 1) * (1 - d[1:]))).sum(1)
        den = np.maximum(1, np.where(left > 0, c, c + 1))
        return den, np.where(left > 0, left, 1.0) / den / np.maximum(1 - lower / lower_den, 1e-300)


# --- level k

def _replies(path: str, grp: int, blk: str) -> dict:
    t = B.delivered(path, grp, blk)
    return {(r, o, h): p for r, o, h, p in zip(*(t.column(c).to_pylist() for c in ("run", "owner", "hot", "payload")))} if t is not None else {}


def _scanned(batches: Iterator[pa.RecordBatch], model: Model, paths: list[str], fold: tuple[int, int] | None) -> Iterator[tuple[str, int, int, _Tokens]]:
    """Runs with all that earlier levels replied."""
    now, said = None, []
    for blk, grp, run, _, b in B.sub_blocks(batches, LIMIT):
        if blk != now:
            now, said = blk, [_replies(p, grp, blk) for p in paths]
        yield blk, grp, run, _Tokens(b, run, said, model, fold)


def _ask_grams(k: int, model: Model, paths: list[str], fold: tuple[int, int] | None):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blk, grp, run, x in _scanned(batches, model, paths, fold):
            for out in x.asks(k, grp, blk, run):
                yield B.rows(_ASK, out)

    return step


def _own_grams(k: int, model: Model, number: bool, path: str | None):
    n, v = model.histories(k), model.v + 1
    d = model.levels[k - 2].d

    def step(t: pa.Table) -> pa.Table:
        owner, out = t.column("owner")[0].as_py(), []
        hots = np.array(t.column("hot").to_pylist())
        cols = {c: t.column(c).to_pylist() for c in ("grp", "blk", "run", "keys", "rest")}
        stats, before = np.zeros(KMAX + 2, np.int64), 0
        for hot in (False, True):
            mine, base = np.flatnonzero(hots == hot).tolist(), U64(n if hot else v)
            asks = [(B.rice_decode(cols["keys"][i]), *(x.astype(np.int64) for x in B.unpack(cols["rest"][i]))) for i in mine]
            side = lambda keys: (keys % base if hot else keys // base).astype(np.int64)  # noqa: E731, B023
            if path is not None:
                part = _stored_part(path, owner, hot)
            elif asks:
                u, inv = np.unique(np.concatenate([a[0] for a in asks]), return_inverse=True)
                flat = np.concatenate([a[1] for a in asks])
                tot = np.bincount(inv, flat, len(u)).astype(np.int64)
                low = np.zeros(len(u), np.int64)
                low[inv[flat > 0]] = np.concatenate([a[2] for a in asks])
                ok = tot > 0
                low = low[ok]
                part = Part.of(u[ok], tot[ok], side(u[ok]), low * d[np.where(low <= KMAX, low, 0)])
                stats += _count_of_counts(tot[ok])
                out.append(("model", owner, None, None, None, hot, part.packed()))
                if hot:
                    out.append(("hot", owner, None, None, None, True, B.pack(part.ctx, part.figures.ravel(), part.lower)))
            else:
                continue
            flags = ((part.figures > 0) << np.arange(KMAX)).sum(1).astype(np.uint8) if len(part.ctx) else np.zeros(0, np.uint8)
            for i, (keys, own, _, want) in zip(mine, asks, strict=True):
                p = part.find(keys)
                ok = p >= 0
                p = p[ok]
                reply = [np.packbits(ok[own == 0]), part.counts[p], np.diff(before + p, prepend=0) if number else np.zeros(0, np.int64)]
                if hot:
                    reply.append(np.zeros(0, np.uint8))
                else:
                    reply.append(flags[np.searchsorted(part.ctx, np.unique(side(part.keys[p])))])
                    want = np.cumsum(want)
                    c = np.minimum(np.searchsorted(part.ctx, want), max(0, len(part.ctx) - 1))
                    there = part.ctx[c] == want if len(part.ctx) else np.zeros(len(want), bool)
                    f, sums = np.zeros((len(want), KMAX), np.int64), np.zeros(len(want))
                    f[there], sums[there] = part.figures[c[there]], part.lower[c[there]]
                    values, code = np.unique(sums, return_inverse=True)
                    reply += [*f.T, code, values]
                out.append(("reply", owner, cols["grp"][i], cols["blk"][i], cols["run"][i], hot, B.pack(*reply)))
            before += len(part.keys)
        if path is None:
            out.append(("stats", owner, None, None, None, False, B.pack(np.array([before]), stats)))
        return pa.Table.from_batches([B.rows(_SAID, out)])

    return step


def _score(model: Model, paths: list[str], fold: tuple[int, int] | None):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, x in _scanned(batches, model, paths, fold):
            first, n = x.at[:-1], np.diff(x.at)
            score = np.add.reduceat(np.log10(x.p), first)
            base = np.add.reduceat(np.log10((x.c1 + 1) / (model.total + model.v + 1)), first)
            have = np.add.reduceat((x.c1 > 0).astype(np.int64), first)
            yield pa.RecordBatch.from_arrays([pa.array(x.ids, pa.int64()), pa.array(~x.train), pa.array(n), pa.array(have), pa.array(np.full(len(n), model.total)), pa.array(base), pa.array(score)], schema=_OUT)

    return step


# --- the exchange

def _exchange(docs: DataFrame, id_col: str, text_col: str, fold: tuple[int, int] | None, order: int, given: Model | None, last: bool) -> tuple[Model, DataFrame | None]:
    """Level by level: ask, answer, deliver.  The model, and unless it is only to be fitted, the scores."""
    spark = docs.sparkSession
    model = given or Model(order, 2 * B.owners(docs))
    src, files = B.with_blocks(B.block_source(docs), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    paths: list[str] = []
    for k in range(1, model.order + 1):
        more = k < model.order
        path = given.levels[k - 1].path if given else None
        ask, own = (_ask_words(model.m, fold), _own_words(path)) if k == 1 else (_ask_grams(k, model, paths, fold), _own_grams(k, model, more, path))
        at = B.shared_dir(spark, f"katz-{k}")
        B.at_owners(src.mapInArrow(B.tidy(ask), ASK), model.m, own, SAID).write.options(**B.WRITE).partitionBy("kind", "owner").parquet(at)
        B.freed(spark)
        said = spark.read.schema(SAID).parquet(at)
        if not given:
            _learn(model, k, said, at)
        if more or last:
            replies = said.where("kind = 'reply'").select("grp", "blk", "run", "owner", "hot", "payload")
            paths.append(B.deliver(replies, files, f"katz-replies-{k}"))
        B.remove(spark, f"{at}/kind=reply")
        del said
        B.freed(spark)
    return model, src.mapInArrow(B.tidy(_score(model, paths, fold)), OUT) if last else None


def _learn(model: Model, k: int, said: DataFrame, path: str) -> None:
    """What the driver needs of a level: one row of figures per owner, and those of hot histories."""
    sizes, n, figures = np.zeros(model.m, np.int64), np.zeros(KMAX + 2, np.int64), {}
    for r in said.where("kind in ('stats', 'hot')").select("kind", "owner", "payload").collect():
        head, *rest = B.unpack(bytes(r.payload))
        if r.kind == "stats":
            sizes[r.owner], n = head[0], n + rest[0]
            if k == 1:
                model.total, model.texts = model.total + int(head[1]), model.texts + int(head[2])
            continue
        for h, f, x in zip(head.tolist(), rest[0].astype(np.int64).reshape(-1, KMAX), rest[1].tolist(), strict=True):
            a, b = figures.get(h, (0, 0.0))
            figures[h] = a + f, b + x
    order = sorted(figures)
    hot = (np.array(order, np.int64), np.array([figures[h][0] for h in order], np.int64).reshape(-1, KMAX), np.array([figures[h][1] for h in order]))
    if k == 1:
        model.uni = Unigrams(model.total, n)
    model.levels.append(Level(np.concatenate([[0], np.cumsum(sizes)]), discounts(n) if k > 1 else model.uni.d, hot, path))


def katz_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: tuple[int, int] = (7, 2), order: int = ORDER) -> DataFrame:
    """log10 probability of every text under a model of the texts whose crc32(id) mod fold[0] is not fold[1]."""
    return _exchange(docs, id_col, text_col, fold, order, None, True)[1]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: tuple[int, int] = (1, 1), order: int = ORDER) -> Model:
    """A model of the texts (by default of all); its tables are in the shared folder."""
    return _exchange(docs, id_col, text_col, fold, order, None, False)[0]


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """log10 probability of every text under a model that was fitted before; all count as held out."""
    return _exchange(docs, id_col, text_col, None, model.order, model, True)[1]


def op1_katz(spark, sf_dir):
    """Katz and add-one scores of every document."""
    return katz_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_katz": op1_katz}
ORACLE: dict[str, str] = {}
