"""Near-duplicate detection by a chosen-path set similarity join.

Texts with equal shingle sets form one class.  In each of ``trees`` independent trees a class follows, from every
node, the one or two coordinates of its minwise signature that the node's hash selects, so that a pair at the
threshold is expected to share more than one child of each node that it shares.  Nodes of at most ``limit``
classes are compared exhaustively within one task, on 64-byte sketches; larger nodes branch on, and what is large
at the last level is compared in square tiles.  Only pairs whose sketches agree on 40 % are proposed, and only
between classes that earlier links have not joined; all proposed pairs are confirmed on full shingle sets.  Then
the links of each class are counted over all pairs of its component, on full sets.

A pair of similarity 0.7 meets in no node of the first level with probability 0.3**24 (trees * 1.5 branches), of the
third with about 1e-6; its sketches fall below 40 % with about 1e-7.

Defined cases: null text, or no words: empty set, linked with nothing, own component, kept.  A null id sorts after
every id.  Of rows that repeat an id in one component, one stays.  A very long text is taken whole.  An empty table
gives no rows.  Other columns of the table, whatever their names, are kept by ``near_dedup`` and not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

M, TREES, LIMIT, LEVELS, K = 64, 16, 48, 3, 5
LOW = int(0.40 * M)
_R = np.random.default_rng(20240607)
_MUL = _R.integers(1, 1 << 63, M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _R.integers(0, 1 << 63, M, dtype=np.uint64)
_POS = _R.integers(1, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SIZES = _R.integers(1, 1 << 63, K + 1, dtype=np.uint64)
_LAST = 2**63 - 1
_FEAT = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("grp", pa.int32()), ("blk", pa.string()), ("row", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary())])
FEAT = "uid long, doc_id long, grp int, blk string, row long, n long, digest binary, sig binary"
_SETS = pa.schema([("uid", pa.int64()), ("hashes", pa.binary())])


def shingles(w: np.ndarray) -> np.ndarray:
    """Distinct hashes of the 5-word shingles of a word sequence, sorted; of fewer words, of the whole sequence."""
    n = len(w)
    if not n:
        return w
    m = min(K, n)
    h = np.full(n - m + 1, _SIZES[m], np.uint64)
    for j in range(m):
        h += w[j : j + n - m + 1] * _POS[j]
    h = np.sort(B.mix(h))
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise values of each set, one for each of M coordinates; all ones for an empty set."""
    out = np.full((len(sets), M), 0xFFFFFFFF, np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        at = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        buf = np.empty_like(flat)
        for j in range(M):
            np.bitwise_xor(flat, _XOR[j], out=buf)
            np.multiply(buf, _MUL[j], out=buf)
            out[full, j] = np.minimum.reduceat(buf, at) >> np.uint64(32)
    return out


def _sets(b: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray]]]:
    data, off = B.text_bytes(b.column("text"))
    for i, _, d, o in B.chunks(data, off):
        h, w = B.word_hashes(d, o)
        w = w.tolist()
        yield i, [shingles(h[p:q]) for p, q in zip(w, w[1:])]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, at = None, 0
    for blk, grp, b in B.by_block(batches):
        if blk != now:
            now, at = blk, 0
        uid, ids = b.column("uid").to_pylist(), b.column("doc_id").to_pylist()
        for i, sets in _sets(b):
            sig = signatures(sets)
            yield B.rows(_FEAT, [(uid[i + k], ids[i + k], grp, blk, at + i + k, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None, sig[k].tobytes()) for k, s in enumerate(sets)])
        at += b.num_rows


# --- trees

def _branches(path: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each node, the one or two coordinates that its hash selects: (rows, coordinate)."""
    h = B.mix(path ^ np.uint64(0x5DEECE66D))
    first = (h & np.uint64(M - 1)).astype(np.int64)
    yield np.arange(len(path)), first
    two = np.flatnonzero((h >> np.uint64(63)) == 1)
    other = (first[two] + 1 + ((h[two] >> np.uint64(8)) % np.uint64(M - 1)).astype(np.int64)) % M
    yield two, other


def _child(path: np.ndarray, coordinate: np.ndarray, value: np.ndarray) -> np.ndarray:
    return B.mix(path * np.uint64(0x9E3779B97F4A7C15) + (coordinate.astype(np.uint64) << np.uint64(32)) + value.astype(np.uint64))


def _roots(trees: int) -> list[tuple[int, int, int]]:
    """(tree, root, coordinate): the first level's coordinates, all different."""
    order, out = np.random.default_rng(99).permutation(M), []
    for t in range(trees):
        for _ in range(1 + t % 2):
            out.append((t, int(B.mix(np.array([t + 1], np.uint64))[0]), int(order[len(out) % M])))
    return out


def _sig(b: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(-1, M)


def _first_level(trees: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig, uid = _sig(b), b.column("uid").to_numpy()
            for t, root, c in _roots(trees):
                p = _child(np.full(len(uid), root, np.uint64), np.full(len(uid), c), sig[:, c])
                yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), pa.array(uid), pa.array(np.full(len(uid), t, np.int32))], names=["path", "uid", "tree"])

    return step


def _next_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sig, uid, path = _sig(b), b.column("uid").to_numpy(), b.column("path").to_numpy().view(np.uint64)
        for r, c in _branches(path):
            p = _child(path[r], c, sig[r, c])
            yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), pa.array(uid[r]), pa.array(np.zeros(len(r), np.int32))], names=["path", "uid", "tree"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by path, those whose node holds more than one class.  Keeps one row between batches."""
    held: pa.RecordBatch | None = None
    met = False
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        p = b.column("path").to_numpy()
        same = p[1:] == p[:-1]
        keep = np.zeros(len(p), bool)
        keep[1:] |= same
        keep[:-1] |= same
        keep[0] |= met
        met, held = bool(keep[-1]), b.slice(len(p) - 1)
        yield b.slice(0, len(p) - 1).filter(pa.array(keep[:-1]))
    if held is not None and met:
        yield held


def _agree(least: int):
    """Pairs (a, b) with sketches and sizes, those whose sketches agree on ``least`` coordinates."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s, t = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, M) for c in ("sa", "sb"))
                yield b.select(["a", "b"]).filter(pa.array((s == t).sum(1) >= least))

    return step


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _compare(uid: np.ndarray, comp: np.ndarray, n: np.ndarray, s: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """Of the row pairs (i, j), those of different components whose sketches agree enough."""
    ok = (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= 70 * np.maximum(n[i], n[j]))
    i, j = i[ok], j[ok]
    ok = (s[i] == s[j]).sum(1) >= LOW
    x, y = uid[i[ok]], uid[j[ok]]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], schema=_PAIRS)


def _columns(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    s = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint8).reshape(-1, M)
    return *(b.column(c).to_numpy() for c in ("uid", "comp", "n")), s


def _small_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by path, no node above LIMIT: all pairs of each node are compared here, those that agree go on."""

    def compare(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        p, cols = b.column("path").to_numpy(), _columns(b)
        first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        size = np.diff(np.append(first, len(p)))
        for k in np.unique(size[size > 1]).tolist():
            f = first[size == k]
            for x in range(k - 1):
                i = np.repeat(f + x, k - 1 - x)
                yield _compare(*cols, i, (f[:, None] + np.arange(x + 1, k)).ravel())

    held: pa.RecordBatch | None = None
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        p = b.column("path").to_numpy()
        cut = int(np.searchsorted(p, p[-1]))
        yield from compare(b.slice(0, cut)) if cut else ()
        held = b.slice(cut)
    if held is not None:
        yield from compare(held)


def _tile(t: pa.Table) -> pa.Table:
    b = t.combine_chunks().to_batches()[0]
    side, cols = b.column("side").to_numpy(), _columns(b)
    x, y = int(b.column("x")[0].as_py()), int(b.column("y")[0].as_py())
    l, r = np.flatnonzero(side == x), np.flatnonzero(side == y)
    out = [_compare(*cols, np.full(len(r) if x != y else len(r) - k - 1, i), r if x != y else r[k + 1 :]) for k, i in enumerate(l.tolist())]
    return pa.Table.from_batches(out, schema=_PAIRS)


def _large_nodes(rows: DataFrame, tile: int = 256) -> DataFrame:
    """All pairs of what is still large, in square tiles; the tiles within the component of a node's smallest root are left out."""
    n = F.ceil(F.col("size") / tile).cast("int")
    ref = F.col("comp") == F.col("ref")
    side = F.when(ref, F.pmod(F.xxhash64("uid"), n)).otherwise(n + F.pmod(F.xxhash64("uid"), n)).cast("int")
    other = F.when(ref, F.sequence(n, 2 * n - 1)).otherwise(F.sequence(F.lit(0), 2 * n - 1))
    tiles = rows.withColumn("side", side).withColumn("other", F.explode(other))
    tiles = tiles.withColumn("x", F.least("side", "other")).withColumn("y", F.greatest("side", "other"))
    return tiles.groupBy("path", "x", "y").applyInArrow(_tile, "a long, b long")


# --- links and components

def _full_sets(path: str):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, want = None, 0, {}
        for blk, grp, b in B.by_block(batches):
            if blk != now:
                now, at, t = blk, 0, B.delivered(path, grp, blk)
                want = dict(zip(t.column("row").to_pylist(), t.column("uid").to_pylist(), strict=True)) if t is not None else {}
            rows = [r for r in range(b.num_rows) if at + r in want]
            if rows:
                part = b.take(pa.array(rows))
                for i, sets in _sets(part):
                    yield B.rows(_SETS, [(want[at + rows[i + k]], s.tobytes()) for k, s in enumerate(sets)])
            at += b.num_rows

    return step


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = np.zeros(b.num_rows, bool)
        for k, (x, y) in enumerate(zip(b.column("ha").to_pylist(), b.column("hb").to_pylist(), strict=True)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            z = np.sort(np.concatenate([x, y]), kind="stable")
            both = int((z[1:] == z[:-1]).sum())
            ok[k] = 100 * both >= 70 * (len(z) - both)
        yield b.select(["a", "b"]).filter(pa.array(ok))


NARROW = 4096  # hashes of a set up to which two bytes of each are enough


def cut_hashes(s: np.ndarray) -> bytes:
    """The low two bytes of each hash of a set, of a large set four, sorted."""
    return np.sort(s.astype(np.uint16 if len(s) <= NARROW else np.uint32)).tobytes()


def may_link(x: bytes, y: bytes) -> bool:
    """Whether two sets can be linked, from their cut hashes: what they share in full they also share cut, so no link is lost."""
    a, b = (np.frombuffer(v, np.uint16 if len(v) <= 2 * NARROW else np.uint32) for v in (x, y))
    if a.dtype != b.dtype:
        a, b = np.sort(a.astype(np.uint16)), np.sort(b.astype(np.uint16))
    at = np.searchsorted(b, a)
    both = min(int((b[np.minimum(at, len(b) - 1)] == a).sum()), len(b))
    return 100 * both >= 70 * (len(a) + len(b) - both)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        low = [cut_hashes(np.frombuffer(h, np.uint64)) for h in b.column("hashes").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("uid"), pa.array(low, pa.binary())], names=["uid", "low"])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = [may_link(x, y) for x, y in zip(b.column("la").to_pylist(), b.column("lb").to_pylist(), strict=True)]
        yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def confirmed(pairs: DataFrame, reps: DataFrame, src: DataFrame, n: int) -> DataFrame:
    """The stored pairs whose full sets are linked.  Sets are made anew from the texts that are asked for.

    Most proposed pairs are not linked; their cut hashes say so, and full sets go only with the others.
    """
    made = B.Scratch(pairs.sparkSession)
    asked = pairs.select(F.col("a").alias("uid")).union(pairs.select("b")).distinct().join(reps.select("uid", "grp", "blk", "row"), "uid")
    path = made.deliver(asked, n, "asked")
    sets = made.stored(src.mapInArrow(B.tidy(_full_sets(path)), "uid long, hashes binary"), "sets")
    low = made.stored(sets.mapInArrow(B.tidy(_cut), "uid long, low binary"), "cut")
    near = pairs.join(low.select(F.col("uid").alias("a"), F.col("low").alias("la")), "a").join(low.select(F.col("uid").alias("b"), F.col("low").alias("lb")), "b")
    near = made.stored(near.select("a", "b", "la", "lb").mapInArrow(B.tidy(_likely), "a long, b long"), "likely")
    B.freed(pairs.sparkSession)
    j = near.join(sets.select(F.col("uid").alias("a"), F.col("hashes").alias("ha")), "a").join(sets.select(F.col("uid").alias("b"), F.col("hashes").alias("hb")), "b")
    out = B.stored(j.select("a", "b", "ha", "hb").mapInArrow(B.tidy(_confirm), "a long, b long"), "links")
    made.drop()
    return out


def components(links: DataFrame) -> DataFrame:
    """(uid, root) of every linked node but the roots; alternating large and small stars, each round a stored table."""
    e = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    last, before = None, B.Scratch(links.sparkSession)
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m"))
        now = B.Scratch(links.sparkSession)
        e = now.stored(small.distinct(), "stars")
        before.drop()
        before = now
        state = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == last:
            return e.select(F.col("u").alias("uid"), F.col("v").alias("root"))
        last = state


# --- degrees

TILE_HASHES, TILE_CLASSES = 200_000, 1024


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many hashes the sets at ``left`` and those at ``right`` share: products of presences, some shared hashes at a time."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    on = count[col] > 1
    row, col = row[on], shared[col[on]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    many = int(col[-1]) + 1 if len(col) else 0
    out, width = np.zeros((len(left), len(right)), np.float32), min(many, max(64, (1 << 21) // max(1, len(sets))))
    for c in range(0, many, max(1, width)):
        i, j = np.searchsorted(col, [c, c + width])
        x = np.zeros((len(sets), width), np.float32)
        x[row[i:j], col[i:j] - c] = 1
        out += x[left] @ x[right].T
    return out.astype(np.int64)


def _tile_degrees(t: pa.Table) -> pa.RecordBatch:
    """Links of each class within one tile: a square of two sides, or the pairs of one."""
    uid, side, x, y = (t.column(c).to_numpy() for c in ("uid", "side", "x", "y"))
    sets = [np.frombuffer(h, np.uint64) for h in t.column("hashes").to_pylist()]
    n = np.array([len(s) for s in sets])
    l, r = np.flatnonzero(side == x[0]), np.flatnonzero(side == y[0])
    both = intersections(sets, l, r)
    linked = 100 * both >= 70 * (n[l][:, None] + n[r][None, :] - both)
    if x[0] == y[0]:
        np.fill_diagonal(linked, False)
        who, many = uid[l], linked.sum(1)
    else:
        who, many = np.concatenate([uid[l], uid[r]]), np.concatenate([linked.sum(1), linked.sum(0)])
    return pa.RecordBatch.from_arrays([pa.array(who), pa.array(many.astype(np.int64))], names=["uid", "n_links"])


def _degrees_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by root and tile; holds one tile."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("root", "x", "y")], 1)
        cut = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), b.num_rows]
        for i, j in zip(cut, cut[1:]):
            k = tuple(key[i])
            if held and k != now:
                yield _tile_degrees(pa.Table.from_batches(held))
                held = []
            now = k
            held.append(b.slice(i, j - i))
    if held:
        yield _tile_degrees(pa.Table.from_batches(held))


def degrees(comp: DataFrame, reps: DataFrame, src: DataFrame, n: int, width: int) -> DataFrame:
    """(uid, n_links) of the classes of every component: all its pairs are compared on full sets, and counts alone leave a task.

    A component beyond ``TILE_HASHES`` hashes or ``TILE_CLASSES`` classes is cut into sides, and each pair of sides is a tile.
    """
    made = B.Scratch(comp.sparkSession)
    members = comp.union(comp.select("root", "root")).distinct().join(reps.select("uid", "grp", "blk", "row", "n"), "uid")
    sides = members.groupBy("root").agg(F.greatest(F.ceil(F.sum("n") / TILE_HASHES), F.ceil(F.count("*") / TILE_CLASSES)).cast("int").alias("sides"))
    path = made.deliver(members.select("uid", "grp", "blk", "row"), n, "members")
    sets = made.stored(src.mapInArrow(B.tidy(_full_sets(path)), "uid long, hashes binary"), "member-sets")
    placed = members.select("uid", "root").join(sides, "root").withColumn("side", F.pmod(F.xxhash64("uid"), "sides").cast("int"))
    tiles = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    tiles = tiles.select("uid", "root", "side", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y")).join(sets, "uid")
    tiles = tiles.repartition(width, "root", "x", "y").sortWithinPartitions("root", "x", "y")
    out = B.stored(tiles.mapInArrow(B.tidy(_degrees_of), "uid long, n_links long").groupBy("uid").agg(F.sum("n_links").alias("n_links")), "degrees")
    made.drop()
    return out


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trees: int = TREES) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, class_id, class_size, n_links, and its place (grp, blk, row).

    A class is the documents with one shingle set; ``class_size`` counts them, ``n_links`` the other classes that are linked
    with it.  ``docs`` must be a block source (see ``blocks.block_source``) if the place is to be used.
    """
    spark = docs.sparkSession
    width, made = B.owners(docs), B.Scratch(spark)
    src, files = B.with_blocks(B.block_source(docs), F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    feats = B.stored(src.mapInArrow(B.tidy(_features), FEAT), "features")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("id"), "uid", "grp", "blk", "row", "n", "sig"))
    reps = feats.where("n > 0").groupBy("digest").agg(first.alias("f"), F.count("*").alias("class_size")).select("digest", "class_size", "f.*")
    reps = made.stored(reps, "classes")
    B.freed(spark)
    sizes = reps.select("uid", "n", "sig")

    rows = sizes.mapInArrow(B.tidy(_first_level(trees)), "path long, uid long, tree int")
    nodes = _nodes(rows, width, made, "level1")
    B.freed(spark)
    lead = nodes.where("tree < 4").groupBy("path").agg(F.min("uid").alias("a"))
    stars = nodes.where("tree < 4").join(lead, "path").where("a < uid").select("a", F.col("uid").alias("b")).distinct()
    tried = made.stored(_agreeing(stars, sizes, int(0.6 * M)), "stars1")
    links = confirmed(tried, reps, src, files)
    comp = components(links)

    found = []
    for level in range(1, LEVELS + 1):
        info = nodes.join(comp, "uid", "left").select("path", "uid", F.coalesce("root", "uid").alias("comp"))
        mixed = info.groupBy("path").agg(F.count("*").alias("size"), F.min("comp").alias("ref"), F.max("comp").alias("top")).where("ref < top").drop("top")
        info = made.stored(info.join(mixed, "path"), "mixed")
        small = info.where(F.col("size") <= LIMIT).join(_sketches(sizes), "uid")
        small = small.repartition(width, "path").sortWithinPartitions("path")
        found.append(made.stored(small.mapInArrow(B.tidy(_small_nodes), "a long, b long"), "found"))
        large = info.where(F.col("size") > LIMIT)
        if large.isEmpty():
            break
        if level == LEVELS:
            found.append(_large_nodes(large.join(_sketches(sizes), "uid")))
        else:
            nodes = _nodes(large.select("path", "uid").join(sizes, "uid").mapInArrow(B.tidy(_next_level), "path long, uid long, tree int"), width, made, f"level{level + 1}")
    more = found[0]
    for f in found[1:]:
        more = more.union(f)
    more = made.stored(more.distinct().join(tried, ["a", "b"], "left_anti"), "proposed")
    B.freed(spark)
    comp = components(links.union(confirmed(more, reps, src, files)))
    B.freed(spark)
    degree = degrees(comp, reps, src, files, width)

    joined = reps.select("digest", "uid", "id", "class_size").join(comp, "uid", "left").join(degree, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    win = joined.where("n_links is not null").groupBy("root").agg(F.min(F.struct("id", "uid")).alias("w"))
    joined = joined.join(win, "root", "left").select("digest", "class_size", F.coalesce("w.id", "id").alias("component"), F.coalesce("w.uid", "uid").alias("winner"), F.col("id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    joined = B.stored(joined, "joined")
    made.drop()
    known = lambda c: F.when(F.col(c) != _LAST, F.col(c))
    place = ["doc_id", F.col("n").alias("n_shingles"), "grp", "blk", "row"]
    full = feats.where("n > 0").drop("sig").join(joined, "digest").select(*place, known("component").alias("component_id"), (F.col("uid") == F.col("winner")).alias("kept"), known("class_id").alias("class_id"), "class_size", "n_links")
    bare = feats.where("n = 0").select(*place, F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"))
    return full.unionByName(bare)


def _nodes(rows: DataFrame, width: int, made: B.Scratch, name: str) -> DataFrame:
    """Rows of nodes that hold more than one class, stored; a class comes once in a node."""
    rows = rows.repartition(width, "path").sortWithinPartitions("path", "uid")
    return made.stored(rows.mapInArrow(B.tidy(_shared), "path long, uid long, tree int"), name)


def _sketches(sizes: DataFrame) -> DataFrame:
    """One byte of each coordinate."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                low = np.ascontiguousarray(_sig(b).astype(np.uint8))
                yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("n"), pa.array([r.tobytes() for r in low], pa.binary())], names=["uid", "n", "sketch"])

    return sizes.mapInArrow(step, "uid long, n long, sketch binary")


def _agreeing(pairs: DataFrame, sizes: DataFrame, least: int) -> DataFrame:
    s = _sketches(sizes)
    a = s.select(F.col("uid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = s.select(F.col("uid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    j = pairs.join(a, "a").join(b, "b").where("100 * least(na, nb) >= 70 * greatest(na, nb)")
    return j.select("a", "b", "sa", "sb").mapInArrow(_agree(least), "a long, b long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, one of each component, with all their columns."""
    src = B.block_source(docs)
    gone = near_groups(src, id_col, text_col).where("not kept").select("grp", "blk", "row")
    _, n = B.with_blocks(src, F.col(id_col))
    return B.keep_rows(src, B.deliver(gone, n, "gone"))


SQL = r"""
with w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
s as (
  select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end)) as sh
  from w),
n as (select doc_id, count(*) as n, md5(string_agg(sh, chr(31) order by sh)) as k from s group by doc_id),
rare as (select sh from s group by sh having count(*) > 1),
i as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from s a join rare using (sh) join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
l as (
  select a, b from i join n x on a = x.doc_id join n y on b = y.doc_id where 100 * c >= 70 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
g as (select e.a, count(distinct y.k) as n_links from e join n x on e.a = x.doc_id join n y on e.b = y.doc_id and x.k <> y.k group by 1),
r as (
  with recursive t(d, m) as (select doc_id, doc_id from n union select t.d, e.b from t join e on t.m = e.a)
  select d, min(m) as m from t group by d),
c as (select doc_id, min(doc_id) over (partition by k) as class_id, count(*) over (partition by k) as class_size from n)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(r.m, d.doc_id) as component_id, coalesce(r.m, d.doc_id) = d.doc_id as kept,
  coalesce(c.class_id, d.doc_id) as class_id, coalesce(c.class_size, 1) as class_size, coalesce(g.n_links, 0) as n_links
from documents d left join n on d.doc_id = n.doc_id left join r on d.doc_id = r.d left join c on d.doc_id = c.doc_id left join g on d.doc_id = g.a
"""


def op7_near_dedup(spark, sf_dir):
    """Every document with its component of linked documents, its class of equal sets, and the links of that class."""
    found = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_shingles", "component_id", "kept", "class_id", "class_size", "n_links")


QUERIES = {"op7_near_dedup": op7_near_dedup}
ORACLE = {"op7_near_dedup": SQL}
