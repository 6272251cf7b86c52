"""Related-document packing: a nearest-neighbour graph, greedy paths, windows filled along each path.

One scan encodes every text, and stores the ids with a minwise sketch of the text's words.  Of all documents that
are equal in a sketch coordinate, each keeps the ``NEAR`` that agree with it in most (see ``search``).
Labels spread along the graph put related documents into one shard; a label that fills more than a shard is split
(``edges_cut`` measures what is cut).
In a shard, a path starts at an unvisited document of least degree and goes on to the nearest unvisited neighbour
until there is none.  Documents are laid end to end along the paths and cut at every ``WINDOW`` ids, so a shard
has one window that is not full.  Only numbers are shuffled; ids stay in the stored table, to whose rows the pieces
are delivered.

Defined cases: a null or empty text is its end id alone; a very long text is cut into as many pieces as it needs; a null
id is carried; repeated rows are packed each; neighbours that agree as much are told apart by a hash; an empty table gives
no rows; other columns of the table, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .tokens import encode, vocabulary

WINDOW, EOS, NEAR, SHARD, SMALL = 2048, 1, 4, 20_000, 48
SPECIAL = {"<|endoftext|>": 50256}  # of the default vocabulary
_MUL = np.random.default_rng(77).integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IDS = pa.schema([("doc_id", pa.int64()), ("uid", pa.int64()), ("grp", pa.int32()), ("blk", pa.string()), ("row", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("ids", pa.binary())])
IDS = "doc_id long, uid long, grp int, blk string, row long, n long, sketch binary, ids binary"
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
DIGEST = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _sketches(raws: list[bytes]) -> np.ndarray:
    """Eight minwise values of each text's words."""
    off = np.concatenate([[0], np.cumsum([len(r) for r in raws])])
    h, w = B.word_hashes(np.frombuffer(b"".join(raws), np.uint8), off)
    out = np.full((len(raws), 8), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(w))
    if len(full):
        for j in range(8):
            out[full, j] = np.minimum.reduceat(h * _MUL[j], w[full]) >> np.uint64(32)
    return out


def _encode(path: str, eos: int, special: dict[str, int]):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, 0
        for blk, grp, b in B.by_block(batches):
            if blk != now:
                now, at = blk, 0
            doc, uid = b.column("doc_id").to_pylist(), b.column("uid").to_pylist()
            for i, ids, raws in encode(b, path, special=special):
                s = _sketches(raws)
                full = [np.append(x, np.uint32(eos)) for x in ids]
                yield B.rows(_IDS, [(doc[i + k], uid[i + k], grp, blk, at + i + k, len(x), s[k].tobytes(), (x.astype(np.uint16) if x.max() < 65536 else x).tobytes()) for k, x in enumerate(full)])
            at += b.num_rows

    return step


def _coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            s = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint32).reshape(-1, 8)
            for j in range(8):
                yield pa.RecordBatch.from_arrays([pa.array((s[:, j].astype(np.int64) << 3) + j), b.column("uid"), b.column("sketch")], names=["value", "uid", "sketch"])


def _ranks(s: np.ndarray, u: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Agreement of rows (i, j) above 24 bits of a hash of the pair, which spreads ties; -1 for a row with itself."""
    score = np.zeros(np.broadcast_shapes(i.shape, j.shape), np.int32)
    for k in range(8):
        score += s[i, k] == s[j, k]
    tie = (u[i] ^ u[j]).astype(np.uint64) * _MUL[0] >> np.uint64(40)
    return np.where(u[i] == u[j], -1, (score << 24) | tie.astype(np.int32))


def _top(u: np.ndarray, v: np.ndarray, rank: np.ndarray, near: int) -> tuple[np.ndarray, ...]:
    """The ``near`` best different v of each u."""
    o = np.lexsort((v, -rank, u))
    u, v, rank = u[o], v[o], rank[o]
    new = np.ones(len(u), bool)
    new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1]) | (rank[1:] != rank[:-1])
    u, v, rank = u[new], v[new], rank[new]
    at = np.arange(len(u)) - np.searchsorted(u, u)
    return u[at < near], v[at < near], rank[at < near]


def search(value: np.ndarray, u: np.ndarray, s: np.ndarray, near: int = NEAR) -> tuple[np.ndarray, ...]:
    """(u, v, rank): the best of all that share a value.

    Groups of at most ``SMALL`` are compared whole; larger ones branch on each later coordinate.  A pair that agrees
    on the coordinates T is compared on the way to the group of T, or that group is large, and then its members
    have ``near`` others there that agree on T.  So no neighbour with a higher agreement than those kept is missed.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
    row, key, last = np.arange(len(u)), value.view(np.uint64), value & 7
    while len(row):
        o = np.lexsort((u[row], key))
        row, key, last = row[o], key[o], last[o]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        for k in np.unique(size[(size > 1) & (size <= SMALL)]).tolist():
            groups = first[size == k]
            for x in range(0, len(groups), max(1, 250_000 // (k * k))):
                r = row[groups[x : x + max(1, 250_000 // (k * k)), None] + np.arange(k)]
                rank = _ranks(s, u, r[:, :, None], r[:, None, :])
                n = min(near, k - 1)
                best = np.argpartition(-rank, n - 1, axis=2)[:, :, :n]
                got = np.take_along_axis(rank, best, 2)
                mine, other = np.repeat(u[r], n, axis=1).ravel(), u[np.take_along_axis(np.broadcast_to(r[:, None, :], rank.shape), best, 2)].ravel()
                ok = got.ravel() >= 0
                found.append((mine[ok], other[ok], got.ravel()[ok]))
        big = np.repeat(size > SMALL, size)
        row, key, last, group = row[big], key[big], last[big], np.repeat(first, size)[big]
        for k in range(1, near + 1):
            i = np.flatnonzero(group[k:] == group[:-k])
            x, y = row[i], row[i + k]
            rank = _ranks(s, u, x, y)
            ok = rank >= 0
            found += [(u[x][ok], u[y][ok], rank[ok]), (u[y][ok], u[x][ok], rank[ok])]
        found = [_top(*(np.concatenate(c) for c in zip(*found, strict=True)), near)]
        rows, keys, lasts = [], [], []
        for k in range(1, 8):
            on = np.flatnonzero(last < k)
            rows.append(row[on])
            keys.append(B.mix(key[on] * np.uint64(0x9E3779B97F4A7C15) + (s[row[on], k].astype(np.uint64) << np.uint64(3)) + np.uint64(k)))
            lasts.append(np.full(len(on), k))
        row, key, last = np.concatenate(rows), np.concatenate(keys), np.concatenate(lasts)
    return found[0]


SLAB = 200_000


def _nearest(near: int):
    """Rows sorted by value and sketch; the best of each uid among those that share a value.

    A task holds ``SLAB`` rows, cut where the value changes.  A value that more rows share is taken in slabs: rows with equal
    sketches lie together there, and those that agree on another coordinate meet in its value too.
    """

    def best(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        s = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint32).reshape(-1, 8)
        u, v, rank = search(t.column("value").to_numpy(), t.column("uid").to_numpy(), s, near)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(rank.astype(np.int32)), pa.array(v)], names=["u", "rank", "v"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.num_rows
            if size >= SLAB:
                t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                value = t.column("value").to_numpy()
                cut = int(np.searchsorted(value, value[-1]))
                yield best([t.slice(0, cut)] if cut else [t])
                held = [t.slice(cut)] if cut else [t.slice(max(0, size - 4 * near))]
                size = held[0].num_rows
        if held:
            yield best(held)

    return step


def neighbours(sketches: DataFrame, width: int, near: int = NEAR) -> DataFrame:
    """(u, [(score, v)]): the neighbours of each document that has some, with the highest agreements there are."""
    rows = sketches.select("uid", "sketch").mapInArrow(_coordinates, "value long, uid long, sketch binary").repartition(width, "value").sortWithinPartitions("value", "sketch")
    edges = rows.mapInArrow(B.tidy(_nearest(near)), "u long, rank int, v long")
    best = F.slice(F.sort_array(F.collect_set(F.struct("rank", "v")), asc=False), 1, near)
    return edges.groupBy("u").agg(F.transform(best, lambda x: F.struct(F.shiftright(x.rank, 24).alias("score"), x.v.alias("v"))).alias("near"))


def shards(size: DataFrame, graph: DataFrame, shard: int = SHARD) -> DataFrame:
    """uid, n, near, shard: labels spread twice along the graph, packed into shards of bounded size."""
    many = max(1, -(-size.count() // shard))
    if many == 1:
        return size.join(graph.withColumnRenamed("u", "uid"), "uid", "left").select("uid", "grp", "blk", "row", "n", "near", F.lit(0).cast("long").alias("shard"))
    edge = graph.select(F.col("u").alias("uid"), F.explode("near.v").alias("v"))
    label = graph.select(F.col("u").alias("uid"), F.xxhash64("u").alias("label"))
    for _ in range(2):
        far = edge.join(label.withColumnRenamed("uid", "v"), "v").groupBy("uid").agg(F.min("label").alias("far"))
        label = label.join(far, "uid").select("uid", F.least("label", "far").alias("label"))
    full = size.join(graph.withColumnRenamed("u", "uid"), "uid", "left").join(label, "uid", "left").withColumn("label", F.coalesce("label", F.xxhash64("uid")))
    full = B.stored(full, "labelled")
    big = full.groupBy("label").agg(F.count("*").alias("c")).where(F.col("c") > shard // 4).withColumn("parts", F.ceil(F.col("c") / (shard // 4)))
    full = full.join(big.select("label", "parts"), "label", "left")
    salt = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("uid"), F.col("parts"))).otherwise(F.lit(0))
    return full.select("uid", "grp", "blk", "row", "n", "near", F.pmod(F.xxhash64("label", salt), F.lit(many)).cast("long").alias("shard"))


def edges_cut(placed: DataFrame) -> float:
    """The share of the graph's edges whose ends are in two shards."""
    at = placed.select("uid", "shard")
    e = placed.select(F.col("shard").alias("own"), F.explode("near.v").alias("uid")).join(at, "uid")
    return e.agg(F.avg((F.col("own") != F.col("shard")).cast("double"))).first()[0] or 0.0


def walk(near: list[list[int]]) -> list[int]:
    """Order of nodes: least degree first, then on to the nearest unvisited neighbour."""
    seen, out = [False] * len(near), []
    heap = [(len(x), i) for i, x in enumerate(near)]
    heapq.heapify(heap)
    while heap:
        _, i = heapq.heappop(heap)
        while i is not None and not seen[i]:
            seen[i] = True
            out.append(i)
            i = next((j for j in near[i] if not seen[j]), None)
    return out


_LAID = pa.schema([("grp", pa.int32()), ("blk", pa.string()), ("row", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
LAID = "grp int, blk string, row long, start long, length long, sequence_id long, offset long"


def _lay(window: int):
    def step(t: pa.Table) -> pa.Table:
        t = t.sort_by([("uid", "ascending")])
        uid = t.column("uid").to_pylist()
        at = {u: i for i, u in enumerate(uid)}
        near: list[list[int]] = [[] for _ in uid]
        for i, ns in enumerate(t.column("near").to_pylist()):
            near[i] = [at[x["v"]] for x in ns or () if x["v"] in at]
        order = np.array(walk(near), np.int64)
        n = t.column("n").to_numpy()[order]
        end = np.cumsum(n)
        begin = end - n
        k = (end - 1) // window - begin // window + 1
        who = np.repeat(np.arange(len(n)), k)
        seq = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + np.repeat(begin // window, k)
        lo, hi = np.maximum(begin[who], seq * window), np.minimum(end[who], (seq + 1) * window)
        place = t.select(["grp", "blk", "row"]).take(pa.array(order[who]))
        shard = t.column("shard")[0].as_py()
        cols = [lo - begin[who], hi - lo, (shard << 32) + seq, lo - seq * window]
        return pa.Table.from_arrays([*[place.column(c) for c in range(3)], *[pa.array(c) for c in cols]], schema=_LAID)

    return step


def _cut(path: str, digest: bool):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces = None, {}
        for b in batches:
            col = {c: b.column(c).to_pylist() for c in ("grp", "blk", "row", "doc_id", "n")}
            ids, out = b.column("ids"), []
            for r in range(b.num_rows):
                if col["blk"][r] != now:
                    now, pieces = col["blk"][r], {}
                    t = B.delivered(path, col["grp"][r], now)
                    for row, *p in zip(*(t.column(c).to_pylist() for c in ("row", "start", "length", "sequence_id", "offset"))) if t is not None else ():
                        pieces.setdefault(row, []).append(p)
                raw, n = ids[r].as_py(), col["n"][r]
                x = np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32).astype("<u4")
                for s, k, q, o in sorted(pieces[col["row"][r]]):
                    own = x[s : s + k].tobytes()
                    out.append((col["doc_id"][r], s, k, zlib.crc32(own), n, q, o) if digest else (col["doc_id"][r], s, k, n, q, o, own))
            names = DIGEST if digest else PIECES
            schema = pa.schema([(f.split()[0], pa.binary() if f.endswith("binary") else pa.int64()) for f in names.split(", ")])
            yield B.rows(schema, out)

    return step


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None, eos: int = EOS, window: int = WINDOW, digest: bool = False, special: dict[str, int] | None = None) -> DataFrame:
    """One row per piece, with its ids as little-endian 32-bit integers, or with their crc32 if ``digest``.

    ``vocab``: ranks of a byte-level vocabulary, the default being the ranks of ``byte_bpe_50k.json``; ``special``: its special tokens.
    """
    special = (SPECIAL if vocab is None else {}) if special is None else special
    width = B.owners(docs)
    src, files = B.with_blocks(B.block_source(docs), F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), F.col(text_col).alias("text"))
    ids = B.stored(src.mapInArrow(B.tidy(_encode(vocab or vocabulary(), eos, special)), IDS), "ids")
    size = ids.select("uid", "grp", "blk", "row", "n")
    graph = B.stored(neighbours(ids.select("uid", "sketch"), width), "graph")
    laid = shards(size, graph).groupBy("shard").applyInArrow(_lay(window), LAID)
    path = B.deliver(laid, files, "pieces")
    return ids.select("doc_id", "grp", "blk", "row", "n", "ids").mapInArrow(B.tidy(_cut(path, digest)), DIGEST if digest else PIECES)


def op8_packing(spark, sf_dir):
    """Every piece of every document."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)


QUERIES = {"op8_packing": op8_packing}
ORACLE: dict[str, str] = {}
