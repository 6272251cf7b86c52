"""Text blocks: numpy views of Arrow text columns, and exchanges addressed to input blocks.

A *block* is a run of rows of one input split.  A first scan numbers the rows of each block and sends small
coded requests to owners; the owners' replies are written to the shared folder, grouped so that the task that
scans a split again reads one file.  So whole texts stay where they are read and only codes are shuffled.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import WRITE, shared_dir, stored

__all__ = ["shared_dir", "stored"]
U64 = np.uint64
_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C15 | 1
_IP = pow(_P, -1, 1 << 64)
CHUNK = 1 << 19


# --- shared folder

def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def freed(spark: SparkSession) -> None:
    """Let go of the shuffle files of plans that nothing refers to any more: their results are stored, so no later read needs them.

    Spark's cleaner removes them once the driver's collectors have met the dead plans.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Tables in the shared folder that one operator makes on its way; ``drop`` removes them once nothing reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_dir(self.spark, name)
        df.write.options(**WRITE).parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def deliver(self, replies: DataFrame, n: int, name: str) -> str:
        self.paths.append(deliver(replies, n, name))
        return self.paths[-1]

    def drop(self) -> None:
        for p in self.paths:
            remove(self.spark, p)
        self.paths = []


SHARE, MOST = 16 << 20, 1 << 17  # bytes of input that an owner answers for; most owners


def owners(df: DataFrame) -> int:
    """Owners of a key range: one for each ``SHARE`` bytes that the plan reads, the session's shuffle width at least.

    Beyond ``MOST`` owners each has more to do; where the plan's size is not known the session's width holds.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    share = size // SHARE if size < 1 << 60 else 0
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST, share))


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (AttributeError, OSError):
        pass


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f`` as a task's step that gives freed memory back to the system when it ends: workers live on between stages."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            _trim()

    return step


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def at_owners(asked: DataFrame, m: int, f: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``f`` over all requests to each of ``m`` owners; a partition is an owner, so no two meet in one task."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from f(pa.Table.from_batches(held)).to_batches()
        held.clear()
        _trim()

    return asked.repartitionById(m, "owner").mapInArrow(step, schema)


# --- rows in blocks

def _scan_only(df: DataFrame) -> bool:
    """Only projections over one file relation: input_file_name() then holds in the scanning task."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    nodes = [re.sub(r"^[\s:+\-*]*", "", x).split(" ")[0] for x in lines]
    return bool(nodes) and nodes[-1].startswith("Relation") and all(x in ("Project", "Filter") for x in nodes[:-1])


def block_source(df: DataFrame) -> DataFrame:
    """``df`` itself if its rows can be addressed by input split, else a stored copy that can be."""
    return df if _scan_only(df) else stored(df, "source")


def with_blocks(df: DataFrame, *columns) -> tuple[DataFrame, int]:
    """``columns`` and, as the last two, the split and its reply file; the number of reply files.

    Sets ``spark.sql.files.minPartitionNum`` of the session where it is unset, so that every scan cuts the same splits.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        # else splits follow the number of executors, and a loss between two scans would move the blocks
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    n = max(1, df.rdd.getNumPartitions())
    blk = F.concat_ws("#", F.input_file_name(), F.input_file_block_start().cast("string"))
    out = df.select(*columns)
    a, b = unused(out, "__blk", "__grp")
    return df.select(*columns, blk.alias(a), F.pmod(F.xxhash64(blk), F.lit(n)).cast("int").alias(b)), n


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Batches cut where the split changes: (blk, grp, rows)."""
    for b in batches:
        if not b.num_rows:
            continue
        split, file = b.column(b.num_columns - 2), b.column(b.num_columns - 1)
        code = split.dictionary_encode()
        ix = code.indices.to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(np.diff(ix)) + 1
        for i, j in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows], strict=True):
            yield split[i].as_py(), file[i].as_py(), b.slice(i, j - i)


def deliver(replies: DataFrame, n: int, name: str) -> str:
    """Write rows with ``grp`` to the shared folder, one folder and file for each reply group."""
    path = shared_dir(replies.sparkSession, name)
    replies.repartitionById(n, "grp").write.options(**WRITE).partitionBy("grp").parquet(path)
    return path


def delivered(path: str, grp: int, blk: str) -> pa.Table | None:
    """In a task: the rows that were delivered to ``blk``."""
    import pyarrow.fs as pfs

    fs, root = pfs.FileSystem.from_uri(path)
    files = fs.get_file_info(pfs.FileSelector(f"{root}/grp={grp}", allow_not_found=True))
    tables = [_read(fs, f.path, blk) for f in files if f.path.endswith(".parquet")]
    tables = [t for t in tables if t.num_rows]
    return pa.concat_tables(tables) if tables else None


def _read(fs, path: str, blk: str) -> pa.Table:
    import pyarrow.parquet as pq

    with fs.open_input_file(path) as f:
        t = pq.ParquetFile(f).read()
    return t.filter(pc.equal(t.column("blk"), blk))


# --- texts as bytes

def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the offsets of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    big = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, o, d = col.buffers()
    off = np.frombuffer(o, np.int64 if big else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(d, np.uint8) if d is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(data: np.ndarray, off: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes: (first, end, bytes, offsets)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def runs(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that cross no text boundary: starts, ends, and each text's range of runs."""
    n = len(mask)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    edge = off[(off > 0) & (off < n)]
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    first[edge] = mask[edge]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    last[edge - 1] = mask[edge - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, off)


@functools.lru_cache(4)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    a, b = np.full(n, _P, U64), np.full(n, _IP, U64)
    a[0] = b[0] = 1
    return np.multiply.accumulate(a), np.multiply.accumulate(b)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


class SpanHash:
    """64-bit hashes of byte spans of one text buffer, from prefix sums of a polynomial mod 2**64."""

    def __init__(self, data: np.ndarray):
        p, self.q = _powers(max(20, int(len(data)).bit_length()))
        self.acc = np.zeros(len(data) + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * p[: len(data)], out=self.acc[1:])

    def __call__(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix((self.acc[e] - self.acc[s]) * self.q[s])


def span_hash(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return SpanHash(data)(s, e) if len(s) else np.zeros(0, U64)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words between ASCII white space, and each text's range of words."""
    low = _LOWER[data]
    s, e, w = runs(~_WS[data], off)
    return span_hash(low, s, e), w


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def squeeze(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run of ASCII white space as one space."""
    ws = _WS[data]
    keep = ~ws
    s, _, _ = runs(ws, off)
    keep[s] = True
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    out = np.where(ws, np.uint8(32), data)[keep]
    return out, total[off]


# --- codes

_C = zstandard.ZstdCompressor(level=1)


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays in their least width, compressed."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        if a.dtype.kind in "ui" and len(a):
            top = int(a.max())
            a = a.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 1 << 32 else np.uint64)
        out.append(a)
    head = ",".join(f"{a.dtype.str}:{len(a)}" for a in out).encode()
    return len(head).to_bytes(4, "little") + head + _C.compress(b"".join(a.tobytes() for a in out))


def unpack(b: bytes) -> list[np.ndarray]:
    n = int.from_bytes(b[:4], "little")
    raw, at, out = zstandard.ZstdDecompressor().decompress(b[4 + n :]), 0, []
    for part in b[4 : 4 + n].decode().split(","):
        kind, _, size = part.rpartition(":")
        a = np.frombuffer(raw, kind, int(size), at)
        at += a.nbytes
        out.append(a)
    return out


def rice_encode(keys: np.ndarray, k: int | None = None) -> bytes:
    """Sorted unsigned 64-bit keys as Golomb-Rice coded gaps: header (k, n), unary quotients, k-bit remainders."""
    n = len(keys)
    if not n:
        return b"\0" * 9
    gap = np.diff(keys, prepend=U64(0))
    if k is None:
        mean = max(1, int(keys[-1]) // n)
        k = max(0, min(63, mean.bit_length() - 1))
    q, r = (gap >> U64(k)).astype(np.int64), gap & U64((1 << k) - 1)
    ends = np.cumsum(q + 1) - 1
    unary = np.ones(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 0
    full, rest = divmod(k, 8)
    low = np.ascontiguousarray(r).view(np.uint8).reshape(n, 8)
    parts = [np.ascontiguousarray(low[:, :full]).tobytes()]
    if rest:
        top = low[:, full]
        bits = (top[:, None] >> np.arange(rest, dtype=np.uint8)) & 1
        parts.append(np.packbits(bits.ravel()).tobytes())
    u = np.packbits(unary).tobytes()
    return bytes([k]) + n.to_bytes(8, "little") + len(unary).to_bytes(8, "little") + u + b"".join(parts)


def rice_decode(b: bytes) -> np.ndarray:
    k, n = b[0], int.from_bytes(b[1:9], "little")
    if not n:
        return np.zeros(0, U64)
    m = int.from_bytes(b[9:17], "little")
    nb = (m + 7) // 8
    unary = np.unpackbits(np.frombuffer(b, np.uint8, nb, 17), count=m)
    ends = np.flatnonzero(unary == 0)
    q = np.diff(ends, prepend=-1) - 1
    full, rest = divmod(k, 8)
    at = 17 + nb
    low = np.zeros((n, 8), np.uint8)
    if full:
        low[:, :full] = np.frombuffer(b, np.uint8, n * full, at).reshape(n, full)
    if rest:
        bits = np.unpackbits(np.frombuffer(b, np.uint8, (n * rest + 7) // 8, at + n * full), count=n * rest).reshape(n, rest)
        low[:, full] = (bits << np.arange(rest, dtype=np.uint8)).sum(1).astype(np.uint8)
    r = low.reshape(-1).view(U64)
    return np.cumsum((q.astype(U64) << U64(k)) | r, dtype=U64)


def owner_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Equal ranges of the key space; sorted keys have sorted owners."""
    return ((keys >> U64(32)) * U64(n)) >> U64(32)


def owner_slices(keys: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
    """Of sorted keys: (owner, first, end) for each owner that has some."""
    o = owner_of(keys, n).astype(np.int64)
    at = np.searchsorted(o, np.arange(n + 1))
    for k in np.flatnonzero(np.diff(at)):
        yield int(k), int(at[k]), int(at[k + 1])


def crc_text(ids: np.ndarray) -> np.ndarray:
    """crc32 of each id written as text."""
    return np.fromiter((zlib.crc32(str(i).encode()) for i in ids.tolist()), np.int64, len(ids))


def rows(schema: pa.Schema, data: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*data, strict=True)) if data else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def keep_rows(df: DataFrame, path: str) -> DataFrame:
    """Rows of a block source, whole, but for those whose (grp, blk, row) was delivered to ``path``.  No text is shuffled."""
    names, schema = df.columns, df.schema
    src, _ = with_blocks(df, *[F.col(f"`{c}`") for c in names])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, gone = None, 0, np.zeros(0, np.int64)
        for blk, grp, b in by_block(batches):
            if blk != now:
                now, at, t = blk, 0, delivered(path, grp, blk)
                gone = t.column("row").to_numpy() if t is not None else np.zeros(0, np.int64)
            keep = ~np.isin(np.arange(at, at + b.num_rows), gone)
            at += b.num_rows
            b = b.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(names))], names=names)

    return src.mapInArrow(tidy(step), schema)


def placed(src: DataFrame, columns: str) -> DataFrame:
    """The columns of ``with_blocks`` with each row's place: (*columns, grp, blk, row)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, 0
        for blk, grp, b in by_block(batches):
            if blk != now:
                now, at = blk, 0
            n = b.num_rows
            own = [b.column(i) for i in range(b.num_columns - 2)]
            names = [b.schema.names[i] for i in range(len(own))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(n, grp, np.int32)), pa.array([blk] * n), pa.array(np.arange(at, at + n))], names=[*names, "grp", "blk", "row"])
            at += n

    return src.mapInArrow(step, f"{columns}, grp int, blk string, row long")


def sub_blocks(batches: Iterator[pa.RecordBatch], limit: int = 8 << 20) -> Iterator[tuple[str, int, int, int, pa.RecordBatch]]:
    """Each split's rows in runs of about ``limit`` bytes of ``text``, the same in every scan: (blk, grp, run, first row, rows)."""
    held: list[pa.RecordBatch] = []
    now, size, count, run, row = ("", 0), 0, 0, 0, 0

    def out() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for blk, grp, b in by_block(batches):
        if (blk, grp) != now:
            if held:
                yield *now, run, row, out()
            held, now, size, count, run, row = [], (blk, grp), 0, 0, 0, 0
        _, off = text_bytes(b.column("text"))
        i, n = 0, b.num_rows
        while i < n:
            j = max(i, int(np.searchsorted(off, off[i] + limit - size, "right")) - 1)
            if j == i and not count:
                j = i + 1
            if j > i:
                held.append(b.slice(i, j - i))
                size, count = size + int(off[j] - off[i]), count + j - i
            i = j
            if i < n:
                yield *now, run, row, out()
                held, size, count, run, row = [], 0, 0, run + 1, row + count
    if held:
        yield *now, run, row, out()
