"""Exact dedup by a Golomb-coded fingerprint exchange.

Each block sends the sorted 64-bit fingerprints of its normalised texts, Golomb-Rice coded, to the owners of
their ranges.  An owner returns a bitmap to each block: which fingerprints another block has too.  Only texts
with a set bit, or met twice in their own block, are suspects; those are combined within their block, then
shuffled by SHA-256 and compared byte by byte.  All others are unique and never leave their split.

Defined cases: a null text counts as empty; a very long text is compared whole; a null id is larger than every id; of
rows that repeat both id and text (a tie), one stays; an empty table gives no rows; other columns of the table, whatever
their names, are kept by ``exact_dedup`` and not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

_REQ = pa.schema([("owner", pa.int32()), ("grp", pa.int32()), ("blk", pa.string()), ("run", pa.int32()), ("keys", pa.binary())])
_REP = pa.schema([("grp", pa.int32()), ("blk", pa.string()), ("run", pa.int32()), ("owner", pa.int32()), ("n", pa.int64()), ("bits", pa.binary())])
_ROW = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.string()), ("grp", pa.int32()), ("blk", pa.string()), ("row", pa.int64()), ("key", pa.string()), ("head", pa.bool_()), ("n", pa.int64()), ("body", pa.binary())])
_RES = pa.schema([("key", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("wins", pa.bool_())])
REQ, REP = "owner int, grp int, blk string, run int, keys binary", "grp int, blk string, run int, owner int, n long, bits binary"
ROW = "doc_id long, text_sha256 string, grp int, blk string, row long, key string, head boolean, n long, body binary"
RES = "key string, keep_id long, group_size long, wins boolean"


def _digests(b: pa.RecordBatch) -> tuple[list[bytes], list[bytes], np.ndarray]:
    """Normalised texts, their SHA-256, and the first 64 bits of that as fingerprints."""
    data, off = B.text_bytes(b.column("text"))
    texts: list[bytes] = []
    for _, _, d, o in B.chunks(data, off, 1 << 20):
        q, at = B.squeeze(d, o)
        raw, at = q.tobytes(), at.tolist()
        texts += [raw[i:j] for i, j in zip(at, at[1:])]
    sha = [hashlib.sha256(t).digest() for t in texts]
    return texts, sha, np.frombuffer(b"".join(s[:8] for s in sha), ">u8").astype(np.uint64)


def _request(n: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blk, grp, run, _, b in B.sub_blocks(batches):
            keys = np.unique(_digests(b)[2])
            yield B.rows(_REQ, [(o, grp, blk, run, B.rice_encode(keys[i:j])) for o, i, j in B.owner_slices(keys, n)])

    return step


def _answer(t: pa.Table) -> pa.Table:
    """Of one owner: for each block, which of its fingerprints some other block sent too."""
    keys = [B.rice_decode(x) for x in t.column("keys").to_pylist()]
    every = np.sort(np.concatenate(keys))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    out = []
    for (g, k, r, o), a in zip(zip(*(t.column(c).to_pylist() for c in ("grp", "blk", "run", "owner"))), keys, strict=True):
        bits = np.isin(a, twice, assume_unique=True)
        if bits.any():
            out.append((g, k, r, o, len(a), np.packbits(bits).tobytes()))
    return pa.Table.from_batches([B.rows(_REP, out)])


def _local(n: int, path: str):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sent = None, {}
        for blk, grp, run, row, b in B.sub_blocks(batches):
            if blk != now:
                now, sent, t = blk, {}, B.delivered(path, grp, blk)
                for r, o, m, bits in zip(*(t.column(c).to_pylist() for c in ("run", "owner", "n", "bits"))) if t is not None else ():
                    sent[r, o] = np.unpackbits(np.frombuffer(bits, np.uint8), count=m).astype(bool)
            texts, sha, keys = _digests(b)
            own, back, count = np.unique(keys, return_inverse=True, return_counts=True)
            hit = count > 1
            for o, i, j in B.owner_slices(own, n):
                if (run, o) in sent:
                    hit[i:j] |= sent[run, o]
            ids, suspect = b.column("doc_id").to_pylist(), hit[back]
            groups: dict[bytes, list[int]] = {}
            for i in np.flatnonzero(suspect).tolist():
                groups.setdefault(texts[i], []).append(i)
            extra: dict[int, tuple] = {}
            for g, members in enumerate(groups.values()):
                first = min(members, key=lambda i: (ids[i] is None, ids[i] or 0, i))
                for i in members:
                    extra[i] = (f"{blk}#{run}#{g}", i == first, len(members), texts[i] if i == first else None)
            one = (None, True, 1, None)
            yield B.rows(_ROW, [(ids[i], sha[i].hex(), grp, blk, row + i, *extra.get(i, one)) for i in range(b.num_rows)])

    return step


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Heads sorted by digest, bytes and id: runs of equal bytes are groups.  Holds one text, and a key for each block."""
    now, body, keep, size, keys = None, None, None, 0, []

    def out() -> pa.RecordBatch:
        return B.rows(_RES, [(k, keep, size, i == 0) for i, k in enumerate(keys)])

    for b in batches:
        for sha, text, i, key, n in zip(*(b.column(c).to_pylist() for c in ("text_sha256", "body", "doc_id", "key", "n"))):
            if sha != now or text != body:
                if keys:
                    yield out()
                now, body, keep, size, keys = sha, text, i, 0, []
            size += n
            keys.append(key)
    if keys:
        yield out()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and the row's place (grp, blk, row).

    ``docs`` must be a block source (see ``blocks.block_source``) if the place is to be used.
    """
    spark = docs.sparkSession
    src, n = B.with_blocks(B.block_source(docs), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    m = B.owners(docs)
    asked = src.mapInArrow(B.tidy(_request(m)), REQ)
    path = B.deliver(asked.groupBy("owner").applyInArrow(_answer, REP), n, "bitmaps")
    local = B.stored(src.mapInArrow(B.tidy(_local(m, path)), ROW), "digests")
    B.remove(spark, path)
    heads = local.where("key is not null and head").select("text_sha256", "body", "doc_id", "key", "n")
    heads = heads.repartition(m, "text_sha256").sortWithinPartitions("text_sha256", "body", F.col("doc_id").asc_nulls_last(), "key")
    settled = heads.mapInArrow(B.tidy(_settle), RES)
    place = ["doc_id", "text_sha256", "grp", "blk", "row"]
    alone = local.where("key is null").select(*place, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    shared = local.where("key is not null").select(*place, "key", "head").join(settled, "key").select(*place, "keep_id", "group_size", (F.col("head") & F.col("wins")).alias("kept"))
    return alone.unionByName(shared)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    src = B.block_source(docs)
    gone = exact_groups(src, id_col, text_col).where("not kept").select("grp", "blk", "row")
    _, n = B.with_blocks(src, F.col(id_col))
    return B.keep_rows(src, B.deliver(gone, n, "gone"))


SQL = r"""
with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = min(doc_id) over g as kept, text_sha256
from t window g as (partition by text_sha256)
"""


def op2_exact_dedup(spark, sf_dir):
    """Every document with its group of equal texts."""
    found = exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {"op2_exact_dedup": op2_exact_dedup}
ORACLE = {"op2_exact_dedup": SQL}
