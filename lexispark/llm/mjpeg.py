"""AVI motion-JPEG: bytes in lossless intra frames, RIFF indexes, shots from histogram differences.

A frame is a lossless JPEG (process 14, SOF3): one 8-bit component, 64 samples a row, predictor 1.  The Huffman
table has one code of each length 1 to 9, for difference categories 8 down to 0, so code and extra bits of any
sample take nine bits together and whole frames are coded and decoded with array operations.  ``clip_rows`` also reads
files of other writers: the luma of baseline frames (see ``jpeg_frames``); other JPEG processes are refused by name.

Frames lie in a ``movi`` list and are found through ``idx1``.  A shot begins where the histogram difference of
two neighbouring frames is above ``mean + k * deviation`` of the preceding differences within the shot, and
above a floor.

Defined cases: a null text is stored as an empty one, 64 zero bytes; a very long text is stored whole, in as many
frames as it needs; equal payloads give equal files; a null id is carried; repeated rows are stored each; an empty table
gives no rows; other columns of the table, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import jpeg_frames

WIDTH, HEIGHT, FPS = 64, 64, 25
_BITS = bytes([1] * 9 + [0] * 7)
_VALS = bytes(range(8, -1, -1))
_DHT = b"\xff\xc4" + struct.pack(">HB", 19 + 9, 0) + _BITS + _VALS


def _nine_bit_codes() -> tuple[np.ndarray, np.ndarray]:
    """Code of each difference -255..255 (at +255), and the difference of each nine-bit code."""
    enc, dec = np.zeros(511, np.uint16), np.zeros(512, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        prefix = ((1 << (8 - s)) - 1) << 1 if s else 0b111111110
        extra = d if d >= 0 else d + (1 << s) - 1
        code = (prefix << s | extra) if s else prefix
        enc[d + 255] = code
        dec[code] = d
    return enc, dec


_ENC, _DEC = _nine_bit_codes()


def _differences(rows: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Predictor 1 over frames stacked in ``rows``; ``start`` marks each frame's first row."""
    x = rows.astype(np.int16)
    d = np.empty_like(x)
    d[:, 1:] = x[:, 1:] - x[:, :-1]
    d[1:, 0] = x[1:, 0] - x[:-1, 0]
    d[start, 0] = x[start, 0] - 128
    return d


def _to_bits(d: np.ndarray) -> np.ndarray:
    """Nine bits a sample; eight samples are nine bytes."""
    c = _ENC[d.reshape(-1, 8).astype(np.int32) + 255]
    out = np.empty((len(c), 9), np.uint8)
    out[:, 0] = c[:, 0] >> 1
    for j in range(1, 9):
        low = c[:, j] >> (j + 1) if j < 8 else 0
        out[:, j] = (((c[:, j - 1] & ((1 << j) - 1)) << (8 - j)) | low) & 255
    return out.reshape(len(d), WIDTH // 8 * 9)


def _from_bits(b: np.ndarray) -> np.ndarray:
    w = b.reshape(-1, 9).astype(np.uint16)
    c = np.empty((len(w), 8), np.uint16)
    for j in range(8):
        c[:, j] = ((w[:, j] & ((1 << (8 - j)) - 1)) << (j + 1)) | (w[:, j + 1] >> (7 - j))
    return _DEC[c].reshape(-1, WIDTH)


def _frame(scan: bytes, rows: int) -> bytes:
    sof = b"\xff\xc3" + struct.pack(">HBHHB", 11, 8, rows, WIDTH, 1) + b"\x01\x11\x00"
    sos = b"\xff\xda" + struct.pack(">HB", 8, 1) + b"\x01\x00\x01\x00\x00"
    return b"\xff\xd8" + sof + _DHT + sos + scan + b"\xff\xd9"


def _chunk(tag: bytes, body: bytes) -> bytes:
    return tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi_file(frames: list[bytes], fps: int = FPS) -> bytes:
    """A RIFF AVI with one MJPG stream and an idx1 index."""
    top = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, top * fps, 0, 0x10, len(frames), 0, 1, top, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, len(frames), top, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", WIDTH * HEIGHT, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    parts, index, at = [], [], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        parts.append(c)
        at += len(c)
    movi = _chunk(b"LIST", b"movi" + b"".join(parts))
    return _chunk(b"RIFF", b"AVI " + hdrl + movi + _chunk(b"idx1", b"".join(index)))


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """AVI files of payloads whose lengths are multiples of 64; all frames are coded together."""
    rows = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, WIDTH)
    counts = np.array([len(p) // WIDTH for p in payloads])
    ends = np.cumsum(counts)
    first = [np.arange(e - c, e, HEIGHT) for c, e in zip(counts, ends, strict=True)]
    starts = np.concatenate(first) if first else np.zeros(0, np.int64)
    bits = _to_bits(_differences(rows, starts))
    flat = bits.reshape(-1)
    ff = np.cumsum(flat == 255)
    size = bits.shape[1]
    stuffed = np.zeros(len(flat) + int(ff[-1]), np.uint8)
    to = np.arange(len(flat))
    to[1:] += ff[:-1]
    stuffed[to] = flat
    edge = lambda r: r * size + (ff[r * size - 1] if r else 0)
    raw, out = stuffed.tobytes(), []
    for f, e in zip(first, ends.tolist(), strict=True):
        cuts = [*f.tolist(), e]
        out.append(avi_file([_frame(raw[int(edge(i)) : int(edge(j))], j - i) for i, j in zip(cuts, cuts[1:])]))
    return out


def riff_frames(avi: bytes) -> tuple[list[tuple[int, int]], float]:
    """(offset, length) of every frame, by idx1, and seconds a frame."""
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, index, seconds = 12, 0, b"", 1 / FPS
    while at + 8 <= len(avi):
        tag, size = avi[at : at + 4], struct.unpack_from("<I", avi, at + 4)[0]
        kind = avi[at + 8 : at + 12]
        if tag == b"LIST" and kind == b"movi":
            movi = at + 8
        elif tag == b"LIST" and kind == b"hdrl":
            seconds = struct.unpack_from("<I", avi, at + 20)[0] / 1e6
        elif tag == b"idx1":
            index = avi[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    rows = [(tag, o, n) for tag, _, o, n in struct.iter_unpack("<4sIII", index) if tag[2:] in (b"dc", b"db") and n]
    base = 0 if rows and avi[rows[0][1] : rows[0][1] + 4] == rows[0][0] else movi  # some writers count from the file's start
    return [(base + o + 8, n) for _, o, n in rows], seconds


def _scan_of(avi: bytes, at: int, n: int) -> tuple[int, int, int]:
    """Of a lossless JPEG frame: first and end of its entropy-coded bytes, and its rows."""
    end, rows, known = at + n, 0, False
    if avi[at : at + 2] != b"\xff\xd8" or avi[end - 2 : end] != b"\xff\xd9":
        raise ValueError("not a JPEG frame")
    at += 2
    while True:
        tag, size = avi[at + 1], struct.unpack_from(">H", avi, at + 2)[0]
        if tag == 0xC3:
            bits, rows, width, comps = struct.unpack_from(">BHHB", avi, at + 4)
            if (bits, width, comps) != (8, WIDTH, 1):
                raise ValueError("unsupported frame layout")
        elif tag == 0xC4:
            known = avi[at + 5 : at + 2 + size] == _BITS + _VALS
        elif tag == 0xDA:
            if not known or avi[at + 7] != 1:
                raise ValueError("unsupported Huffman table or predictor")
            return at + 2 + size, end - 2, rows
        elif 0xC0 <= tag <= 0xCF and tag != 0xC8:
            raise ValueError("unsupported JPEG process")
        at += 2 + size


def decode_many(files: list[bytes]) -> list[tuple[np.ndarray, list[int], float]]:
    """Of each AVI: its samples (rows x 64), the rows of each frame, and seconds a frame."""
    parts, shape = [], []
    for f in files:
        frames, seconds = riff_frames(f)
        spans = [_scan_of(f, *x) for x in frames]
        parts += [f[a:b] for a, b, _ in spans]
        shape.append(([r for _, _, r in spans], seconds))
    flat = np.frombuffer(b"".join(parts), np.uint8)
    stuff = np.zeros(len(flat), bool)
    stuff[1:] = flat[:-1] == 255
    d = _from_bits(flat[~stuff].reshape(-1, 9))
    heights = np.array([r for rs, _ in shape for r in rs])
    ends = np.cumsum(heights)
    starts = ends - heights
    if int(ends[-1] if len(ends) else 0) != len(d):
        raise ValueError("frame heights do not match their data")
    d = d.astype(np.int32)
    lead = d[:, 0].copy()
    total = np.cumsum(lead)
    base = np.repeat(total[starts] - lead[starts], heights)
    d[:, 0] = total - base + 128
    x = np.cumsum(d, 1).astype(np.uint8)
    out, at = [], 0
    for rs, seconds in shape:
        n = sum(rs)
        out.append((x[at : at + n], rs, seconds))
        at += n
    return out


def decode_any(files: list[bytes]) -> list[tuple[np.ndarray, list[int], float]]:
    """The same for files of any writer: those of this module's layout together, others by the luma of their baseline frames."""
    out: list = [None] * len(files)
    own = []
    for i, f in enumerate(files):
        frames, seconds = riff_frames(f)
        try:
            for x in frames:
                _scan_of(f, *x)
            own.append(i)
        except (ValueError, IndexError, struct.error):
            luma = [jpeg_frames.luma(f[a : a + n]) for a, n in frames]
            if len({x.shape[1] for x in luma}) > 1:
                raise ValueError("frames of several widths") from None
            out[i] = np.concatenate(luma), [len(x) for x in luma], seconds
    for i, x in zip(own, decode_many([files[i] for i in own]) if own else [], strict=True):
        out[i] = x
    return out


def shots(x: np.ndarray, heights: list[int], k: float = 3.0, floor: float = 0.25) -> list[tuple[int, int]]:
    """(first, end) frames of each shot."""
    n = len(heights)
    if n < 2:
        return [(0, n)] if n else []
    frame = np.repeat(np.arange(n), heights)
    hist = np.bincount((frame[:, None] * 32 + (x >> 3)).ravel(), minlength=n * 32).reshape(n, 32)
    hist = hist / hist.sum(1, keepdims=True)
    diff = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    out, first, count, total, square = [], 0, 0, 0.0, 0.0
    for i, v in enumerate(diff.tolist(), 1):
        mean = total / count if count else 0.0
        spread = max(0.0, square / count - mean * mean) ** 0.5 if count else 0.0
        if v > max(floor, mean + k * spread):
            out.append((first, i))
            first, count, total, square = i, 0, 0.0, 0.0
        else:
            count, total, square = count + 1, total + v, square + v * v
    return [*out, (first, n)]


def payload(text: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of 64."""
    return text + b"\0" * (-len(text) % 64 or (0 if text else 64))


MEDIA = "doc_id long, n_bytes long, avi binary"
CLIPS = "doc_id long, clip int, first_frame int, end_frame int, start_s double, end_s double, mean_level double"
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("avi", pa.binary())])
_CLIPS = pa.schema([("doc_id", pa.int64()), ("clip", pa.int32()), ("first_frame", pa.int32()), ("end_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("mean_level", pa.float64())])
_DIGEST = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_bytes", "payload_bytes")] + [("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _stored(b: pa.RecordBatch) -> Iterator[tuple[list, list[int], list[bytes]]]:
    data, off = B.text_bytes(b.column("text"))
    ids = b.column("doc_id").to_pylist()
    for i, j, d, o in B.chunks(data, off):
        raw, at = d.tobytes(), o.tolist()
        texts = [raw[p:q] for p, q in zip(at, at[1:])]
        yield ids[i:j], [len(t) for t in texts], encode_many([payload(t) for t in texts])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in _stored(b):
            yield B.rows(_MEDIA, list(zip(*part, strict=True)))


def _clips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, files = b.column("doc_id").to_pylist(), b.column("avi").to_pylist()
        for i in range(0, len(files), 64):
            out = []
            for doc, (x, heights, sec) in zip(ids[i : i + 64], decode_any(files[i : i + 64]), strict=True):
                at = np.concatenate([[0], np.cumsum(heights)])
                out += [(doc, k, a, e, a * sec, e * sec, float(x[at[a] : at[e]].mean())) for k, (a, e) in enumerate(shots(x, heights))]
            yield B.rows(_CLIPS, out)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for ids, sizes, files in _stored(b):
            out = []
            for doc, n, f, (x, heights, _) in zip(ids, sizes, files, decode_many(files), strict=True):
                p, cut = x.tobytes(), shots(x, heights)
                feature = f"frames={len(heights)};level={x.mean():.4f};shots=" + ",".join(f"{a}-{e}" for a, e in cut)
                out.append((doc, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(f), hashlib.sha256(f).hexdigest(), feature))
            yield B.rows(_DIGEST, out)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and an AVI file for each document."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(B.tidy(_encode), MEDIA)


def clip_rows(media: DataFrame) -> DataFrame:
    """Timed clips of a table with doc_id and avi."""
    return media.select("doc_id", "avi").mapInArrow(B.tidy(_clips), CLIPS)


def op6_avi_mjpeg(spark, sf_dir):
    """Every text stored in motion-JPEG, read back and described."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", "text").mapInArrow(B.tidy(_digest), DIGEST)


QUERIES = {"op6_avi_mjpeg": op6_avi_mjpeg}
ORACLE: dict[str, str] = {}
