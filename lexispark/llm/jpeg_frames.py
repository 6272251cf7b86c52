"""Luma of baseline JPEG frames, as cameras and editors put them into motion-JPEG files.

Sequential DCT frames of 8 bits (SOF0, SOF1) with any Huffman and quantisation tables, sampling factors and restart
intervals; files that leave the Huffman tables out, as AVI allows, get the standard ones.  Other processes are refused.
"""

from __future__ import annotations

import struct

import numpy as np

ZIGZAG = np.array([0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])
_K = np.arange(8)
DCT = np.sqrt(np.where(_K[:, None] == 0, 1, 2) / 8) * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16)


def _standard() -> dict[tuple[int, int], tuple[list[int], list[int]]]:
    hexes = lambda s: list(bytes.fromhex(s))
    lum = hexes("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa")
    chroma = hexes("0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa".replace(" ", ""))
    return {
        (0, 0): ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12))), (1, 0): ([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125], lum),
        (0, 1): ([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0], list(range(12))), (1, 1): ([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119], chroma),
    }


STANDARD = _standard()


def codes(bits: list[int], values: list[int]) -> list[tuple[int, int, int]]:
    """(code, length, value) of a table."""
    out, code, at = [], 0, 0
    for length, n in enumerate(bits, 1):
        for v in values[at : at + n]:
            out.append((code, length, v))
            code += 1
        at += n
        code <<= 1
    return out


def _lookup(bits: list[int], values: list[int]) -> list[int]:
    """By the next 16 bits: length of the code times 256, and its value; 0 where there is none."""
    table = [0] * 65536
    for code, length, v in codes(bits, values):
        a = code << (16 - length)
        table[a : a + (1 << (16 - length))] = [length << 8 | v] * (1 << (16 - length))
    return table


class _Bits:
    def __init__(self, scan: bytes):
        self.n = 8 * len(scan)
        self.value, self.at = int.from_bytes(scan + b"\xff" * 4, "big"), 0
        self.size = self.n + 32

    def peek(self, k: int) -> int:
        return self.value >> (self.size - self.at - k) & ((1 << k) - 1)


def luma(jpeg: bytes) -> np.ndarray:
    """Rows of the first component of a baseline frame."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, quant, tables, parts, every = 2, {}, {k: _lookup(*v) for k, v in STANDARD.items()}, [], 0
    height = width = 0
    while True:
        if at + 4 > len(jpeg) or jpeg[at] != 0xFF:
            raise ValueError("not a JPEG frame")
        tag, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        if tag == 0xFF:
            at += 1
            continue
        body = jpeg[at + 4 : at + 2 + size]
        if tag in (0xC0, 0xC1):
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError("unsupported sample size")
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif tag == 0xC4:
            p = 0
            while p < len(body):
                n = sum(body[p + 1 : p + 17])
                tables[body[p] >> 4, body[p] & 15] = _lookup(list(body[p + 1 : p + 17]), list(body[p + 17 : p + 17 + n]))
                p += 17 + n
        elif tag == 0xDB:
            p = 0
            while p < len(body):
                wide = body[p] >> 4
                q = np.frombuffer(body, ">u2" if wide else np.uint8, 64, p + 1).astype(np.float64)
                quant[body[p] & 15] = q
                p += 65 + 64 * wide
        elif tag == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif tag == 0xDA:
            use = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
            return _scan(jpeg[at + 2 + size :], height, width, parts, use, quant, tables, every)
        elif 0xC0 <= tag <= 0xCF and tag != 0xC8:
            raise ValueError("unsupported JPEG process")
        at += 2 + size


def _scan(data: bytes, height: int, width: int, parts: list, use: dict, quant: dict, tables: dict, every: int) -> np.ndarray:
    if len(use) != len(parts):
        raise ValueError("unsupported scan of some components")
    if len(parts) == 1:
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    hs, vs = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-width // (8 * hs)), -(-height // (8 * vs))
    own_h, own_v = parts[0][1], parts[0][2]
    out = np.zeros((down * own_v, across * own_h, 64))
    pieces = _restarts(data)
    bits, last = _Bits(pieces[0]), [0] * len(parts)
    for m in range(across * down):
        if every and m and m % every == 0:
            if m // every >= len(pieces):
                break
            bits, last = _Bits(pieces[m // every]), [0] * len(parts)
        for i, (c, h, v, _) in enumerate(parts):
            dc, ac = tables[0, use[c][0]], tables[1, use[c][1]]
            for y in range(v):
                for x in range(h):
                    block = _block(bits, dc, ac)
                    last[i] += block[0][1]
                    if i == 0:
                        at = out[m // across * v + y, m % across * h + x]
                        at[0] = last[i]
                        for k, value in block[1:]:
                            at[k] = value
    if (hs, vs) != (own_h, own_v):
        raise ValueError("unsupported sampling of luma")
    coef = np.zeros_like(out)
    coef[..., ZIGZAG] = out * quant[parts[0][3]]
    x = np.einsum("ki,yxkl,lj->yixj", DCT, coef.reshape(*out.shape[:2], 8, 8), DCT).reshape(out.shape[0] * 8, out.shape[1] * 8)
    return np.clip(np.round(x + 128), 0, 255).astype(np.uint8)[:height, :width]


def _restarts(data: bytes) -> list[bytes]:
    """Entropy-coded bytes without stuffing, cut at restart marks, to the end of the image."""
    out, start, at = [], 0, 0
    while True:
        at = data.find(b"\xff", at)
        tag = data[at + 1] if 0 <= at < len(data) - 1 else 0xD9
        if tag == 0:
            at += 2
            continue
        end = at if at >= 0 else len(data)
        out.append(data[start:end].replace(b"\xff\x00", b"\xff"))
        if not 0xD0 <= tag <= 0xD7:
            return out
        start = at = end + 2


def _block(bits: _Bits, dc: list[int], ac: list[int]) -> list[tuple[int, int]]:
    """(place, value) of a block's coefficients, the first its difference."""
    out, k = [], 0
    while k < 64:
        got = (ac if k else dc)[bits.peek(16)]
        if not got or bits.at > bits.n:
            raise ValueError("broken JPEG data")
        bits.at += got >> 8
        run, size = (got & 255) >> 4, got & 15
        if k and not size:
            if run < 15:
                break
            k += 16
            continue
        k += run if k else 0
        raw = bits.peek(size) if size else 0
        bits.at += size
        if k > 63:
            raise ValueError("broken JPEG data")
        out.append((k, raw if not size or raw >> (size - 1) else raw - (1 << size) + 1))
        k += 1
    return out
