"""Byte-level BPE ids of whole texts, and offset-mapped attribution of tokens to sections.

A document is encoded once.  Token lengths in bytes give spans; each token is allocated to a section by an explicit
rule: ``start`` (the section of its first byte), ``largest`` (most bytes, the earlier on ties) or ``split`` (in
proportion to bytes).  Sections are character spans, sorted and apart; what lies between them is section -1.

Defined cases: a null text is empty and has the one empty section 0; sections that overlap or leave the text raise;
the strings of special tokens are ordinary text here; a very long text is encoded whole; equal bytes of two sections in
one token (a tie of ``largest``) go to the earlier one; a null id is carried; repeated rows each get their rows; an empty
table gives no rows; other columns of the table, whatever their names, are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

RULES = ("start", "largest", "split")


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of a public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(2)
def encoder(path: str):
    """The encoder, and each id's length in bytes."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    size[list(ranks.values())] = [len(k) for k in ranks]
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), size


def _ids(enc, text: str, special: dict[str, int]) -> list[int]:
    """Ids of a text; the strings of ``special`` have their own id and part what is around them."""
    for name, own in special.items():
        if name in text:
            rest = {k: v for k, v in special.items() if k != name}
            parts = [_ids(enc, part, rest) for part in text.split(name)]
            return [x for k, p in enumerate(parts) for x in ([own, *p] if k else p)]
    return enc.encode_ordinary(text)


def encode(b: pa.RecordBatch, path: str, step: int = 64, special: dict[str, int] | None = None) -> Iterator[tuple[int, list[np.ndarray], list[bytes]]]:
    """(first row, ids of each text, the texts' bytes), a few texts at a time."""
    enc, _ = encoder(path)
    col = b.column("text")
    for i in range(0, b.num_rows, step):
        texts = [t or "" for t in col.slice(i, step).to_pylist()]
        yield i, [np.array(_ids(enc, t, special or {}), np.uint32) for t in texts], [t.encode() for t in texts]


def lines(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of lines, each with its line feed; one empty line of an empty text."""
    cut = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    at = np.concatenate([[0], cut])
    if len(at) > 1 and at[-1] == len(raw):
        at = at[:-1]
    return at, np.append(at[1:], len(raw))


_KINDS = {b"#": "heading", b"-": "list", b"*": "list", b"|": "table", b"": "blank"}


def kind(line: bytes) -> str:
    """heading, list, table, blank or text, by a line's first character or its separators."""
    line = line.strip()
    return _KINDS.get(line[:1]) or ("table" if line.count(b" | ") > 1 else "text")


def allocate(size: np.ndarray, first: np.ndarray, end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Tokens of each section, how many of its tokens cross its edges, and tokens of no section.

    ``size``: bytes of each token in order; ``first``, ``end``: byte spans of sections, sorted and apart.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    n = len(first)
    stop = np.cumsum(size)
    if (first[1:] < end[:-1]).any() or (end < first).any() or (n and (first[0] < 0 or end[-1] > (stop[-1] if len(stop) else 0))):
        raise ValueError("sections overlap or leave the text")
    start = stop - size
    edge = np.empty(2 * n, np.int64)
    edge[::2], edge[1::2] = first, end
    a = np.searchsorted(edge, start, "right") - 1
    z = np.searchsorted(edge, stop, "left") - 1
    got, cross = np.zeros(n + 1), np.zeros(n + 1, np.int64)
    slot = lambda g: np.where((g >= 0) & (g % 2 == 0), g // 2, n)
    whole = z <= a
    np.add.at(got, slot(a[whole]), 1.0)
    for t in np.flatnonzero(~whole).tolist():
        gaps = np.arange(a[t], z[t] + 1)
        lo = np.where(gaps >= 0, edge[np.maximum(gaps, 0)], 0) if n else np.zeros(1, np.int64)
        hi = np.append(edge[gaps[1:]], stop[t])
        part = np.minimum(hi, stop[t]) - np.maximum(lo, start[t])
        at = slot(gaps)
        np.add.at(cross, np.unique(at[part > 0]), 1)
        if rule == "split":
            np.add.at(got, at, part / size[t])
        else:
            got[at[0 if rule == "start" and part[0] > 0 else int(np.argmax(part > 0)) if rule == "start" else int(np.argmax(part))]] += 1
    return got[:n], cross[:n], float(got[n])


OUT = "doc_id long, section long, kind string, first long, end long, tokens double, crossing long, doc_tokens long"
_OUT = pa.schema([("doc_id", pa.int64()), ("section", pa.int64()), ("kind", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("tokens", pa.float64()), ("crossing", pa.int64()), ("doc_tokens", pa.int64())])


def section_tokens(docs: DataFrame, rule: str = "largest", vocab: str | None = None, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None) -> DataFrame:
    """Tokens of each section of each document.

    ``sections_col`` is an array of structs (kind, first, end) in characters; without it the sections are lines.
    """
    path = vocab or vocabulary()
    cols = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")]
    if sections_col:
        cols.append(F.col(sections_col).alias("sections"))

    def one(ids: np.ndarray, raw: bytes, given: list | None, size: np.ndarray) -> tuple:
        body = np.frombuffer(raw, np.uint8)
        char = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])
        if given is None:
            f, e = lines(raw)
            kinds = [kind(raw[x:y]) for x, y in zip(f.tolist(), e.tolist())]
            cf, ce = char[f], char[e]
        else:
            cf, ce = np.array([g["first"] for g in given], np.int64), np.array([g["end"] for g in given], np.int64)
            if len(cf) and (cf.min() < 0 or ce.max() > char[-1]):
                raise ValueError("sections overlap or leave the text")
            byte = np.append(np.flatnonzero((body & 0xC0) != 0x80), len(raw))
            f, e, kinds = byte[cf], byte[ce], [g["kind"] for g in given]
        got, cross, rest = allocate(size[ids], f, e, rule)
        no = list(range(len(f)))
        if given is not None and rest:
            no, kinds, cf, ce, got, cross = [*no, -1], [*kinds, None], np.append(cf, 0), np.append(ce, char[-1]), np.append(got, rest), np.append(cross, 0)
        return no, kinds, cf, ce, got, cross

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, size = encoder(path)
        for b in batches:
            doc = b.column("doc_id").to_pylist()
            given = b.column("sections").to_pylist() if sections_col else [None] * b.num_rows
            for i, ids, raws in encode(b, path):
                parts = [one(x, r, g if not sections_col else g or [], size) for x, r, g in zip(ids, raws, given[i:])]
                n = [len(p[0]) for p in parts]
                cols = [np.concatenate([p[k] for p in parts]) for k in (2, 3, 4, 5)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([d for d, k in zip(doc[i:], n) for _ in range(k)], pa.int64()), pa.array([x for p in parts for x in p[0]], pa.int64()), pa.array([x for p in parts for x in p[1]], pa.string()),
                    pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int64)), pa.array(cols[2]), pa.array(cols[3].astype(np.int64)), pa.array(np.repeat([len(x) for x in ids], n).astype(np.int64)),
                ], schema=_OUT)

    return docs.select(*cols).mapInArrow(B.tidy(step), OUT)


def op4_section_tokens(spark, sf_dir):
    """Tokens of every line of every document."""
    return section_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_section_tokens": op4_section_tokens}
ORACLE: dict[str, str] = {}
