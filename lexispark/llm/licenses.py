"""License scans by ordered signature rules.

Rules (``license_rules.RULES``) are tried in order on the words of a text, and only those whose keyword the text
contains.  A match begins and ends with whole words.  A detection that lies within one of higher priority (an earlier
rule) or within a longer one of the same label is suppressed; both by sweeps over sorted ends, so that a text with
many detections takes n log n steps.  Listed identifiers of SPDX tags come before all rules, with the licence's own label, at
priority -1; of another identifier only ``spdx`` is known.  A ``+`` is no word, so ``GPL-2.0+`` is gpl-2.0.  Places of three base phrases are counted on the words and always kept.

Defined cases: a null or empty text has no words, no places, empty labels and score 0; a very long text is scanned
whole; a null id is carried; repeated rows and ties each get their row; an empty table gives no rows; other columns of
the table, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .license_rules import RULES, SPDX

_WORD = np.ones(256, bool)
_WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
PHRASES = ((b"mit license", "mit"), (b"apache license", "apache"), (b"general public license", "gpl"))


@lru_cache(1)
def rules() -> list[tuple[str, str, re.Pattern]]:
    """(label, keyword, pattern over words joined by one space), in order of priority."""
    out = []
    for line in RULES.strip().splitlines():
        label, key, pattern = (x.strip() for x in line.split(" | "))
        out.append((label, key.replace("_", " "), re.compile("(?<![^ ])(?:" + pattern.replace("_?", " ?").replace("_", " ").replace("[^.]", ".") + ")(?![^ ])")))
    return out


@lru_cache(1)
def _prefilter() -> ahocorasick.Automaton:
    """Keywords, each with the rules that it gates."""
    by: dict[str, list[int]] = {}
    for k, (_, key, _) in enumerate(rules()):
        by.setdefault(key, []).append(k)
    found = ahocorasick.Automaton()
    for key, ks in by.items():
        found.add_word(key, tuple(ks))
    found.make_automaton()
    return found


_TAG = "spdx license identifier "
_NEXT = re.compile(r"(?: with (?:[a-z0-9]+ ){0,6}?exception(?: [0-9]+)*)? (?:or|and) ")


@lru_cache(1)
def _identifiers() -> tuple[dict[str, str], re.Pattern]:
    """Labels by the words of SPDX identifiers, and a pattern for the longest of these."""
    none = {"spdx", "all-rights-reserved", "proprietary", "copyright-notice"}
    every = {re.sub("[^a-z0-9]+", " ", x): x for x in [*SPDX.lower().split(), *(label for label, _, _ in rules())] if x not in none}
    return every, re.compile("(?:" + "|".join(sorted(every, key=len, reverse=True)) + ")(?![^ ])")


def spdx(words: str) -> list[tuple[int, int, str, int]]:
    """Detections of the licences that SPDX tags name."""
    out, at = [], words.find(_TAG)
    while at >= 0:
        labels, pattern = _identifiers()
        end = at + len(_TAG)
        while m := pattern.match(words, end):
            out.append((*m.span(), labels[m[0]], -1))
            more = _NEXT.match(words, m.end())
            end = more.end() if more else len(words)
        at = words.find(_TAG, at + 1)
    return out


class _Cover:
    """Intervals; asks whether one of them contains another.  Keeps those with the largest end up to each start."""

    def __init__(self):
        self.first, self.end = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def holds(self, a: np.ndarray, e: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.first, a, "right") - 1
        return (k >= 0) & (self.end[np.maximum(k, 0)] >= e) if len(self.first) else np.zeros(len(a), bool)

    def add(self, a: np.ndarray, e: np.ndarray) -> None:
        a, e = np.concatenate([self.first, a]), np.concatenate([self.end, e])
        o = np.lexsort((-e, a))
        a, e = a[o], e[o]
        top = np.concatenate([[-1], np.maximum.accumulate(e)[:-1]])
        self.first, self.end = a[e > top], e[e > top]


def detect(words: str) -> list[tuple[int, int, str, int]]:
    """Detections (first, end, label, rule) in words joined by single spaces, after suppression."""
    every, found = rules(), list(dict.fromkeys(spdx(words)))
    keys = sorted({k for _, ks in _prefilter().iter(words) for k in ks})
    if not keys and not found:
        return []
    cover = _Cover()
    if found:
        cover.add(np.array([f[0] for f in found]), np.array([f[1] for f in found]))
    for k in keys:
        label, _, pattern = every[k]
        at = np.array([m.span() for m in pattern.finditer(words)], np.int64).reshape(-1, 2)
        new = at[~cover.holds(at[:, 0], at[:, 1])] if len(at) else at
        if len(new):
            cover.add(new[:, 0], new[:, 1])
            found += [(a, e, label, k) for a, e in new.tolist()]
    return sorted(f for f, longer in zip(found, _within_longer(found), strict=True) if not longer)


def _within_longer(found: list[tuple[int, int, str, int]]) -> list[bool]:
    """Of each detection, whether a longer one of its label contains it."""
    out, label, top, last = [False] * len(found), None, -1, None
    for i in sorted(range(len(found)), key=lambda i: (found[i][2], found[i][0], -found[i][1])):
        a, e, tag, _ = found[i]
        if tag != label:
            label, top, last = tag, -1, None
        if (a, e) == last:  # the same span again: as long, not longer
            out[i] = held
            continue
        held = out[i] = top >= e
        top, last = max(top, e), (a, e)
    return out


SPANS = "doc_id long, label string, priority int, first_word long, last_word long, match string"
DIGEST = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_SPANS = pa.schema([("doc_id", pa.int64()), ("label", pa.string()), ("priority", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("match", pa.string())])
_DIGEST = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_words", "n_base", "first_word", "last_word")] + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def _joined(b: pa.RecordBatch) -> Iterator[tuple[int | None, int, bytes]]:
    """(id, number of words, words joined by one space) of each text."""
    data, off = B.text_bytes(b.column("text"))
    ids = b.column("doc_id").to_pylist()
    for i, _, d, o in B.chunks(data, off):
        low = B.lower_ascii(d)
        word = _WORD[low]
        s, e, w = B.runs(word, o)
        keep = word.copy()
        last = e < np.repeat(o[1:], np.diff(w)) if len(s) else np.zeros(0, bool)
        keep[e[last]] = True
        at = np.zeros(len(low) + 1, np.int64)
        np.cumsum(keep, out=at[1:])
        raw, cut = np.where(word, low, np.uint8(32))[keep].tobytes(), at[o].tolist()
        for k, n in enumerate(np.diff(w).tolist()):
            yield ids[i + k], n, raw[cut[k] : cut[k + 1]].rstrip(b" ")


def base_places(words: bytes) -> list[tuple[int, str]]:
    """(word number, label) of every place of a base phrase."""
    if b"license" not in words:
        return []
    padded, out = b" " + words + b" ", []
    for phrase, label in PHRASES:
        want = b" " + phrase + b" "
        at, n, done = padded.find(want), 0, 0
        while at >= 0:
            n, done = n + padded.count(b" ", done, at), at
            out.append((n, label))
            at = padded.find(want, at + 1)
    return sorted(out)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for i, n, words in _joined(b):
            base, more = base_places(words), detect(words.decode("utf-8", "replace"))
            tags = {t for _, t in base}
            labels = tags | {t for _, _, t, _ in more}
            covered = sum(e - a for a, e, _, _ in more)
            score = 1.0 if base else min(1.0, 0.5 + covered / 200) if more else 0.0
            out.append((i, n, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(tags)), ",".join(sorted(labels)), score))
        yield B.rows(_DIGEST, out)


def _span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for i, _, raw in _joined(b):
            words = raw.decode("utf-8", "replace")
            gaps = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32) if len(words) == len(raw) else np.array([j for j, c in enumerate(words) if c == " "])
            out += [(i, label, k, int(np.searchsorted(gaps, a)), int(np.searchsorted(gaps, e)), words[a:e]) for a, e, label, k in detect(words)]
        yield B.rows(_SPANS, out)


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per detection, in words."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(B.tidy(_span_rows), SPANS)


def op10_license_scan(spark, sf_dir):
    """Base places and labels of each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", "text").mapInArrow(B.tidy(_digest), DIGEST)


QUERIES = {"op10_license_scan": op10_license_scan}
ORACLE: dict[str, str] = {}
