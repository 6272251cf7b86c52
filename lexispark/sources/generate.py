"""Synthetic lexicons of any size: each entry follows from its number and a seed, so tasks make them alone."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from . import nodes as N

_PARTS = "ba ka ta lo mi ne su ri po da gu fe".split()
_KINDS = "Noun Verb Adjective Adverb".split()


def entry(n: int, seed: int = 0) -> N.Node:
    """About a kilobyte of entry: senses, subsenses, examples, relations, traits, media."""
    r = random.Random(seed * 1_000_003 + n)
    word = lambda k=3: "".join(r.choice(_PARTS) for _ in range(k))

    def text(host: N.Node, lang: str, words: int, tag: str = "form") -> None:
        host.set_form(lang, " ".join(word() for _ in range(words)), tag)

    e = N.Node("entry", "entry")
    e.attrs |= {"id": f"{word()}_{n}", "guid": f"{n:08x}-{r.getrandbits(32):08x}"}
    text(e.add(N.Node("lexical-unit", "multitext")), "qaa", 1)
    if n % 5 == 0:
        p = e.add(N.Node("pronunciation", "pronunciation"))
        p.add(N.Node("media", "urlref")).attrs["href"] = f"{n}.wav"
    for k in range(1 + n % 3):
        s = e.add(N.Node("sense", "sense"))
        s.attrs |= {"id": f"s{n}.{k}", "order": k}
        s.add(N.Node("grammatical-info", "grammatical-info")).attrs["value"] = r.choice(_KINDS)
        for lang in ("en", "fr"):
            text(s, lang, 2, "gloss")
        text(s.add(N.Node("definition", "multitext")), "en", 8)
        text(s.add(N.Node("example", "example")), "qaa", 6)
        if n % 7 == 0:
            sub = s.add(N.Node("subsense", "sense"))
            sub.attrs["id"] = f"s{n}.{k}a"
            text(sub, "en", 2, "gloss")
    if n:
        rel = e.add(N.Node("relation", "relation"))
        rel.attrs |= {"type": "see", "ref": f"s{r.randrange(n)}.0"}
    t = e.add(N.Node("trait", "trait"))
    t.attrs |= {"name": "status", "value": r.choice(("draft", "done"))}
    return e


def entries(spark: SparkSession, n: int, seed: int = 0, parts: int | None = None) -> DataFrame:
    """(entry_pos, raw) of ``n`` entries, in order of partitions."""

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"entry_pos": f["id"], "raw": [N.canonical(entry(int(i), seed)).encode() for i in f["id"]]})

    return spark.range(0, n, 1, parts).mapInPandas(step, "entry_pos long, raw binary")
