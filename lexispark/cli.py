"""Command line: validate, stats, sort, check-media, export.  Exit 0, 1 on findings, 2 on errors."""

from __future__ import annotations

import argparse
import csv
import json
import sys
import tempfile
from collections import Counter
from pathlib import Path

from .operators import report
from .operators.lexicon import Lexicon, canonicalize
from .operators.validate import findings, problems
from .session import session, shared_dir
from .sources.lift_source import local_file
from .sources.nodes import LiftError


_FORMATS = ["text", "json"]
NOTE = "sounds that are named " + "in the text of forms " + "are not followed here"


def _counts(*parts: tuple[int, str]) -> str:
    return ", ".join(f"{n} {what}" for n, what in parts)


def _validate(spark, a) -> int:
    if a.path == "-":
        base = local_file(shared_dir(spark, "stdin"))
        base.mkdir(parents=True)
        with tempfile.TemporaryDirectory(dir=base) as d:
            p = Path(d) / "stdin.lift"
            p.write_bytes(sys.stdin.buffer.read())
            lex = Lexicon.read(spark, p, resolve_ranges=False)
            lex.path = None
            return _findings(findings(problems(lex, a.require_ids)), a)
    return _findings(findings(problems(Lexicon.read(spark, a.path), a.require_ids), not a.no_check_media), a)


def _findings(found, a) -> int:
    """Print findings as they come, then their counts."""
    counts = Counter()
    if a.format == "json":
        found = list(found)
        counts.update(f.level for f in found)
    else:
        for f in found:
            counts[f.level] += 1
            print(f)
    errors, warnings = counts["error"], counts["warning"]
    if a.format == "json":
        total = {"errors": errors, "warnings": warnings}
        print(json.dumps({"problems": [vars(f) for f in found], "summary": total}, indent=2))
    else:
        print(_counts((errors, "error(s)"), (warnings, "warning(s)")) + ("  (strict: warnings treated as errors)" if a.strict and warnings else ""))
    return int(bool(errors or (a.strict and warnings)))


def _stats(spark, a) -> int:
    s = report.stats(Lexicon.read(spark, a.path, resolve_ranges=False))
    if a.format == "json":
        print(json.dumps({k: getattr(s, k) for k in ("entries", "senses", "examples", "media_refs", "languages", "traits")}, indent=2))
        return 0
    for name, v in (("entries:   ", s.entries), ("senses:    ", s.senses), ("examples:  ", s.examples), ("media refs: ", s.media_refs), ("languages: ", ", ".join(s.languages) or "(none)")):
        print(f"{name}{v}")
    if s.top:
        print("top traits: " + ", ".join(f"{n} ({c})" for n, c in s.top))
    return 0


def _sort(spark, a) -> int:
    target = a.output or a.path
    canonicalize(spark, a.path, target)
    print("wrote", target)
    return 0


def _check_media(spark, a) -> int:
    lex = Lexicon.read(spark, a.path)
    missing = orphans = 0
    for r in lex.missing_media().orderBy("entry_pos", "seq").toLocalIterator(prefetchPartitions=True):
        missing += 1
        print(f"missing  {r.kind:12s} {r.href!r} (entry {r.entry_id or r.entry_guid or '?'})")
    for r in lex.orphan_media().orderBy("path").toLocalIterator(prefetchPartitions=True):
        orphans += 1
        print(f"orphaned {r.path} (no media/illustration references it)")
    if orphans:
        print("note:", NOTE)
    print(_counts((missing, "missing"), (orphans, "orphaned")))
    return int(bool(missing))


def _export(spark, a) -> int:
    langs = [x.strip() for x in a.langs.split(",") if x.strip()] if a.langs else None
    lex = Lexicon.read(spark, a.path, resolve_ranges=False)
    rows = report.export_rows(lex, langs)
    if a.output is None:
        csv.writer(sys.stdout, delimiter="\t" if a.tsv else ",").writerows(rows)
    else:
        with open(a.output, "w", newline="", encoding="utf-8") as f:
            csv.writer(f, delimiter="\t" if a.tsv else ",").writerows(rows)
    return 0


def main(argv: list[str] | None = None, spark=None) -> int:
    p = argparse.ArgumentParser(prog="lexispark", description="Lexicon files on Spark.")
    sub = p.add_subparsers(dest="command", required=True)
    v = sub.add_parser("validate")
    v.add_argument("path")
    v.add_argument("--format", default=_FORMATS[0], choices=_FORMATS)
    for flag in ("--strict", "--no-check-media", "--require-ids"):
        v.add_argument(flag, action="store_true")
    s = sub.add_parser("stats")
    s.add_argument("path")
    s.add_argument("--format", default=_FORMATS[0], choices=_FORMATS)
    o = sub.add_parser("sort")
    o.add_argument("path")
    o.add_argument("-o", "--output")
    c = sub.add_parser("check-media")
    c.add_argument("path")
    e = sub.add_parser("export")
    e.add_argument("path")
    e.add_argument("-o", "--output")
    e.add_argument("--langs")
    e.add_argument("--tsv", action="store_true")
    a = p.parse_args(argv)
    run = {"validate": _validate, "stats": _stats, "sort": _sort, "check-media": _check_media, "export": _export}[a.command]
    try:
        return run(spark or session(), a)
    except (LiftError, OSError) as x:
        print(f"error: {x}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    raise SystemExit(main())
