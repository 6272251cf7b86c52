"""Secret scans: fixed patterns, and an assignment-aware lexer.

The lexer reads name-literal pairs from source and configuration syntax, propagates constants down a text, and scores
each literal by how sensitive its target name is and how random it looks.  Pairs that score enough add spans of kind
``lex``; spans of the fixed patterns stay as they are.

Names: bare, dotted or quoted keys of any length, with a subscript (``a["key"] =``), an array size or a type
(``key: str = "x"``, ``key string = "x"``).  Operators: ``=``, ``:``, ``:=``, ``=>``, ``<-``; a comma after a quoted name that
opens an argument list; a blank after ``--name``, ``ENV NAME``, ``#define NAME``; the element ``<name>x</name>``.  Values:
quoted, triple-quoted and backquoted strings, joined by ``+``, ``.`` or standing side by side; lists of strings; block
scalars and here-documents; else an unquoted run of signs.  ``{`` and ``(`` are structure.  A name that a value refers to
(``a + b``, ``${a}``, ``$a``, ``#{a}``, ``%(a)s``, ``{a}`` in an f-string) stands for its last literal; what is not known counts as empty.

A value is kept as the counts of its signs, its ends and its length, so that a text that doubles a constant on every
line costs no more than its own length; its text is built up to ``LONGEST`` signs and is null beyond.  White space is
allowed in passphrases, connection strings and keys; other names with such values score half.

Defined cases: a null or empty text has no spans; a very long text is scanned whole, in time proportional to its
length; offsets are code points, end exclusive; a null id is carried; repeated rows and ties each get their row; an
empty table gives no rows; other columns of the table, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

KINDS = ("assign", "access", "hex", "lex")
LONGEST = 1 << 16
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_HINT = re.compile(r"(?ai:passw|secret|token|api_?key)", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")

_WORD = r"[A-Za-z_$](?:[\w$]|[.\-](?=\w))*+"
_KEY = re.compile(
    rf"""(?:(?P<q>["'`])(?P<quoted>[^"'`\n]++)(?P=q)(?:\])?|(?:(?<![\w$.\-])|(?<=\s--)|(?<=\s-))(?P<bare>{_WORD})(?:\[\w*\])?+)"""
    r"""(?:(?P<comma>[\x20\t]*,)|(?P<type>[\x20\t]++[A-Za-z_][\w.]*+(?=[\x20\t]*:?=[\x20\t]*["'`]))?[\x20\t]*+(?P<op>:=|=>|<-|=(?![=~>])|:(?![:=])))"""
)
_TYPE = re.compile(r"""[\x20\t]*(?:&?(?:'\w+[\x20\t]+)?(?:mut[\x20\t]+)?)[A-Za-z_][\w.:]*(?:\[(?:[^\[\]\n=]|\[[^\[\]\n=]*+\])*+\]|<(?:[^<>\n=]|<[^<>\n=]*+>)*+>)*+[?!*]*(?:[\x20\t]*\|[\x20\t]*\w+)*[\x20\t]*=[\x20\t]*(?=[bBrRuUfF]{0,2}["'`])""")
_PREFIX = re.compile(r"""[bBrRuUfF@$]{0,2}(?=["'`])""")
_QUOTED = {'"': re.compile(r'(?:[^"\\\n]|\\.)*+'), "'": re.compile(r"(?:[^'\\\n]|\\.)*+"), "`": re.compile(r"(?:[^`\\]|\\.)*+", re.S)}
_BARE = re.compile(r"""(?:[$#]\{\w[^{}$\n]*+\}|\{\{[^{}\n]*+\}\}|[^\s"'`,;<>(){}\[\]])++""")
_BLANK, _SPACE = re.compile(r"[\x20\t]*+"), re.compile(r"\s*+")
_HEREDOC = re.compile(r"""<<[-~]?[\x20\t]*["']?(\w+)["']?[^\n]*\n""")
_SCALAR = re.compile(r"[|>][+-]?\d?[+-]?[\x20\t]*(?:#[^\n]*)?\n")
_JOIN = re.compile(r"\s*+(?:\+|\.(?=\s*+[\"'$])|&)\s*+(?=[\"'`A-Za-z_$])")
_TERM = re.compile(r"[A-Za-z_$][\w$]*+(?:\.\w++)*+(?![\w(\[])")
_CODE = re.compile(r"[A-Za-z_$][A-Za-z_$.]*")
_FLAG = re.compile(rf"""(?:(?<=\s)|^)--?(?P<name>{_WORD})[\x20\t]++(?P<value>[^\s\-"'`][^\s"'`]*+|"[^"\n]*+"|'[^'\n]*+')""", re.M)
_LINE = re.compile(r"^[\x20\t]*+(?:ENV|ARG|#[\x20\t]*+define|setx?)[\x20\t]++(?P<name>\w++)[\x20\t]++(?P<value>[^\s=:][^\n]*+)", re.M)
_ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][\w:.\-]*+)>(?P<value>[^<]++)</(?P=name)>")
_REF = re.compile(r"\$\{(\w++)[^{}$\n]*+\}|#\{(\w+)\}|%\((\w+)\)s|\{\{\s*([\w.]+)\s*\}\}|\$([A-Za-z_]\w*)")
_FREF = re.compile(r"(?<![$#{])\{(\w+)\}(?!\})")
_NAMES = (
    (1.0, ("password", "passwd", "passphrase", "pwd", "secret", "privatekey", "clientsecret", "secretkey", "accesskey")),
    (0.9, ("apikey", "authtoken", "accesstoken", "refreshtoken", "bearer", "token", "signingkey", "encryptionkey", "masterkey")),
    (0.7, ("credential", "connectionstring", "connstr", "dsn", "webhook", "salt", "auth")),
)
_WIDE = ("passphrase", "mnemonic", "connectionstring", "connstr", "dsn", "privatekey")
_PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|changeme|example|placeholder|none|null|true|false|todo|your[-_ ].*|<.*>|env|string|str|int)$", re.S)
_SETS = (set("abcdefghijklmnopqrstuvwxyz"), set("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), set("0123456789"))


@lru_cache(4096)
def _sensitivity(name: str) -> float:
    flat = re.sub(r"[^a-z0-9]", "", name.lower())
    best = max((w for w, keys in _NAMES if any(k in flat for k in keys)), default=0.0)
    if best < 0.9 and "pass" in [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", name)]:
        return 0.9
    return best


def sensitivity(name: str) -> float:
    """0 to 1 by the words of a target name."""
    return _sensitivity(name) if len(name) <= 200 else _sensitivity.__wrapped__(name)


def _entropy(counts: Counter, n: int) -> float:
    return -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0


def entropy(s: str) -> float:
    """Bits a character."""
    return _entropy(Counter(s), len(s))


class Value:
    """A literal as counts of its signs, its length, its first signs and its last, and its text while that is short."""

    __slots__ = ("n", "counts", "head", "last", "text")

    def __init__(self, text: str = ""):
        self.n, self.counts, self.head, self.last = len(text), Counter(text), text[:16], text[-1:]
        self.text: str | None = text if self.n <= LONGEST else None

    @classmethod
    def of(cls, parts: list[str | Value]) -> Value:
        """Strings and values in a row."""
        parts = [p for p in parts if (len(p) if isinstance(p, str) else p.n)]
        if len(parts) == 1:
            return cls(parts[0]) if isinstance(parts[0], str) else parts[0]
        if all(isinstance(p, str) or p.text is not None for p in parts) and sum(len(p) if isinstance(p, str) else p.n for p in parts) <= LONGEST:
            return cls("".join(p if isinstance(p, str) else p.text for p in parts))
        every = [cls("".join(p for p in parts if isinstance(p, str))), *(p for p in parts if not isinstance(p, str))]
        out = cls()
        out.n, out.text = sum(v.n for v in every), None
        for v in every:
            for c, k in v.counts.items():
                out.counts[c] += k
        out.head = "".join(p[:16] if isinstance(p, str) else p.head for p in parts[:16])[:16]
        out.last = parts[-1][-1] if isinstance(parts[-1], str) else parts[-1].last
        return out

    def placeholder(self) -> bool:
        if self.text is not None:
            return bool(_PLACEHOLDER.match(self.text))
        signs = set(self.counts)
        return signs <= {"x", "X"} or signs == {"*"} or bool(re.match("(?i)your[-_ ]", self.head)) or (self.head[:1] == "<" and self.last == ">")


def literal_score(name: str, value: str | Value) -> float:
    """Sensitivity of the name times a measure of the literal; 0 for placeholders and short values."""
    worth = sensitivity(name)
    if not worth:
        return 0.0
    v = value if isinstance(value, Value) else Value(value)
    if v.n < 8 or v.placeholder():
        return 0.0
    signs = set(v.counts)
    kinds = sum(bool(signs & s) for s in _SETS) + bool(signs - _SETS[0] - _SETS[1] - _SETS[2])
    score = worth * min(1.0, _entropy(v.counts, v.n) / 3.5) * (0.6 + 0.1 * kinds)
    if signs & set(" \t\n\r") and not any(k in re.sub(r"[^a-z]", "", name.lower()) for k in _WIDE):
        return score / 2
    return score


class _Lexer:
    """Pairs of one text, in the order of their names."""

    def __init__(self, text: str):
        self.text, self.known, self.block = text, {}, 0

    def resolved(self, raw: str, f: bool = False) -> Value:
        """A literal's text with its references followed."""
        if not ("$" in raw or "{" in raw or "%(" in raw):
            return Value(raw)
        out, at = [], 0
        marks = [(m.start(), m.end(), next(g for g in m.groups() if g)) for m in _REF.finditer(raw)]
        if f:
            marks = sorted(marks + [(m.start(), m.end(), m[1]) for m in _FREF.finditer(raw)])
        for a, e, name in marks:
            if a < at:
                continue
            out.append(raw[at:a])
            if name in self.known:
                out.append(self.known[name])
            elif raw[a] == "$" and raw[a + 1] != "{" and not re.match(r"\$[A-Z_]{2,}$|\$[a-z_]+$", raw[a:e]):
                out.append(raw[a:e])  # a dollar sign within a random literal
            at = e
        return Value.of([*out, raw[at:]])

    def literal(self, p: int) -> tuple[Value, int] | None:
        """The string at ``p`` and where it ends."""
        t = self.text
        at = _PREFIX.match(t, p)
        if not at:
            return None
        f, p = "f" in at[0].lower() or "$" in at[0], at.end()
        q = t[p]
        if q != "`" and t.startswith(q * 3, p):
            e = t.find(q * 3, p + 3)
            return self.resolved(t[p + 3 : e if e >= 0 else len(t)], f), (e + 3 if e >= 0 else len(t))
        m = _QUOTED[q].match(t, p + 1)
        return self.resolved(m[0], f), min(len(t), m.end() + (t[m.end() : m.end() + 1] == q))

    def chain(self, p: int, lines: bool = False) -> tuple[Value, int] | None:
        """A string, or a name that something is joined to, with all that is joined to it."""
        got = self.literal(p)
        if got is None:
            term = _TERM.match(self.text, p)
            if not term or not (j := _JOIN.match(self.text, term.end())) or self.text[j.end()] not in "\"'`" and term[0] not in self.known:
                return None
            got = self.known.get(term[0], Value()), term.end()
        parts, e = [got[0]], got[1]
        while True:
            side = (_SPACE if lines else _BLANK).match(self.text, e).end()
            more = self.literal(side) if side < len(self.text) else None
            if more is None and (j := _JOIN.match(self.text, e)):
                more = self.literal(j.end())
                if more is None and (term := _TERM.match(self.text, j.end())):
                    more = self.known.get(term[0], Value()), term.end()
            if more is None:
                return Value.of(parts), e
            parts.append(more[0])
            e = more[1]

    def scalar(self, key: int, p: int) -> tuple[Value, int]:
        """The lines from ``p`` that are indented more than the line of ``key``."""
        t = self.text
        line = t.rfind("\n", 0, key) + 1
        depth = _BLANK.match(t, line).end() - line
        out, e = [], p
        while e < len(t):
            end = t.find("\n", e)
            end = len(t) if end < 0 else end
            first = _BLANK.match(t, e, end).end()
            if first < end and first - e <= depth:
                break
            out.append(t[first:end])
            e = min(len(t), end + 1)
        return Value("\n".join(out).strip("\n")), e

    def value(self, key: int, p: int, spaced: bool, name: str) -> Iterator[tuple[Value, int, bool]]:
        """(value, end, quoted) of what is assigned at ``p``: none for structure and unknown expressions."""
        t = self.text
        p = _BLANK.match(t, p).end()
        if p >= len(t):
            return
        got = self.chain(p)
        if got:
            yield *got, True
            return
        c = t[p]
        if c == "(":
            got = self.chain(_SPACE.match(t, p + 1).end(), lines=True)
            if got:
                yield *got, True
            return
        if c == "[":
            p = _SPACE.match(t, p + 1).end()
            while got := self.chain(p):
                yield *got, True
                p = _SPACE.match(t, got[1]).end()
                if t[p : p + 1] != ",":
                    return
                p = _SPACE.match(t, p + 1).end()
            return
        if key >= self.block:
            here = _HEREDOC.match(t, p) if c == "<" else None
            if here:
                end = re.compile(rf"^[\x20\t]*{here[1]}\b", re.M).search(t, here.end())
                self.block = end.start() if end else len(t)
                yield Value(t[here.end() : self.block].strip("\n")), self.block, True
                return
            fold = _SCALAR.match(t, p) if c in "|>" else None
            if fold:
                value, self.block = self.scalar(key, fold.end())
                yield value, self.block, True
                return
        m = _BARE.match(t, p)
        if not m:
            return
        raw, e = m[0], m.end()
        if any(k in re.sub(r"[^a-z]", "", name.lower()) for k in _WIDE):
            end = t.find("\n", p)
            end = end if end >= 0 else len(t)
            note = re.compile(r"(?<=[\x20\t])[#;]").search(t, p + 1, end)
            raw = t[p : note.start() if note else end].rstrip(" \t\r,;")
            e = p + len(raw)
        elif t[e : e + 1] in ("(", "["):
            return
        if raw in self.known:
            yield self.known[raw], e, True
        elif not (spaced and _CODE.fullmatch(raw)):
            yield self.resolved(raw), e, False

    def pairs(self) -> Iterator[tuple[str, Value, int, int, bool]]:
        t, at = self.text, 0
        while m := _KEY.search(t, at):
            name, key = (m["bare"], m.start("bare")) if m["bare"] else (m["quoted"], m.start("quoted"))
            at = max(m.end(), m.start() + 1)
            if m["op"] is None:
                opens = m["quoted"] is not None and t[max(0, m.start() - 1) : m.start()] == "("
                if not opens:
                    at = m.end("quoted") if m["quoted"] else m.end()
                    continue
                p = m.end()
            else:
                p = m.end()
                typed = _TYPE.match(t, p) if m["op"] == ":" else None
                p = at = typed.end() if typed else p
            spaced = m["op"] not in (None, ":") and t[m.start("op") - 1] == " "
            for value, e, quoted in self.value(key, p, spaced, name):
                self.known[name.strip()] = value
                yield name, value, key, e, quoted
                if not quoted:
                    at = max(at, e)


def pairs(text: str) -> Iterator[tuple[str, Value, int, int, bool]]:
    """(name, literal, first, end, quoted) of each assignment, with constants followed."""
    yield from _Lexer(text).pairs()
    for pattern in (_FLAG, _LINE, _ELEMENT):
        for m in pattern.finditer(text):
            raw = m["value"].strip()
            quoted = raw[:1] in ('"', "'") and raw[-1:] == raw[:1] and len(raw) > 1
            yield m["name"], Value(raw[1:-1] if quoted else raw), m.start("name"), m.start("value") + len(m["value"].rstrip()), quoted


def _named(text: str) -> bool:
    """Whether a name that the scorer rates may stand in a text: its letters in a row, whatever stands between words."""
    flat = re.sub(r"[^a-z0-9]", "", text.lower())
    return "pass" in flat or any(k in flat for _, keys in _NAMES for k in keys)


def scan(text: str, threshold: float = 0.55) -> list[tuple[int, int, str]]:
    """Spans (first, end, kind) by start, then kind."""
    found: list[tuple[int, int, str]] = []
    if _HINT.search(text):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    if _named(text):
        found += sorted({(a, e, "lex") for name, value, a, e, _ in pairs(text) if literal_score(name, value) >= threshold})
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


SPANS = "doc_id long, kind string, first long, end long, match string"
DIGEST = "doc_id long, n_assign long, n_access long, n_hex long, n_lex long, base_sha256 string, spans string"
_SPANS = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("match", pa.string())])
_DIGEST = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_assign", "n_access", "n_hex", "n_lex")] + [("base_sha256", pa.string()), ("spans", pa.string())])


def _texts(b: pa.RecordBatch) -> Iterator[tuple[int | None, str]]:
    for i, t in zip(b.column("doc_id"), b.column("text"), strict=True):
        yield i.as_py(), t.as_py() or ""


def _span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield B.rows(_SPANS, [(i, k, a, e, t[a:e]) for i, t in _texts(b) for a, e, k in scan(t)])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for i, t in _texts(b):
            found = scan(t)
            n = Counter(k for _, _, k in found)
            base = ",".join(f"{k}:{a}:{e}" for a, e, k in found if k != "lex")
            out.append((i, n["assign"], n["access"], n["hex"], n["lex"], hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{k}:{a}:{e}" for a, e, k in found)))
        yield B.rows(_DIGEST, out)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per span, with its text."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(B.tidy(_span_rows), SPANS)


def op9_secret_scan(spark, sf_dir):
    """Counts, spans and a digest of the fixed patterns' spans for each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", "text").mapInArrow(B.tidy(_digest), DIGEST)


QUERIES = {"op9_secret_scan": op9_secret_scan}
ORACLE: dict[str, str] = {}
