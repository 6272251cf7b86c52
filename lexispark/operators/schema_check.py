"""Schema conformance of elements against the content model table.

All content is an interleave of counted slots, so conformance is attribute by attribute and slot by slot.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from ..sources.spec import KINDS, MIXED, SLOTS

_TZ = r"(?:Z|[+-](?:0\d|1[0-3]):[0-5]\d|[+-]14:00)?"
_DAY = re.compile(r"-?\d{4,}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])" + _TZ)
_TIME = re.compile(r"-?\d{4,}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])T(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?" + _TZ)
_INT = re.compile(r"[+-]?\d+")
_LONG = {1, 3, 5, 7, 8, 10, 12}


def _real_day(v: str) -> bool:
    y, m, d = re.match(r"(-?\d+)-(\d\d)-(\d\d)", v).groups()
    y, m, d = int(y), int(m), int(d)
    leap = y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)
    return d <= (31 if m in _LONG else 30 if m != 2 else 29 if leap else 28)


_KNOWN = {k: {a: t for a, t, _ in kind.attrs} for k, kind in KINDS.items()}
_NEEDED = {k: [a for a, _, needed in kind.attrs if needed or (k == "form" and a == "lang")] for k, kind in KINDS.items()}


def valid(kind: str, value: str) -> bool:
    if kind not in ("date", "int"):
        return True
    v = re.sub(r"[\t\n\r ]+", " ", value).strip(" ")
    if kind == "date":
        return bool(_DAY.fullmatch(v) or _TIME.fullmatch(v)) and _real_day(v)
    return bool(_INT.fullmatch(v))


def violations(el: ET.Element, kind: str) -> Iterator[str]:
    """A message for each violation, parents before children."""
    spec = KINDS[kind]
    known = _KNOWN[kind]
    for a, v in el.attrib.items():
        if a not in known:
            yield f"element {el.tag} has invalid attribute {a}"
        elif not valid(known[a], v):
            yield f"element {el.tag} attribute {a} has invalid value {v!r}"
    for a in _NEEDED[kind]:
        if a not in el.attrib:
            yield f"element {el.tag} lacks attribute {a}"
    kids = [c for c in el if isinstance(c.tag, str)]
    if kind in MIXED:
        for c in kids:
            if c.tag == "span":
                yield from violations(c, "span")
            else:
                yield f"element {c.tag} is not allowed in {el.tag}"
        return
    slots, count = SLOTS[kind], dict.fromkeys(spec.least, 0)
    for t in (el.text, *[c.tail for c in el]):
        if t and not t.isspace():
            yield f"element {el.tag} has text where none is allowed"
            break
    for c in kids:
        slot = slots.get(c.tag)
        count[c.tag] = count.get(c.tag, 0) + 1
        if slot is None:
            yield f"element {c.tag} is not allowed in {el.tag}"
        elif count[c.tag] > slot[1]:
            yield f"element {el.tag} has more than one {c.tag}"
        else:
            yield from violations(c, slot[0])
    for tag in spec.least:
        if not count[tag]:
            yield f"element {el.tag} lacks element {tag}"
