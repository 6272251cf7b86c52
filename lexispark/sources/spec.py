"""The content model of LIFT 0.13 as a table: one row per kind of node, read by parser, serializer and validator.

A kind has attributes (name, type, required) in output order, and slots (tag, kind of child, most) in output order.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Kind:
    attrs: tuple[tuple[str, str, bool], ...] = ()
    slots: tuple[tuple[str, str, int], ...] = ()
    least: tuple[str, ...] = ()


MANY = 1 << 30
_DATES = (("dateCreated", "date", False), ("dateModified", "date", False))
_NOTED = (("annotation", "annotation", MANY), ("trait", "trait", MANY))
_OPEN = (*_NOTED, ("field", "field", MANY))
_FORMS = (("form", "form", MANY),)


def _a(*names: str) -> tuple[tuple[str, str, bool], ...]:
    """``name``: optional text; ``name!``: required; ``name:type``."""
    out = []
    for n in names:
        name, _, kind = n.rstrip("!").partition(":")
        out.append((name, kind or "string", n.endswith("!")))
    return tuple(out)


def _mt(*tags: str) -> tuple[tuple[str, str, int], ...]:
    return tuple((t, "multitext", 1) for t in tags)


_SENSE = Kind(
    (*_a("id", "order:int"), *_DATES),
    (
        ("grammatical-info", "grammatical-info", 1), ("gloss", "form", MANY), *_mt("definition"), ("relation", "relation", MANY), ("note", "note", MANY), ("example", "example", MANY),
        ("reversal", "reversal", MANY), ("illustration", "urlref", MANY), ("subsense", "sense", MANY), *_OPEN,
    ),
)

KINDS: dict[str, Kind] = {
    "entry": Kind(
        (*_a("id", "guid", "order:int"), *_DATES, ("dateDeleted", "date", False)),
        (*_mt("lexical-unit", "citation"), ("pronunciation", "pronunciation", MANY), ("variant", "variant", MANY), ("sense", "sense", MANY), ("note", "note", MANY), ("relation", "relation", MANY), ("etymology", "etymology", MANY), *_OPEN),
    ),
    "sense": _SENSE,
    "pronunciation": Kind(_DATES, (*_FORMS, ("media", "urlref", MANY), *_OPEN)),
    "variant": Kind((*_a("ref"), *_DATES), (*_FORMS, ("pronunciation", "pronunciation", MANY), ("relation", "relation", MANY), *_OPEN)),
    "note": Kind((*_a("type"), *_DATES), (*_FORMS, *_OPEN)),
    "example": Kind((*_a("source"), *_DATES), (*_FORMS, ("translation", "translation", MANY), ("note", "note", MANY), *_OPEN)),
    "translation": Kind(_a("type"), _FORMS),
    "relation": Kind((*_a("type!", "ref!", "order:int"), *_DATES), (*_mt("usage"), *_OPEN)),
    "etymology": Kind((*_a("type!", "source!"), *_DATES), (*_FORMS, ("gloss", "form", MANY), *_OPEN)),
    "reversal": Kind(_a("type"), (*_FORMS, ("main", "main", 1), ("grammatical-info", "grammatical-info", 1))),
    "main": Kind((), (*_FORMS, ("main", "main", 1), ("grammatical-info", "grammatical-info", 1))),
    "grammatical-info": Kind(_a("value!"), (("trait", "trait", MANY),)),
    "urlref": Kind(_a("href:uri!"), _mt("label")),
    "field": Kind((*_a("type!"), *_DATES), (*_FORMS, *_NOTED)),
    "trait": Kind(_a("name!", "value!"), (("annotation", "annotation", MANY),)),
    "annotation": Kind(_a("name!", "value", "who", "when:date"), _FORMS),
    "form": Kind(_a("lang"), (("text", "text", 1), ("annotation", "annotation", MANY)), ("text",)),
    "multitext": Kind((), _FORMS),
    "text": Kind(),
    "span": Kind(_a("lang", "href:uri", "class")),
    "header": Kind((), (*_mt("description"), ("ranges", "ranges", 1), ("fields", "fields", 1))),
    "ranges": Kind((), (("range", "range", MANY),)),
    "fields": Kind((), (("field", "field-definition", MANY),)),
    "field-definition": Kind(_a("tag!"), _FORMS),
    "range": Kind(_a("id!", "href:uri", "guid"), (*_mt("description", "label", "abbrev"), ("range-element", "range-element", MANY))),
    "range-element": Kind(_a("id!", "parent", "guid"), _mt("description", "label", "abbrev")),
}
#: Attributes that are "" when they are missing though required; a form's language stays null.
EMPTY = {(k, a) for k, kind in KINDS.items() for a, _, needed in kind.attrs if needed}
MIXED = {"text", "span"}
SLOTS = {k: {tag: (child, most) for tag, child, most in kind.slots} for k, kind in KINDS.items()}
#: Elements that are left out when they hold neither forms nor residue.
OPTIONAL_TEXT = {"multitext"}
