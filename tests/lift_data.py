"""A small lexicon, written for these tests, with residue, mixed content, recursion and defects."""


def el(tag, /, *kids, **attrs):
    """An element as text; ``_`` in a name stands for a hyphen, a final one is dropped."""
    head = "<" + tag.replace("_", "-") + "".join(f" {k.rstrip('_')}='{v}'" for k, v in attrs.items())
    return head + "/>" if not kids else head + ">" + "".join(kids) + f"</{tag.replace('_', '-')}>"


def form(lang, text, tag="form"):
    return el(tag, el("text", text) if text else el("text"), lang=lang)


def doc(*kids, root="lift", **attrs):
    return el(root, *kids, **({"version": "0.13"} if root == "lift" else {}), **attrs)


DECL = "<?xml " + "version='1.0' " + "encoding='UTF-8'?>\n"
RANGES = DECL + doc(
    "\n  ", el("range", el("range-element", id="Noun"), el("range-element", id="Verb", parent="Noun"), "\n    ", el("range-element", id="Adj", parent="nowhere"), id="grammatical-info"),
    "\n  ", el("range", el("range-element", id="ok", guid="g-ok"), el("range-element", id="café", guid="g-ok"), id="status", guid="g-status"), "\n", root="lift-ranges",
) + "\n"

HEADER = el(
    "header",
    "\n    ", el("ranges", el("range", id="grammatical-info", href="words.lift-ranges"), el("range", id="lost", href="lost/none.lift-ranges")),
    "\n    ", el("fields", el("field", form("en", "pattern"), tag="cv")), "\n  ",
)
MIXED = "be " + el("span", "b&amp;&lt;e", el("span", "in"), lang="fr", class_="x") + " tail"
B = el(
    "entry",
    "\n    ", el("lexical-unit", form("qaa", MIXED)),
    "\n    ", el("trait", name="status", value="ok"), el("trait", name="status", value="café"),
    "\n    ", el("pronunciation", form("ipa", "bi"), el("media", el("label", form("en", "snd")), href="b.wav")),
    "\n    ", el("variant", form("qaa", "bee"), el("relation", type="v", ref="gone"), ref="a"),
    "\n    ", el(
        "sense", el("grammatical-info", value="Noun"), form("en", "insect", "gloss"), form("en", "second", "gloss"),
        "\n      ", el("definition", form("en", "a bee"), form("en", "again")),
        "\n      ", el("example", form("qaa", "x"), el("translation", form("en", "y"), type="free"), source="s"),
        "\n      ", el("illustration", href="pictures\\b.jpg"), "\n    ", id="b1", order="1",
    ),
    "\n    ", el("sense", el("subsense", form("fr", "abeille", "gloss"), id="b2a"), el("subsense", el("grammatical-info", value="Pronoun"), el("relation", type="syn", ref="b1"), id="b2b")),
    "\n    ", el("unknown-thing", el("k"), a="1"), "\n  ", id="b", guid="2222", dateCreated="2020-01-02T03:04:05Z", **{"q:mark": "1"},
)
A = el(
    "entry", el("citation", form("qaa", "")),
    "\n    ", el("relation", type="ant", ref="b2a", order="2x"), el("relation", type="ant", ref="missing"), el("note", form("en", "hi"), type="n"),
    "\n    ", el("etymology", form("la", "ab"), form("en", "from", "gloss"), type="t", source="s"),
    "\n    ", el("reversal"), "\n  ", id="a", guid="1111", dateDeleted="2019-01-01",
)
C = el("entry", el("sense", el("reversal", form("en", "r"), el("main", form("en", "m"), el("grammatical-info", value="Verb")), type="en"), id="c1"), id="c", guid="2222")
LIFT = DECL + "<!-- before -->" + doc("\n  ", HEADER, "\n  <!-- between -->\n  ", B, "\n  ", A, "\n  ", C, "\n", producer="maker 1", **{"xmlns:q": "urn:q"}) + "\n<!-- after -->\n"


def folder(path):
    """A lexicon folder; the .lift file."""
    (path / "words.lift").write_text(LIFT, encoding="utf-8")
    (path / "words.lift-ranges").write_text(RANGES, encoding="utf-8")
    (path / "pictures").mkdir()
    (path / "audio").mkdir()
    (path / "pictures" / "b.jpg").write_bytes(b"x")
    (path / "audio" / "stray.wav").write_bytes(b"x")
    return path / "words.lift"
