"""The assignment lexer on written syntax, suppression against brute force, and both on hostile texts."""

import random
import string
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexispark.llm import licenses, secrets

RANDOM = st.text(string.ascii_letters + string.digits + "!@%^*_-", min_size=9, max_size=20).filter(lambda s: s[0].isalnum())
STYLES = [
    ("{n} = \"{v}\"", 0), ("{n}: '{v}',", 0), ("{n}: str = \"{v}\"", 0), ("let {n}: &'static str = \"{v}\";", 0), ("var {n} string = \"{v}\"", 0), ("export {n}={v}", 0), ("  {n}: {v}", 0),
    ("cfg[\"{n}\"] = '{v}'", 0), ("'{n}' => '{v}',", 0), ("{{\"x\":{{\"{n}\":\"{v}\"}}}}", 0), ("put(\"{n}\", \"{v}\")", 0), ("run --{n} {v} -x", 0), ("ENV {n} {v}", 0), ("<{n}>{v}</{n}>", 0), ("{n} := `{v}`", 0),
    ("base = \"{a}\"\n{n} = base + \"{b}\"", 0), ("BASE={a}\n{n}=${{BASE}}{b}", 0), ("base = '{a}'\n{n} = f'{{base}}{b}'", 0), ("{n} = (\"{a}\"\n    \"{b}\")", 0), ("{n} = [\n  \"{v}\",\n]", 0), ("{n}: |\n  {v}\nother: 1", 0), ("{n} = <<EOF\n{v}\nEOF\n", 0), ("{n} = \"\"\"{v}\"\"\"", 0),
]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(STYLES), st.sampled_from(["db_password", "pass_word", "clientSecret", "x" * 90 + "_token", "private__key"]), RANDOM), min_size=1, max_size=6))
def test_every_written_pair_is_read(items):
    want, blocks = [], []
    for (style, _), name, v in items:
        blocks.append(style.format(n=name, v=v, a=v[:4], b=v[4:]))
        want.append((name, v))
    text = "\n\nsome prose, with words\n".join(blocks) + "\n"
    got = [(n, v.text) for n, v, *_ in secrets.pairs(text)]
    for w in want:
        assert got.count(w) >= want.count(w), (w, text, got)
    for n, v, a, e, _ in secrets.pairs(text):
        assert text[a:].startswith(n) and a < e <= len(text)


def test_no_pair_that_is_none():
    for t in ("password = get_password()", "password = os.environ['X']", "if password == 'abcdefgh12':", "password: ${DB_PASSWORD}", "secret = other_name", "a token is a word"):
        assert not [s for s in secrets.scan(t) if s[2] == "lex"], t
    assert [s[2] for s in secrets.scan('pass_phrase: "correct horse battery staple"')] == ["lex"]
    assert secrets.scan("") == []


def test_value_of_parts_equals_its_text():
    r = random.Random(2)
    for _ in range(200):
        parts = ["".join(r.choice("abXY 12*") for _ in range(r.randrange(6))) for _ in range(r.randrange(6))]
        v, w = secrets.Value.of([secrets.Value(p) if r.random() < 0.5 else p for p in parts]), secrets.Value("".join(parts))
        assert (v.n, v.counts, v.head, v.last, v.text) == (w.n, w.counts, w.head, w.last, w.text)
    long = "ab" * secrets.LONGEST
    v = secrets.Value.of([long, secrets.Value("z9"), long])
    assert v.text is None and v.n == 4 * secrets.LONGEST + 2 and v.counts["z"] == 1 and secrets.literal_score("password", v) == pytest.approx(secrets.literal_score("password", secrets.Value(long + "z9" + long)))


@pytest.mark.parametrize("text", ['a = "Zx91kkQp2"\n' + 'a = "${a}${a}"\n' * 60 + 'password = "${a}"\n', "pwd:" * 100_000, "a-" * 100_000, "password='" + "${a" * 50_000, "a:b<" * 100_000, "".join(" " * i + "a: |\n" for i in range(600)), 'pwd="' * 50_000, "dsn: a" + "," * 200_000 + "b"])
def test_hostile_texts_take_their_length(text):
    began = time.process_time()
    found = secrets.scan(text)
    assert time.process_time() - began < 3
    if text.startswith("a = "):
        assert found[-1][2] == "lex" and text[found[-1][0] :].startswith("password")


def slow_detect(words):
    """Suppression as it is defined, by comparing all."""
    every, found = licenses.rules(), list(dict.fromkeys(licenses.spdx(words)))
    for k, (label, key, pattern) in enumerate(every):
        for m in pattern.finditer(words) if key in words else ():
            if not any(x <= m.start() and m.end() <= y for x, y, _, _ in found):
                found.append((*m.span(), label, k))
    return sorted(f for f in found if not any(o[2] == f[2] and o[0] <= f[0] and f[1] <= o[1] and o[1] - o[0] > f[1] - f[0] for o in found))


def test_suppression_equals_brute_force():
    r = random.Random(5)
    words = "mit license apache version 2 0 gnu general public lesser affero bsd 3 clause or later any spdx identifier isc émit licensed under the gpl x".split()
    for _ in range(150):
        t = " ".join(r.choice(words) for _ in range(r.choice([3, 20, 120])))
        assert licenses.detect(t) == slow_detect(t)


def test_whole_words_and_many_detections():
    assert licenses.detect("émit license") == [] and licenses.detect("mit licenseé") == []
    began = time.process_time()
    found = licenses.detect("mit license bsd license " * 50_000)
    assert len(found) >= 100_000 and time.process_time() - began < 8
    assert len(licenses.base_places(b"mit license " * 100_000)) == 100_000
