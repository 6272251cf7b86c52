"""Exact dedup, media, secret and license operators against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lexispark.llm import blocks as B
from lexispark.llm import exact_dedup, jpeg_frames, licenses, mjpeg, secrets
from tests.llm.data import documents, empty, texts


@pytest.mark.parametrize("keys", [[], [0], [7, 7], [2**64 - 1], list(range(0, 90000, 17))])
def test_rice_round_trip(keys):
    keys = np.array(keys, np.uint64)
    assert (B.rice_decode(B.rice_encode(keys)) == keys).all()


def test_pack_round_trip():
    a = [np.array([1, 2, 300]), np.array([0.5]), np.zeros(0, np.int64), np.array([2**40], np.uint64)]
    assert all((x == y).all() for x, y in zip(a, B.unpack(B.pack(*a)), strict=True))


def test_exact_groups(spark):
    rows = [(i % 55, t, "en", "s", 0, i) for i, t in enumerate(texts())] + [(None, "a", None, None, None, 1), (3, "a", None, None, None, 1)]
    df = documents(spark, rows)
    got = exact_dedup.exact_groups(df).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r[0])
    assert len(got) == len(rows)
    want = sorted((str(i), hashlib.sha256(k.encode()).hexdigest(), str(min((x for x in g if x is not None), default=None)), len(g)) for k, g in groups.items() for i in g)
    assert sorted((str(r.doc_id), r.text_sha256, str(r.keep_id), r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    stay = exact_dedup.exact_dedup(df)
    assert stay.columns == df.columns and stay.count() == len(groups)
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_mjpeg_digest(spark):
    got = {r.doc_id: r for r in documents(spark).select("doc_id", "text").mapInArrow(mjpeg._digest, mjpeg.DIGEST).collect()}
    for i, t in enumerate(texts()):
        b = (t or "").encode()
        p = b + b"\0" * ((-len(b)) % 64 if b else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert mjpeg.encode_documents(empty(spark)).count() == 0


def test_mjpeg_every_difference_and_shots(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([np.tile([0, 255], 64 * 32), r.integers(0, 256, 64 * 64), np.full(64 * 64 * 5, 10), np.full(64 * 64 * 4, 200)]).astype(np.uint8)
    f = mjpeg.encode_many([x.tobytes(), x[:128].tobytes()])
    (y, heights, sec), (z, _, _) = mjpeg.decode_many(f)
    assert y.tobytes() == x.tobytes() and z.tobytes() == x[:128].tobytes() and sec == 0.04
    frames, _ = mjpeg.riff_frames(f[0])
    assert len(frames) == len(heights) == 11 and all(f[0][a : a + 2] == b"\xff\xd8" for a, _ in frames)
    assert (2, 7) in mjpeg.shots(y, heights) and (7, 11) in mjpeg.shots(y, heights)
    media = spark.createDataFrame([(1, bytearray(f[0]))], "doc_id long, avi binary")
    clips = mjpeg.clip_rows(media).orderBy("clip").collect()
    assert clips[-1].end_s == pytest.approx(0.44) and clips[-1].mean_level == 200


def baseline_frame(x, chroma=False, every=0, own_tables=True):
    """A baseline JPEG of rows and columns that are multiples of 16, with quantisation by 1."""
    J = jpeg_frames
    words = {k: {v: (c, n) for c, n, v in J.codes(*t)} for k, t in J.STANDARD.items()}
    out, bits, last = [], [], 0

    def put(value, n):
        bits.extend((value >> (n - 1 - k)) & 1 for k in range(n))

    def number(v):
        n = abs(v).bit_length()
        return n, (v if v > 0 else v + (1 << n) - 1)

    def block(z, table, last):
        n, raw = number(int(z[0]) - last)
        put(*words[0, table][n])
        put(raw, n)
        run = 0
        for v in z[1:].tolist():
            if not v:
                run += 1
                continue
            while run > 15:
                put(*words[1, table][0xF0])
                run -= 16
            n, raw = number(int(v))
            put(*words[1, table][run << 4 | n])
            put(raw, n)
            run = 0
        if run:
            put(*words[1, table][0])
        return int(z[0])

    def flush():
        bits.extend([1] * (-len(bits) % 8))
        out.append(np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00"))
        bits.clear()

    side, count = 16 if chroma else 8, 0
    for y in range(0, x.shape[0], side):
        for c in range(0, x.shape[1], side):
            if every and count and count % every == 0:
                flush()
                out.append(bytes([0xFF, 0xD0 + (count // every - 1) % 8]))
                last = 0
            for a in range(0, side, 8):
                for b in range(0, side, 8):
                    z = np.round(J.DCT @ (x[y + a : y + a + 8, c + b : c + b + 8].astype(float) - 128) @ J.DCT.T).ravel()[J.ZIGZAG]
                    last = block(z, 0, last)
            for _ in range(2 if chroma else 0):
                block(np.zeros(64), 1, 0)
            count += 1
    flush()
    seg = lambda tag, body: bytes([0xFF, tag]) + (len(body) + 2).to_bytes(2, "big") + body
    n = 3 if chroma else 1
    sof = bytes([8]) + x.shape[0].to_bytes(2, "big") + x.shape[1].to_bytes(2, "big") + bytes([n]) + b"".join(bytes([i + 1, 0x22 if chroma and not i else 0x11, 0]) for i in range(n))
    sos = bytes([n]) + b"".join(bytes([i + 1, 0x11 if i else 0]) for i in range(n)) + bytes([0, 63, 0])
    dht = b"".join(seg(0xC4, bytes([k[0] << 4 | k[1]]) + bytes(t[0]) + bytes(t[1])) for k, t in J.STANDARD.items()) if own_tables else b""
    return b"\xff\xd8" + seg(0xDB, b"\0" + b"\1" * 64) + seg(0xC0, sof) + dht + (seg(0xDD, every.to_bytes(2, "big")) if every else b"") + seg(0xDA, sos) + b"".join(out) + b"\xff\xd9"


@pytest.mark.parametrize("chroma,every,own", [(False, 0, True), (False, 3, False), (True, 0, True), (True, 2, False)])
def test_baseline_frames_of_other_writers(spark, chroma, every, own):
    r = np.random.default_rng(3)
    x = r.integers(0, 256, (32, 48)).astype(np.uint8)
    got = jpeg_frames.luma(baseline_frame(x, chroma, every, own))
    assert got.shape == x.shape and np.abs(got.astype(int) - x).max() <= 2
    dark, light = np.full((32, 48), 20, np.uint8), np.full((32, 48), 220, np.uint8)
    avi = mjpeg.avi_file([baseline_frame(f, chroma, every, own) for f in [dark] * 5 + [light] * 4])
    media = spark.createDataFrame([(1, bytearray(avi)), (2, bytearray(mjpeg.encode_many([b"a" * 64])[0]))], "doc_id long, avi binary")
    clips = {(c.doc_id, c.clip): (c.first_frame, c.end_frame, round(c.mean_level)) for c in mjpeg.clip_rows(media).collect()}
    assert clips == {(1, 0): (0, 5, 20), (1, 1): (5, 9, 220), (2, 0): (0, 1, 97)}
    with pytest.raises(ValueError, match="process"):
        jpeg_frames.luma(baseline_frame(x).replace(b"\xff\xc0", b"\xff\xc2"))


def test_secret_base(spark):
    got = {r.doc_id: r for r in documents(spark).select("doc_id", "text").mapInArrow(secrets._digest, secrets.DIGEST).collect()}
    for i, t in enumerate(texts()):
        t, out = t or "", []
        for kind, p, g, n in (("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)):
            out += [(m.start(), ("assign", "access", "hex").index(kind), f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(p, t) if len(m[g]) >= n]
        assert got[i].base_sha256 == hashlib.sha256(",".join(x[2] for x in sorted(out)).encode()).hexdigest()
    assert secrets.secret_spans(empty(spark)).count() == 0


def test_secret_lexer():
    t = 'prefix = "Zx81kQ"\nclient_secret = prefix + "pL0v92mWqe7"\ncolour: blueberry-pie\npassword: changeme\nauth_token="${prefix}77Aa"\n'
    names = [t[a:e].split(" ")[0].split("=")[0] for a, e, k in secrets.scan(t) if k == "lex"]
    assert names == ["client_secret", "auth_token"]
    assert secrets.literal_score("password", "changeme") == 0 and secrets.literal_score("colour", "Zx81kQpL0v92") == 0


def test_license_base(spark):
    got = {r.doc_id: r for r in documents(spark).select("doc_id", "text").mapInArrow(licenses._digest, licenses.DIGEST).collect()}
    for i, t in enumerate(texts()):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = sorted((k, lab) for ph, lab in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for k in range(len(words)) if words[k : k + len(ph.split())] == ph.split())
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and {x for _, x in places} <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
    assert licenses.license_spans(empty(spark)).count() == 0


def test_license_rules():
    assert len(licenses.rules()) > 200
    for label, key, pattern in licenses.rules():
        assert label and key
    found = lambda s: {x[2] for x in licenses.detect(s)}
    assert found("licensed under the apache license version 2 0") == {"apache-2.0"}
    assert found("gnu lesser general public license v2 1") == {"lgpl-2.1"}
    assert found("spdx license identifier bsd 3 clause") >= {"bsd-3-clause"}
    assert found("nothing here") == set()


def _sample(parsed, r):
    """A random string that a parsed pattern matches."""
    out = ""
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "BRANCH":
            out += _sample(r.choice(arg[1]), r)
        elif op == "SUBPATTERN":
            out += _sample(arg[-1], r)
        elif op == "MAX_REPEAT":
            out += "".join(_sample(arg[2], r) for _ in range(r.randint(arg[0], min(int(arg[1]), arg[0] + 2))))
        elif op == "IN":
            kind, what = arg[0]
            out += chr(what) if str(kind) == "LITERAL" else chr(what[0]) if str(kind) == "RANGE" else "1" if "DIGIT" in str(what) else "x"
        elif op == "ANY":
            out += "x"
        else:
            assert op == "ASSERT_NOT", op
    return out


def test_license_gates_are_in_every_match():
    r = random.Random(1)
    for label, key, pattern in licenses.rules():
        for _ in range(50):
            s = _sample(re._parser.parse(pattern.pattern), r)
            assert pattern.fullmatch(s) and key in s, (label, key, s)
            assert any(a == 0 or e == len(s) for a, e, _, _ in licenses.detect(s)), s


def test_license_spdx():
    found = lambda s: {x[2] for x in licenses.detect(" ".join(re.findall("[a-z0-9]+", s.lower())))}
    for i in "MIT ISC Zlib AGPL-3.0-only AGPL-3.0-or-later GPL-2.0-only GPL-3.0-or-later LGPL-2.1-only BSD-3-Clause-Clear Apache-2.0 0BSD".split():
        assert found(f"SPDX-License-Identifier: {i}\nint main") == {"spdx", i.lower()}, i
    assert found("AGPL-3.0-only") == {"agpl-3.0-only"} and found("CreativeML Open RAIL-M") == {"openrail-m"}
    assert found("SPDX-License-Identifier: (MIT OR Apache-2.0) AND ISC") == {"spdx", "mit", "apache-2.0", "isc"}
    assert found("SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note-exception OR MIT") == {"spdx", "gpl-2.0-only", "mit"}
    assert found("SPDX-License-Identifier: NoSuch-1.0") == {"spdx"}
