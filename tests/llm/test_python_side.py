"""The Python parts of the operators against their libraries, definitions and round trips."""

import os
import random
import re

import numpy as np
import pytest

from tesserae.llm import jpeg, op3_tokens, op4_secrets, op5_toxicity, op7_pieces, op8_media, op10_jaccard, trigrams
from tesserae.llm.shingles import shingles

TEXTS = ["", " ", "a", "Hello  world\n\tfoo é 😀 a", "   a ", "a\x00b▁c", "<s> </s> <0x41>", "\r\n　x\xa0y ﬁ Å", " " * 5000 + "x", "theing" * 3000]


def noise(seed, n, most=60):
    rnd = random.Random(seed)
    alphabet = "abcde  ▁\n\t,.()é😀ßtheingonst012'-=/_<>\x00　"
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, most))) for _ in range(n)]


def test_sentencepiece_ids_and_text():
    import sentencepiece

    raw = op7_pieces.model_bytes()
    lib = sentencepiece.SentencePieceProcessor(model_proto=raw)
    model, _ = op7_pieces.spm.load(raw)
    for x in TEXTS + noise(1, 2000):
        ids = op7_pieces.encode_text(x, raw)
        assert ids == lib.encode(x)
        assert model.decode(ids) == lib.decode(ids)
        assert op3_tokens.count_text(x, raw) == len(ids)
    assert op7_pieces.encode_text(None, raw) == [] and op3_tokens.count_text(None, raw) == 0


def test_jpeg_round_trip():
    texts = [None, "", "a", "x" * 64, "é" * 40000, *noise(2, 50, 900)]
    files = [jpeg.store(op8_media.payload(x)) for x in texts]
    for x, f, (h, image) in zip(texts, files, op8_media._read(files), strict=True):
        assert jpeg.restore(h, image) == op8_media.payload(x)
        assert f[:2] == b"\xff\xd8" and f[-2:] == b"\xff\xd9"
        assert (h.height, h.width) == (8 * image.shape[0], 8 * image.shape[1])
    assert op8_media._read([b"no image", None, files[0]])[:2] == [None, None]


def brute_spans(x):
    x, out = x or "", []
    for kind, p, group, least in (
        ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20),
        ("hex", r"[0-9a-f]+", 0, 24),
    ):
        out += [(m.start(), m.end(), kind) for m in re.finditer(p, x, re.A) if len(m.group(group)) >= least]
    return sorted(out, key=lambda s: (s[0], ("assign", "access", "hex").index(s[2])))


def test_secrets_against_plain_search():
    rnd = random.Random(3)
    parts = ["password", "TOKEN", "api_key", "apikey", "secret", "passwd", "=", ": ", '"', "abcdef12", "abc", "AKIA", "ABCDEFGHIJKLMNOP", "deadbeef" * 4, "K", "ſecret", " ", "\n", "é", "ghp_" + "a" * 36]
    texts = [None, ""] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    base = {r.kind for r in op4_secrets.BASE}
    for x, spans in zip(texts, op4_secrets.find(texts), strict=True):
        assert [s for s in spans if s[2] in base] == brute_spans(x)
    assert op4_secrets.redact("a token=abcdef b", op4_secrets.find(["a token=abcdef b"])[0]) == "a [REDACTED:assign] b"


def test_whole_secrets_are_redacted():
    body = "\n".join("MIIEvQIBADANBgkqhkiG9w0BAQEFAASC" + str(i) for i in range(30))
    for kind in ("", "RSA ", "ENCRYPTED ", "X25519 "):
        key = f"-----BEGIN {kind}PRIVATE KEY-----\n{body}\n-----END {kind}PRIVATE KEY-----"
        texts = [f"a\n{key}\nb {key} c", f"a {key[:-40]}"]
        got = [op4_secrets.redact(x, s) for x, s in zip(texts, op4_secrets.find(texts), strict=True)]
        assert got == ["a\n[REDACTED:pem]\nb [REDACTED:pem] c", "a [REDACTED:pem]"]
    secrets = {
        "sk": ["sk-" + "aB3_" * 5, "sk-proj-" + "aB3-" * 9], "github": ["github_pat_" + "aB3_" * 20], "gitlab": ["glpat-" + "aB3-" * 5], "npm": ["npm_" + "aB3x" * 9],
        "thm": ["thm_" + "aB3-" * 11, "thm_a.b-c_" + "aB3-" * 10 + "xyz"],
    }
    for kind, found in secrets.items():
        for x in found:
            assert op4_secrets.redact(f"see {x}, b", op4_secrets.find([f"see {x}, b"])[0]) == f"see [REDACTED:{kind}], b"
    for n in (1, 64, 65, 5000):
        x = f"postgres://{'u' * n}:{'pQ-' * n}@host/db"
        assert op4_secrets.redact(x, op4_secrets.find([x])[0]) == "postgres[REDACTED:login]host/db"
    assert op4_secrets.find(["task-" + "a-" * 20, "-----BEGIN PUBLIC KEY-----", "http://a:80/b"]) == [[], [], []]


def test_trigram_queries_admit_every_match():
    assert trigrams.query(r"[0-9a-f]{24,}") is True
    assert trigrams.query(r"AKIA[A-Z]+") == ("and", "aki", "kia")


def test_linked_sets_meet_in_what_they_send():
    rnd = random.Random(4)
    for n in range(1, 61):
        for _ in range(60):
            a = set(rnd.sample(range(90), n))
            b = set(list(a)[: n - rnd.randint(0, max(1, n // 6))]) | set(rnd.sample(range(100, 140), rnd.randint(0, max(1, n // 6))))
            if a == b or not b or 100 * len(a & b) < 80 * len(a | b):
                continue
            x, y = sorted(a), sorted(b)
            common = set(x[: op10_jaccard.sent(len(x))]) & set(y[: op10_jaccard.sent(len(y))])
            assert len(common) >= max(op10_jaccard.wanted(len(x)), op10_jaccard.wanted(len(y))), (x, y)
            c = op10_jaccard.overlap(len(a), len(b))
            assert len(a & b) >= c and c in op10_jaccard.subset_sizes(len(a)) and c in op10_jaccard.subset_sizes(len(b))


def test_postings_against_plain_search():
    rnd = random.Random(7)
    wanted = {"aki", "kia", "tok", "oke", "ken", "://", "=ab"}
    texts = ["", "ab", "ak", "ia tok", *["".join(rnd.choice("akitoken:/=bé😀ſK ") for _ in range(rnd.randint(0, 30))) for _ in range(500)]]
    block = trigrams.Block(texts, trigrams.Index(wanted))
    for g in wanted:
        plain = [i for i, x in enumerate(texts) if g in re.sub("[A-Z]", lambda m: m[0].lower(), x)]
        assert block.postings[g].tolist() == plain
    assert block.candidates(("and", "tok", ("or", "aki", "ken"))).tolist() == [i for i, x in enumerate(texts) if "tok" in x and ("aki" in x or "ken" in x)]
    assert trigrams.Block([], trigrams.Index(wanted)).candidates("tok").tolist() == []


def test_shingles():
    assert len(shingles(None)) == len(shingles(" \n")) == 0
    assert len(shingles("a b")) == 1 and (shingles("A  b") == shingles("a\tb")).all()
    assert len(shingles("a b c d e f")) == 2
    assert (shingles("É b c d e") != shingles("é b c d e")).all()


def test_ftrl_learns_from_words():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(1500):
        bad = i % 8 == 0
        rows.append((" ".join([*rnd.choices(words, k=30), *(["awful"] if bad else [])]), int(bad)))
    w = op5_toxicity.fit([(op5_toxicity.features(x), y) for x, y in rows[:1000]])
    got = [op5_toxicity.probability(x, w) >= op5_toxicity.THRESHOLD for x, _ in rows[1000:]]
    assert got == [bool(y) for _, y in rows[1000:]]
    assert op5_toxicity.fit([]) is None and op5_toxicity.probability("x", None) == op5_toxicity.PRIOR


def plain_ftrl(rows):
    """FTRL-proximal by the book, with dictionaries; returns the weights of all coordinates met."""
    import math

    rows = [r for r in rows for _ in range(op5_toxicity.WEIGHT if r[1] else 1)]
    bias, z, n = 1 << op5_toxicity.BITS, {}, {}

    def weight(i):
        v, l1 = z.get(i, 0.0), 0.0 if i == bias else op5_toxicity.L1
        if abs(v) <= l1:
            return 0.0
        return (math.copysign(l1, v) - v) / ((op5_toxicity.BETA + math.sqrt(n.get(i, 0.0))) / op5_toxicity.ALPHA + op5_toxicity.L2)

    for epoch in range(op5_toxicity.EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            at, y = [*rows[k][0].tolist(), bias], rows[k][1]
            x = {i: op5_toxicity.PAIR if (1 << op5_toxicity.BITS - 1) <= i < bias else 1.0 for i in at}
            w = {i: weight(i) for i in at}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w[i] * x[i] for i in at)))))
            for i in at:
                g = (p - y) * x[i]
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / op5_toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) * (op5_toxicity.PAIR if (1 << op5_toxicity.BITS - 1) <= i < bias else 1.0) for i in z}


def test_ftrl_against_plain_python():
    rnd = random.Random(6)
    rows = [(op5_toxicity.features(" ".join([*rnd.choices([f"w{i}" for i in range(40)], k=12), *(["awful", "bad"] if i % 5 == 0 else [])])), int(i % 5 == 0)) for i in range(120)]
    got, want = op5_toxicity.fit(rows), plain_ftrl(rows)
    assert all(got[i] == pytest.approx(w, rel=1e-5, abs=1e-6) for i, w in want.items())
    assert np.count_nonzero(got) == sum(w != 0 for w in want.values()) > 1


def plain_dc(data):
    """The DC coefficients of each component of a baseline JPEG, bit by bit, with its AC coefficients decoded."""
    i, tables, parts, interval = 2, {}, [], 0
    while data[i + 1] != 0xDA:
        n = int.from_bytes(data[i + 2 : i + 4], "big")
        body, marker = data[i + 4 : i + 2 + n], data[i + 1]
        if marker == 0xC0:
            parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15) for k in range(body[5])]
            size = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        if marker == 0xDD:
            interval = int.from_bytes(body, "big")
        while marker == 0xC4 and body:
            code, k, table = 0, 17, {}
            for length in range(1, 17):
                for _ in range(body[length]):
                    table[length, code] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
            tables[body[0]], body = table, body[k:]
        i += 2 + n
    n = int.from_bytes(data[i + 2 : i + 4], "big")
    scan = {data[i + 5 + 2 * k]: (data[i + 6 + 2 * k] >> 4, 16 | data[i + 6 + 2 * k] & 15) for k in range(data[i + 4])}
    pieces = re.split(rb"\xff[\xd0-\xd7]", re.sub(rb"\xff\xd9.*$", b"", data[i + 2 + n :], flags=re.S))
    streams = ["".join(f"{b:08b}" for b in p.replace(b"\xff\0", b"\xff")) for p in pieces]
    across, down = max(p[1] for p in parts), max(p[2] for p in parts)
    alone = len(parts) == 1
    units = -(-size[1] // (8 * (1 if alone else across))) * -(-size[0] // (8 * (1 if alone else down)))
    out, k = {p[0]: [] for p in parts}, 0
    for s in streams:
        at, last = 0, dict.fromkeys(out, 0)

        def read(table):
            nonlocal at
            code = 0
            for length in range(1, 17):
                code = code << 1 | int(s[at])
                at += 1
                if (length, code) in table:
                    return table[length, code]
            raise AssertionError

        def bits(m):
            nonlocal at
            v = int(s[at : at + m] or "0", 2)
            at += m
            return v if not m or v >> m - 1 else v - (1 << m) + 1

        for _ in range(min(interval or units, units - k)):
            k += 1
            for c, h, v in parts:
                for _ in range(1 if alone else h * v):
                    last[c] += bits(read(tables[scan[c][0]]))
                    out[c].append(last[c])
                    place = 1
                    while place < 64 and (r := read(tables[scan[c][1]])):
                        bits(r & 15)
                        place += (r >> 4) + 1
    return out


def made_jpeg(rnd, width, height, sampling, interval):
    """A colour JPEG of random coefficients with AC, by a plain encoder with code tables of its own."""
    dc = {s: f"{k:04b}" for k, s in enumerate(range(12))}
    ac_symbols = [0x00, 0xF0, *[r << 4 | s for r in range(16) for s in range(1, 11)]]
    ac = {s: f"{k:09b}" for k, s in enumerate(ac_symbols)}
    table = lambda kind, length, symbols: bytes([kind, *[len(symbols) if n == length else 0 for n in range(1, 17)], *symbols])
    segment = lambda m, b: bytes([0xFF, m]) + (len(b) + 2).to_bytes(2, "big") + b
    parts = [(1, *sampling), (2, 1, 1), (3, 1, 1)]
    head = b"\xff\xd8" + segment(0xDB, bytes([0, 7, *[1] * 63])) + segment(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([3]) + b"".join(bytes([c, h << 4 | v, 0]) for c, h, v in parts))
    head += segment(0xC4, table(0, 4, list(range(12)))) + segment(0xC4, table(16, 9, ac_symbols)) + (segment(0xDD, interval.to_bytes(2, "big")) if interval else b"") + segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    units, out, body, marks = -(-width // (8 * sampling[0])) * -(-height // (8 * sampling[1])), "", b"", 0
    last = dict.fromkeys((1, 2, 3), 0)
    value = lambda v: "" if not v else f"{v if v > 0 else v + (1 << abs(v).bit_length()) - 1:0{abs(v).bit_length()}b}"
    flush = lambda o: bytes(int((o + "1" * (-len(o) % 8))[i : i + 8], 2) for i in range(0, len(o), 8)).replace(b"\xff", b"\xff\0")
    for u in range(units):
        if interval and u and u % interval == 0:
            body, out, last = body + flush(out) + bytes([0xFF, 0xD0 + marks % 8]), "", dict.fromkeys((1, 2, 3), 0)
            marks += 1
        for c, h, v in parts:
            for _ in range(h * v):
                now = rnd.randint(-120, 120)
                d, last[c], place = now - last[c], now, 1
                out += dc[abs(d).bit_length()] + value(d)
                while place < 63 and rnd.random() < 0.7:
                    run, x = min(rnd.randint(0, 20), 62 - place), rnd.choice([-300, -3, -1, 1, 2, 90])
                    while run > 15:
                        out, run, place = out + ac[0xF0], run - 16, place + 16
                    out += ac[run << 4 | abs(x).bit_length()] + value(x)
                    place += run + 1
                out += ac[0] if place < 64 else ""
    return head + body + flush(out) + b"\xff\xd9"


#: A file made elsewhere: the small picture of Python's own e-mail tests, if this Python has them.
def foreign_files():
    import test

    for folder in test.__path__:
        for x in ("test_email/data/python.jpg", "imghdrdata/python.jpg"):
            if os.path.exists(f"{folder}/{x}"):
                yield open(f"{folder}/{x}", "rb").read()


def test_thumbnails_of_foreign_files():
    rnd = random.Random(11)
    files = [made_jpeg(rnd, 61, 47, (2, 2), 0), made_jpeg(rnd, 33, 90, (2, 1), 3), made_jpeg(rnd, 8, 8, (1, 1), 0), *foreign_files()]
    for data, got in zip(files, op8_media._read(files), strict=True):
        h, image = got
        across, down = (1, 1) if len(h.scan) == 1 else (h.parts[0][1], h.parts[0][2])
        want = np.array(plain_dc(data)[h.scan[0][0]]).reshape(*h.units()[::-1], down, across).transpose(0, 2, 1, 3).reshape(image.shape)
        assert (image == np.clip(np.round(want * h.dc_quant[h.parts[0][3]] / 8 + 128), 0, 255)).all()


def test_damaged_files_are_null():
    rnd = random.Random(12)
    good = made_jpeg(rnd, 61, 47, (2, 2), 4)
    bad = [good[:n] for n in range(0, 260, 7)] + [good.replace(b"\xff\xc0\0\x11\x08\0\x2f\0\x3d", b"\xff\xc0\0\x11\x08\xff\xff\xff\xff")]
    for _ in range(300):
        x = bytearray(good)
        x[rnd.randrange(len(x))] = rnd.randrange(256)
        bad.append(bytes(x))
    got = op8_media._read([*bad, good])
    assert got[-1] is not None and got[: len(range(0, 260, 7)) + 1] == [None] * (len(range(0, 260, 7)) + 1)
    zero = bytearray(good)
    zero[good.index(b"\xff\xc0") + 11] = 0
    assert op8_media._read([bytes(zero)]) == [None]


def test_long_payloads_are_several_images():
    payload = random.Random(13).randbytes(2 * jpeg.PART + 640)
    data = jpeg.store(payload)
    parts = jpeg.images(data)
    assert len(parts) == 3 and b"".join(parts) == data
    assert b"".join(jpeg.restore(h, x) for h, x in op8_media._read(parts)) == payload
