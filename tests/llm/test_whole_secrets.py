"""A secret is found at every place, however often its wrapping stands in the text, and in every member of packed data."""

import base64
import bz2
import gzip
import lzma
import random
import urllib.parse
import zlib

from lodeworks.llm import secrets

KEY = 'password = "abcdef0123456789"'


def test_nested_secrets_that_repeat():
    once = base64.b64encode(KEY.encode()).decode()
    wraps = [base64.b64encode(once.encode()).decode(), base64.b64encode(urllib.parse.quote(KEY, safe="").replace("a", "%61").encode()).decode(), base64.b64encode(gzip.compress(base64.b64encode(once.encode()))).decode()]
    for w in wraps:
        for mark in ("", " %41 ", " %2541 "):
            text = f"first {w} then{mark} {w} and {w}."
            places = [i for i in range(len(text)) if text.startswith(w, i)]
            assert secrets.worklist(text) == [(0, i, i + len(w)) for i in places] and len(places) == 3


def test_all_members():
    for pack in (gzip.compress, bz2.compress, lzma.compress):
        w = base64.b64encode(pack(b"nothing in here\n") + pack(KEY.encode())).decode()
        assert secrets.worklist(f"x {w} y") == [(0, 2, 2 + len(w))]
        w = base64.b64encode(pack(KEY.encode()) + b"rest").decode()
        assert secrets.worklist(w) == [(0, 0, len(w))]


def test_any_depth_of_packing():
    raw = KEY.encode()
    for n in range(40):
        raw = (gzip.compress, zlib.compress, bz2.compress, lzma.compress)[n % 4](raw)
    w = base64.b64encode(raw).decode()
    assert secrets.worklist(f"x {w} y") == [(0, 2, 2 + len(w))]
    for _ in range(12):
        w = base64.b64encode(w.encode()).decode()
    assert secrets.worklist(w) == [(0, 0, len(w))]


def test_wrapped_base64():
    text = "the settings of the service are " + KEY + " and nothing else is to be told of them here"
    plain = base64.b64encode(text.encode()).decode()
    for size in (44, 60, 64, 76):
        for end in ("\n", "\r\n", "\n    "):
            w = end.join(plain[i : i + size] for i in range(0, len(plain), size))
            for before, after in (("body:\n", "\n"), ('"', '",'), ("", "\nNext words are prose")):
                assert secrets.worklist(before + w + after) == [(0, len(before), len(before) + len(w))], (size, end, before)
    lines = "\n".join("A" * 64 for _ in range(3))
    assert secrets.worklist(lines) == []


def test_content_beyond_a_piece(monkeypatch):
    """Data larger than a piece is read to its end, in every form and depth, and every cut between pieces is seen through."""
    monkeypatch.setattr(secrets, "PIECE", 1000)
    monkeypatch.setattr(secrets, "OVERLAP", 100)
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress):
        for lead in range(5_950, 6_050, 7):
            data = b"plain words\n" * (lead // 12) + b" " * (lead % 12) + KEY.encode() + b"\nmore words" * 300
            for raw in (pack(data), gzip.compress(pack(data)), pack(b"first member ") + pack(data)):
                w = base64.b64encode(raw).decode()
                assert secrets.worklist(f"x {w} y") == [(0, 2, 2 + len(w))], (pack, lead)
    assert secrets.hidden(base64.b64encode(gzip.compress(b"plain words\n" * 2000)).decode()) == frozenset()


def test_self_reproducing_data_ends(monkeypatch):
    class Same:
        eof, unused_data, unconsumed_tail = False, b"", b""

        def decompress(self, raw, most):
            self.eof = True
            return raw

    monkeypatch.setattr(secrets, "_opened", lambda raw: Same() if raw.startswith(b"loop") else None)
    assert b"".join(secrets.content(b"loop forever")) == b"loop forever"


def brute(text):
    """All layers with their spans by plain recursion."""
    found = set()

    def below(t, span):
        found.update((k, *span) for k, _, _ in secrets.scan(t))
        plain = secrets.ESCAPES.sub(lambda m: secrets.meant(m[0]) or m[0], t)
        if plain != t:
            below(plain, span)
        for m in secrets.BASE64.finditer(t):
            for x in secrets.decoded(m[0]):
                below(x, span)

    for k, s, e in secrets.scan(text):
        found.add((k, s, e))
    for m in secrets.BASE64.finditer(text):
        for x in secrets.decoded(m[0]):
            below(x, m.span())
    return sorted(found, key=lambda x: (x[1], x[0], x[2]))


def test_random_nests_against_recursion():
    rng = random.Random(5)
    wraps = [lambda b: base64.b64encode(b), lambda b: base64.b64encode(gzip.compress(b)), lambda b: base64.b64encode(lzma.compress(b)), lambda b: urllib.parse.quote_from_bytes(b).replace("e", "%65").encode(), lambda b: b"see " + b + b" and " + b]
    keys = [KEY, "AKIA" + "Q7" * 8, "0f" * 16, "no secret in this one"]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            b = rng.choice(keys).encode()
            for _ in range(rng.randrange(5)):
                b = rng.choice(wraps)(b)
            parts.append(base64.b64encode(b).decode() if rng.random() < 0.7 else rng.choice(keys))
        text = " word ".join(parts + parts[:1])
        assert secrets.worklist(text) == brute(text), text


def test_other_encodings_and_unmarked_data(monkeypatch):
    """Text in UTF-16 with and without mark, raw deflate data, octal escapes, and these inside each other."""
    b64 = lambda raw: base64.b64encode(raw).decode()
    flat = lambda raw: (c := zlib.compressobj(9, zlib.DEFLATED, -15)).compress(raw) + c.flush()
    wraps = [b64(KEY.encode(x)) for x in ("utf-16", "utf-16-le", "utf-16-be")] + [b64(b"\xfe\xff" + KEY.encode("utf-16-be")), b64(flat(KEY.encode())), b64(flat(KEY.encode("utf-16"))), b64(flat(gzip.compress(KEY.encode()))), b64(gzip.compress(b64(flat(KEY.encode())).encode()))]
    for w in wraps:
        assert secrets.worklist(f"x {w} y") == [(0, 2, 2 + len(w))]
    octal = "".join(f"\\{b:03o}" for b in b"pass") + 'word = "abcdef0123456789"'
    assert secrets.worklist(f"x {octal} y") == [(0, 2, 1 + len(octal))]
    w = b64(octal.encode("utf-16-le"))
    assert secrets.worklist(w) == [(0, 0, len(w))]
    monkeypatch.setattr(secrets, "PIECE", 500)
    w = b64(flat(b"plain words and nothing else in here. " * 100 + KEY.encode()))
    assert secrets.worklist(w) == [(0, 0, len(w))]
    rng = random.Random(1)
    assert not any(secrets.worklist(b64(rng.randbytes(rng.randrange(12, 60)))) for _ in range(2000))
