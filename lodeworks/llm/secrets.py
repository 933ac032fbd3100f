"""Secret scans through layers of encoding.

A text is the first layer. A worklist holds layers; each is scanned for secrets,
and every part of it that decodes (percent escapes, backslash escapes in hexadecimal or
octal digits, HTML character escapes, base64 on one line or wrapped over lines of one
length, of text in UTF-8 or UTF-16, and gzip, zlib, bzip2 or xz data of any depth or raw
deflate data inside base64) makes a new layer, until no new one comes. Each layer carries the span of the original text behind every one of its
characters: by character for escapes, by the whole encoded part for base64 and
compressed data. All that lies below an encoded part has the part's span, so a part
gives a set of kinds, which is worked out once and told at every place where the part
stands; below a part no content is worked on twice, so no cycle is followed.

Compressed data is unpacked as a stream, so a small text cannot fill an executor:
content of over ``PIECE`` bytes is scanned in pieces that overlap by ``OVERLAP``
characters, so that beyond ``PIECE`` a secret or an inner encoded part is sure to be
seen whole only if it is no longer than that.

Defined results: null text is the empty text; an empty table gives an empty
result; repeated rows are answered alike; other columns are neither read nor
returned. Compressed data may have several members; broken or cut data gives what it
holds; xz data that asks for over ``XZ_MEMORY`` bytes of memory is not opened.
"""

from __future__ import annotations

import binascii
import bz2
import codecs
import hashlib
import html
import itertools
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
PIECE, OVERLAP, XZ_MEMORY = 16 << 20, 1 << 20, 256 << 20
#: Base64 on several lines: all but the last have one length, of at least this.
WRAP = 40

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: What every assign match holds in lower case; a cheap test before the full pattern.
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")

ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4})+|(?:\\x[0-9A-Fa-f]{2})+|(?:\\[0-3][0-7]{2})+|\\u\{[0-9A-Fa-f]{1,6}\}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&(?:quot|amp|lt|gt|apos);")
#: A base64 word: 16 characters or more, of which some are capitals or digits.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
MIXED = re.compile(r"[A-Z0-9]")
BREAK = re.compile(r"\r?\n[\x20\t]*")
#: What may end wrapped base64 on a line of its own, too short to be a word.
REST = re.compile(r"\r?\n[\x20\t]*([A-Za-z0-9+/_-]{1,15}={0,2})(?![^\s\"'<,;)])")
PRINTABLE = frozenset(range(32, 127)) | {9, 10, 13}

Span = tuple[int, int, int]


def scan(text: str, longest: int | None = None) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base matches: leftmost, not overlapping within a kind.

    ``longest``: the length of the longest run without white space, if known.
    """
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        found += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if longest is None or longest >= 32:
        found += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return found


class Layer:
    """A text and where it comes from: runs of (start in this text, start in the original, end in the original, by character)."""

    def __init__(self, text: str, runs: list[tuple[int, int, int, bool]]):
        self.text, self.runs, self.starts = text, runs, [r[0] for r in runs]

    def origin(self, start: int, end: int) -> tuple[int, int]:
        """The span of the original text behind ``start`` to ``end``, which is not empty."""
        a, lo, hi, each = self.runs[bisect_right(self.starts, start) - 1]
        first = lo + start - a if each else lo
        a, lo, hi, each = self.runs[bisect_right(self.starts, end - 1) - 1]
        return first, lo + end - a if each else hi


def meant(s: str) -> str | None:
    """What a run of character escapes stands for; null if it decodes to nothing else."""
    if s[0] == "%" or s[1].isdigit() and s[0] == "\\":
        raw = bytes.fromhex(s.replace("%", "")) if s[0] == "%" else bytes(int(x, 8) for x in s.split("\\")[1:])
        try:
            new = raw.decode()
        except UnicodeDecodeError:
            new = raw.decode("latin-1")
    elif s[0] == "&":
        new = html.unescape(s)
    elif s.startswith("\\u{"):
        code = int(s[3:-1], 16)
        new = chr(code) if code < 0x110000 else s
    elif s[1] == "u":
        new = b"".join(int(x, 16).to_bytes(2, "big") for x in s.split("\\u")[1:]).decode("utf-16-be", "replace")
    else:
        new = bytes.fromhex(s.replace("\\x", "")).decode("latin-1")
    if new == s or not new:
        return None
    return "".join("\ufffd" if 0xD800 <= ord(c) < 0xE000 else c for c in new)


def unescaped(layer: Layer) -> Layer | None:
    """The layer with its character escapes undone; null if it has none that decode."""
    out, runs, at, n = [], [], 0, 0
    if not any(x in layer.text for x in "%\\&"):
        return None
    for m in ESCAPES.finditer(layer.text):
        new = meant(m.group())
        if new is None:
            continue
        _kept(layer, at, m.start(), runs, n)
        out.append(layer.text[at : m.start()])
        n += m.start() - at
        lo, hi = layer.origin(m.start(), m.end())
        runs.append((n, lo, hi, False))
        out.append(new)
        n += len(new)
        at = m.end()
    if not at:
        return None
    _kept(layer, at, len(layer.text), runs, n)
    out.append(layer.text[at:])
    return Layer("".join(out), runs)


def _kept(layer: Layer, start: int, end: int, runs: list, n: int) -> None:
    """Carries the runs behind ``start`` to ``end`` over to the new layer at ``n``."""
    i = bisect_right(layer.starts, start) - 1
    while start < end:
        a, lo, hi, each = layer.runs[i]
        stop = min(end, layer.starts[i + 1] if i + 1 < len(layer.runs) else end)
        runs.append((n, lo + start - a, lo + stop - a, True) if each else (n, lo, hi, False))
        n, start, i = n + stop - start, stop, i + 1


def _opened(raw: bytes):  # noqa: ANN202
    """A decompressor for the member that ``raw`` starts with; null if it is in no known form."""
    if raw[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if raw[:1] == b"\x78" and len(raw) > 2 and (raw[0] * 256 + raw[1]) % 31 == 0:
        return zlib.decompressobj()
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if raw[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(memlimit=XZ_MEMORY)
    return None


def members(raw: bytes, more: Iterator[bytes]) -> Iterator[bytes]:
    """The data of all members of a stream that starts with ``raw``, in pieces of ``PIECE`` bytes at most."""
    while (d := _opened(raw)) is not None:
        while not d.eof:
            try:
                out = d.decompress(raw, PIECE)
            except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
                return
            if out:
                yield out
            # zlib hands back what it did not read, the others keep it.
            raw = getattr(d, "unconsumed_tail", b"")
            if not raw and not d.eof and getattr(d, "needs_input", len(out) < PIECE):
                raw = next(more, b"")
                if not raw:
                    return
        # Zeros may stand behind a member, and the next one's mark may come in parts.
        raw = d.unused_data.lstrip(b"\0")
        while len(raw) < 6 and (new := next(more, b"")):
            raw = (raw + new).lstrip(b"\0")


def content(raw: bytes) -> Iterator[bytes]:
    """``raw`` through all its layers of compression, in pieces; a layer that is its own ancestor ends the way down."""
    first, more, seen = raw, iter(()), set()
    while True:
        mark = hashlib.sha256(first).digest()
        if mark in seen or _opened(first) is None:
            return itertools.chain([first], more)
        seen.add(mark)
        more = members(first, more)
        # As much as a piece, so that the mark is that of the whole content where it is small.
        got = [next(more, b"")]
        while got[-1] and sum(map(len, got)) < PIECE:
            got.append(next(more, b""))
        first = b"".join(got)
        if not first:
            return iter(())


def inflated(raw: bytes) -> Iterator[bytes]:
    """Raw deflate data in pieces; it has no mark, so what does not start as such gives nothing."""
    d = zlib.decompressobj(-15)
    while raw and not d.eof:
        try:
            out = d.decompress(raw, PIECE)
        except zlib.error:
            return
        if not out:
            return
        yield out
        raw = d.unconsumed_tail


def _encoding(start: bytes) -> str:
    """By a mark, or by where the zeros of a text of mostly Latin letters stand; else UTF-8."""
    if start[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16-le" if start[0] == 255 else "utf-16-be"
    head = start[:512]
    even, odd, half = head[::2].count(0), head[1::2].count(0), len(head) // 2
    if half >= 4 and max(even, odd) > 0.4 * half and min(even, odd) < 0.1 * half:
        return "utf-16-be" if even > odd else "utf-16-le"
    return "utf-8"


def readable(pieces: Iterator[bytes]) -> Iterator[str]:
    """Pieces of text in UTF-8 or UTF-16 of which nearly all is printable, each after the end of the one before; stops where it is not."""
    piece, tail = next(pieces, b""), ""
    decoder = codecs.getincrementaldecoder(_encoding(piece))()
    while piece:
        after = next(pieces, b"")
        try:
            text = decoder.decode(piece, final=not after)
        except UnicodeDecodeError:
            return
        if sum(1 for c in text if c >= "\x80" or ord(c) in PRINTABLE) < 0.95 * len(text):
            return
        text = text.removeprefix("\ufeff")
        yield tail + text
        tail, piece = text[-OVERLAP:], after


def decoded(s: str) -> Iterator[str]:
    """The text in a base64 word, through any compression, in pieces; none if it does not decode."""
    body = s.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return iter(())
    try:
        raw = binascii.a2b_base64(body + "=" * (-len(body) % 4))
    except (binascii.Error, ValueError):
        return iter(())
    told = readable(content(raw))
    first = next(told, None)
    if first is not None:
        return itertools.chain([first], told)
    pieces = inflated(raw)
    start = next(pieces, b"")
    after = next(pieces, b"")
    return readable(itertools.chain([start, after], pieces) if after else content(start))


def _words(text: str) -> Iterator[tuple[int, int, str]]:
    """The base64 words of a text that may decode, as (start, end, word); of the readings of wrapped lines the first that decodes counts."""
    if not any(len(w) >= 16 and MIXED.search(w) for w in text.split()):
        return
    found = [(m.start(), m.end(), m.group()) for m in BASE64.finditer(text)]
    at = 0
    while at < len(found):
        size, last = len(found[at][2]), at
        while size >= WRAP and last + 1 < len(found) and len(found[last][2]) == size >= len(found[last + 1][2]) and found[last][2][-1] != "=" and BREAK.fullmatch(text, found[last][1], found[last + 1][0]):
            last += 1
        block = found[at : last + 1]
        word = "".join(w for _, _, w in block)
        ways = [(block[0][0], block[-1][1], word)] if last > at else []
        if size >= WRAP and len(block[-1][2]) == size and word[-1] != "=" and (rest := REST.match(text, block[-1][1])):
            ways.insert(0, (block[0][0], rest.end(1), word + rest[1]))
        if ways and (way := next((x for x in ways if any(True for _ in decoded(x[2]))), None)):
            yield way
        else:
            yield from (x for x in block if MIXED.search(x[2]))
        at = last + 1


def hidden(word: str) -> frozenset[int]:
    """The kinds of the secrets in all layers below a base64 word."""
    kinds, seen, todo = set(), set(), [decoded(word)]
    while todo:
        text = next(todo[-1], None)
        if text is None:
            todo.pop()
            continue
        if not text or (mark := hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()) in seen:
            continue
        seen.add(mark)
        kinds |= {k for k, _, _ in scan(text)}
        if any(x in text for x in "%\\&") and (plain := ESCAPES.sub(lambda m: meant(m[0]) or m[0], text)) != text:
            todo.append(iter([plain]))
        todo.append(itertools.chain.from_iterable(decoded(w) for _, _, w in _words(text)))
    return frozenset(kinds)


def worklist(text: str) -> list[Span]:
    """(kind, start, end) in the original of all secrets of all layers, without repeats, in order."""
    found, known = set(), {}
    layer = Layer(text, [(0, 0, len(text), True)])
    # Undoing escapes shortens a text, so this ends.
    while layer is not None and layer.text:
        found |= {(k, *layer.origin(s, e)) for k, s, e in scan(layer.text)}
        for start, end, word in _words(layer.text):
            if word not in known:
                known[word] = hidden(word)
            if known[word]:
                span = layer.origin(start, end)
                found |= {(k, *span) for k in known[word]}
        layer = unescaped(layer)
    return sorted(found, key=lambda x: (x[1], x[0], x[2]))


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def answer(text: str | None) -> tuple[int, int, int, str, str]:
    """The counts of base matches by kind, the digest of base spans, and all spans."""
    text = text or ""
    words = text.split()
    longest = max(map(len, words), default=0)
    base = sorted(scan(text, longest), key=lambda x: (x[1], x[0]))
    layered = any(x in text for x in "%\\&") or longest >= 16 and any(len(w) >= 16 and MIXED.search(w) for w in words)
    n = [sum(1 for x in base if x[0] == k) for k in range(len(KINDS))]
    every = worklist(text) if layered else base
    return *n, hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(every)


def scan_secrets(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_assign, n_access, n_hex, base_sha256 and spans."""
    t = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    kind = t.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [answer(x.as_py()) for x in b.column(1)]
            cols = [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(5)]
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, types, strict=True))], ["k", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    out = t.mapInArrow(run, f"k {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return out.withColumnRenamed("k", key)
