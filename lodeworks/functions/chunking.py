"""Passages of a text with their exact byte ranges, and batches of passages for a model."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodeworks.vocabulary import BATCH_CHUNKS, BATCH_TOKENS, BOUNDARY_PART, CHUNK_CHARS, OVERLAP_CHARS


#: Characters of passages that a worker hands on at once.
HELD_CHARS = 1 << 20


def _starts(raw: bytes, at: int) -> int:
    """The next byte from ``at`` on that begins a character."""
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return min(at, len(raw))


def _forward(raw: bytes, at: int, chars: int) -> int:
    """Where ``chars`` characters from ``at`` end; characters have four bytes at most."""
    part = raw[at : at + 4 * chars]
    if part.isascii():
        return min(len(raw), at + chars)
    return at + len(part.decode(errors="ignore")[:chars].encode())


def _back(raw: bytes, at: int, chars: int) -> int:
    """Where the ``chars`` characters before ``at`` begin."""
    part = raw[max(0, at - 4 * chars) : at]
    if part.isascii():
        return max(0, at - chars)
    return at - len(part[_starts(part, 0) :].decode()[-chars:].encode())


def _break(raw: bytes, start: int, end: int) -> int:
    """The best place to end a window: after a paragraph, a line, a sentence or a word in its last part."""
    low = start + int((end - start) * (1 - BOUNDARY_PART))
    for mark in (b"\n\n", b"\n"):
        if (i := raw.rfind(mark, low, end)) >= 0:
            return _starts(raw, i + len(mark))
    sentence = max(raw.rfind(m, low, end) for m in (b".", b"!", b"?"))
    if 0 <= sentence and sentence + 1 < end:
        return _starts(raw, sentence + 1)
    if (i := raw.rfind(b" ", low, end)) >= 0:
        return _starts(raw, i + 1)
    return _starts(raw, end)


def split(text: str | None) -> Iterator[tuple[int, int, int, str]]:
    """(index, start, end, passage): bytes of the text as given; windows overlap and are measured in characters."""
    whole = (text or "").strip()
    if not whole:
        return
    base = len(text[: len(text) - len(text.lstrip())].encode())
    raw = whole.encode()
    start = index = 0
    while start < len(raw):
        last = _forward(raw, start, CHUNK_CHARS)
        end = last if last == len(raw) else _break(raw, start, last)
        window = raw[start:end].decode()
        passage = window.strip()
        if passage:
            lead = len(window[: len(window) - len(window.lstrip())].encode())
            begin = base + start + lead
            yield index, begin, begin + len(passage.encode()), passage
            index += 1
        if end >= len(raw):
            return
        back = _back(raw, end, OVERLAP_CHARS)
        start = back if back > start else end


def passages(batches: Iterator[pa.RecordBatch], own: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Passages of batches of keys and texts, handed on by their characters and not by the rows of a batch, so that a worker holds few of them."""
    names, types = ["k", "chunk_index", "start_byte", "end_byte", "chunk_text"], [own, pa.int32(), pa.int32(), pa.int32(), pa.string()]
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows, strict=True), types, strict=True)], names)
    rows, held = [], 0
    for b in batches:
        for n in range(b.num_rows):
            k = b.column(0)[n].as_py()
            for c in split(b.column(1)[n].as_py()):
                rows.append((k, *c))
                held += len(c[3])
                if held >= HELD_CHARS:
                    yield made(rows)
                    rows, held = [], 0
    if rows:
        yield made(rows)


def chunk(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_index, start_byte, end_byte, chunk_text) of every document."""
    t = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = t.schema["k"].dataType.simpleString()

    own = to_arrow_type(t.schema["k"].dataType)
    out = t.mapInArrow(lambda batches: passages(batches, own), f"k {kind}, chunk_index int, start_byte int, end_byte int, chunk_text string")
    return out.withColumnRenamed("k", key)


def batches(passages: Iterable[str]) -> Iterator[list[str]]:
    """Groups within both bounds; characters a token are learnt from ``send`` of each group's true tokens."""
    ratio, group, used = 1.3, [], 0.0
    for p in passages:
        cost = len(p or "") / ratio
        if group and (len(group) >= BATCH_CHUNKS or used + cost > BATCH_TOKENS):
            told = yield group
            if told:
                ratio = min(4.0, max(0.5, sum(map(len, group)) / told))
                cost = len(p) / ratio
            group, used = [], 0.0
        group.append(p)
        used += cost
    if group:
        yield group
