"""Mail, archives and office files as sources: bytes in, texts and members out.

Parsers see one file at a time inside ``mapInPandas``; nesting is unrolled by
rounds over a frontier of members, each known by the hash of its bytes.
"""

from __future__ import annotations

import email
import email.header
import email.policy
import hashlib
import io
import re
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from email.utils import getaddresses, parsedate_to_datetime
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.functions.text import html_text
from lodeworks.operators.tables import stored
from lodeworks.sources.names import decode_names
from lodeworks.vocabulary import MAX_DEPTH

MAX_MEMBERS, MAX_RATIO, MAX_BYTES = 2000, 100, 512 << 20


class Declined(ValueError):
    """Content that no reader takes; the message is a reason of the vocabulary."""


@dataclass
class Member:
    selector: str
    filename: str
    content: bytes


@dataclass
class Message:
    body: str
    headers: dict[str, str]
    members: list[Member] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def decode_text(raw: bytes, declared: str | None = None) -> tuple[str, str]:
    """(text, note): UTF-8, then a byte-order mark, then the declared name, then Russian if it reads so, then replacement."""
    try:
        return raw.decode("utf-8-sig"), ""
    except UnicodeDecodeError:
        pass
    for mark, name in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if raw.startswith(mark):
            return raw[2:].decode(name, "replace"), f"bom:{name}"
    if declared:
        try:
            return raw.decode(declared), f"declared:{declared.lower()}"
        except (UnicodeDecodeError, LookupError):
            pass
    best = max(("windows-1251", "koi8-r"), key=lambda n: russian_share(raw.decode(n, "replace")))
    if russian_share(raw.decode(best, "replace")) >= 0.7:
        return raw.decode(best, "replace"), f"detected:{best}"
    return raw.decode("utf-8", "replace"), "replaced"


def plain_text(raw: bytes, declared: str | None = None) -> tuple[str, str]:
    """(text, note) of a plain-text file; one with NUL bytes is no text."""
    text, note = decode_text(raw, declared)
    if "\0" in text:
        raise Declined("NUL_BYTES")
    return text, note


def russian_share(text: str) -> float:
    """The part of letters beyond ASCII that stand in lower-case-led Cyrillic words."""
    words = re.findall(r"[^\W\d_]+", text)
    every = sum(1 for w in words for c in w if ord(c) > 127)
    good = sum(len(w) for w in words if re.fullmatch(r"[А-Яа-яЁё]?[а-яё]+", w))
    return good / every if every else 0.0


FIELD = re.compile(rb"[!-9;-~]+[ \t]*:")


def repaired(raw: bytes) -> bytes:
    """A message whose header lines are all fields or their continuations.

    A line that is neither belongs to the field before it if more fields follow;
    otherwise the body begins there, and the blank line that should stand before it is put in.
    """
    lines = raw.split(b"\n")
    end = next((n for n, x in enumerate(lines) if not x.strip()), len(lines))
    sound = [bool(FIELD.match(x)) or (n == 0 and x.startswith(b"From ")) for n, x in enumerate(lines[:end])]
    last = max((n for n, ok in enumerate(sound) if ok), default=-1)
    out = []
    for n, x in enumerate(lines[:end]):
        if sound[n] or (x[:1] in (b" ", b"\t") and n > 0):
            out.append(x)
        elif n < last and out:
            out.append(b" " + x)
        else:
            return b"\n".join([*out, b"", *lines[n:]])
    return b"\n".join(out + lines[end:])


def read_message(raw: bytes) -> Message:
    """The body (plain text first, else the first HTML), headers with names in lower case, and attachments."""
    fixed = repaired(raw)
    parsed = email.message_from_bytes(fixed, policy=email.policy.compat32)
    headers: dict[str, str] = {}
    out = Message("", headers, warnings=["header_repaired"] if fixed != raw else [])
    for k, v in parsed.raw_items():
        v = re.sub(r"\r?\n[ \t]+", " ", v)
        if (eight := v.encode("ascii", "surrogateescape")).isascii():
            headers.setdefault(k.lower(), _words(v))
        else:
            # Bytes beyond ASCII that no encoded word declares.
            text, note = decode_text(eight)
            headers.setdefault(k.lower(), _words(text))
            if note:
                out.warnings.append(f"header_{note.split(':')[0]}")
    html_body, plain = None, []
    n = 0
    for part in _own_parts(parsed):
        if part.is_multipart() and part.get_content_type() != "message/rfc822":
            continue
        if part is not parsed and part.get_content_type() == "message/rfc822":
            inner = part.get_payload()
            n += 1
            out.members.append(Member(f"mime-v1:{n}", _words(part.get_filename() or "message.eml"), b"".join(p.as_bytes() for p in inner)))
            continue
        data = part.get_payload(decode=True) or b""
        name = part.get_filename()
        if part.get_content_maintype() == "text" and not name:
            text, note = decode_text(data, part.get_content_charset())
            if note == "replaced":
                out.warnings.append("charset_replaced")
            if part.get_content_subtype() == "html":
                html_body = text if html_body is None else html_body
            else:
                plain.append(text)
        elif data:
            n += 1
            out.members.append(Member(f"mime-v1:{n}", last_part(_words(name or "attachment")), data))
    out.body = "\n".join(plain) if any(p.strip() for p in plain) else html_text(html_body) or ""
    return out


def _own_parts(message) -> Iterator:
    """The parts of a message, without those inside attached messages."""
    yield message
    if message.is_multipart() and message.get_content_type() != "message/rfc822":
        for part in message.get_payload():
            yield from _own_parts(part)


def _words(value: str) -> str:
    """Encoded words decoded; what does not decode stays."""
    try:
        return str(email.header.make_header(email.header.decode_header(value)))
    except (ValueError, LookupError):
        return value


def last_part(name: str) -> str:
    return name.replace("\\", "/").rsplit("/", 1)[-1]


def mailboxes(value: str | None) -> list[tuple[str, str, bool]]:
    """(address, display name, valid) in order; a broken one keeps its place."""
    out = []
    for name, address in getaddresses([value or ""]):
        ok = bool(re.fullmatch(r"[^\s@<>]+@[^\s@<>]+", address))
        if address or name:
            out.append((address.strip().lower() if ok else address, name, ok))
    return out


def identifiers(value: str | None) -> list[str]:
    """Message ids in order, without repeats: in angle brackets as written, else between spaces and commas."""
    found = re.findall(r"<([^<>]*)>|([^<>\s,]+)", value or "")
    ids = [(a or b).strip() for a, b in found]
    return list(dict.fromkeys(x for x in ids if re.fullmatch(r"[^\s<>]+@[^\s<>]+", x)))


def sent_at(value: str | None) -> pd.Timestamp | None:
    try:
        t = parsedate_to_datetime(value)
        return pd.Timestamp(t).tz_convert(None) if t.tzinfo else pd.Timestamp(t)
    except (TypeError, ValueError, IndexError):
        return None


#: The zip flag of names in UTF-8, and the extra field that repeats a name in UTF-8 with a checksum of the plain one (fixed values).
UTF8_FLAG, UNICODE_PATH = 0x800, 0x7075


def zip_name(info: zipfile.ZipInfo) -> bytes | str:
    """A member's name as text where the archive says how to read it, else its bytes."""
    if info.flag_bits & UTF8_FLAG:
        return info.orig_filename
    raw, extra = info.orig_filename.encode("cp437"), info.extra
    while len(extra) >= 4:
        kind, size = struct.unpack_from("<HH", extra)
        field, extra = extra[4 : 4 + size], extra[4 + size :]
        # A name changed by a tool that left the field alone has another checksum.
        if kind == UNICODE_PATH and len(field) == size > 5 and field[0] == 1 and struct.unpack_from("<I", field, 1)[0] == zlib.crc32(raw):
            try:
                return field[5:].decode()
            except UnicodeDecodeError:
                return raw
    return raw


def member_names(names: list[bytes | str]) -> list[str]:
    """Texts as they are; the others are decoded together, for a container has one charset."""
    found = iter(decode_names([n for n in names if isinstance(n, bytes)])[0])
    return [next(found) if isinstance(n, bytes) else n for n in names]


def unroll(raw: bytes) -> list[Member]:
    """Regular members of a zip, a tar or a gzipped tar, within bounds on number and expansion."""
    bound = min(MAX_BYTES, MAX_RATIO * max(1, len(raw)))
    if raw[:4] == b"PK\x03\x04":
        try:
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                infos = [i for i in z.infolist() if not i.is_dir()]
                if len(infos) > MAX_MEMBERS or sum(i.file_size for i in infos) > bound:
                    raise Declined("ARCHIVE_TOO_LARGE")
                if any(i.flag_bits & 1 for i in infos):
                    raise Declined("ARCHIVE_ENCRYPTED")
                names = member_names([zip_name(i) for i in infos])
                return [Member(f"zip-v1:{n}", last_part(name), z.read(i)) for n, (name, i) in enumerate(zip(names, infos, strict=True), 1)]
        except NotImplementedError as e:
            raise Declined("UNSUPPORTED_FORMAT") from e
        except (zipfile.BadZipFile, zlib.error, EOFError) as e:
            raise Declined("ARCHIVE_DAMAGED") from e
    if raw[:3] == b"BZh" or raw[:6] == b"7z\xbc\xaf\x27\x1c":
        raise Declined("UNSUPPORTED_FORMAT")
    try:
        if raw[:2] == b"\x1f\x8b":
            stream = zlib.decompressobj(31)
            raw = stream.decompress(raw, bound + 1)
            if len(raw) > bound:
                raise Declined("ARCHIVE_TOO_LARGE")
            if raw[257:262] != b"ustar":
                raise Declined("UNSUPPORTED_FORMAT")
        found, total = [], 0
        with tarfile.open(fileobj=io.BytesIO(raw), mode="r:", errors="surrogateescape", encoding="utf-8") as t:
            for n, i in enumerate(t, 1):
                total += i.size
                if n > MAX_MEMBERS or total > bound:
                    raise Declined("ARCHIVE_TOO_LARGE")
                if i.isreg():
                    found.append((n, i.name.encode("utf-8", "surrogateescape"), t.extractfile(i).read()))
        names = member_names([name for _, name, _ in found])
        return [Member(f"tar-v1:{n}", last_part(name), data) for name, (n, _, data) in zip(names, found, strict=True)]
    except (tarfile.TarError, zlib.error, EOFError) as e:
        raise Declined("ARCHIVE_DAMAGED") from e


def _texts(node: ElementTree.Element, leaf: str) -> str:
    return "".join(x.text or "" for x in node.iter() if x.tag.endswith("}" + leaf))


def _tag(node: ElementTree.Element) -> str:
    return node.tag.rsplit("}", 1)[-1]


def office_text(raw: bytes, kind: str) -> str:
    """Text of docx, xlsx, pptx, odt or rtf."""
    if kind == "rtf":
        return rtf_text(raw)
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        load = lambda n: ElementTree.fromstring(z.read(n))
        number = lambda n: int(re.search(r"(\d+)\.xml$", n)[1])
        if kind == "docx":
            return _blocks(next(x for x in load("word/document.xml") if _tag(x) == "body"))
        if kind == "odt":
            out = []
            for x in load("content.xml").iter():
                if _tag(x) in ("p", "h"):
                    out.append("".join(x.itertext()))
            return "\n".join(out)
        if kind == "pptx":
            out = []
            for n in sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number):
                k = number(n)
                out.append(f"# Slide {k}\n" + "\n".join(filter(None, (_texts(p, "t") for p in load(n).iter() if _tag(p) == "p"))))
                note = f"ppt/notesSlides/notesSlide{k}.xml"
                if note in names and (text := "\n".join(filter(None, (_texts(p, "t") for p in load(note).iter() if _tag(p) == "p")))):
                    out.append("Notes:\n" + text)
            return "\n\n".join(out)
        if kind == "xlsx":
            shared = [_texts(s, "t") for s in load("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
            titles = [s.get("name") for s in load("xl/workbook.xml").iter() if _tag(s) == "sheet"] if "xl/workbook.xml" in names else []
            out = []
            for k, n in enumerate(sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=number)):
                rows = []
                for row in (x for x in load(n).iter() if _tag(x) == "row"):
                    cells = [_cell(c, shared) for c in row if _tag(c) == "c"]
                    if any(c.strip() for c in cells):
                        rows.append("\t".join(cells))
                out.append("\n".join([f"# {titles[k] if k < len(titles) else n}", *rows]))
            return "\n\n".join(out)
    raise Declined("UNSUPPORTED_FORMAT")


def _cell(c: ElementTree.Element, shared: list[str]) -> str:
    if c.get("t") == "inlineStr":
        return _texts(c, "t")
    value = _texts(c, "v")
    return shared[int(value)] if c.get("t") == "s" and value.isdigit() and int(value) < len(shared) else value


def _blocks(body: ElementTree.Element) -> str:
    out = []
    for x in body:
        if _tag(x) == "p":
            out.append(_texts(x, "t"))
        elif _tag(x) == "tbl":
            for row in (r for r in x if _tag(r) == "tr"):
                out.append("\t".join(" ".join(_texts(p, "t") for p in c.iter() if _tag(p) == "p") for c in row if _tag(c) == "tc"))
    return "\n".join(out)


def rtf_text(raw: bytes) -> str:
    """Text of RTF: groups of tables and pictures left out, hex and Unicode escapes decoded."""
    s, out, stack, skip, uc = raw.decode("latin-1"), [], [], False, 0
    for m in re.finditer(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-f]{2})|\\([^a-z'])|([{}])|([^\\{}\r\n]+)", s, re.I):
        word, num, code, sign, brace, plain = m.groups()
        if brace == "{":
            stack.append(skip)
        elif brace == "}":
            skip = stack.pop() if stack else False
        elif sign == "*" or word in ("fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer"):
            skip = True
        elif skip:
            continue
        elif word in ("par", "line", "row"):
            out.append("\n")
        elif word in ("tab", "cell"):
            out.append("\t")
        elif word == "u" and num:
            out.append(chr(int(num) % 65536))
            uc = 1
        elif code:
            out.append("" if uc else bytes.fromhex(code).decode("windows-1252", "replace"))
            uc = 0
        elif sign in ("\\", "{", "}"):
            out.append(sign)
        elif plain:
            out.append(plain[uc:] if uc else plain)
            uc = 0
    return "".join(out).strip()


MEMBER_SCHEMA = "parent_sha string, selector string, filename string, sha256 string, content binary, reason string"


def members_of(files: DataFrame) -> DataFrame:
    """Members of ``files`` (sha256, doc_type, content); a container that is declined gives one row with its reason."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for sha, kind, raw in zip(p["sha256"], p["doc_type"], p["content"], strict=True):
                try:
                    found = read_message(bytes(raw)).members if kind == "email" else unroll(bytes(raw))
                    rows += [(sha, m.selector, m.filename, hashlib.sha256(m.content).hexdigest(), m.content, None) for m in found if m.content]
                except Declined as e:
                    rows.append((sha, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["parent_sha", "selector", "filename", "sha256", "content", "reason"])

    return files.filter("doc_type IN ('email', 'archive')").select("sha256", "doc_type", "content").mapInPandas(run, MEMBER_SCHEMA)


def unroll_all(files: DataFrame, classify, *, depth: int = MAX_DEPTH) -> DataFrame:
    """All members at any depth, as ``members_of``; bytes seen before are linked, not opened again.

    ``classify``: (content, name) to a column with doc_type.
    """
    every, frontier = None, files.select("sha256", "doc_type", "content").dropDuplicates(["sha256"])
    seen = frontier.select("sha256")
    for _ in range(depth):
        found = stored(members_of(frontier), "members")
        every = found if every is None else every.unionByName(found)
        new = found.filter("reason IS NULL").dropDuplicates(["sha256"]).join(seen, "sha256", "left_anti")
        frontier = stored(new.withColumn("doc_type", classify(F.col("content"), F.col("filename"))["doc_type"]).select("sha256", "doc_type", "content"), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier.select("sha256"))
    return every


MAIL_SCHEMA = (
    "sha256 string, subject string, message_id string, sent_at timestamp, list_id string, headers map<string,string>, body string, "
    "addresses array<struct<kind:string,ordinal:int,address:string,display_name:string,valid:boolean>>, references array<string>, warnings array<string>"
)


def messages(files: DataFrame) -> DataFrame:
    """Parsed mail of ``files`` (sha256, content)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for sha, raw in zip(p["sha256"], p["content"], strict=True):
                m = read_message(bytes(raw))
                h = m.headers
                boxes = [
                    {"kind": kind.replace("-", "_"), "ordinal": n, "address": a, "display_name": d, "valid": ok}
                    for kind in ("from", "to", "cc", "bcc", "reply-to") for n, (a, d, ok) in enumerate(mailboxes(h.get(kind)))
                ]
                ids = identifiers(h.get("message-id"))
                refs = list(dict.fromkeys(identifiers(h.get("in-reply-to")) + identifiers(h.get("references"))))
                notes = m.warnings + ([] if ids else ["missing_message_id"]) + ([] if sent_at(h.get("date")) is not None else ["missing_date"])
                rows.append((sha, h.get("subject", ""), ids[0] if ids else "", sent_at(h.get("date")), h.get("list-id", ""), h, m.body, boxes, refs, notes))
            yield pd.DataFrame(rows, columns=["sha256", "subject", "message_id", "sent_at", "list_id", "headers", "body", "addresses", "references", "warnings"])

    return files.select("sha256", "content").mapInPandas(run, MAIL_SCHEMA)


#: Bytes of contents whose results a worker hands on at once.
HELD_BYTES = 1 << 20


def _per_row(names: tuple[str, ...], read: Callable) -> Callable[..., Column]:
    """A column function that reads bytes, with a second argument, a batch of rows at a time; what is declined gives nulls and the reason."""

    def one(raw: bytes | None, x: str | None) -> tuple:
        if raw is None:
            return (None,) * len(names)
        try:
            return (*read(raw, x), None)
        except Declined as e:
            return (None,) * (len(names) - 1) + (str(e),)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.struct([(n, pa.string()) for n in names])
        for content, told in batches:
            # Rows go on as soon as they have some bytes, so that a worker holds no batch of results whole.
            rows, held = [], 0
            for n in range(len(content)):
                raw = content[n].as_py()
                rows.append(dict(zip(names, one(raw, told[n].as_py()), strict=True)))
                held += len(raw or b"")
                if held >= HELD_BYTES:
                    yield pa.array(rows, kind)
                    rows, held = [], 0
            if rows:
                yield pa.array(rows, kind)

    return F.arrow_udf(run, T.StructType([T.StructField(n, T.StringType()) for n in names]))


#: (text, note, reason) of plain-text bytes and a declared charset (or null).
decoded = _per_row(("text", "note", "reason"), plain_text)
#: (text, reason) of an office file's bytes and its kind.
office_texts = _per_row(("text", "reason"), lambda raw, kind: (office_text(raw, kind),))
