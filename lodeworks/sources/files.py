"""Files as a source: scan, ignore rules, content types, stable reads."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HIDDEN = (".DS_Store", "Thumbs.db")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, relative_path, filename, size, modified_at, sha256, content) of the regular files below ``root``."""
    t = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # Paths come qualified, so the root is told from its own name further down by its whole path.
    path = spark._jvm.org.apache.hadoop.fs.Path(root.rstrip("/") or "/")
    base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/") + "/"
    rel = F.when(F.startswith("path", F.lit(base)), F.substr("path", F.lit(len(base) + 1))).otherwise(F.element_at(F.split("path", "/"), -1))
    name = F.element_at(F.split("path", "/"), -1)
    t = t.select("path", rel.alias("relative_path"), name.alias("filename"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), F.sha2("content", 256).alias("sha256"), "content")
    return t.filter(~F.col("filename").isin(*HIDDEN) & ~F.startswith("filename", F.lit("._")))


def unstable(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose size or time changed between two listings, or that are gone: their reads are put off."""
    same = after.select(F.col("path").alias("_p"), F.col("size").alias("_s"), F.col("modified_at").alias("_m"))
    still = (F.col("path") == F.col("_p")) & (F.col("size") == F.col("_s")) & (F.abs(F.unix_millis("modified_at") - F.unix_millis("_m")) <= 1)
    return before.join(same, still, "left_anti").select("path")


# -- ignore rules -----------------------------------------------------------------------


def _glob(segment: str) -> str:
    """A segment's pattern as a regular expression: * ? and classes stay inside the segment."""
    out, i = "", 0
    while i < len(segment):
        c = segment[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            end = segment.find("]", i + 2)
            if end < 0:
                raise ValueError(f"a class is not closed in {segment!r}")
            body = segment[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "^!" else body).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += re.escape(segment[i + 1] if c == "\\" and i + 1 < len(segment) else c)
            i += c == "\\"
        i += 1
    return out


def _segment(segment: str) -> str:
    """As ``_glob``, or the stem as written and the suffix from the first dot on in either case."""
    stem, dot, suffix = segment.partition(".")
    return f"(?:{_glob(segment)}|{_glob(stem)}(?i:{_glob(dot + suffix)}))" if dot else _glob(segment)


def ignore_patterns(rules: Sequence[str]) -> list[tuple[bool, str]]:
    """(includes again, regular expression over a relative path) of each rule, in order."""
    out = []
    for raw in rules:
        p = raw.strip()
        again = p.startswith("!")
        p = p[1:].strip() if again else p
        below = p.endswith("/")
        p = p.removesuffix("/")
        if not p:
            raise ValueError(f"ignore rule {raw!r} has no pattern")
        parts = p.split("/")
        if len(parts) == 1:
            body = "(?:.*/)?" + _segment(p)
        else:
            body = ""
            for k, part in enumerate(parts):
                last = k == len(parts) - 1
                body += (".+" if last else "(?:[^/]+/)*") if part == "**" else _segment(part) + ("" if last else "/")
        out.append((again, f"^{body}/.+$" if below else f"^{body}$"))
    return out


def ignored(path: Column, rules: Sequence[str]) -> Column:
    """Whether a relative path is left out; of the rules that match, the last decides."""
    verdict = F.lit(False)
    for again, pattern in ignore_patterns(rules):
        verdict = F.when(F.rlike(path, F.lit(pattern)), F.lit(not again)).otherwise(verdict)
    return verdict


def ignored_member(name: Column, rules: Sequence[str]) -> Column:
    """For members of containers only rules on bare names apply."""
    return ignored(name, [r for r in rules if "/" not in r])


# -- content types ----------------------------------------------------------------------

#: Suffixes of text that is not written for readers, and of formats built on zip and gzip (fixed values).
TEXT_FORMATS = (
    ".log", ".c", ".h", ".cc", ".cpp", ".cxx", ".hh", ".hpp", ".hxx", ".m", ".mm", ".go", ".py", ".rb", ".pl", ".pm", ".php", ".java", ".kt", ".kts",
    ".scala", ".swift", ".cs", ".js", ".mjs", ".cjs", ".ts", ".tsx", ".jsx", ".rs", ".lua", ".sh", ".bash", ".zsh", ".ps1", ".bat", ".cmd", ".sql",
    ".css", ".scss", ".sass", ".less", ".vue", ".r", ".dart", ".groovy", ".gradle", ".asm", ".s", ".json", ".jsonl", ".ndjson", ".xml", ".xsd",
    ".xsl", ".xslt", ".wsdl", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".plist", ".properties", ".lock", ".map", ".har",
)
ZIP_FORMATS = (
    ".epub", ".pages", ".numbers", ".key", ".pkpass", ".jar", ".war", ".ear", ".apk", ".aab", ".ipa", ".xpi", ".crx", ".vsix", ".whl", ".nupkg",
    ".sketch", ".kmz", ".cbz", ".3mf", ".appx", ".msix", ".xap",
)
GZIP_FORMATS = (".emz", ".wmz", ".svgz")
IMAGE_MAGIC = {"89504e470d0a1a0a": "image/png", "ffd8ff": "image/jpeg", "47494638": "image/gif", "424d": "image/bmp", "49492a00": "image/tiff", "4d4d002a": "image/tiff"}
HEADER_BYTES = 64 << 10


def _suffixed(name: Column, suffixes: Sequence[str]) -> Column:
    """The name ends in one of the suffixes, in any case and ahead of rotation numbers."""
    plain = F.regexp_replace(F.lower(name), r"(?:\.[0-9]+)+$", "")
    return F.rlike(plain, F.lit("(?:" + "|".join(map(re.escape, suffixes)) + ")$")) | F.rlike(F.lower(name), F.lit("(?:" + "|".join(map(re.escape, suffixes)) + ")$"))


def email_like(content: Column) -> Column:
    """The header block names a sender, a subject or date, and an id, a trace or a MIME version."""
    head = F.decode(F.substr(content, F.lit(1), F.lit(HEADER_BYTES)), "ISO-8859-1")
    block = F.element_at(F.split(head, r"(?m)^\r?$", 2), 1)
    has = lambda *names: F.rlike(block, F.lit("(?im)^(?:" + "|".join(names) + "):"))
    return has("from") & has("subject", "date") & has("message-id", "received", "mime-version")


def classify(content: Column, name: Column) -> Column:
    """(doc_type, subtype, declined) from the bytes; the name only refuses formats that bytes cannot tell."""
    starts = lambda h: F.startswith(F.hex(F.substr(content, F.lit(1), F.lit(16))), F.lit(h.upper()))
    inside = lambda s: F.contains(F.decode(F.substr(content, F.lit(1), F.lit(1 << 16)), "ISO-8859-1"), F.lit(s))
    image = F.lit(False)
    for h in IMAGE_MAGIC:
        image = image | starts(h)
    zipped, gzipped = starts("504b0304"), starts("1f8b")
    is_text = (F.octet_length(content) > 0) & F.is_valid_utf8(F.substr(content, F.lit(1), F.lit(1 << 20)).cast("string")) & (F.position(F.lit("\0"), F.decode(F.substr(content, F.lit(1), F.lit(1 << 16)), "ISO-8859-1")) == 0)
    route = lambda t, sub="", no=False: F.struct(F.lit(t).alias("doc_type"), F.lit(sub).alias("subtype"), F.lit(no).alias("declined"))
    return (
        F.when(starts("255044462d"), route("pdf")).when(email_like(content), route("email"))
        .when(zipped & inside("word/"), route("office", "docx")).when(zipped & inside("xl/"), route("office", "xlsx"))
        .when(zipped & inside("ppt/"), route("office", "pptx")).when(zipped & inside("mimetypeapplication/vnd.oasis.opendocument.text"), route("office", "odt"))
        .when(zipped & ~inside("mimetypeapplication/") & ~_suffixed(name, ZIP_FORMATS), route("archive"))
        .when(gzipped & ~_suffixed(name, GZIP_FORMATS), route("archive"))
        .when(starts("425a68") | starts("377abcaf271c") | (F.hex(F.substr(content, F.lit(258), F.lit(5))) == "7573746172"), route("archive"))
        .when(starts("7b5c727466"), route("office", "rtf")).when(image, route("image"))
        .when(starts("d0cf11e0a1b11ae1"), route("legacy-office", "", True))
        .when(is_text & ~_suffixed(name, TEXT_FORMATS), route("text")).otherwise(route("unsupported", "", True))
    )


def matches(path: str, rules: Sequence[str]) -> bool:
    """The same verdict for one path, on the driver."""
    out = False
    for again, pattern in ignore_patterns(rules):
        if re.match(pattern, path):
            out = not again
    return out
