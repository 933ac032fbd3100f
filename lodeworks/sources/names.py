"""File names of container members whose charset nobody declared.

All names of a container are decoded together. A charset's merit is the share of
characters beyond ASCII that stand in words of one script and ordinary case. The best
one is taken if its merit is high and well above the next different reading;
otherwise what is not ASCII is replaced.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

#: Charsets in the order of preference among equals (fixed values).
CHARSETS = (
    "windows-1251", "koi8-r", "cp866", "iso8859-5", "mac-cyrillic", "windows-1252", "cp437", "cp850", "iso8859-1", "windows-1250", "gb18030", "big5",
    "shift_jis", "euc-jp", "euc-kr",
)
LEAST, MARGIN = 0.7, 0.15


def _script(c: str) -> str:
    return unicodedata.name(c, "?").split(" ")[0]


def merit(texts: Sequence[str]) -> float:
    good, every = 0.0, sum(1 for t in texts for c in t if ord(c) > 127)
    for w in (w for t in texts for w in re.findall(r"[^\W\d_]+", t)):
        foreign = sum(1 for c in w if ord(c) > 127)
        if len({_script(c) for c in w}) > 1:
            continue
        if w.islower() or w.isupper() or w.istitle():
            good += foreign
        elif w.lower() == w.upper():
            # Almost any bytes read as ideographs: a script without case is weaker evidence.
            good += 0.8 * foreign
    return good / every if every else 0.0


def decode_names(raw: Sequence[bytes], hint: str | None = None) -> tuple[list[str], str]:
    """The names and the charset (empty for UTF-8, ``replaced`` if none is trusted)."""
    try:
        return [r.decode() for r in raw], ""
    except UnicodeDecodeError:
        pass
    found: list[tuple[float, str, list[str]]] = []
    for name in dict.fromkeys([hint, *CHARSETS] if hint else CHARSETS):
        try:
            texts = [r.decode(name) for r in raw]
        except (UnicodeDecodeError, LookupError):
            continue
        if all(c.isprintable() for t in texts for c in t):
            found.append((merit(texts), name, texts))
    found.sort(key=lambda x: -x[0])
    if found:
        best = found[0]
        rest = [x[0] for x in found[1:] if x[2] != best[2]]
        if best[0] >= LEAST and best[0] - max(rest, default=0.0) >= MARGIN:
            return best[2], best[1]
    return ["".join(chr(b) if b < 128 else "�" for b in r) for r in raw], "replaced"
