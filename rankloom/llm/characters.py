"""Letters, numbers, white space and lower case as the tokenizers library knows them; ``regex`` and Python follow other versions of Unicode."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import regex
from tokenizers import Regex, normalizers, pre_tokenizers

OTHER, LETTER, NUMBER, SPACE = range(4)
#: What ``regex`` knows by the same class as the library, for each class.
STAND_INS = "\x00", "ª", "²", "\x85"
#: Code points from here on are of no class but OTHER in any version.
END = 0x40000


@cache
def _young() -> np.ndarray:
    """Which code points below ``END`` Unicode 3.2 doesn't assign; of all others, versions since tell the same."""
    return np.array([unicodedata.ucd_3_2_0.category(chr(c)) == "Cn" for c in range(END)] + [True])


def _has_young(text: str) -> bool:
    return not text.isascii() and bool(_young()[np.minimum(np.frombuffer(text.encode("utf-32-le"), "<u4"), END)].any())


_library = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str


def lowered(lines: str) -> str:
    """Canonical composition of each line, then lower case by character, so a capital sigma is small sigma wherever it stands."""
    if _has_young(lines):
        return "\n".join(_library(x) if _has_young(x) else lowered(x) for x in lines.split("\n"))
    return unicodedata.normalize("NFC", lines).replace("\N{GREEK CAPITAL LETTER SIGMA}", "\N{GREEK SMALL LETTER SIGMA}").lower()


@cache
def classes() -> np.ndarray:
    """The class of each code point below ``END``, and of all others at the end."""
    out = np.zeros(END + 1, np.uint8)
    points = np.r_[0:0xD800, 0xE000:END]
    text = "".join(map(chr, points.tolist()))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
            out[points[a:b]] = kind
    return out


@cache
def _stand_ins() -> dict[int, str]:
    """Stand-ins of the characters that ``regex`` puts into another class than the library."""
    points = np.r_[0:0xD800, 0xE000:END]
    text, theirs = "".join(map(chr, points.tolist())), np.zeros(END, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            theirs[points[m.start() : m.end()]] = kind
    wrong = np.flatnonzero(theirs != classes()[:END])
    return {c: STAND_INS[k] for c, k in zip(wrong.tolist(), classes()[wrong].tolist(), strict=True)}


def find(pattern: regex.Pattern, text: str) -> list[str]:
    """All matches of a pattern of classes, with the library's classes."""
    if not _has_young(text):
        return pattern.findall(text)
    return [text[m.start() : m.end()] for m in pattern.finditer(text.translate(_stand_ins()))]
