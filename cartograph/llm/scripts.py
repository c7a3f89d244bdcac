"""Words of texts in any script.

A word is a run of characters other than white space; but scripts that are written without
spaces between words (Han, Kana, Bopomofo, Yi, Thai, Lao, Tibetan, Burmese, Khmer and their
neighbours) would give one word a paragraph, so there each character is a word of its own.
"""

from __future__ import annotations

import re

#: Ranges of code points of scripts without spaces between words.
RANGES = [
    (0x0E00, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x2E80, 0x2FDF), (0x3005, 0x3007),
    (0x3021, 0x3029), (0x3040, 0x30FF), (0x3100, 0x312F), (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA4CF), (0xF900, 0xFAFF),
    (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF),
]
#: As a character class of Python's regular expressions, and of Java's.
UNSPACED = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in RANGES) + "]"
UNSPACED_JAVA = "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in RANGES) + "]"

_SOME, _WORD = re.compile(UNSPACED), re.compile(rf"{UNSPACED}|[^\s{UNSPACED[1:]}+")


def words_of(text: str) -> list[str]:
    if text.isascii() or not _SOME.search(text):
        return text.split()
    return _WORD.findall(text)
