"""Words of a text as problem 8 counts them."""

from __future__ import annotations

import re
import sys
import unicodedata

_WORD = re.compile(r"[^\W_]+")
_INVISIBLE: dict[int, None] = {}


def words(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case, compatibility forms unified, invisible characters removed."""
    if not text:
        return []
    if not text.isascii():
        if not _INVISIBLE:
            _INVISIBLE.update((i, None) for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i)) == "Cf")
            _INVISIBLE.update((i, None) for i in (*range(0xFE00, 0xFE10), 0x034F))  # variation selectors, joiner
        text = unicodedata.normalize("NFKC", text.translate(_INVISIBLE))
    return _WORD.findall(text.lower())
