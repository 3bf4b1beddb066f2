"""Character classes shared by the text operators: look-alikes, invisible marks, odd spaces, level form.

All functions take and return Python strings; offsets are code points.
"""

from __future__ import annotations

import unicodedata

import numpy as np

# Letters of other scripts or alphabets that look like one Latin letter.
LOOKALIKES = {
    # Cyrillic, small
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "о": "o", "р": "p",
    "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ё": "ë", "ї": "ï", "м": "m", "п": "n",
    # Cyrillic, capital
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "Ӏ": "I", "М": "M", "О": "O",
    "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "У": "Y", "Ѵ": "V", "Ԝ": "W", "Х": "X", "Ё": "Ë", "Ї": "Ï",
    # Greek, small
    "α": "a", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ω": "w", "ό": "ó", "ά": "á", "ί": "í", "έ": "é", "ϲ": "c", "ϳ": "j",
    # Greek, capital
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Έ": "É",
    # Latin letters of phonetic alphabets, small capitals, dotless letters
    "ɑ": "a", "ɡ": "g", "ɩ": "i", "ı": "i", "ȷ": "j", "ʋ": "v", "ᴄ": "c", "ᴏ": "o", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w",
    "ᴢ": "z", "ꜱ": "s", "ɪ": "i",
    # Armenian
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "ք": "p", "զ": "q",
}

# Characters that show nothing and those that show a space.
INVISIBLE = frozenset(
    "­͏؜᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤"
    "⁦⁧⁨⁩︎️﻿"
)
SPACES = frozenset("               　")

_ASCII_LEVEL = {i: (chr(i).lower() if chr(i).isalnum() else None) for i in range(128)}


class _Level(dict):
    """Translation table of the level form, filled as characters turn up."""

    def __missing__(self, point: int) -> str | None:
        plain = unicodedata.normalize("NFKD", LOOKALIKES.get(chr(point), chr(point))).casefold()
        plain = unicodedata.normalize("NFKD", plain)
        out = "".join(LOOKALIKES.get(c, c) for c in plain if not unicodedata.combining(c))
        out = "".join(c for c in unicodedata.normalize("NFKD", out).casefold() if c.isalnum())
        self[point] = out or None
        return self[point]


_LEVEL = _Level(_ASCII_LEVEL)


def level(text: str | None) -> str:
    """``text`` without letter case, spacing, punctuation, accents and look-alike letters; null gives ''."""
    return text.translate(_LEVEL) if text else ""


_NONE, _NEW, _MANY = 0, -1, -2  # level forms of a character: none, not yet looked up, several characters
_ONE = np.full(0x110000, _NEW, dtype=np.int32)


def levels(texts: list[str | None]) -> list[str]:
    """``level`` of each text, for many at once."""
    return [t for at in range(0, len(texts), 256) for t in _levels(texts[at : at + 256])]


def _levels(texts: list[str | None]) -> list[str]:
    points = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = _ONE[points]
    if (new := points[out == _NEW]).size:
        for point in set(new.tolist()):
            plain = _LEVEL[point]
            _ONE[point] = _NONE if not plain else ord(plain) if len(plain) == 1 else _MANY
        out = _ONE[points]
    ends = np.cumsum([0, *(len(t or "") for t in texts)])
    many = set((np.searchsorted(ends, np.flatnonzero(out == _MANY), side="right") - 1).tolist())
    there = out != _NONE
    kept = np.concatenate([[0], np.cumsum(there)])[ends].tolist()
    flat = np.maximum(out[there], 0).tobytes().decode("utf-32-le", "surrogatepass")
    return [level(t) if i in many else flat[kept[i] : kept[i + 1]] for i, t in enumerate(texts)]
