"""Text folding shared by the text operators: look-alike letters, markup, entities, hyphenation, case."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

# Letters of other scripts that look like Latin ones, and the Latin letter each is read as.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ё": "e", "ԁ": "d", "ɡ": "g", "ⅼ": "l", "ո": "n", "ѵ": "v", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ɑ": "a", "ı": "i", "ł": "l",
}
FOLD = str.maketrans(LOOKALIKES)
INVISIBLE = re.compile("[­͏᠎​-‏‪-‮⁠-⁤︀-️﻿]")
TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>|\[/?[A-Za-z]{1,10}\]")
LINE_QUOTE = re.compile(r"(?m)^[ \t]*(?:[>|]+[ \t]*)+")
HYPHEN = re.compile(r"[-‐‑‒–](?<=\w[-‐‑‒–])[ \t]*\r?\n\s*(?=\w)|[-‐‑'’ʼ`´](?<=\w[-‐‑'’ʼ`´])(?=\w)")
ACCENT = re.compile("[̀-̆̉-ͯ]")
WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case, compatibility forms, entities and tags resolved, quote marks, invisible signs and hyphenation removed, look-alikes as Latin."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text or "[" in text:
        text = TAG.sub(" ", text)
    if text.isascii():  # nothing to normalise, and no look-alikes
        return HYPHEN.sub("", LINE_QUOTE.sub("", text.lower()))
    text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    text = HYPHEN.sub("", LINE_QUOTE.sub("", text))
    text = ACCENT.sub("", unicodedata.normalize("NFD", text.casefold()))
    return unicodedata.normalize("NFC", text).translate(FOLD)


@lru_cache(maxsize=100_000)
def fold_word(word: str) -> str:
    return fold(word)


def words(text: str | None) -> list[str]:
    return WORD.findall(fold(text)) if text else []
