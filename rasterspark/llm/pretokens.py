"""Splitting of text before tokenisation, as two public vocabularies define it.

The patterns need Unicode property classes. Most text needs only what the built-in
``re`` module has, which is several times faster; a text with a character outside
that range goes to the ``regex`` module. Both paths give the same pieces.
"""

from __future__ import annotations

import re
from itertools import chain

import regex

_SPACE = r"\t-\r \x85\xa0  -     　"
#: Beyond these, \w, \d and \s of ``re`` and the Unicode classes L, N and White_Space differ or might.
_RARE = re.compile("[\x1c-\x1f\x85\xb2\xb3\xb9\xbc-\xbeɐ-\U0010ffff]")

_BYTE_LEVEL = re.compile(r" ?[^\W\d_]+| ?\d+|'(?:s|t|re|ve|m|ll|d)| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_BYTE_LEVEL_ANY = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_WORD_LEVEL = re.compile(r"[^\W\d_]+|\d|'(?:s|t|re|ve|m|ll|d)|(?:[^\s\w]|_)+")
_WORD_LEVEL_ANY = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")


def byte_level_pieces(text: str) -> list[str]:
    return (_BYTE_LEVEL_ANY if _RARE.search(text) else _BYTE_LEVEL).findall(text)


def word_level_pieces(text: str) -> list[str]:
    return (_WORD_LEVEL_ANY if _RARE.search(text) else _WORD_LEVEL).findall(text)


#: A space before more white space or at the end: only there can a space be inside a run that is a piece of its own.
_LOOSE = re.compile(r" (?:\s|\Z)")
_RUN = re.compile(r"\s{2,}")
_SEPARATORS = "\x1c\x1d\x1e\x1f"  # white space to ``re`` alone
#: Starts the name of a stretch that has no space before it.
PLACED = "\x1c"
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
#: Names of stretches that are one piece for certain.
WORD = rf"^\x1c?[{_LETTERS}]+$"
_MARKED = re.compile(rf"[{_LETTERS}]+[.,;:!?]")


def stretch_key(text: str) -> str:
    """A stretch's name: what follows its space, or the text behind a mark."""
    return text[1:] if text[:1] == " " and text[1:2] != PLACED else PLACED + text


def stretch_text(key: str) -> str:
    return key[1:] if key[:1] == PLACED else " " + key


def stretch_pieces(key: str) -> list[str]:
    """The names of a stretch's pieces, each a stretch of its own."""
    if _MARKED.fullmatch(key):
        return [key[:-1], PLACED + key[-1]]
    return list(map(stretch_key, byte_level_pieces(stretch_text(key))))


def is_plain(text: str) -> bool:
    """Whether a text's stretches are simply what lies between its spaces."""
    return not _LOOSE.search(text) and not any(c in text for c in _SEPARATORS)


def stretches(text: str) -> list[str]:
    """Names of parts of a text, such that the pieces of the parts, in turn, are the text's pieces.

    A part is what lies between single spaces, with the space before it. A run of white
    space is a part but for its last character, which goes with what follows if it is a
    space and is a part of its own otherwise; at the end of the text the run is one part.
    """
    if any(c in text for c in _SEPARATORS):
        return list(map(stretch_key, byte_level_pieces(text)))
    out, at = [], 0
    for m in chain(_RUN.finditer(text), [None]):
        a, b = m.span() if m else (len(text), len(text))
        out += (PLACED + text[at:a]).split(" ")
        at = b
        if b < len(text):
            out.append(PLACED + text[a : b - 1])
            if text[b - 1] == " ":
                at = b - 1
            else:
                out.append(PLACED + text[b - 1])
        elif a < b:
            out.append(PLACED + text[a:b])
    return [p for p in out if p != PLACED]


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in names:
            names[b] = chr(extra)
            extra += 1
    return [names[b] for b in range(256)]
