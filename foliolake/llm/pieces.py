"""Pre-tokens of texts, found with the standard library where that is safe.

Tokenizers of this kind encode each pre-token on its own, so a text's ids are those of
its pre-tokens in order. The expressions below hold for characters whose class is the
same in every Unicode version in use; texts with others take the tokenizer's own way."""

from __future__ import annotations

import re
import unicodedata

#: Beyond these the libraries' tables might differ: controls, U+0130 and all from U+0250.
_ODD = re.compile("[^\t-\r\x20-\x7e\xa0-įı-ɏ]")


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)


L, N, S = _class("L"), _class("N"), "\t-\r\x20\xa0"
_TAILS = "'(?:[stmd]|re|ve|ll)"


def _patterns(letters: str, numbers: str, blanks: str) -> tuple:
    """Byte-level: an optional blank before a run of one class. Word-level: runs of
    letters, single digits, runs of others; blanks are dropped. Letters come first, as
    most pre-tokens are such and no tail begins like them."""
    byte = f" ?[{letters}]+|{_TAILS}| ?[{numbers}]+| ?[^{blanks}{letters}{numbers}]+|[{blanks}]+(?![^{blanks}])|[{blanks}]+"
    word = f"[{letters}]+|{_TAILS}|[{numbers}]|[^{blanks}{letters}{numbers}]+"
    return re.compile(byte).findall, re.compile(word).findall


_BYTE, _WORD = _patterns(L, N, S)
_BYTE_ASCII, _WORD_ASCII = _patterns("A-Za-z", "0-9", "\t-\r ")


def byte_level(text: str) -> list[str]:
    return (_BYTE_ASCII if text.isascii() else _BYTE)(text)


def word_level(text: str) -> list[str]:
    return (_WORD_ASCII if text.isascii() else _WORD)(text)


_USUAL = bytes([*range(9, 14), *range(32, 127)])


def plain(text: str) -> bool:
    if text.isascii():
        return not text.encode().translate(None, _USUAL)
    return _ODD.search(text) is None


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself where it is visible,
    else the next free one from U+0100."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = [], 256
    for b in range(256):
        out.append(chr(b) if b in seen else chr(free))
        free += b not in seen
    return out


class Cache(dict):
    """Pre-token -> what it becomes. Of two generations the older one goes when the
    younger is full; entries that were asked for since are in the younger."""

    def __init__(self, most: int = 250_000):
        super().__init__()
        self.most, self.old = most, {}

    def missing(self, lists: list[list[str]]) -> list[str]:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        found = set().union(*lists).difference(self)
        again = found.intersection(self.old) if self.old else set()
        self.update({x: self.old[x] for x in again})
        return list(found - again)
