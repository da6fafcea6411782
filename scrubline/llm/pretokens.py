"""Cutting text into pre-tokens, and caches of what is known of them.

A pre-token begins with at most one space, so a text may be cut before a space that has no white
space on both sides without changing its pre-tokens. Pieces between such spaces repeat much, and
are looked up whole; only new pieces are cut by the pattern.
"""

from __future__ import annotations

import re

import regex

_SPLIT_UNSAFE = re.compile(r"\s \s")


def pieces_of(text: str) -> list[str] | None:
    """The text cut at spaces, the first piece marked by a leading NUL as one without a space; None if that is unsafe."""
    if _SPLIT_UNSAFE.search(text) or "\x00" in text:
        return None
    parts = text.split(" ")
    parts[0] = "\x00" + parts[0]
    return parts


def spelled(piece: str) -> str:
    """The text of a piece, with its space if it has one."""
    return piece[1:] if piece[:1] == "\x00" else " " + piece


class Memo(dict):
    """A cache in two generations, of about ``limit`` entries at most: what isn't used in the newer one goes."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def wanted(self, keys) -> set:
        """The keys that are in neither generation; those in the older one are brought over."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        new = {k for k in set(keys) if k not in self}
        for k in new & self.old.keys():
            self[k] = self.old[k]
            new.remove(k)
        return new


# The classes of the pattern among the first 256 characters.
_LATIN = {r"\p{L}": "a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", r"\p{N}": "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", r"\s": " \t-\r\u0085\u00a0"}


def _latin(pattern: str) -> str:
    """The pattern for texts of the first 256 characters, in classes that the standard library has."""
    out, inside = "", False
    for part in re.findall(r"\\p\{\w\}|\\[sS]|.", pattern):
        inside = part == "[" or inside and part != "]"
        kind = _LATIN.get(part.lower() if part == r"\S" else part)
        out += part if kind is None else f"[^{kind}]" if part == r"\S" else kind if inside else f"[{kind}]"
    return out


def cutter(pattern: str):
    """The pattern's findall; texts of the first 256 characters go to the standard library, which is faster."""
    whole, latin = regex.compile(pattern), re.compile(_latin(pattern))

    def cut(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return whole.findall(text)
        return latin.findall(text)

    return cut
