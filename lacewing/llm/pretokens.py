"""Where a fast cut into pre-tokens may stand in for the tokenizers library's own.

The library's normaliser and pre-tokenizer are exact but slow from Python, and
another regular-expression engine knows other versions of the Unicode tables.
Both cut by the class of each character alone, so characters are compared one
by one, when they first occur: a text whose characters all agree takes the fast
cut, any other text the library's.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

#: What each character is tried between: letters, digits, punctuation, spaces and itself.
_PROBES = ("a{0}", "a{0}a", "1{0}1", "!{0}!", " {0} ", "{0}{0}a", "'{0}")


def composes(c: str) -> bool:
    """Could normalisation join this character to its neighbours, or make several of it?"""
    if c.isascii():
        return False
    code = ord(c)
    jamo = 0x1100 <= code <= 0x11FF or 0xA960 <= code <= 0xA97F or 0xD7B0 <= code <= 0xD7FF
    # marks compose with what stands before them; unassigned here may be marks elsewhere
    return jamo or unicodedata.combining(c) != 0 or unicodedata.category(c)[0] == "M" or unicodedata.category(c) == "Cn" or len(c.lower()) != 1 or unicodedata.normalize("NFC", c) != c


class Agreement:
    """The characters on which both cuts agree, found as they occur."""

    def __init__(self, fast: Callable[[str], list[str]], library: Callable[[str], list[str]], odd: Callable[[str], bool] = lambda c: False):
        self.fast, self.library, self.is_odd = fast, library, odd
        self.sure: set[str] = set()
        self.odd: set[str] = set()
        self.ascii = self.covers("".join(map(chr, range(128))))

    def _same(self, c: str) -> bool:
        return not self.is_odd(c) and all(self.fast(p.format(c)) == self.library(p.format(c)) for p in _PROBES)

    def covers(self, text: str) -> bool:
        """May the fast cut be used for this text?"""
        if text.isascii() and getattr(self, "ascii", False):
            return True
        chars = set(text)
        if chars <= self.sure:
            return True
        for c in chars - self.sure - self.odd:
            (self.sure if self._same(c) else self.odd).add(c)
        return chars <= self.sure
