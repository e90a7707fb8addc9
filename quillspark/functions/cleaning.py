"""Cleaning of texts as plain Python: a table for characters, a bounded memo for words.

The regular expressions that built-in functions would need (``text.local_clean_inline``)
cost over a microsecond a character, most of it per match; here each character is one
table lookup and each word one dictionary lookup.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np

from . import words as W

#: Words that both families drop: letters mixed with digits, and one character that is no word.
NO_WORDS = "[0-9]+[a-z][a-z0-9']*|[a-z'][a-z0-9']*?[0-9][a-z0-9']*|[0-9][0-9']*'[0-9']*[a-z][a-z0-9']*|[b-hj-z0-9]"
_DROPPED, _SPELLED = 0, 1
_QUOTES = {"’": "'", "‘": "'", "“": '"', "”": '"'}
_COMMA = re.compile("(?<=[0-9]),(?=[0-9])")
_WE = re.compile("^(i am not scared(?: .*)?) we$")


def _folded(c: str) -> str:
    return c if c.isascii() else unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()


class _Memo(dict):
    """What a rule makes of each word; emptied when it is full, so memory is bounded."""

    def __init__(self, rule):
        self.rule = rule

    def __missing__(self, word: str) -> str:
        value = self.rule(word)
        if len(word) <= 40:
            if len(self) >= 200_000:
                self.clear()
            self[word] = value
        return value


class _Cleaner:
    """``spell``: what a character becomes; ``other``: the byte of characters beyond ASCII for which ``changes`` says nothing."""

    def __init__(self, spell, changes, other: int, kept: str, dropped: list[str], fused: dict[str, list[str]]):
        self.table, self.spelled = np.full(0x110000, other, dtype=np.uint8), {}
        beyond = (code for code in range(0x80, 0x110000) if changes(chr(code)))
        for code in [*range(0x80), *map(ord, _QUOTES), *beyond]:
            one = "".join(x if x in kept else " " for x in spell(chr(code)))
            if len(one) == 1:
                self.table[code] = ord(one)
            elif one:
                self.table[code], self.spelled[code] = _SPELLED, one
            else:
                self.table[code] = _DROPPED
        drops = re.compile("|".join([*dropped, NO_WORDS])).fullmatch

        def rule(word: str) -> str:
            bare = word.strip("'")
            return "" if drops(bare) else " ".join(fused[bare]) if bare in fused else bare

        self.memo = _Memo(rule)
        self.ascii = self.table[:256].tobytes()

    def plain(self, text: str) -> str:
        """Lower-case words, apart by spaces and (local) commas."""
        if text.isascii():
            return text.encode().translate(self.ascii).decode()
        codes = self.table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].tobytes()
        if b"\x01" in codes:
            return self.plain(text.translate(self.spelled))
        return codes.replace(b"\0", b"").decode()

    def words(self, text: str) -> str:
        return " ".join(filter(None, map(self.memo.__getitem__, text.split())))


@functools.cache
def _local() -> _Cleaner:
    spell = lambda c: _folded(_QUOTES.get(c, c)).lower()
    return _Cleaner(spell, unicodedata.decomposition, _DROPPED, "abcdefghijklmnopqrstuvwxyz0123456789' ,", W.LOCAL_IGNORE_WORDS, W.FUSED_TOKENS)


@functools.cache
def _legacy() -> _Cleaner:
    spell = lambda c: _QUOTES.get(c, c).lower()
    return _Cleaner(spell, lambda c: c.lower() != c, ord(" "), "abcdefghijklmnopqrstuvwxyz0123456789' ", [*W.LEGACY_IGNORE_WORDS, "[0-9]+"], {})


def local(text: str) -> str:
    """Accents folded, numbers kept: the words of a text, one space between them."""
    plain = _local().plain(text)
    if "," in plain:
        plain = _COMMA.sub("", plain).replace(",", " ")
    return _local().words(plain)


def legacy(text: str) -> str:
    """Accents split words, numbers go."""
    words = _legacy().words(_legacy().plain(text))
    return _WE.sub(r"\1", words) if words.endswith(" we") else words
