"""Word tables for executors: each distinct word is looked at once, texts become arrays of row numbers."""

from __future__ import annotations

import ctypes
import zlib

import numpy as np
import pyarrow as pa

#: The most frequent function words of four languages (fixed values).
FUNCTION_WORDS = {
    "en": "the of and to in is that for it with as on are be this was by at from have not or an you which".split(),
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er".split(),
    "fr": "le la les de des et en un une du que qui est dans pour par sur pas au avec ce il sont plus ne".split(),
    "es": "el la los las de que y en un una por con para del se no es al lo como más pero sus su fue".split(),
}
LANGUAGES = tuple(FUNCTION_WORDS)
FUNCTION = frozenset(w for words in FUNCTION_WORDS.values() for w in words)
_STRIP = "\"'`.,;:!?()[]{}<>|*&%$#@~^_-+=/\\«»„“”‚‘’¿¡…"


def plain(word: str) -> str:
    """The word in lower case without marks at its ends."""
    return word.lower().strip(_STRIP)


def word_hash(word: str, bits: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) & ((1 << bits) - 1)


class WordTable(dict):
    """Maps words to row numbers of `table`, a growing array of what describe(word) returns.

    Emptied between texts when `most` words are in it, so memory has a bound.
    """

    def __init__(self, describe, width: int, dtype: type, most: int = 200_000):  # noqa: ANN001
        super().__init__()
        self.describe, self.most = describe, most
        self.table = np.zeros((1024, width), dtype)

    def __missing__(self, word: str) -> int:
        row = len(self)
        if row == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[row] = self.describe(word)
        self[word] = row
        return row

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


#: What the operator that ran last keeps in this Python worker, by name.
_kept: dict = {}


def kept(name, make):  # noqa: ANN001, ANN201
    """What make() made when this worker was first asked for `name`. Workers serve one operator after another, so
    asking for another name lets go of what was kept."""
    if name not in _kept:
        let_go()
        _kept[name] = make()
    return _kept[name]


def let_go() -> None:
    """Keep nothing, and give freed memory back to the system: allocators would hold it for as long as the worker lives."""
    _kept.clear()
    pa.default_memory_pool().release_unused()
    if hasattr(_c := ctypes.CDLL(None), "malloc_trim"):
        _c.malloc_trim(0)


_NO_LANGUAGE = (0.0,) * len(LANGUAGES)
#: How much a function word speaks for each of LANGUAGES; one that several share counts less for each.
_language_rows = {w: tuple((w in words) / sum(w in x for x in FUNCTION_WORDS.values()) for words in FUNCTION_WORDS.values()) for w in FUNCTION}


def language_row(word: str) -> tuple[float, ...]:
    """How much a plain word speaks for each of LANGUAGES."""
    return _language_rows.get(word, _NO_LANGUAGE)
