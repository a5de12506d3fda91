"""Space-delimited units of text and bounded per-worker caches of what a tokenizer makes of them.

A unit is cut only where no token of the tokenizer can cross, so the pieces of a text are the pieces of its units in
order. Caches live in the Python worker and are emptied when full: they change how fast a result comes, never the result.
"""

from __future__ import annotations

import ctypes
import gc
import re

#: Entries of a worker's cache; about 80 MB at most.
CACHE_ENTRIES = 400_000
#: Longer units are encoded each time they occur, so that a cache entry stays small.
CACHED_LENGTH = 96

_BLANK = re.compile(r"\s")
_OPEN: dict[str, object] = {}
_HELD: dict[str, list] = {}
_LAST: list[str] = []


def held(operator: str, *caches: dict) -> None:
    """Name what an operator keeps in a Python worker between tasks."""
    _HELD.setdefault(operator, []).extend(caches)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def trim() -> None:
    """Give freed memory back to the system, where the C library would keep it."""
    if _TRIM:
        _TRIM(0)


def claim(operator: str) -> None:
    """Called in a worker as an operator's task begins: what other operators kept there goes, for workers serve them all in turn."""
    if _LAST != [operator]:
        _LAST[:] = [operator]
        for name, caches in _HELD.items():
            if name != operator:
                for c in caches:
                    c.clear()
        gc.collect()
        trim()


def opened(kind: str, path: str):
    """A tokenizer, opened once in each Python worker."""
    if (key := f"{kind}:{path}") not in _OPEN:
        if kind == "sentencepiece":
            from sentencepiece import SentencePieceProcessor

            _OPEN[key] = SentencePieceProcessor(model_file=path)
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            found = Tokenizer.from_file(path)
            found.no_truncation()
            found.no_padding()
            _OPEN[key] = found
    return _OPEN[key]


class UnitCache(dict):
    """unit -> value, filled by `encode` (a list of units to a list of values)."""

    def __init__(self, encode, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.encode, self.entries = encode, entries
        self.mark, self.frequent = None, {}

    def learn(self, units) -> None:
        """Encode what is missing, in one call."""
        if len(self) > self.entries + len(self.frequent):
            self.clear()
            self.update(self.frequent)
        if new := [u for u in units if u not in self and len(u) <= CACHED_LENGTH]:
            self.update(zip(new, self.encode(new), strict=True))

    def __missing__(self, unit: str):
        value = self.encode([unit])[0]
        if len(unit) <= CACHED_LENGTH:
            self[unit] = value
        return value


_CACHES: dict[object, UnitCache] = {}
held("units", _CACHES)


def cache(key, encode, mark=None, frequent=dict, entries: int = CACHE_ENTRIES) -> UnitCache:
    """One cache for each key in a Python worker; tasks that follow find it filled. frequent() gives the entries that stay
    in it, and is called when the mark is new."""
    claim("units")
    if key not in _CACHES:
        _CACHES.clear()
        _CACHES[key] = UnitCache(encode, entries)
    found = _CACHES[key]
    if mark is not None and found.mark != mark:
        found.mark, found.frequent = mark, frequent()
        found.update(found.frequent)
    return found


def runs(text: str, chars: int = 500_000):
    """A text in pieces of about `chars` characters, cut at white space only."""
    start = 0
    while len(text) - start > chars and (blank := _BLANK.search(text, start + chars)):
        yield text[start : blank.start()]
        start = blank.end()
    yield text[start:]


def slices(texts: list[str | None], chars: int = 1_000_000):
    """(from, to) of runs of texts of about `chars` characters, so that what is held of split texts stays bounded."""
    start = size = 0
    for i, x in enumerate(texts):
        size += len(x) if x else 0
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
