"""Values of words (ids, alignments), worked out once per distinct word and task."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain

#: bytes of words and values that a task keeps; beyond it the cache starts anew
CACHE_BYTES = 96 << 20
#: rough size of a cache entry beside its word and value
ENTRY = 200


class WordCache:
    def __init__(self, values_of: Callable[[list[str]], list], limit: int = CACHE_BYTES):
        self.known: dict = {}
        self.values_of, self.limit, self.size = values_of, limit, 0

    def ensure(self, words: set[str]) -> Callable:
        """After this, the returned getter knows every one of ``words``."""
        if self.size > self.limit:
            self.known, self.size = {}, 0
        missing = list(words - self.known.keys())
        if missing:
            values = self.values_of(missing)
            self.known.update(zip(missing, values))
            parts = values if isinstance(values[0], bytes) else chain.from_iterable(values)
            self.size += ENTRY * len(missing) + sum(map(len, missing)) + sum(map(len, parts))
        return self.known.__getitem__


def slices(texts: list[str], limit: int = 1 << 20):
    """Runs of texts of about ``limit`` characters: (first, past last)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


#: two neighbouring blanks, or one at the end
LOOSE = re.compile(r" (?=\s|\Z)")


def at_spaces(text: str) -> list[str]:
    """Parts that begin at every space after a non-space and before a non-blank; joined by spaces they are ``text``."""
    parts = text.split(" ")
    if not LOOSE.search(text):
        return parts
    out: list[str] = [parts[0]]
    for before, p in zip(parts, parts[1:]):
        if not before or not p or p[0].isspace():
            out[-1] += " " + p
        else:
            out.append(p)
    return out
