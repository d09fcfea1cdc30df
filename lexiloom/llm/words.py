"""Word sets of texts as hashes, shared by operators that compare texts."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from lexiloom.llm.canonical import canonical_text

_WORD = re.compile(r"[^\W_]+")
_CACHE_LIMIT = 400_000


def words_of(*texts: str | None) -> set[str]:
    """Distinct runs of letters and digits of the canonical texts, lower case."""
    found: set[str] = set()
    for t in texts:
        if t:
            found.update(_WORD.findall(canonical_text(t).lower()))
    return found


class WordHasher:
    """32-bit hashes of words, remembered in a cache of bounded size."""

    def __init__(self) -> None:
        self._known: dict[str, int] = {}

    def __call__(self, words: set[str]) -> np.ndarray:
        """Sorted distinct hashes of the words."""
        known = self._known
        if len(known) > _CACHE_LIMIT:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w) & 0xFFFFFFFF
            out.append(h)
        return np.unique(np.array(out, dtype=np.uint32))
