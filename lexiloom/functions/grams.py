"""Normalized text, grams, winnowed fingerprints: array expressions in the JVM."""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType, StringType

from lexiloom.functions.text import let, strip, text

# Fixed values of the fingerprints: gram lengths in characters and words, window.
CHAR_GRAM, WORD_GRAM, WINDOW = 8, 3, 4
# The English stop words of the public scikit-learn list.
STOP_WORDS = (
    "a about above across after afterwards again against all almost alone along already also although always am among amongst "
    "amoungst amount an and another any anyhow anyone anything anyway anywhere are around as at back be became because become "
    "becomes becoming been before beforehand behind being below beside besides between beyond bill both bottom but by call can "
    "cannot cant co con could couldnt cry de describe detail do done down due during each eg eight either eleven else elsewhere "
    "empty enough etc even ever every everyone everything everywhere except few fifteen fifty fill find fire first five for former "
    "formerly forty found four from front full further get give go had has hasnt have he hence her here hereafter hereby herein "
    "hereupon hers herself him himself his how however hundred i ie if in inc indeed interest into is it its itself keep last "
    "latter latterly least less ltd made many may me meanwhile might mill mine more moreover most mostly move much must my myself "
    "name namely neither never nevertheless next nine no nobody none noone nor not nothing now nowhere of off often on once one "
    "only onto or other others otherwise our ours ourselves out over own part per perhaps please put rather re same see seem "
    "seemed seeming seems serious several she should show side since sincere six sixty so some somehow someone something sometime "
    "sometimes somewhere still such system take ten than that the their them themselves then thence there thereafter thereby "
    "therefore therein thereupon these they thick thin third this those though three through throughout thru thus to together too "
    "top toward towards twelve twenty two un under until up upon us very via was we well were what whatever when whence whenever "
    "where whereafter whereas whereby wherein whereupon wherever whether which while whither who whoever whole whom whose why will "
    "with within without would yet you your yours yourself yourselves"
).split()
_ODD = re.compile(r"[^\x00-\x7f]")


@pandas_udf(StringType())
def _decompose(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKD", v) if v is not None and _ODD.search(v) else v)


def normalize(c: Column) -> Column:
    """Lower case, compatibility decomposition, no punctuation, single spaces.

    The Arrow UDF is needed as Spark has no Unicode normalization; everything
    around it stays in the JVM.
    """
    bare = F.regexp_replace(_decompose(F.lower(text(c))), r"[^\p{L}\p{N}_\s\p{Z}\u0085一-鿿]", "")
    return strip(F.regexp_replace(bare, r"(?U)[\s\p{Z}\x1c-\x1f]+", " "))


def _sliding(items: Column, width: int, combine) -> Column:
    """``combine(i)`` for each 0-based start of a full window; empty if none."""
    starts = F.when(F.size(items) >= width, F.sequence(F.lit(0), F.size(items) - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, combine)


def char_grams(normalized: Column, k: int = CHAR_GRAM) -> Column:
    """All substrings of k characters, spaces included."""
    chars = F.filter(F.split(normalized, ""), lambda ch: ch != "")
    return let(chars, lambda cs: _sliding(cs, k, lambda i: F.concat(*[F.get(cs, i + j) for j in range(k)])))


def word_grams(normalized: Column, n: int = WORD_GRAM) -> Column:
    """All runs of n words joined by a space."""
    words = F.filter(F.split(normalized, " "), lambda w: w != "")
    return let(words, lambda ws: _sliding(ws, n, lambda i: F.concat_ws(" ", *[F.get(ws, i + j) for j in range(n)])))


def hash32(gram: Column) -> Column:
    """The first 32 bits of md5: the same in every process and engine."""
    return F.conv(F.substring(F.md5(gram), 1, 8), 16, 10).cast("long")


def winnow(hashes: Column, window: int = WINDOW) -> Column:
    """The distinct minima of every window of hashes; all hashes if fewer."""
    return let(
        hashes,
        lambda h: F.array_distinct(
            F.when(F.size(h) < window, h).otherwise(_sliding(h, window, lambda i: F.least(*[F.get(h, i + j) for j in range(window)])))
        ),
    )


def fingerprint(normalized: Column) -> Column:
    """Winnowed hashes of character grams and of word grams together."""
    return F.array_union(winnow(F.transform(char_grams(normalized), hash32)), winnow(F.transform(word_grams(normalized), hash32)))


#: Hashes of grams that a worker remembers; forgotten when full.  Characters hashed at a time.
_REMEMBERED, _AT_ONCE = 200_000, 500_000
_PUNCTUATION, _BLANKS = re.compile(r"[^\w\s]"), re.compile(r"\s+")
# The constants of md5.
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4


# Of the last word of a message, by its bytes in use (-1 to 4): what is kept, and the mark of the end.
_KEPT = np.array([0, 0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)
_MARK = np.array([0, 0x80, 0x8000, 0x800000, 0x80000000, 0], np.uint32)


def _md5_32(words: list[np.ndarray], bits: np.ndarray) -> np.ndarray:
    """The first 32 bits of md5 of many messages of one block: their words up to the end mark, their lengths in bits."""
    a, b, c, d = (np.full(len(bits), x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, turned = np.empty_like(a), np.empty_like(a)
    for i, (sine, turn) in enumerate(zip(_SINES, _TURNS, strict=True)):
        if i < 16:
            np.bitwise_xor(c, d, f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, f)
            f ^= d
        else:
            np.invert(d, f)
            f |= b
            f ^= c
        word = (i, (5 * i + 1) % 16, (3 * i + 5) % 16, 7 * i % 16)[i // 16]
        f += a
        f += np.uint32(sine)
        if word < len(words):
            f += words[word]
        elif word == 14:
            f += bits
        np.left_shift(f, np.uint32(turn), turned)
        f >>= np.uint32(32 - turn)
        f |= turned
        f += b
        a, d, c, b, f = d, c, b, f, a
    return (a + np.uint32(0x67452301)).byteswap()


def _least(h: np.ndarray) -> np.ndarray:
    """The minima of all windows of a row of hashes."""
    m = h[: max(0, len(h) - WINDOW + 1)].copy()
    for k in range(1, WINDOW):
        np.minimum(m, h[k : k + len(m)], out=m)
    return m


class Prints:
    """Fingerprints of lowered texts: sorted distinct hashes, of many texts at a time."""

    def __init__(self) -> None:
        self._known: dict[str, int] = {}

    def _hash(self, gram: str) -> int:
        h = self._known.get(gram)
        if h is None:
            if len(self._known) >= _REMEMBERED:
                self._known.clear()
            h = self._known[gram] = int.from_bytes(hashlib.md5(gram.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()[:4], "big")
        return h

    def _hashes(self, whole: str, word: np.ndarray, odd: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Hashes of parts of a text: short ones of plain letters many at a time, others one by one."""
        out = np.empty(len(start), np.uint32)
        plain = (odd[start + size] == odd[start]) & (size < 56)
        at = np.flatnonzero(plain)
        for k in range(0, len(at), 8192):
            part = at[k : k + 8192]
            first, n = start[part], size[part]
            words = []
            for j in range(int(n.max()) // 4 + 1):
                left = np.clip(n - 4 * j, -1, 4) + 1
                words.append(word[first + 4 * j] & _KEPT[left] | _MARK[left])
            out[part] = _md5_32(words, (n * 8).astype(np.uint32))
        rest = np.flatnonzero(~plain)
        out[rest] = [self._hash(whole[i : i + n]) for i, n in zip(start[rest].tolist(), size[rest].tolist(), strict=True)]
        return out

    def _together(self, normal: list[str]) -> list[np.ndarray]:
        """Fingerprints of normalized texts; their grams are parts of all of them, a line each."""
        whole = "\n".join(normal) + "\n"
        codes = np.r_[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32), np.zeros(64, np.uint32)]
        odd, lines = (np.cumsum(np.r_[0, x]) for x in (codes > 127, codes == 10))
        word = codes[:-3] | codes[1:-2] << 8 | codes[2:-1] << 16 | codes[3:] << 24
        # character grams, in a line each
        start = np.flatnonzero(lines[CHAR_GRAM:-64] == lines[: -64 - CHAR_GRAM])
        chars = self._hashes(whole, word, odd, start, np.full(len(start), CHAR_GRAM))
        char_ends = np.searchsorted(start, np.flatnonzero(codes == 10))
        # runs of words, likewise
        ends = np.flatnonzero((codes[: len(whole)] == 32) | (codes[: len(whole)] == 10))
        begins = np.r_[0, ends[:-1] + 1]
        begins, ends = begins[begins < ends], ends[begins < ends]
        first, last = begins[: max(0, len(begins) - WORD_GRAM + 1)], ends[WORD_GRAM - 1 :]
        one = lines[first] == lines[last]
        first, last = first[one], last[one]
        runs = self._hashes(whole, word, odd, first, last - first)
        run_ends = np.searchsorted(first, np.flatnonzero(codes == 10))
        least = _least(chars), _least(runs)
        out, c, r = [], 0, 0
        for c_end, r_end in zip(char_ends.tolist(), run_ends.tolist(), strict=True):
            parts = [(h[x:y] if y - x < WINDOW else m[x : y - WINDOW + 1]) for h, m, x, y in ((chars, least[0], c, c_end), (runs, least[1], r, r_end))]
            h = np.concatenate(parts)
            h.sort()
            out.append(h[np.r_[True, h[1:] != h[:-1]]] if len(h) else h)
            c, r = c_end, r_end
        return out

    def __call__(self, lowered: list[str]) -> list[np.ndarray]:
        out, at = [], 0
        while at < len(lowered):
            normal, size = [], 0
            while at < len(lowered) and (not normal or size + len(lowered[at]) <= _AT_ONCE):
                value = lowered[at]
                if _ODD.search(value):
                    value = unicodedata.normalize("NFKD", value)
                normal.append(_BLANKS.sub(" ", _PUNCTUATION.sub("", value)).strip())
                size, at = size + len(value), at + 1
            out += self._together(normal)
        return out


@pandas_udf(ArrayType(LongType()))
def _fingerprints(lowered: Iterator[pd.Series]) -> Iterator[pd.Series]:
    prints = Prints()
    for batch in lowered:
        yield pd.Series([h.astype(np.int64) for h in prints(batch.tolist())], dtype=object)


def text_fingerprint(c: Column) -> Column:
    """The fingerprint of a text that is not normalized yet, in any order.

    The same hashes as ``fingerprint(normalize(c))``.  The text goes to Python
    for its normal form anyway; hashing its grams there, those of plain letters
    many at a time and each other known gram once, takes less than a tenth of
    the time of higher-order functions.
    """
    return _fingerprints(F.lower(text(c)))


def plain_words(c: Column) -> Column:
    """Words of two characters or more without stop words."""
    return F.filter(
        F.regexp_extract_all(F.lower(text(c)), F.lit(r"(?U)\b(\w\w+)\b"), 1), lambda w: ~w.isin(STOP_WORDS)
    )


def terms(c: Column) -> Column:
    """Words of two characters or more without stop words, then their bigrams."""
    return let(plain_words(c), lambda ws: F.concat(ws, _sliding(ws, 2, lambda i: F.concat_ws(" ", F.get(ws, i), F.get(ws, i + 1)))))
