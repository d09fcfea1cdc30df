"""Problem 4: one consistent form for text that merely looks the same.

Method: quick-check properties of Unicode decide which characters can be
unstable: those whose NFC quick check is not "yes", default-ignorable characters
and controls, spaces other than the plain one, and compatibility forms (full and
half width, ligatures, mathematical letters).  Text without any is passed
through untouched.  Otherwise only the segments around unstable characters are
normalized, each with its boundary context (the whole run of letters, marks and
invisible characters it stands in, and the character that a mark may join), and
the canonical segments are spliced into the unchanged rest.

The canonical form is in NFC, without invisible characters, with every space
character a plain space; full-width letters, digits and signs are in their plain
form, but signs of Chinese text kept; half-width kana are full; ligatures of
letters are spelled out and mathematical letters plain; letters of another
script that pass for Latin ones inside a Latin word become the Latin letter, so
"NF\u03baB" becomes "NFkB": callers that must keep Greek inside words pass
``greek=False``.  Superscripts, typographic quotes, dashes and ellipses, single
Greek symbols and whole words of other scripts stay as they are.

Null stays null and empty stays empty; line ends and tabs are kept.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

# Letters of Greek and Cyrillic that look like a Latin letter.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "ү": "y", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "Ϲ": "C", "ι": "i", "κ": "k",
    "ρ": "p", "υ": "u", "α": "a", "ϳ": "j", "Ϳ": "J", "γ": "y", "τ": "t", "χ": "x", "η": "n", "ε": "e",
}

# Quick-check classes, as the contents of a character class.
INVISIBLE = r"\p{Default_Ignorable_Code_Point}\u2800\ufff9-\ufffb\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x84\x86-\x9f"
SPACES = r"\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NOT_NFC = r"\p{NFC_Quick_Check=No}\p{NFC_Quick_Check=Maybe}"
WIDE_WORD = r"\uff10-\uff19\uff21-\uff3a\uff41-\uff5a"
WIDE_SIGN = r"\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff5e\uffe0-\uffe6"
LIGATURES = r"\ufb00-\ufb06"
#: Other compatibility letters: half-width kana and mathematical letters and digits.
PLAINER = r"\uff61-\uff9f\U0001d400-\U0001d7ff"
ACCENTS = r"\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f"

_ALIKE = "".join(LOOKALIKES)
_GREEK = frozenset(c for c in LOOKALIKES if unicodedata.name(c).startswith("GREEK"))
_UNSTABLE = regex.compile(f"[{INVISIBLE}{SPACES}{NOT_NFC}{WIDE_WORD}{WIDE_SIGN}{LIGATURES}{PLAINER}{ACCENTS}{_ALIKE}]")
#: Runs within which characters can interact; their ends are stable boundaries.
_SEGMENT = regex.compile(rf"[{SPACES}](?!\p{{M}})|[{WIDE_SIGN}](?!\p{{M}})|(?:[^\p{{L}}\p{{N}}\s](?=\p{{M}}))?[\p{{L}}\p{{M}}\p{{N}}{INVISIBLE}{NOT_NFC}{LIGATURES}{ACCENTS}]+")
_DROP = regex.compile(f"[{INVISIBLE}]+")
_ONE_SPACE, _ONE_SIGN = regex.compile(f"[{SPACES}]"), regex.compile(f"[{WIDE_SIGN}]")
_LETTERS = regex.compile(r"[\p{L}\p{M}]+")
_LATIN = regex.compile(r"\p{Latin}")
_ALIKE_RE = regex.compile(f"[{_ALIKE}]")
_HAN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Bopomofo}\p{Hangul}\u3001-\u3003\u3008-\u3011]")
_ACCENT_AFTER = regex.compile(rf"\p{{L}}[{ACCENTS}]")
_WIDE_OR_LIG = regex.compile(f"[{WIDE_WORD}{LIGATURES}]")
_PLAINER = regex.compile(f"[{PLAINER}]+")
#: All that can be unstable in ASCII.
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def _segment(text: str, greek: bool) -> tuple[str, bool]:
    """The canonical form of one segment and whether a listed defect was in it."""
    bare = _DROP.sub("", text)
    defect = bare != text
    if _WIDE_OR_LIG.search(bare):
        defect = True
        bare = _WIDE_OR_LIG.sub(lambda m: unicodedata.normalize("NFKC", m[0]), bare)
    if _ONE_SPACE.search(bare):
        defect = True
        bare = _ONE_SPACE.sub(" ", bare)
    bare = _PLAINER.sub(lambda m: unicodedata.normalize("NFKC", m[0]), bare)
    defect = defect or _ACCENT_AFTER.search(bare) is not None
    bare = unicodedata.normalize("NFC", bare)
    if _ALIKE_RE.search(bare):

        def word(m: regex.Match) -> str:
            nonlocal defect
            if _LATIN.search(m[0]):
                new = "".join(c if not greek and c in _GREEK else LOOKALIKES.get(c, c) for c in m[0])
                defect = defect or new != m[0]
                return new
            return m[0]

        bare = unicodedata.normalize("NFC", _LETTERS.sub(word, bare))
    return bare, defect


def canonical(text: str | None, greek: bool = True) -> tuple[str | None, bool]:
    """The canonical form of a text, and whether it held a listed defect."""
    if text is None or not (_CONTROL if text.isascii() else _UNSTABLE).search(text):
        return text, False
    chinese = _HAN.search(text) is not None
    parts, at, found = [], 0, False
    for m in _SEGMENT.finditer(text):
        own = m[0]
        if not _UNSTABLE.search(own):
            continue
        if len(own) == 1 and _ONE_SPACE.match(own):
            new, defect = " ", True
        elif len(own) == 1 and _ONE_SIGN.match(own):
            new, defect = (own, False) if chinese else (unicodedata.normalize("NFKC", own), True)
        else:
            new, defect = _segment(own, greek)
        parts.append(text[at : m.start()])
        parts.append(new)
        at, found = m.end(), found or defect
    parts.append(text[at:])
    done = "".join(parts)
    # what was dropped or replaced may have kept a mark from its letter
    return done if unicodedata.is_normalized("NFC", done) else unicodedata.normalize("NFC", done), found


def canonical_text(text: str | None) -> str | None:
    """Only the canonical form."""
    return canonical(text)[0]


def _columns(batches: Iterator[pa.RecordBatch], fields: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {"key": batch.column("key")}
        for f in fields:
            pairs = [canonical(t) for t in batch.column(f).to_pylist()]
            out[f] = pa.array([p[0] for p in pairs], pa.string())
            out[f"{f}_unstable"] = pa.array([p[1] for p in pairs], pa.bool_())
        yield pa.RecordBatch.from_pydict(out)


def canonicalize(df: DataFrame, key: str, *fields: str) -> DataFrame:
    """Canonical forms of the named string columns, one row per input row.

    Returns ``key`` (the key's own type), each field in canonical form, and for
    each field ``<field>_unstable``: whether it held a listed defect.  A pass
    without a shuffle; other columns of the input are not carried.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, " + ", ".join(f"`{f}` string, `{f}_unstable` boolean" for f in fields)
    source = df.select(F.col(key).alias("key"), *fields)
    return source.mapInArrow(lambda it: _columns(it, fields), schema).withColumnRenamed("key", key)


def unstable_fields(df: DataFrame, key: str, *fields: str) -> DataFrame:
    """Distinct ``(key, fld)`` of the fields that hold a listed defect.

    Fields of plain ASCII without controls are dropped in the JVM before any Python runs.
    """
    suspicious = None
    for f in fields:
        test = F.col(f).rlike(r"[^\t\n\r\x20-\x7e]")
        suspicious = test if suspicious is None else suspicious | test
    done = canonicalize(df.where(suspicious), key, *fields)
    flags = [F.when(F.col(f"{f}_unstable"), F.lit(f)) for f in fields]
    return done.select(key, F.explode(F.array_compact(F.array(*flags))).alias("fld")).distinct()
