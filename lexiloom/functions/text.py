"""Scalar text functions as Column expressions: all JVM-side, none a Python UDF.

Nulls count as empty text.  Patterns are stated with the flags that give them
Unicode meaning (white space and word ends too, as texts of pages hold no-break
spaces), and ``(?d)`` where line anchors should see ``\\n`` alone.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The section headers, header and affiliation phrases recognised.
ABSTRACT_LINE = r"(?iuUmd)^(?:abstract|摘要|summary|概要)\s*[:\-]?\s*$"
ABSTRACT_INLINE = r"(?iuUmd)^[^\n]{0,40}?\babstract\b\s*[—–\-:]\s*"
KEYWORD_LINE = r"(?iuUmd)^(?:keywords?|index terms?|關鍵字|關鍵詞)\s*[:\-]?\s*"
INTRODUCTION_LINE = r"(?iuUmd)^(?:1\.?\s+introduction|1\.?\s+介紹|1\.?\s+緒論|introduction)\s*$"
CLOSING_LINE = r"(?iuUmd)^(?:\d+\.?\s+)?(?:conclusion|related work|references|acknowledgment|bibliography|參考文獻|結論)"
PAGE_HEADER = (
    r"(?iU)^(?:ieee\b|transactions\b|proceedings\s+of|acm\s+(?:transactions|sigchi|siggraph)|springer\b|elsevier\b|nature\b"
    r"|vol\.?\s*\d|volume\s+\d|no\.?\s*\d|this\s+(?:article|paper)\s+(?:was|is|has\s+been)\s+(?:published|accepted|submitted)"
    r"|authorized\s+licensed|digital\s+object\s+identifier|doi\s*:|arxiv\s*:|©\s*\d{4}|copyright)"
)
AFFILIATION = (
    r"(?iU)(?:department\s+of|school\s+of|university\s+(?:of|at)?|institute\s+of|laboratory|research\s+(?:center|group|lab)"
    r"|faculty\s+of|college\s+of|national\s+\w+\s+(?:university|institute)|@[\w.\-]+\.[a-z]{2,}"
    r"|(?:received|revised|accepted)\s+\w+\s+\d{1,2})"
)
AUTHOR_LINE = (
    r"(?U)^[A-Z][a-z]+(?:[- ][A-Z][a-z]+)*\d*(?:\s*(?:and|,)\s*[A-Z][a-z]+(?:[- ][A-Z][a-z]+)*\d*)+\s*$"
)
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085  ]"
# Words that never count as important (only those of four letters or more can matter).
UNIMPORTANT = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can need dare "
    "ought used to of in on at by for with about as into through during including until against among throughout despite "
    "towards upon concerning this that these those it its we our their which who whom and or but if then than so yet nor not "
    "from also such each paper propose proposed present show shows results using"
).split()


def text(c: Column | str) -> Column:
    """The column with nulls as empty text."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def let(value: Column, use) -> Column:
    """Bind an expression once and use it several times in another."""
    return F.transform(F.array(value), use)[0]


def before(c: Column, pattern: str) -> Column:
    """What precedes the first match (all of it without one)."""
    return F.split(c, pattern, 2)[0]


def after(c: Column, pattern: str) -> Column:
    """What follows the first match; null without one."""
    return F.get(F.split(c, pattern, 2), F.lit(1))


def clean(c: Column) -> Column:
    """At most one blank line and one space in a row, stripped."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r" {2,}", " "))


def lines(c: Column) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(F.transform(F.split(c, LINE_BREAK), strip), lambda x: x != "")


def is_author_line(line: Column) -> Column:
    """Whether a short line is a list of capitalized names."""
    return (F.length(line) <= 120) & line.rlike(AUTHOR_LINE)


def is_front_matter(line: Column) -> Column:
    """Whether a line is a page header, affiliation, address or author list."""
    return line.rlike(PAGE_HEADER) | line.rlike(AFFILIATION) | line.contains("@") | is_author_line(line)


def extract_title(c: Column) -> Column:
    """The first of the first 20 lines that can be a title, else the first line."""

    def usable(line: Column) -> Column:
        return (
            (F.length(line) >= 10) & ~line.rlike(r"(?U)^[\d\s]+$") & ~line.rlike(r"(?iu)^(?:abstract|keywords?|摘要|關鍵字)")
            & ~is_front_matter(line)
        )

    return let(lines(text(c)), lambda ls: F.coalesce(F.get(F.filter(F.slice(ls, 1, 20), usable), F.lit(0)), F.get(ls, F.lit(0)), F.lit("")))


def content_start(c: Column) -> Column:
    """How many characters of front matter precede the content.

    Lines are taken with their ends while they are front matter or hold only
    digits and punctuation; the first other or blank line, or line 41, ends it.
    """
    ended = F.regexp_extract_all(text(c), F.lit(rf"([^\n\r\x0b\x0c\x1c-\x1e\u0085  ]*(?:{LINE_BREAK})|[^\n\r\x0b\x0c\x1c-\x1e\u0085  ]+$)"), 1)

    def step(state: Column, line: Column) -> Column:
        bare = strip(line)
        skip = state["open"] & (bare != "") & (is_front_matter(bare) | bare.rlike(r"(?U)^[\d\s,;.\-]+$"))
        return F.struct(F.when(skip, state["at"] + F.length(line)).otherwise(state["at"]).alias("at"), skip.alias("open"))

    return F.aggregate(F.slice(ended, 1, 40), F.struct(F.lit(0).alias("at"), F.lit(True).alias("open")), step)["at"]


def extract_abstract(c: Column) -> Column:
    """The abstract: after a header line, after an inline header, or from the content start."""
    whole = text(c)
    line, inline = after(whole, ABSTRACT_LINE), after(whole, ABSTRACT_INLINE)
    to_intro = F.when(after(line, INTRODUCTION_LINE).isNotNull(), before(line, INTRODUCTION_LINE)).otherwise(F.substring(line, 1, 1500))
    stop = F.least(
        F.when(after(inline, KEYWORD_LINE).isNotNull(), F.length(before(inline, KEYWORD_LINE))),
        F.when(after(inline, INTRODUCTION_LINE).isNotNull(), F.length(before(inline, INTRODUCTION_LINE))),
    )
    # a stop right at the start counts as none
    to_stop = F.when(F.coalesce(stop, F.lit(0)) > 0, F.substring(inline, F.lit(1), stop)).otherwise(F.substring(inline, 1, 1500))
    fallback = F.substring(whole, content_start(c) + 1, F.lit(600))
    return clean(F.when(line.isNotNull(), to_intro).when(inline.isNotNull(), to_stop).otherwise(fallback))


def extract_keywords(c: Column) -> Column:
    """Keywords of three to 59 characters on the line of the first keyword header."""
    rest = after(text(c), KEYWORD_LINE)
    raw = F.when(F.instr(rest, "\n") > 0, before(rest, r"\n")).otherwise(F.substring(rest, 1, 300))
    parts = F.transform(F.split(raw, r"[;,，；、|]"), strip)
    return F.coalesce(F.filter(parts, lambda p: (F.length(p) > 2) & (F.length(p) < 60)), F.array().cast("array<string>"))


def extract_body(c: Column, most: int = 4000) -> Column:
    """The text from the content start to the first closing section."""
    whole = text(c)
    # a header counts only from the content start on; a line break keeps ^ honest there
    rest = F.substring(whole, content_start(c) + 1, F.lit(2**31 - 1))
    return F.substring(clean(before(rest, CLOSING_LINE)), 1, most)


def important_words(c: Column, top: int = 10) -> Column:
    """The most frequent words of four letters or more; ties by first occurrence."""
    found = F.filter(
        F.regexp_extract_all(F.lower(text(c)), F.lit(r"(?U)\b([a-zA-Z]{4,})\b"), 1),
        lambda w: ~w.isin([w for w in UNIMPORTANT if len(w) > 3]),
    )

    def ranked(words: Column) -> Column:
        one = F.transform(F.array_distinct(words), lambda w: F.struct(
            (-F.size(F.filter(words, lambda x: x == w))).alias("n"), F.array_position(words, w).alias("p"), w.alias("w")
        ))
        return F.transform(F.slice(F.array_sort(one), 1, top), lambda s: s["w"])

    return let(found, ranked)


def search_query(title: Column, keywords: Column, abstract: Column) -> Column:
    """Title and five keywords, or eight important words, in 300 characters."""
    kws = F.coalesce(keywords, F.array().cast("array<string>"))
    extra = F.when(F.size(kws) > 0, F.slice(kws, 1, 5)).otherwise(F.slice(important_words(abstract), 1, 8))
    return F.substring(F.array_join(F.concat(F.array(text(title)), extra), " "), 1, 300)


def join_hyphens(c: Column) -> Column:
    """Words split over lines joined, the hyphen kept."""
    return F.regexp_replace(text(c), r"(?U)(\w)-\n(\w)", "$1-$2")


def source_text(title: Column, abstract: Column, body: Column) -> Column:
    """What a source paper is compared by."""
    return F.concat_ws(" ", text(title), text(abstract), text(body))


def authors_et_al(names: Column) -> Column:
    """The first three names, and "et al." where there are more."""
    return F.concat(F.array_join(F.slice(names, 1, 3), ", "), F.when(F.size(names) > 3, " et al.").otherwise(""))
