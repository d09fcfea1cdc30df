"""Problem 3: texts that were cut off, and how often each source cuts.

Method.  One pass over all texts counts the corpus vocabulary and, for the last
one, two and three words before every gap, how often a sentence ended there and
how often it went on (of contexts only those that an open text asks for).  The vocabulary becomes a trie as a relation: the proper
prefixes of its words.  The end of a text is cleaned of the marks that may
follow a cut (tags, ellipses, brackets, padding) and then judged by the first
evidence there is, named in ``evidence``:

* ``prefix``: the final token is unknown and a proper prefix of known words;
* ``length``: many open texts of the source have exactly this length, far more
  than of the lengths around it, and the token is unknown or its words seldom
  end a sentence;
* ``marks``: an ellipsis followed an open sentence, a hyphen a word, or a bracket
  near the end never closed;
* ``context``: fewer than half of the sentences with the same last words ended
  there; where no context is known, a known word that is a prefix of others.

Texts that end in sentence punctuation, a link, a keyword list or a heading are
complete; a citation or bracket at the end is set aside and the words before it
are judged.  A repeated key counts once.  Null and blank texts are not records.
The final token of a text never counts towards the vocabulary, and names (words
capitalized within a sentence) share one class in the contexts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexiloom.core.storage import materialize
from lexiloom.llm.canonical import canonical_text

_TOKEN = regex.compile(r"\d+(?:[.,]\d+)*|\p{Han}|[\p{L}\p{M}]+(?:['’-][\p{L}\p{M}]+)*")
_ASCII_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[A-Za-z]+(?:['-][A-Za-z]+)*")
# The end of a sentence: a full stop, but not one inside a number, before a space or the next token; or a blank line.
# Every way begins with a character of its own, which lets the search skip all others.
_QUOTED = r"[\"'”’)\]]*(?=\s|{t}|$)"
_STOPS = rf"\.(?!(?<=\d\.)\d){_QUOTED}|!{_QUOTED}|\?{_QUOTED}|。|！|？|\n\s*\n"
_END, _ASCII_END = regex.compile(_STOPS.format(t=r"[\d\p{L}\p{M}]")), re.compile(_STOPS.format(t="[0-9A-Za-z]"))
_STOP = re.compile(r"[.!?。！？][\"'”’)\]»]*$")
_DOTS = re.compile(r"(?:…|\.\.\.+|\[\s*(?:…|\.\.\.)\s*\]|&hellip;?|&(?:h(?:e(?:l(?:l(?:i(?:p)?)?)?)?)?)?)\s*$")
_TAG = re.compile(r"(?:</?[A-Za-z][\w:.-]*\s*/?>|</?[\w:.-]*|&(?:nbsp|#\d*|amp|lt|gt|quot)?;?)\s*$")
_VOID = re.compile(r"[\s�​﻿]+$")
_CITED = re.compile(r"\s*(?:\[\d+(?:\s*[,;–-]\s*\d+)*\]|\([^()]{1,80}\))$")
_LINK = re.compile(r"(?:https?://|www\.|doi:)\S+$", re.I)
_KEYWORDS = re.compile(r"(?:^|[.!?。\n]\s*)(?:key\s?words?|index terms?|關鍵字|關鍵詞)\s*[:：—-][^.!?。]*$", re.I)
_HEADING = re.compile(
    r"\n\s*(?:\[\d+\][^\n]*|\d*\.?\s*(?:references|bibliography|acknowledge?ments?|appendix|funding|notes|supplement\w*)\b[^\n]{0,80})$", re.I
)
FLUSH = 300_000
#: Final tokens that may be broadcast to the prefixes, and contexts that may be sent to the counting pass.
MOST_FINALS = 200_000


class _Remembered(dict):
    """Values of a function of tokens, remembered up to a bound."""

    def __init__(self, function) -> None:
        self._function = function

    def __missing__(self, token: str) -> str:
        if len(self) >= FLUSH:
            self.clear()
        value = self[token] = self._function(token)
        return value


def _class_of(token: str) -> str:
    return "#" if token[0].isdigit() else "@" if token[0].isupper() else token.lower()


_LOWER, _CLASS = _Remembered(str.lower), _Remembered(_class_of)


def _classed(text: str) -> tuple[list[str], list[str], list[int]]:
    """Tokens of a canonical text in lower case, their classes, and the
    positions of the tokens, other than the last, after which a sentence ends."""
    token, end = (_ASCII_TOKEN, _ASCII_END) if text.isascii() else (_TOKEN, _END)
    shouting = text.isupper()
    words, classes, ended = [], [], []
    for sentence in end.split(text):
        own = token.findall(sentence)
        if not own:
            continue
        if words:
            ended.append(len(words) - 1)
        low = [_LOWER[w] for w in own]
        words += low
        if shouting:
            classes += ["#" if w[0].isdigit() else w for w in low]
        else:
            classes.append("#" if low[0][0].isdigit() else low[0])
            classes += [_CLASS[w] for w in own[1:]]
    return words, classes, ended


def _contexts(classes: list[str]) -> list[str]:
    """Keys of the last three, two and one classes, most specific first."""
    return [" ".join(classes[-k:]) for k in (3, 2, 1)]


def _counted(batches: Iterator[pa.RecordBatch], wanted: tuple[set, set, set] | None) -> Iterator[pa.RecordBatch]:
    """Counts of words, and of the contexts in ``wanted`` (keys as tuples of classes; None: all)."""
    vocabulary: Counter[str] = Counter()
    every: Counter[tuple] = Counter()
    ends: Counter[tuple] = Counter()

    def flush() -> pa.RecordBatch:
        n = len(vocabulary)
        out = pa.RecordBatch.from_pydict({
            "kind": pa.array(["w"] * n + ["c"] * len(every)), "key": pa.array([*vocabulary, *map(" ".join, every)], pa.string()),
            "ended": pa.array([*vocabulary.values(), *(ends[k] for k in every)], pa.int64()),
            "went_on": pa.array([0] * n + [v - ends[k] for k, v in every.items()], pa.int64()),
        })
        for c in (vocabulary, every, ends):
            c.clear()
        return out

    for batch in batches:
        for t in batch.column("text").to_pylist():
            words, one, ended = _classed(canonical_text(t))
            # the last token is judged, so it does not count
            vocabulary.update([w for w, c in zip(words[:-1], one, strict=False) if c != "#"])
            before = one[:-1]
            for n in (1, 2, 3):
                # contexts that end at each token, from the n-th on
                found = zip(*(before[k:] for k in range(n)))  # noqa: B905
                if wanted is None:
                    every.update(found)
                    ends.update([tuple(one[i + 1 - n : i + 1]) for i in ended if i + 1 >= n])
                else:
                    own = wanted[n - 1]
                    every.update([k for k in found if k in own])
                    ends.update([k for i in ended if i + 1 >= n and (k := tuple(one[i + 1 - n : i + 1])) in own])
            if len(vocabulary) + len(every) > FLUSH:
                yield flush()
    yield flush()


def tail(text: str) -> dict:
    """What the end of a text shows: open or not, its last token and contexts."""
    rest, dots, hyphen = text, False, False
    while True:
        before = rest
        rest = _VOID.sub("", rest)
        m = _DOTS.search(rest)
        if m and not (m[0].strip() == "&" and not rest[: m.start()].strip()):
            dots, rest = True, rest[: m.start()]
        rest = _TAG.sub("", rest)
        if rest == before:
            break
    facts = {"open": False, "sure": False, "token": None, "k3": None, "k2": None, "k1": None}
    if not rest:
        return facts
    if _STOP.search(rest) or not dots and (_LINK.search(rest) or _KEYWORDS.search(rest) or _HEADING.search(rest)):
        return facts
    bare = rest if dots else _CITED.sub("", rest)
    if _STOP.search(bare):
        return facts
    hyphen = bool(re.search(r"\w[-‐]$", bare))
    words, classes, _ = _classed(canonical_text(bare))
    if not words:
        return facts | {"open": dots, "sure": dots}
    keys = _contexts(classes[-3:])
    last = words[-1]
    facts.update(open=True, sure=dots or hyphen, token=None if last[0].isdigit() else last, k3=keys[0], k2=keys[1], k1=keys[2])
    # an opened bracket or quotation never closed near the end shows a cut
    window = bare[-160:]
    if window.rfind("(") > window.rfind(")") or window.rfind("[") > window.rfind("]"):
        facts["sure"] = True
    return facts


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [tail(t) for t in batch.column("text").to_pylist()]
        cols = {c: batch.column(c) for c in ("tbl", "rec_key", "origin", "n_chars")}
        for c, kind in (("open", pa.bool_()), ("sure", pa.bool_()), ("token", pa.string()), ("k3", pa.string()), ("k2", pa.string()), ("k1", pa.string())):
            cols[c] = pa.array([f[c] for f in found], kind)
        yield pa.RecordBatch.from_pydict(cols)


def _ended_share(n: int) -> Column:
    e, g = F.col(f"e{n}"), F.col(f"g{n}")
    return F.when(e + g >= (3 if n > 1 else 20), e / (e + g))


def judged(records: DataFrame) -> DataFrame:
    """Verdicts on ``records(tbl, rec_key, origin, text)``.

    Returns ``(tbl, rec_key, origin, is_cut, evidence)``, one row for each key.  The
    evidence of the open texts alone is joined; complete texts are told by
    their last characters and never leave the scan.
    """
    texts = records.where("text is not null and trim(text) <> ''")
    suspects = texts.where(~F.col("text").rlike(r"[^.…][.。!?]\s*$")).withColumn("n_chars", F.length("text"))
    tails = materialize(
        suspects.select("tbl", "rec_key", "origin", "n_chars", "text").mapInArrow(
            _tails, "tbl string, rec_key long, origin string, n_chars int, open boolean, sure boolean, token string, k3 string, k2 string, k1 string"
        ).where("open").distinct(),
        "tails",
    )
    # the contexts that any open text asks for; where they are too many to be sent out, all are counted
    asked = tails.select(F.explode(F.array_distinct(F.array_compact(F.array("k1", "k2", "k3")))).alias("k")).distinct().limit(MOST_FINALS + 1).toPandas()["k"]
    wanted = None
    if len(asked) <= MOST_FINALS:
        keys = [tuple(k.split(" ")) for k in asked]
        wanted = tuple({k for k in keys if len(k) == n} for n in (1, 2, 3))
    stats = materialize(
        texts.select("text").mapInArrow(lambda it: _counted(it, wanted), "kind string, key string, ended long, went_on long")
        .groupBy("kind", "key").agg(F.sum("ended").alias("ended"), F.sum("went_on").alias("went_on")),
        "stats",
    )
    words = stats.where("kind = 'w'").select(F.col("key").alias("token"), F.col("ended").alias("seen"))
    finals = tails.where("token is not null").select("token").distinct()
    prefixes = words.where("length(token) > 1").select(F.explode(F.expr("transform(sequence(1, length(token) - 1), i -> substr(token, 1, i))")).alias("token"))
    if finals.count() <= MOST_FINALS:
        prefixes = prefixes.join(F.broadcast(finals), "token", "left_semi")
    trie = prefixes.groupBy("token").agg(F.count("*").alias("below"))
    known = (
        finals.join(words, "token", "left")
        .join(trie, "token", "left")
        .select("token", F.coalesce("seen", F.lit(0)).alias("seen"), F.coalesce("below", F.lit(0)).alias("below"))
    )
    contexts = stats.where("kind = 'c'")
    out = tails.join(known, "token", "left")
    for n in (3, 2, 1):
        c = contexts.select(F.col("key").alias(f"k{n}"), F.col("ended").alias(f"e{n}"), F.col("went_on").alias(f"g{n}"))
        wanted = tails.select(f"k{n}").distinct().join(c, f"k{n}")
        out = out.join(wanted, f"k{n}", "left")
    lengths = tails.groupBy("tbl", "origin", "n_chars").agg(F.count("*").alias("same"))
    near = Window.partitionBy("tbl", "origin").orderBy("n_chars").rangeBetween(-25, 25)
    spikes = lengths.withColumn("around", F.sum("same").over(near) - F.col("same")).select(
        "tbl", "origin", "n_chars", ((F.col("same") >= 3) & (F.col("same") * 8 > F.col("around"))).alias("spike")
    )
    out = out.join(spikes.withColumnRenamed("origin", "o"), (out.tbl == spikes.tbl) & out.origin.eqNullSafe(F.col("o")) & (out.n_chars == spikes.n_chars), "left").select(
        out["*"], "spike"
    )
    unknown = F.col("token").isNotNull() & (F.coalesce("seen", F.lit(0)) == 0)
    share = F.coalesce(_ended_share(3), _ended_share(2), _ended_share(1))
    below = F.coalesce("below", F.lit(0)) > 0
    evidence = (
        F.when(unknown & below, "prefix")
        .when(F.coalesce("spike", F.lit(False)) & (unknown | F.coalesce(share < 0.9, F.lit(True))), "length")
        .when(F.col("sure"), "marks")
        .when(F.coalesce(share < 0.5, below), "context")
    )
    verdicts = out.select("tbl", "rec_key", evidence.alias("evidence")).where("evidence is not null").groupBy("tbl", "rec_key").agg(F.max("evidence").alias("evidence"))
    everyone = texts.groupBy("tbl", "rec_key").agg(F.min("origin").alias("origin"))
    return everyone.join(verdicts, ["tbl", "rec_key"], "left").select("tbl", "rec_key", "origin", F.col("evidence").isNotNull().alias("is_cut"), "evidence")


def cut_rates(verdicts: DataFrame) -> DataFrame:
    """Per table and source: records, cut records and the rate of cuts."""
    return verdicts.groupBy("tbl", "origin").agg(
        F.count("*").alias("records"), F.count_if("is_cut").alias("cut"), (F.count_if("is_cut") / F.count("*")).alias("rate")
    )
