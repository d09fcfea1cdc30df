"""Problem 5: long spans that appear letter by letter in more than one record.

Method.  Tokens are code points.  Rabin-Karp hashes of every window of a fixed
length are computed; those that occur in more than one distinct text are the
repeated windows, and repeated windows merge into maximal intervals.

Counting every window of every text in Spark would shuffle many times the
input.  So the search has two steps with the same result.  First, of the
windows of ``span - SLACK + 1`` characters only those go to Spark that a rule
selects from the content of the ``span`` characters around them (the window at
the position, modulo the slack, of the least hash of short grams).  Two texts
that share ``span`` characters select the same window in them, so no case is
lost.  The selected windows are counted; those of a single text end there.
Second, texts that share a selected window are compared on the hashes of
every window of ``span`` characters; repeated windows merge into intervals.

Exact copies collapse into one text before the first shuffle of windows, and
no group is collected: pairs of texts come from a join on the repeated windows,
in which hot windows are cut into blocks on both sides.
Null and empty texts and texts shorter than ``span`` are in no result row of the
pairs and have zero shared characters in the report.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lexiloom.core.links import expand_links, keyed_pairs, member_pairs
from lexiloom.core.storage import materialize

SLACK = 41
GRAM = 16
#: Stands for the place of a window that a text holds more than once.
REPEATED = -1
_BLOCK = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(_BLOCK + 1, _BASE), dtype=np.uint64)
_INVERSE = np.cumprod(np.full(_BLOCK + 1, np.uint64(pow(int(_BASE), -1, 2**64))), dtype=np.uint64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _prefix(codes: np.ndarray) -> np.ndarray:
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    out = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(x * _POWERS[: len(x)], dtype=np.uint64, out=out[1:])
    return out


def _hashes(prefix: np.ndarray, length: int, at: np.ndarray | None = None) -> np.ndarray:
    """Rolling hashes of the windows of a length, at all or at given positions."""
    if at is None:
        raw = (prefix[length:] - prefix[:-length]) * _INVERSE[: len(prefix) - length]
    else:
        raw = (prefix[at + length] - prefix[at]) * _INVERSE[at]
    raw = (raw ^ (raw >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return raw ^ (raw >> np.uint64(29))


def window_hashes(text: str, length: int) -> np.ndarray:
    """Hashes of every window of ``length`` code points, in order.

    Texts beyond one block are hashed in overlapping blocks.
    """
    codes, step = _codes(text), _BLOCK - length
    if len(codes) < length:
        return np.empty(0, dtype=np.uint64)
    parts = [_hashes(_prefix(codes[a : a + _BLOCK]), length) for a in range(0, len(codes) - length + 1, step + 1)]
    return np.concatenate(parts)[: len(codes) - length + 1]


def _least_in(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    have, out = 1, keys
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    extra = width - have
    return np.minimum(out[: len(out) - extra], out[extra:]) if extra else out


def selected(codes: np.ndarray, span: int) -> np.ndarray:
    """Positions of the windows of ``span - SLACK + 1`` that the rule selects."""
    grams = _hashes(_prefix(codes), GRAM)
    keys = (grams >> np.uint64(20) << np.uint64(20)) | np.arange(len(grams), dtype=np.uint64)
    least = (_least_in(keys, span - GRAM + 1) & np.uint64((1 << 20) - 1)).astype(np.int64)
    at = np.arange(len(least))
    return at + (least - at) % SLACK


def _windows(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    size = span - SLACK + 1
    for batch in batches:
        texts, ids, flags = batch.column("text").to_pylist(), batch.column("class").to_numpy(), batch.column("main").to_numpy(zero_copy_only=False)
        todo: list[tuple[int, int, np.ndarray]] = []
        filled = 0

        def flush() -> pa.RecordBatch:
            codes = np.concatenate([c for _, _, c in todo])
            ends = np.cumsum([len(c) for _, _, c in todo])
            at = selected(codes, span)
            # the span characters behind a selected window must lie in one text
            first = np.arange(len(at))
            inside = first + span <= ends[np.searchsorted(ends, first, side="right")]
            at = np.unique(at[inside])
            owner = np.searchsorted(ends, at, side="right")
            h = _hashes(_prefix(codes), size, at)
            starts = np.r_[0, ends[:-1]]
            within = at - starts[owner] + np.array([a for _, a, _ in todo])[owner]
            rows = np.array([r for r, _, _ in todo])[owner]
            # one row for each window of a text; REPEATED where it has several places
            order = np.lexsort((h, rows))
            h, rows, within = h[order], rows[order], within[order]
            fresh = np.r_[True, (np.diff(rows) != 0) | (h[1:] != h[:-1])] if len(h) else np.empty(0, bool)
            single = np.r_[fresh[1:], True] if len(h) else fresh
            place = np.where(single, within, REPEATED)[fresh].astype(np.int32)
            return pa.RecordBatch.from_pydict({
                "h": pa.array(h[fresh].view(np.int64)), "class": pa.array(ids[rows[fresh]]),
                "main": pa.array(flags[rows[fresh]]), "place": pa.array(place),
            })

        for r, t in enumerate(texts):
            codes = _codes(t)
            for a in range(0, max(1, len(codes) - span + 1), _BLOCK - span):
                piece = codes[a : a + _BLOCK - 1]
                if len(piece) < span:
                    continue
                if filled + len(piece) > _BLOCK:
                    yield flush()
                    todo, filled = [], 0
                todo.append((r, a, piece))
                filled += len(piece)
        if todo:
            yield flush()


def _runs(mask: np.ndarray, span: int) -> np.ndarray:
    """Merged intervals [start, end) covered by windows at the true positions."""
    at = np.flatnonzero(mask)
    if not len(at):
        return np.empty((0, 2), dtype=np.int64)
    cut = np.flatnonzero(np.diff(at) > span) + 1
    first = at[np.r_[0, cut]]
    last = at[np.r_[cut - 1, len(at) - 1]]
    return np.stack([first, last + span], axis=1)


def _alike(x: str, y: str) -> int:
    """Length of the common prefix."""
    n = 0
    for p, q in zip(x, y):  # noqa: B905
        if p != q:
            break
        n += 1
    return n


def _reaches(ta: str, a: int, tb: str, b: int, size: int, span: int) -> bool:
    """Whether the equal windows at a and b lie in an equal run of ``span``."""
    if ta[a : a + size] != tb[b : b + size]:
        return False
    need = span - size
    right = _alike(ta[a + size : a + span], tb[b + size : b + span])
    if right >= need:
        return True
    return right + _alike(ta[max(0, a - need) : a][::-1], tb[max(0, b - need) : b][::-1]) >= need


def _confirmed(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    size = span - SLACK + 1
    for batch in batches:
        keep = []
        columns = (batch.column(c).to_pylist() for c in ("text_a", "text_b", "places"))
        for k, (ta, tb, places) in enumerate(zip(*columns, strict=True)):
            sure = any(
                p["place_a"] != REPEATED and p["place_b"] != REPEATED and _reaches(ta, p["place_a"], tb, p["place_b"], size, span) for p in places
            )
            if not sure and any(p["place_a"] == REPEATED or p["place_b"] == REPEATED for p in places):
                ha, hb = window_hashes(ta, span), window_hashes(tb, span)
                sure = any(ta[p : p + span] in tb for p in np.flatnonzero(np.isin(ha, hb)))
            if sure:
                keep.append(k)
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int32())) for c in ("class_a", "class_b")], ["class_a", "class_b"])


def _reach(equal, most: int) -> int:
    """The largest m up to ``most`` for which ``equal(i, j)`` holds on all parts of [0, m)."""
    low, high, step = 0, 0, 256
    while low < most:
        high = min(most, low + step)
        if not equal(low, high):
            break
        low, step = high, 2 * step
    else:
        return most
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if equal(low, middle) else (low, middle)
    return low


def _extent(ta: str, a: int, tb: str, b: int) -> tuple[int, int]:
    """How far the equal letters around a and b reach to the left and to the right."""
    right = _reach(lambda i, j: ta[a + i : a + j] == tb[b + i : b + j], min(len(ta) - a, len(tb) - b))
    return _reach(lambda i, j: ta[a - j : a - i] == tb[b - j : b - i], min(a, b)), right


def _shared_spans(ta: str, tb: str, places: list[dict], span: int) -> tuple[list[int], list[int]]:
    """The intervals of both texts that lie in a common run of ``span``, as flat lists.

    Every such run holds a selected window, so runs are found by letters around
    those; texts that repeat a window are compared on the hashes of all windows.
    """
    if any(REPEATED in p.values() for p in places):
        ha, hb = window_hashes(ta, span), window_hashes(tb, span)
        return _runs(np.isin(ha, hb), span).ravel().tolist(), _runs(np.isin(hb, ha), span).ravel().tolist()
    ends: dict[int, int] = {}  # how far the last run reaches, by the distance of the places
    out: tuple[list[int], list[int]] = ([], [])
    for a, b in sorted((p["place_a"], p["place_b"]) for p in places):
        if a < ends.get(a - b, 0):
            continue
        left, right = _extent(ta, a, tb, b)
        ends[a - b] = a + right
        if left + right >= span:
            out[0].extend((a - left, a + right))
            out[1].extend((b - left, b + right))
    return out


def _spanned(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("text_a", "text_b", "places"))
        found = [_shared_spans(ta, tb, places, span) for ta, tb, places in zip(*columns, strict=True)]
        keep = pa.array([k for k, (x, _) in enumerate(found) if x], pa.int32())
        ints = pa.list_(pa.int32())
        yield pa.RecordBatch.from_pydict({
            "class_a": batch.column("class_a"), "class_b": batch.column("class_b"),
            "spans_a": pa.array([x for x, _ in found], ints), "spans_b": pa.array([y for _, y in found], ints),
        }).take(keep)


def _distinct(texts: DataFrame, span: int) -> DataFrame:
    return (
        texts.where(F.length("text") >= span)
        .groupBy(F.xxhash64("text").alias("class"), "text")
        .agg(F.max("main").alias("main"))
    )


def _with_texts(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    def side(x: str) -> DataFrame:
        return distinct.select(*(F.col(c).alias(f"{c}_{x}") for c in ("class", "text", "main")))

    return pairs.join(side("a"), "class_a").join(side("b"), "class_b").where("main_a or main_b")


def _candidates(texts: DataFrame, span: int) -> DataFrame:
    """Pairs of different texts with a selected window in common: ``class_a, class_b, text_a, text_b, places``.

    ``texts(text, main)``: only pairs with at least one ``main`` text count;
    ``class`` is the 64-bit hash of a text (texts are told apart by their letters).
    Candidates carry the places of the windows they share, so letters are compared
    only around those.
    """
    distinct = _distinct(texts, span)
    rows = distinct.select("class", "text", "main").mapInArrow(
        lambda it: _windows(it, span), "h long, class long, main boolean, place int"
    )
    met = keyed_pairs(rows, "h", "class").where("main_a or main_b").groupBy("class_a", "class_b").agg(F.collect_set(F.struct("place_a", "place_b")).alias("places"))
    return _with_texts(met, distinct).select("class_a", "class_b", "text_a", "text_b", "places")


def text_links(texts: DataFrame, span: int) -> DataFrame:
    """Pairs ``(class_a, class_b)`` of different texts that share ``span`` characters."""
    return materialize(_candidates(texts, span).mapInArrow(lambda it: _confirmed(it, span), "class_a long, class_b long"), "span-links")


def link_spans(texts: DataFrame, span: int) -> DataFrame:
    """The pairs of :func:`text_links` with the shared intervals of both texts, as flat lists of start and end."""
    return _candidates(texts, span).mapInArrow(lambda it: _spanned(it, span), "class_a long, class_b long, spans_a array<int>, spans_b array<int>")


def _records(candidates: DataFrame, segments: DataFrame) -> DataFrame:
    """``(kind, id, own, text)`` of abstracts, paragraphs and snippets, keys once."""
    none = F.lit(None).cast("long")
    a = candidates.select(F.lit("abstract").alias("kind"), F.col("cand_id").alias("id"), none.alias("own"), F.col("abstract").alias("text"))
    p = segments.select(F.lit("paragraph").alias("kind"), F.col("seg_id").alias("id"), none.alias("own"), F.col("source_paragraph").alias("text"))
    s = segments.select(F.lit("snippet").alias("kind"), F.col("seg_id").alias("id"), F.col("cand_id").alias("own"), F.col("candidate_snippet").alias("text"))
    return a.union(p).union(s).where("text is not null")


def _members(records: DataFrame, span: int) -> DataFrame:
    return records.where(F.length("text") >= span).select(F.xxhash64("text").alias("class"), "kind", "id", "own").distinct()


def shared_pairs(candidates: DataFrame, segments: DataFrame, span: int = 120) -> DataFrame:
    """Distinct ``(kind, id_a, id_b)`` of the records that share a span.

    ``abstract``: two candidates; ``paragraph``: a candidate's abstract and a
    segment's source paragraph; ``snippet``: a candidate's abstract and the
    snippet of a segment of another candidate.
    """
    records = _records(candidates, segments)
    members = _members(records, span)
    links = text_links(records.select("text", (F.col("kind") == "abstract").alias("main")), span)
    alike = members.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select(F.col("class").alias("class_a"), F.col("class").alias("class_b"))
    links = materialize(links.union(alike), "links")
    turned = links.union(links.where("class_a <> class_b").select(F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b")))
    abstracts = members.where("kind = 'abstract'").select("class", "id")
    others = members.where("kind <> 'abstract'").select("class", "kind", F.col("id").alias("id_b"), "own")
    among = member_pairs(links, abstracts).select(F.lit("abstract").alias("kind"), "id_a", "id_b")
    across = (
        expand_links(turned, abstracts.withColumnRenamed("id", "id_a"), others)
        .where("kind = 'paragraph' or own is null or own <> id_a")
        .select("kind", "id_a", "id_b").distinct()
    )
    return among.union(across)


def shared_report(candidates: DataFrame, segments: DataFrame, span: int = 120) -> DataFrame:
    """How much of each record occurs in other records.

    One row for each abstract, paragraph and snippet that is not null: ``(kind,
    id, n_chars, shared_chars, n_spans)``.  The shared characters are those of
    the merged intervals of all partners: every other record of any kind counts
    (the kinds of ``shared_pairs`` limit only the pairs), so also a snippet's own
    candidate and the rows that repeat a paragraph.  A text of ``span``
    characters or more that another record repeats whole is shared whole.
    Repeated keys with one text count once; the texts of one key that has
    several are no partners of each other.
    """
    records = _records(candidates, segments).distinct()
    key = F.concat_ws(":", "kind", F.coalesce(F.col("id").cast("string"), F.lit("")))
    sized = records.select("kind", "id", F.xxhash64("text").alias("class"), F.length("text").alias("n_chars"), key.alias("key")).distinct()
    long = sized.where(F.col("n_chars") >= span)
    several = long.groupBy("key").agg(F.count_distinct("class").alias("n")).where("n > 1").select("key", F.col("key").alias("viewer"))
    # a class has one set of intervals for all its records, but for keys with several texts
    seen = long.join(several, "key", "left").withColumn("viewer", F.coalesce("viewer", F.lit("")))
    viewers = seen.select("class", "viewer", "n_chars").distinct()
    holders = long.groupBy("class").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    texts = records.select("text", F.lit(True).alias("main"))
    links = materialize(link_spans(texts, span), "shared-spans")
    directed = links.select(F.col("class_a").alias("class"), F.col("class_b").alias("partner"), F.col("spans_a").alias("spans")).union(
        links.select("class_b", "class_a", "spans_b")
    )
    n = F.expr("transform(sequence(0, size(spans) - 2, 2), i -> struct(spans[i] as s, spans[i + 1] as e))")
    other = directed.join(holders.withColumnRenamed("class", "partner"), "partner").select(
        "class", F.when(F.col("first") == F.col("last"), F.col("first")).alias("only"), F.explode(n).alias("r")
    ).select("class", "only", "r.s", "r.e")
    whole = holders.where("first <> last").select("class", F.lit(None).cast("string").alias("only"), F.lit(0).alias("s"), F.lit(2**31 - 1).alias("e"))
    runs = (
        other.union(whole).join(viewers, "class").where("only is null or only <> viewer")
        .select("class", "viewer", "s", F.least("e", "n_chars").alias("e")).distinct()
    )
    before = Window.partitionBy("class", "viewer").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    covered = (
        runs.withColumn("reach", F.coalesce(F.max("e").over(before), F.lit(0)))
        .groupBy("class", "viewer")
        .agg(
            F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", "reach"))).alias("shared_chars"),
            F.count_if((F.col("s") > F.col("reach")) | (F.col("reach") == 0)).alias("n_spans"),
        )
    )
    shared = seen.join(covered, ["class", "viewer"]).select("key", "class", "shared_chars", "n_spans")
    return sized.join(shared, ["key", "class"], "left").select(
        "kind", "id", "n_chars", F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), F.coalesce("n_spans", F.lit(0)).alias("n_spans")
    )
