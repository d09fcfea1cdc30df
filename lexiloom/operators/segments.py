"""Paragraphs of sources matched with sentence windows of candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lexiloom.functions.grams import Prints
from lexiloom.functions.text import let, strip, text
from lexiloom.operators.scoring import beside_sources, pair_texts

# Fixed values of the matching.
MIN_PARAGRAPH, SENTENCES, MIN_SENTENCE, SNIPPET, TOP, LEAST = 40, 3, 10, 300, 5, 0.01


def paragraphs(c: Column) -> Column:
    """Paragraphs of at least MIN_PARAGRAPH characters; short ones join the next.

    A short rest at the end is dropped.
    """
    parts = F.filter(F.transform(F.split(text(c), r"\n{2,}|(?<=[。！？.!?])\n"), strip), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(state: Column, part: Column) -> Column:
        return let(
            F.when(state["open"] == "", part).otherwise(F.concat(state["open"], F.lit(" "), part)),
            lambda both: F.struct(
                F.when(F.length(both) >= MIN_PARAGRAPH, F.concat(state["done"], F.array(both))).otherwise(state["done"]).alias("done"),
                F.when(F.length(both) >= MIN_PARAGRAPH, F.lit("")).otherwise(both).alias("open"),
            ),
        )

    return F.aggregate(parts, start, step)["done"]


def sentence_windows(c: Column) -> Column:
    """Windows of SENTENCES sentences; the whole text if it has no more."""
    whole = text(c)
    sentences = F.filter(F.transform(F.split(strip(whole), r"(?U)(?<=[。！？.!?])\s+"), strip), lambda s: F.length(s) > MIN_SENTENCE)
    return let(
        sentences,
        lambda ss: F.when(F.size(ss) <= SENTENCES, F.array(whole)).otherwise(
            F.transform(F.sequence(F.lit(1), F.size(ss) - SENTENCES + 1), lambda i: F.array_join(F.slice(ss, i, SENTENCES), " "))
        ),
    )


def _best(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """The kept segments of each row, from sources and rows in one sorted table."""
    prints, now, paras, hashes, places, sizes = Prints(), None, [], None, None, None
    names = ["row", "paragraph_index", "source_paragraph", "candidate_snippet", "overlap"]
    for batch in batches:
        of_row = batch.column("row").is_valid().to_pylist()
        parts = batch.column("parts").to_pylist()
        srcs, of_it, used = batch.column("src_id").to_pylist(), None, [True] * batch.num_rows
        for i in range(batch.num_rows - 1, -1, -1):  # sources without rows need no fingerprints; the last one's rows may follow
            of_it = srcs[i] if of_row[i] else of_it
            used[i] = srcs[i] in (of_it, srcs[-1])
        flat = iter(prints([p for ps, u in zip(batch.column("lowered").to_pylist(), used, strict=True) if u for p in ps]))
        at, out = [], [[], [], [], []]
        for i, (src, own) in enumerate(zip(srcs, parts, strict=True)):
            if not used[i]:
                continue
            found = [next(flat) for _ in own]
            if not of_row[i]:
                if src != now:  # a repeated source counts once
                    now, paras, sizes = src, own, np.array([len(f) for f in found], np.int64)
                    hashes, places = np.concatenate([*found, np.empty(0, np.uint32)]), np.repeat(np.arange(len(own)), sizes)
                    order = np.argsort(hashes, kind="stable")
                    hashes, places = hashes[order], places[order]
                continue
            if src != now or not paras:
                continue
            best: dict[int, tuple[float, int, int, int]] = {}
            for w, fp in enumerate(found):
                first = np.searchsorted(hashes, fp, "left")
                n = np.searchsorted(hashes, fp, "right") - first
                shared = np.bincount(places[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(paras))
                for p in np.flatnonzero(shared).tolist():
                    common, united = int(shared[p]), int(sizes[p]) + len(fp) - int(shared[p])
                    if p not in best or common / united > best[p][0]:
                        best[p] = (common / united, w, common, united)
            kept = sorted((-((2000 * c + u) // (2 * u)), p, w) for p, (j, w, c, u) in best.items() if j >= LEAST)[:top]
            for less, p, w in kept:
                at.append(i)
                for x, v in zip(out, (p, paras[p][:SNIPPET], own[w][:SNIPPET], -less), strict=True):
                    x.append(v)
        kinds = (pa.int32(), pa.string(), pa.string(), pa.int64())
        made = [pa.array(x, t) for x, t in zip(out, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(at, pa.int64())), *made], names)


def row_segments(rows: DataFrame, sources: DataFrame, top: int = TOP) -> DataFrame:
    """The best matching window of each paragraph, the ``top`` of each of ``rows(src_id, cand_id, text)``.

    One pass over sources and rows brought together by source: paragraphs and
    windows are cut there, each paragraph has its fingerprint made once, and only
    the kept segments leave it.
    """
    both = beside_sources(rows, sources)
    parts = F.when(F.col("row").isNull(), paragraphs(F.col("text"))).otherwise(sentence_windows(F.col("text")))
    cut = both.select("src_id", "row", parts.alias("parts"))
    read = cut.select("src_id", "row", "parts", F.transform("parts", F.lower).alias("lowered"))
    kind = both.schema["row"].dataType.simpleString()
    found = read.mapInArrow(lambda it: _best(it, top), f"row {kind}, paragraph_index int, source_paragraph string, candidate_snippet string, overlap long")
    return found.select("row.src_id", "row.cand_id", "paragraph_index", "source_paragraph", "candidate_snippet", "overlap")


def best_segments(pairs: DataFrame, sources: DataFrame, candidates: DataFrame, top: int = TOP) -> DataFrame:
    """The best matching window of each paragraph, the ``top`` of each pair.

    ``sources(src_id, text)``, ``candidates(cand_id, text)``.  The first window wins
    ties, then the first paragraph.
    Returns ``src_id, cand_id, paragraph_index, source_paragraph,
    candidate_snippet, overlap`` (tenths of a percent).
    """
    return row_segments(pair_texts(pairs, candidates), sources, top)


def segment_colour(overlap_percent: Column) -> Column:
    """Background of a matched segment by its overlap."""
    return F.when(overlap_percent >= 15, "#ffebee").when(overlap_percent >= 7, "#fff8e1").otherwise("#f1f8e9")
