"""Scores of source-candidate pairs, their combination, ranking and tiers.

A pair table has ``(src_id, cand_id)``.  Scores are made where a source meets the
candidates found for it, in one pass over both, never by comparing every source
with every candidate; pairs that share nothing score 0.  Scores are also given in tenths as integers, rounded
half up, so that results do not depend on an engine's rounding of doubles.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexiloom.core.storage import materialize
from lexiloom.functions.grams import Prints, plain_words, terms, text_fingerprint
from lexiloom.functions.text import strip, text

#: Weight of a gram in one text only, under smoothed idf over two texts.
UNSHARED = math.log(1.5) + 1
# Weights of the three scores in percent, tier bounds in tenths.
WEIGHTS, HIGH, MEDIUM = (45, 20, 35), 600, 350


def gram_weights(texts: DataFrame, *keys: str) -> DataFrame:
    """``keys, gram, w`` with ``w = 1 + ln(tf)`` of ``texts(keys, text)``."""
    grams = texts.select(*keys, F.explode(terms(F.col("text"))).alias("gram"))
    return grams.groupBy(*keys, "gram").agg((1 + F.log(F.count("*"))).alias("w"))


def beside_sources(rows: DataFrame, sources: DataFrame, *of_source: str) -> DataFrame:
    """Sources and the rows found for them in one table, a source right before its rows.

    ``rows(src_id, text, ...)``, ``sources(src_id, text, ...)``.  Returns ``src_id,
    row`` (all columns of the row but its text; null for a source), ``text`` and the
    named columns of the source.  Both sides are shuffled by ``src_id`` once and
    sorted, for a pass that keeps one source at a time.  Nothing is joined: neither
    side can be taken for small and sent to the driver, whatever the texts and
    arrays made of them are estimated at, and a source with any number of rows
    needs no more memory than others.
    """
    kept = [c for c in rows.columns if c != "text"]
    none = [F.lit(None).cast(sources.schema[c].dataType).alias(c) for c in of_source]
    mine = rows.select("src_id", F.struct(*kept).alias("row"), "text", *none)
    theirs = sources.select("src_id", F.lit(None).cast(mine.schema["row"].dataType).alias("row"), "text", *of_source)
    both = theirs.unionByName(mine).where("src_id is not null")
    return both.repartition(F.col("src_id")).sortWithinPartitions("src_id", F.col("row").isNotNull())


def _weights(words: str) -> tuple[dict[str, float], float]:
    """Weights ``1 + ln(tf)`` of words and bigrams, and the sum of their squares."""
    ws = words.split(" ") if words else []
    w = {g: 1 + math.log(n) for g, n in Counter(ws + [f"{x} {y}" for x, y in itertools.pairwise(ws)]).items()}
    return w, sum(x * x for x in w.values())


def _cosine(s: tuple[dict[str, float], float], c: tuple[dict[str, float], float]) -> float | None:
    """The cosine of two texts' vectors in closed form; None if they share nothing."""
    (own, s_all), (other, c_all) = s, c
    dot = ss = cc = 0.0
    for g, y in other.items():
        x = own.get(g)
        if x is not None:
            dot, ss, cc = dot + x * y, ss + x * x, cc + y * y
    k = UNSHARED * UNSHARED
    return min(1.0, dot / math.sqrt((ss + k * (s_all - ss)) * (cc + k * (c_all - cc)))) if dot else None


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their scores, from :func:`beside_sources`; rows without a source are left out."""
    prints, now, own, keywords = Prints(), None, None, None
    for batch in batches:
        at, out = [], [[], [], [], []]
        found = prints(batch.column("lowered").to_pylist())
        of_row = batch.column("row").is_valid().to_pylist()
        names = batch.column("keywords").to_pylist()
        for i, (src, words) in enumerate(zip(batch.column("src_id").to_pylist(), batch.column("words").to_pylist(), strict=True)):
            if not of_row[i]:
                if src != now:  # a repeated source counts once
                    now, own, keywords = src, (_weights(words), found[i]), names[i]
            elif src == now:
                common = len(np.intersect1d(own[1], found[i], assume_unique=True))
                united = len(own[1]) + len(found[i]) - common if len(own[1]) and len(found[i]) else 0
                at.append(i)
                for x, v in zip(out, (keywords, _cosine(own[0], _weights(words)), common, united), strict=True):
                    x.append(v)
        kinds = (pa.list_(pa.string()), pa.float64(), pa.int64(), pa.int64())
        made = [pa.array(x, t) for x, t in zip(out, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(at, pa.int64())), *made], ["row", "keywords", "cosine", "common", "united"])


def met_scores(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows(src_id, text, ...)`` without the text, with ``keywords, cosine, common, united`` of text and source.

    ``cosine`` is null for texts that share no gram.  Rows without a source are left
    out; a repeated source counts once.
    """
    if "keywords" not in sources.columns:
        sources = sources.withColumn("keywords", F.lit(None).cast("array<string>"))
    both = beside_sources(rows, sources, "keywords")
    words = F.array_join(plain_words(F.col("text")), " ")
    read = both.select("src_id", "row", F.lower(text("text")).alias("lowered"), words.alias("words"), "keywords")
    kind = both.schema["row"].dataType
    scored = read.mapInArrow(_met, f"row {kind.simpleString()}, keywords array<string>, cosine double, common long, united long")
    return scored.select("row.*", "keywords", "cosine", "common", "united")


def pair_texts(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """The distinct pairs with their candidate's text."""
    # texts are estimated as a few bytes each, so they are never to be broadcast
    return pairs.select("src_id", "cand_id").distinct().join(candidates.hint("merge"), "cand_id").select("src_id", "cand_id", "text")


def tfidf_scores(pairs: DataFrame, sources: DataFrame, candidates: DataFrame) -> DataFrame:
    """``src_id, cand_id, cosine`` of TF-IDF vectors fitted on each pair alone.

    With two texts the inverse document frequency takes two values only, so the
    cosine has a closed form over the shared grams and the texts' own totals.
    """
    met = met_scores(pair_texts(pairs, candidates), sources)
    return met.where("cosine is not null").select("src_id", "cand_id", "cosine")


def keyword_overlap(keywords: Column, abstract: Column) -> tuple[Column, Column]:
    """Matched keywords (order and repeats kept) and their share in tenths of a percent."""
    kws = F.coalesce(keywords, F.array().cast("array<string>"))
    low = F.lower(text(abstract))
    matched = F.filter(kws, lambda k: F.contains(low, F.lower(k)))
    n, m = F.size(kws).cast("long"), F.size(matched).cast("long")
    return matched, F.when(n > 0, F.floor((2000 * m + n) / (2 * n))).otherwise(F.lit(0)).cast("long")


def fingerprints(texts: DataFrame, *keys: str) -> DataFrame:
    """``keys, fp``: the winnowed fingerprint of each text."""
    return texts.select(*keys, text_fingerprint(F.col("text")).alias("fp"))


def fingerprint_scores(pairs: DataFrame, sources: DataFrame, candidates: DataFrame) -> DataFrame:
    """``src_id, cand_id, common, united`` of the pairs' fingerprints.

    The pair list is given, so the texts travel to their source and the sets are
    met there; no fingerprint is shuffled.
    """
    return met_scores(pair_texts(pairs, candidates), sources).select("src_id", "cand_id", "common", "united")


#: Hashes of one block of each side of a top-k search.
BLOCK_LEFT, BLOCK_RIGHT = 2_000_000, 500_000
_NEAR = "id_l long, id_r long, common long, united long, rank int"


def _indexed(files: list[str], most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The written right side in blocks of about ``most`` hashes: ids, sizes, and an index of the rows that hold each hash."""
    held, n = [], 0
    for batch in itertools.chain(_batches(files), [None]):
        if batch is not None and batch.num_rows:
            held.append(batch)
            n += pc.sum(pc.list_value_length(batch.column("fp"))).as_py() or 0
        if held and (batch is None or n >= most):
            rows = pa.Table.from_batches(held)
            sets = rows.column("fp").combine_chunks()
            sizes, ids = sets.value_lengths().to_numpy(zero_copy_only=False), rows.column("id_r").to_numpy()
            hashes, place = np.unique(sets.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
            postings = np.repeat(np.arange(len(sizes)), sizes)[np.argsort(place, kind="stable")]
            yield ids, sizes, hashes, postings, np.r_[0, np.cumsum(np.bincount(place, minlength=len(hashes)))]
            held, n = [], 0


def _batches(files: list[str]) -> Iterator[pa.RecordBatch]:
    for uri in files:
        system, path = pa.fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as f:
            yield from pq.ParquetFile(f).iter_batches(batch_size=256, columns=["id_r", "fp"])


def _nearest(lefts: list[tuple[int, np.ndarray]], files: list[str], k: int, most: int) -> pa.RecordBatch:
    """The k nearest rows of the whole right side for each row of a left block."""
    near = np.full((len(lefts), k), -1.0)
    ids, commons, uniteds = (np.zeros((len(lefts), k), np.int64) for _ in range(3))
    for own, sizes, hashes, postings, ends in _indexed(files, most):
        for i, (_, fp) in enumerate(lefts):
            at = np.searchsorted(hashes, fp)
            at = at[hashes[np.minimum(at, len(hashes) - 1)] == fp]
            first, n = ends[at], ends[at + 1] - ends[at]
            common = np.bincount(postings[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sizes))
            united = len(fp) + sizes - common
            j = common / united
            new = np.flatnonzero((j >= near[i, -1]) & (common > 0))
            if len(new) > k:  # ties of the last are kept, they are told apart by id
                new = new[j[new] >= np.partition(j[new], -k)[-k]]
            if len(new):
                js, js_ids = np.r_[near[i], j[new]], np.r_[ids[i], own[new]]
                best = np.lexsort((js_ids, -js))[:k]
                near[i], ids[i] = js[best], js_ids[best]
                commons[i], uniteds[i] = np.r_[commons[i], common[new]][best], np.r_[uniteds[i], united[new]][best]
    row, rank = np.nonzero(near > 0)
    names = np.array([x for x, _ in lefts], np.int64)
    columns = names[row], ids[row, rank], commons[row, rank], uniteds[row, rank], (rank + 1).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [f.split()[0] for f in _NEAR.split(", ")])


def _searched(batches: Iterator[pa.RecordBatch], files: list[str], k: int, most: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    lefts, n = [], 0
    for batch in batches:
        for x, own in zip(batch.column("id_l").to_pylist(), batch.column("fp"), strict=True):
            lefts.append((x, own.values.to_numpy(zero_copy_only=False).copy()))
            n += len(lefts[-1][1])
            if n >= most[0]:
                yield _nearest(lefts, files, k, most[1])
                lefts, n = [], 0
    if lefts:
        yield _nearest(lefts, files, k, most[1])


def topk_jaccard(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows of ``right(id_r, fp)`` nearest to each of ``left(id_l, fp)``, exactly; ids are numbers.

    Every row of ``left`` is a query against all of ``right``.  Both sides are
    written to the shared folder once.  A task takes a block of queries of a
    bounded number of hashes and reads the files of the right side, block by
    block, through an index made in place; it keeps k rows a query, and they alone
    leave it.  Nothing is shuffled once for each block of the other side, so disk
    grows with the two sides and not with their product; the time does.  (An
    inverted join would ship a row for each shared hash.)  Rows that share nothing
    are not nearest; ties go to the lesser id.
    """
    l, r = (materialize(df.where("size(fp) > 0").dropDuplicates([c]).withColumn(c, F.col(c).cast("long")), "prints") for df, c in ((left, "id_l"), (right, "id_r")))
    blocks = math.ceil((l.agg(F.sum(F.size("fp"))).first()[0] or 0) / BLOCK_LEFT)
    files, most = sorted(r.inputFiles()), (BLOCK_LEFT, BLOCK_RIGHT)
    dealt = l.repartition(max(blocks, l.sparkSession.sparkContext.defaultParallelism), "id_l")
    return dealt.select("id_l", "fp").mapInArrow(lambda it: _searched(it, files, k, most), _NEAR)


def tenths(part: Column, whole: Column) -> Column:
    """``part / whole`` in tenths of a percent, rounded half up; 0 for no whole."""
    return F.when(whole > 0, F.floor((2000 * part + whole) / (2 * whole))).otherwise(F.lit(0)).cast("long")


def combined_tenths(tfidf: Column, keyword: Column, prints: Column) -> Column:
    """The weighted score in tenths, from scores in tenths."""
    a, b, c = WEIGHTS
    return F.floor((a * tfidf + b * keyword + c * prints + 50) / 100).cast("long")


def risk_tier(score_tenths: Column) -> Column:
    """high, medium or low."""
    return F.when(score_tenths >= HIGH, "high").when(score_tenths >= MEDIUM, "medium").otherwise("low")


def risk_colour(tier: Column) -> Column:
    """The mark of a tier."""
    return F.when(tier == "high", "🔴").when(tier == "medium", "🟡").otherwise("🟢")


def title_key(title: Column) -> Column:
    """What titles are de-duplicated by."""
    return F.substring(F.lower(strip(text(title))), 1, 80)


def first_arrivals(candidates: DataFrame) -> DataFrame:
    """The first arrival of each title of a source; all blank titles are one."""
    w = Window.partitionBy("src_id", title_key(F.col("title"))).orderBy("arrival_seq")
    return candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def score_pairs(candidates: DataFrame, papers: DataFrame) -> DataFrame:
    """All scores of ``candidates`` against the paper they were found for.

    ``candidates(src_id, cand_id, title, abstract, arrival_seq, ...)``,
    ``papers(doc_id, title, abstract, body, keywords)``.  Candidates whose paper
    is missing are dropped; a blank abstract scores 0 everywhere; a repeated paper
    counts once.
    """
    sources = papers.select(F.col("doc_id").alias("src_id"), F.concat_ws(" ", text("title"), text("abstract"), text("body")).alias("text"), "keywords")
    # only a candidate with an id has scores by its text
    met = met_scores(candidates.withColumn("text", F.when(F.col("cand_id").isNotNull(), text("abstract"))), sources)
    matched, overlap = keyword_overlap(F.col("keywords"), F.col("abstract"))
    scored = met.withColumn("matched_keywords", matched).withColumn("kw", overlap).drop("keywords")
    return (
        scored.withColumn("tf", F.floor(F.coalesce("cosine", F.lit(0.0)) * 1000 + 0.5).cast("long"))
        .withColumn("fp", F.coalesce(tenths(F.col("common"), F.col("united")), F.lit(0)))
        .withColumn("score", combined_tenths(F.col("tf"), F.col("kw"), F.col("fp")))
        .withColumn("risk_tier", risk_tier(F.col("score")))
        .drop("cosine", "common", "united")
    )


def ranked(scored: DataFrame) -> DataFrame:
    """With ``rank`` inside each source: best first, ties by arrival."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("src_id").orderBy(F.desc("score"), "arrival_seq")))


def tier_summary(scored: DataFrame) -> DataFrame:
    """Rows of each tier per source."""
    count = lambda t: F.count_if(F.col("risk_tier") == t).alias(t)
    return scored.groupBy("src_id").agg(F.count("*").alias("total"), count("high"), count("medium"), count("low"))
