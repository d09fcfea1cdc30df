"""Problem 8: how demanding each text is to read in its own language.

Method.  Every language has a vocabulary ranked by frequency over all its
documents.  A document's coverage rank is the rank at which the smallest prefix
of that vocabulary covers a fixed share of the document's tokens.  Coverage
ranks at four shares and the complexity of the sentences (words per sentence,
word length) are computed in SQL and compared with the language's own mean and
spread.  Judgements of readers calibrate them: a logistic model for "at least
intermediate" and one for "advanced" is fitted on at most about ``MAX_LABELS``
labelled documents (a documented bound, drawn by hash) and applied to all
documents as a SQL expression.

The language is decided by the text, since the given one may be wrong: the
language under whose word frequencies the text is most likely, with frequencies
over all documents as labelled.  A text none of whose words occurs under a label
keeps the given language, or ``und``.

Scale.  Joins on words take the most frequent ``HEAD`` rows of the word table as
a broadcast (a fixed bound); the rest, whose words are rare, is shuffled, so no
task holds the rows of a common word.

Defined results: ``n_words`` counts runs with a letter or digit in the text;
texts without a letter (null and empty ones too) have a null level and are never
found; texts under ``MIN_WORDS`` words get an estimate but are never advanced in
``advanced_documents``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexiloom.core.storage import materialize

SHARES = (0.5, 0.7, 0.8, 0.9)
MAX_LABELS = 50_000
#: Rows of a word table that are broadcast.
HEAD = 20_000
MIN_WORDS = 30
FEATURES = ("cover_50", "cover_70", "cover_80", "cover_90", "mean_rank", "sentence_mean", "sentence_weighted", "sentence_max", "word_length", "long_8", "long_10", "log_words")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1)


def n_words(text: Column) -> Column:
    """Runs of visible characters that hold a letter or digit; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, r"\s+"), lambda w: w.rlike(r"[\p{L}\p{N}]"))), F.lit(0))


def _sentence_lengths(text: Column) -> Column:
    parts = F.split(text, r"[.!?。！？\n]+")
    counts = F.transform(parts, lambda s: F.size(F.regexp_extract_all(s, F.lit(r"(\p{L}+)"), 1)))
    return F.filter(counts, lambda n: n > 0)


def tokens(documents: DataFrame) -> DataFrame:
    """``(doc_id, lang, word, n)``: how often each word occurs in each document."""
    return (
        documents.where("text is not null").select("doc_id", "lang", F.explode(_words(F.col("text"))).alias("word"))
        .groupBy("doc_id", "lang", "word").agg(F.count("*").alias("n"))
    )


def by_word(rows: DataFrame, table: DataFrame, on: list[str], weight: str) -> DataFrame:
    """``rows`` joined with ``table``, one row for each ``on``: its HEAD heaviest rows by broadcast, the others by shuffle."""
    head = materialize(table.orderBy(F.desc(weight), *on).limit(HEAD), "head")
    common = F.broadcast(head.select(*on).withColumn("_common", F.lit(True)))
    rare = lambda df: df.join(common, on, "left_anti")
    return rows.join(F.broadcast(head), on).unionByName(rare(rows).join(rare(table), on))


def languages(counted: DataFrame) -> DataFrame:
    """``(doc_id, own)``: the language under which a document's words are likeliest."""
    by_label = counted.where("lang is not null").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    totals = by_label.groupBy("lang").agg(F.sum("n").alias("total"))
    # one row a word, with its weight under each language
    profile = (
        by_label.join(F.broadcast(totals), "lang").withColumn("w", F.struct(F.col("lang").alias("own"), F.log(F.col("n") / F.col("total") * 1e7 + 1).alias("weight")))
        .groupBy("word").agg(F.sum("n").alias("all"), F.collect_list("w").alias("ws"))
    )
    met = by_word(counted.select("doc_id", "word", "n"), profile, ["word"], "all")
    scored = met.select("doc_id", "n", F.explode("ws").alias("w")).groupBy("doc_id", F.col("w.own").alias("own")).agg(F.sum(F.col("n") * F.col("w.weight")).alias("score"))
    likeliest = scored.groupBy("doc_id").agg(F.max_by("own", F.struct("score", "own")).alias("found"))
    given = counted.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    return given.join(likeliest, "doc_id", "left").select("doc_id", F.coalesce("found", "lang", F.lit("und")).alias("own"))


def features(documents: DataFrame) -> DataFrame:
    """One row for each document with words: its language and FEATURES."""
    counted = materialize(tokens(documents), "tokens")
    own = materialize(languages(counted), "languages")
    placed = counted.join(own, "doc_id").select("doc_id", "own", "word", "n")
    vocabulary = placed.groupBy("own", "word").agg(F.sum("n").alias("total"))
    # words of one language ranked without one task per language: equal counts share a rank
    spread = vocabulary.groupBy("own", "total").agg(F.count("*").alias("words"))
    ranked = spread.withColumn("rank", F.sum("words").over(Window.partitionBy("own").orderBy(F.desc("total")).rowsBetween(Window.unboundedPreceding, 0)))
    ranks = vocabulary.join(ranked.select("own", "total", "rank"), ["own", "total"]).select("own", "word", "total", F.log("rank").alias("rank"))
    # the running count over a document's ranks notes where each share is reached
    document = Window.partitionBy("doc_id", "own")
    running = by_word(placed, ranks, ["own", "word"], "total").select(
        "doc_id", "own", "rank", "n", F.sum("n").over(document.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)).alias("run"), F.sum("n").over(document).alias("all"),
    )
    cover = [F.min(F.when(F.col("run") >= F.col("all") * p, F.col("rank"))).alias(f"cover_{int(p * 100)}") for p in SHARES]
    covered = running.groupBy("doc_id", "own").agg(*cover, (F.sum(F.col("rank") * F.col("n")) / F.sum("n")).alias("mean_rank"))
    lengths = documents.where("text is not null").select(
        "doc_id", _sentence_lengths(F.col("text")).alias("sl"), F.transform(_words(F.col("text")), F.length).alias("wl"),
        n_words(F.col("text")).alias("n_words"),
    )
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x) / F.size(a)
    shape = lengths.where("size(sl) > 0").select(
        "doc_id", "n_words", F.log(mean(F.col("sl"))).alias("sentence_mean"),
        (F.aggregate("sl", F.lit(0.0), lambda t, x: t + x * x) / F.aggregate("sl", F.lit(0.0), lambda t, x: t + x)).alias("sentence_weighted"),
        F.log(F.array_max("sl")).alias("sentence_max"), mean(F.col("wl")).alias("word_length"),
        (F.size(F.filter("wl", lambda x: x >= 8)) / F.size("wl")).alias("long_8"),
        (F.size(F.filter("wl", lambda x: x >= 10)) / F.size("wl")).alias("long_10"), F.log(F.size("wl")).alias("log_words"),
    )
    return covered.join(shape, "doc_id").select("doc_id", "own", "n_words", *FEATURES).dropDuplicates(["doc_id"])


def standardized(rows: DataFrame) -> DataFrame:
    """Features as distances from the language's mean, in its standard deviations."""
    stats = rows.where(F.col("n_words") >= MIN_WORDS).groupBy("own").agg(
        *(F.avg(f).alias(f"m_{f}") for f in FEATURES), *(F.stddev_pop(f).alias(f"d_{f}") for f in FEATURES)
    )
    z = [F.coalesce((F.col(f) - F.col(f"m_{f}")) / F.nullif(F.col(f"d_{f}"), F.lit(0.0)), F.lit(0.0)).alias(f) for f in FEATURES]
    return rows.join(stats, "own", "left").select("doc_id", "own", "n_words", F.round(F.exp("cover_80")).cast("long").alias("coverage_rank"), F.exp("sentence_mean").alias("words_per_sentence"), *z)


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray | None = None, strength: float | None = None, rounds: int = 40) -> np.ndarray:
    """Weights (intercept first) of a ridge logistic regression, by Newton steps.

    The weights are drawn to ``prior`` (zero unless given) as by ``strength``
    labels; by default a hundredth of the labels, the intercept free.  Few labels
    shade into many without a switch, and none give the prior itself.
    """
    z = np.c_[np.ones(len(x)), x]
    mean = np.zeros(z.shape[1]) if prior is None else prior
    w = mean.copy()
    ridge = np.full(z.shape[1], strength) if strength is not None else 1e-2 * len(y) * np.r_[0.0, np.ones(x.shape[1])] + 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-9)
        w = w - np.linalg.solve(hessian, z.T @ (p - y) + ridge * (w - mean))
    return w


def _judged(labels: DataFrame) -> DataFrame:
    level = F.when(F.col("reading_level") == "advanced", 2).when(F.col("reading_level") == "intermediate", 1).when(F.col("reading_level") == "basic", 0)
    once = labels.select("doc_id", "rater_id", level.alias("level")).where("level is not null").distinct()
    return once.groupBy("doc_id").agg(F.avg("level").alias("level"))


def _probability(weights: np.ndarray) -> Column:
    score = F.lit(float(weights[0]))
    for f, w in zip(FEATURES, weights[1:], strict=True):
        score = score + F.col(f) * float(w)
    return 1 / (1 + F.exp(-score))


def reading_levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, lang, n_words, coverage_rank, words_per_sentence, p_intermediate, p_advanced, level)``."""
    rows = materialize(standardized(materialize(features(documents), "features")), "levels")
    labelled = rows.where(F.col("n_words") >= MIN_WORDS).join(_judged(labels), "doc_id")
    most = MAX_LABELS / max(1, labels.count())
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(1.0, most) * (1 << 20))).select("level", *FEATURES).toPandas()
    if len(sample):
        x, y = sample[list(FEATURES)].to_numpy(float), sample["level"].to_numpy(float)
        middle, high = fit_logistic(x, (y >= 0.5).astype(float)), fit_logistic(x, (y >= 1.5).astype(float))
    else:
        middle = high = np.zeros(1 + len(FEATURES))
    scored = rows.withColumn("p_intermediate", _probability(middle)).withColumn("p_advanced", _probability(high))
    level = F.when(F.col("p_advanced") >= 0.5, "advanced").when(F.col("p_intermediate") >= 0.5, "intermediate").otherwise("basic")
    known = scored.select("doc_id", F.col("own").alias("lang"), F.col("n_words").alias("found"), "coverage_rank", "words_per_sentence", "p_intermediate", "p_advanced", level.alias("level"))
    # texts with a letter have their count from the features
    counted = F.when(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)), 0).otherwise(n_words(F.col("text")))
    everyone = documents.groupBy("doc_id").agg(F.max(counted).alias("others"))
    return everyone.join(known, "doc_id", "left").select("doc_id", "lang", F.coalesce("found", "others").alias("n_words"), "coverage_rank", "words_per_sentence", "p_intermediate", "p_advanced", "level")


def advanced_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id`` of the documents at level advanced with at least MIN_WORDS words."""
    return reading_levels(documents, labels).where((F.col("level") == "advanced") & (F.col("n_words") >= MIN_WORDS)).select("doc_id")
