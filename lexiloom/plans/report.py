"""The report: scored, de-duplicated, ranked and tiered candidates of each paper."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexiloom.functions.text import text
from lexiloom.operators.scoring import first_arrivals, ranked, risk_colour, score_pairs, tier_summary
from lexiloom.operators.segments import best_segments, segment_colour
from lexiloom.plans.labels import filled, label


def ranked_report(candidates: DataFrame, papers: DataFrame, threshold: float = 10.0) -> DataFrame:
    """All candidates at or above the threshold, ranked within their paper.

    Titles are de-duplicated before scoring, which gives the same rows as after
    it (the key does not depend on the score) and saves the work.
    """
    scored = ranked(score_pairs(first_arrivals(candidates), papers))
    return scored.where(F.col("score") >= round(threshold * 10))


def summary(report: DataFrame) -> DataFrame:
    """Total and tier counts per paper."""
    return tier_summary(report)


def matched_segments(report: DataFrame, papers: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matched paragraphs of the reported pairs only."""
    sources = papers.select(F.col("doc_id").alias("src_id"), F.concat_ws(" ", text("title"), text("abstract"), text("body")).alias("text"))
    texts = candidates.select("cand_id", text("abstract").alias("text")).dropDuplicates(["cand_id"])
    return best_segments(report, sources, texts)


def projection(report: DataFrame, segments: DataFrame, lang: str = "en") -> DataFrame:
    """The eleven report columns, the scores named in a language."""
    listed = segments.groupBy("src_id", "cand_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("overlap")).alias("o"), F.col("paragraph_index").alias("i")))).alias("ss")
    )
    one = lambda s: F.format_string("#%d(%d.%d%%)", s["i"] + 1, F.floor(-s["o"] / 10), -s["o"] % 10)
    rows = report.join(listed.hint("merge"), ["src_id", "cand_id"], "left")  # lists are estimated as one entry each
    return rows.select(
        "src_id", "rank",
        (F.col("score") / 10).alias(label("metric_combined", lang)), (F.col("tf") / 10).alias(label("metric_tfidf", lang)),
        (F.col("fp") / 10).alias(label("metric_ngram", lang)), (F.col("kw") / 10).alias(label("metric_keyword", lang)),
        F.coalesce(F.array_join(F.transform("ss", one), "; "), F.lit("")).alias("Matched Paragraphs"),
        text("title").alias("Title"), text("authors").alias("Authors"), F.col("year").alias("Year"), F.col("source").alias("Source"),
        text("url").alias("URL"), F.substring(text("abstract"), 1, 300).alias("Abstract"),
    )


def write_csv(rows: DataFrame, path: str) -> None:
    """The report as CSV with a header; the files follow the rows' partitions."""
    rows.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def detail(report: DataFrame, lang: str = "en") -> DataFrame:
    """What a detail view shows of each result: heading, cut texts, names for what is unknown, scores, matched keywords."""
    unknown, tier = F.lit(label("unknown", lang)), F.col("risk_tier")
    score = lambda c: F.concat(F.floor(F.col(c) / 10), F.lit("."), F.col(c) % 10, F.lit("%"))
    names = F.create_map(*[F.lit(x) for t in ("high", "medium", "low") for x in (t, label(f"risk_{t}", lang))])
    title = F.substring(text("title"), 1, 90)
    return report.select(
        "src_id", "cand_id", filled("expander_result", lang, icon=risk_colour(tier), i=F.col("rank"), title=title, score=F.col("score") / 10).alias("heading"),
        risk_colour(tier).alias("mark"), title.alias("short_title"), F.substring(text("abstract"), 1, 400).alias("short_abstract"),
        F.coalesce(F.nullif("authors", F.lit("")), unknown).alias("authors"), F.coalesce(F.nullif("year", F.lit(0)).cast("string"), unknown).alias("year"), text("url").alias("link"), "source",
        F.array_join("matched_keywords", "`, `").alias("keywords"), names[tier].alias("risk"), *(score(c).alias(f"{n}_shown") for c, n in (("score", "combined"), ("tf", "tfidf"), ("fp", "ngram"), ("kw", "keyword"))),
        (F.col("score") >= 600).alias("expanded"),
    )


def detail_segments(segments: DataFrame, lang: str = "en") -> DataFrame:
    """The matched segments as a detail view shows them: named paragraph, overlap, colour, both texts."""
    percent = F.concat(F.floor(F.col("overlap") / 10), F.lit("."), F.col("overlap") % 10, F.lit("%"))
    return segments.select(
        "src_id", "cand_id", "paragraph_index", filled("para_source", lang, n=F.col("paragraph_index") + 1).alias("place"), F.concat(F.lit(label("para_overlap", lang) + " "), percent).alias("shown"),
        segment_colour(F.col("overlap") / 10).alias("colour"), "source_paragraph", "candidate_snippet",
    )


def progress(candidates: DataFrame, limits: DataFrame) -> DataFrame:
    """Share of each source's limit that has arrived per paper, at most 1."""
    got = candidates.groupBy("src_id", "source").agg(F.count("*").alias("done"))
    return got.join(F.broadcast(limits), "source").select("src_id", "source", "done", F.least(F.lit(1.0), F.col("done") / F.col("max_results")).alias("share"))
