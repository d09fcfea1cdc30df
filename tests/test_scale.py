"""Plans that stay whole on large tables: what is shuffled, broadcast and made of a row."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from lexiloom.functions import grams
from lexiloom.operators import scoring, segments

DATA = "/root/testdata/sf0.001"


def ran(df):
    """The rows' number and the plan as it ran."""
    n = len(df.collect())
    return n, df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["ranked_report", "risk_tier_summary", "detail_view", "streamed_scores", "tfidf_cosine", "fingerprint_jaccard"])
def test_scores_send_no_texts_or_grams_to_the_driver(spark, name):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")  # Spark's own
    try:
        n, plan = ran(contract.queries()[name](spark, DATA))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert n > 0 and "BroadcastExchange" not in plan and "Generate" not in plan


def test_a_batch_of_the_stream_sends_nothing_to_the_driver(spark):
    candidates, papers = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("candidates", "papers"))
    n, plan = ran(scoring.score_pairs(scoring.first_arrivals(candidates), papers))
    assert n > 0 and "BroadcastExchange" not in plan and "Generate" not in plan


@pytest.mark.parametrize("name", ["detail_segments", "segment_top5", "report_projection"])
def test_segments_leave_one_pass(spark, name):
    n, plan = ran(contract.queries()[name](spark, DATA))
    assert n > 0 and "BroadcastExchange" not in plan and "Generate" not in plan


def test_topk_ships_neither_side_once_for_each_block_of_the_other(spark):
    n, plan = ran(contract.queries()["topk_fingerprint"](spark, DATA))
    assert n > 0 and "CoGroup" not in plan and "Generate" not in plan


def test_a_pair_of_many_paragraphs_and_windows(spark):
    paras = [f"Paragraph number {i} tells of item {i * 7} in box {i * 13} and shelf {i * 31} here." for i in range(300)]
    s = spark.createDataFrame([(1, "\n\n".join(paras)), (2, "")], "src_id long, text string")
    c = spark.createDataFrame([(7, " ".join(paras)), (8, paras[5]), (9, None)], "cand_id long, text string")
    got = segments.best_segments(s.select("src_id").crossJoin(c.select("cand_id")), s, c, 2**31 - 1).collect()
    assert sum(r["cand_id"] == 7 for r in got) == 300
    best = max((r for r in got if r["cand_id"] == 8), key=lambda r: r["overlap"])
    assert (best["paragraph_index"], best["overlap"], best["candidate_snippet"]) == (5, 1000, paras[5])


def test_repeated_and_missing_sources(spark):
    s = spark.createDataFrame([(1, "apples and pears are fruit"), (1, "apples and pears are fruit"), (2, ""), (3, None)], "src_id long, text string")
    rows = spark.createDataFrame([(1, 5, "apples and pears are fruit"), (1, 6, None), (2, 5, "apples"), (3, 5, "x"), (4, 5, "apples"), (None, 5, "apples")], "src_id long, cand_id long, text string")
    got = {(r["src_id"], r["cand_id"]): (r["cosine"], r["common"] > 0, r["common"] == r["united"]) for r in scoring.met_scores(rows, s).collect()}
    assert got == {(1, 5): (1.0, True, True), (1, 6): (None, False, True), (2, 5): (None, False, True), (3, 5): (None, False, True)}


def test_prints_of_mixed_letters_in_bulk(spark):
    texts = ["", "abc", "x" * 70 + " " + "y" * 70 + " z", "a b c", "abcdefgh", "naïve ﬁelds 漢字 and plain words follow here", "same same same same same same"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: set(r["fp"]) for r in scoring.fingerprints(df, "id").collect()}
    want = {r["id"]: set(r["fp"]) for r in df.select("id", grams.fingerprint(grams.normalize(F.col("text"))).alias("fp")).collect()}
    assert got == want
