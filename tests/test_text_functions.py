import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text as T

P1 = (
    "Learning to pack containers well\nJohn Smith1 and Jane Doe2\nDepartment of Logistics, University of Nowhere\nAbstract\n"
    "We pack containers.\nKeywords: packing; bins\n1. Introduction\nContainers are everywhere.\nReferences\n[1] x"
)
P2 = "IEEE TRANSACTIONS ON BINS\nA second look at best fit\nAbstract—Best fit is old. It works.\nIndex Terms—bins, best fit\nI. INTRODUCTION\nBins."


def one(spark, value, expr):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(expr(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("raw, title", [
    (P1, "Learning to pack containers well"), (P2, "A second look at best fit"), ("", ""), (None, ""),
    ("1234\nshort", "1234"), ("12345678901\nJohn Smith, Jane Doe\nme@x.org is mine and long\nReal title of paper", "Real title of paper"),
])
def test_title(spark, raw, title):
    assert one(spark, raw, T.extract_title) == title


def test_abstract_branches(spark):
    assert one(spark, P1, T.extract_abstract) == "We pack containers.\nKeywords: packing; bins"
    assert one(spark, P2, T.extract_abstract) == "Best fit is old. It works."
    plain = "John Smith, Jane Doe\n" + "x" * 700
    assert one(spark, plain, T.extract_abstract) == "x" * 600
    assert one(spark, None, T.extract_abstract) == ""


def test_keywords(spark):
    assert one(spark, P1, T.extract_keywords) == ["packing", "bins"]
    assert one(spark, P2, T.extract_keywords) == ["—bins", "best fit"]
    assert one(spark, "關鍵字：裝箱問題、容器最佳化", T.extract_keywords) == ["：裝箱問題", "容器最佳化"]
    assert one(spark, "none here", T.extract_keywords) == []
    assert one(spark, None, T.extract_keywords) == []


def test_content_start_and_body(spark):
    assert one(spark, "\nme@x.org\nBody", T.content_start) == 0
    assert one(spark, "me@x.org\r\n12, 13\nBody", T.content_start) == len("me@x.org\r\n12, 13\n")
    assert one(spark, "me@x.org\nBody text.\n2 Related Work\nrest", T.extract_body) == "Body text."
    assert len(one(spark, "y" * 9000, T.extract_body)) == 4000
    assert one(spark, None, T.extract_body) == ""


def test_important_words_ties_by_first_place(spark):
    assert one(spark, "beta alpha alpha beta gamma these with a", T.important_words) == ["beta", "alpha", "gamma"]
    assert one(spark, None, T.important_words) == []


def test_small_functions(spark):
    assert one(spark, "cross-\nchan", T.join_hyphens) == "cross-chan"
    assert one(spark, "a\n\n\n\nb   c ", T.clean) == "a\n\nb c"
    names = spark.createDataFrame([(["a", "b", "c", "d"],), ([],), (["a"],)], "n array<string>")
    assert [r[0] for r in names.select(T.authors_et_al(F.col("n"))).collect()] == ["a, b, c et al.", "", "a"]
    q = spark.createDataFrame([("T", None, "alpha alpha beta"), (None, ["k1", "k2"], "x")], "t string, k array<string>, a string")
    assert [r[0] for r in q.select(T.search_query(F.col("t"), F.col("k"), F.col("a"))).collect()] == ["T alpha beta", " k1 k2"]
