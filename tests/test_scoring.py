import hashlib
import math
import re
import unicodedata
from collections import Counter

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from lexiloom.functions import grams
from lexiloom.operators import scoring, segments


def py_normal(t):
    t = unicodedata.normalize("NFKD", t.lower())
    return " ".join(re.sub(r"[^\w\s]", "", t).split())


def py_hash(g):
    return int(hashlib.md5(g.encode()).hexdigest()[:8], 16)


def py_winnow(h):
    return set(h) if len(h) < 4 else {min(h[i : i + 4]) for i in range(len(h) - 3)}


def py_print(t):
    n = py_normal(t)
    ws = n.split()
    return py_winnow([py_hash(n[i : i + 8]) for i in range(len(n) - 7)]) | py_winnow([py_hash(" ".join(ws[i : i + 3])) for i in range(len(ws) - 2)])


def py_cosine(a, b):
    def vec(t):
        ws = [w for w in re.findall(r"\b\w\w+\b", t.lower()) if w not in grams.STOP_WORDS]
        return Counter(ws + [f"{x} {y}" for x, y in zip(ws, ws[1:])])

    x, y = vec(a), vec(b)
    idf = lambda g: math.log(3 / (1 + (g in x) + (g in y))) + 1
    w = lambda v: {g: (1 + math.log(n)) * idf(g) for g, n in v.items()}
    x, y = w(x), w(y)
    norm = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(x[g] * y[g] for g in x if g in y) / norm if norm else 0.0


TEXTS = ["", "abc", "exactly8", "federated learning", "federated systems of learning", "Café ﬁeld trials in spring", "cafe field trials in spring", "the of and", "語音增強研究與語音增強方法"]


def test_fingerprints_match_the_model(spark):
    df = spark.createDataFrame(list(enumerate([*TEXTS, None])), "id long, text string")
    got = {r["id"]: set(r["fp"]) for r in scoring.fingerprints(df, "id").collect()}
    assert got == {i: py_print(t or "") for i, t in enumerate([*TEXTS, ""])}
    assert got[5] == got[6]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab éßñ12.,-漢", max_size=60), min_size=1, max_size=6))
def test_fingerprints_on_random_texts(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert {r["id"]: set(r["fp"]) for r in scoring.fingerprints(df, "id").collect()} == {i: py_print(t) for i, t in enumerate(texts)}


def test_tfidf_closed_form(spark):
    s = spark.createDataFrame([(1, TEXTS[3]), (2, TEXTS[4]), (3, "")], "src_id long, text string")
    c = spark.createDataFrame(list(enumerate(TEXTS)), "cand_id long, text string")
    pairs = s.select("src_id").crossJoin(c.select("cand_id"))
    got = {(r[0], r[1]): r[2] for r in scoring.tfidf_scores(pairs, s, c).collect()}
    for i, a in ((1, TEXTS[3]), (2, TEXTS[4]), (3, "")):
        for j, b in enumerate(TEXTS):
            assert abs(got.get((i, j), 0.0) - py_cosine(a, b)) < 1e-9
    assert abs(got[(1, 3)] - 1) < 1e-9


def test_scores_ranking_and_tiers(spark):
    papers = spark.createDataFrame([(1, "Bins and boxes", "We pack the bins tightly today.", ["bins", "bins", "zebra"], "Body about bins.", 0)], "doc_id long, title string, abstract string, keywords array<string>, body string, score int")
    same = "Bins and boxes We pack the bins tightly today. Body about bins."
    cands = spark.createDataFrame(
        [(1, 10, "A", same, 1), (1, 11, " a ", same, 2), (1, 12, None, None, 3), (1, 13, "", "", 4), (1, 14, "B", "Nothing shared whatsoever", 5), (9, 15, "C", same, 6)],
        "src_id long, cand_id long, title string, abstract string, arrival_seq long",
    )
    rows = {r["cand_id"]: r for r in scoring.ranked(scoring.score_pairs(scoring.first_arrivals(cands), papers)).collect()}
    assert sorted(rows) == [10, 12, 14]  # 11 repeats a title, 13 another blank one, 15 has no paper
    assert (rows[10]["tf"], rows[10]["fp"], rows[10]["kw"], rows[10]["score"], rows[10]["risk_tier"], rows[10]["rank"]) == (1000, 1000, 667, 933, "high", 1)
    assert rows[12]["score"] == 0 and rows[12]["rank"] == 2
    total = scoring.tier_summary(scoring.score_pairs(cands, papers)).first()
    assert total["total"] == 5 and total["high"] + total["medium"] + total["low"] == 5
    assert scoring.score_pairs(cands.limit(0), papers).count() == 0


def test_nearest_prints_equal_brute_force(spark, monkeypatch):
    a = scoring.fingerprints(spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id_l long, text string"), "id_l")
    b = scoring.fingerprints(spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id_r long, text string"), "id_r")
    prints = [py_print(t) for t in TEXTS]
    for most, k in ((10**6, 100), (20, 3)):
        monkeypatch.setattr(scoring, "BLOCK_LEFT", most)
        monkeypatch.setattr(scoring, "BLOCK_RIGHT", most)
        want = []
        for i, p in enumerate(prints):
            near = sorted((-len(p & q) / len(p | q), j) for j, q in enumerate(prints) if p & q)[:k]
            want += [(i, j, len(p & prints[j]), len(p | prints[j]), n + 1) for n, (_, j) in enumerate(near)]
        got = scoring.topk_jaccard(a, b, k).select("id_l", "id_r", "common", "united", "rank").collect()
        assert sorted(tuple(r) for r in got) == sorted(want)
    assert scoring.topk_jaccard(a.limit(0), b, 3).count() == 0 and scoring.topk_jaccard(a, b.limit(0), 3).count() == 0


def test_paragraphs_and_windows(spark):
    text = "Short.\n\nNow a paragraph that is certainly longer than forty characters.\nTail"
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(segments.paragraphs(F.col("t"))).collect()] == [["Short. Now a paragraph that is certainly longer than forty characters."], [], []]
    four = "First sentence here. Second sentence here. Third sentence here. Fourth sentence here."
    got = spark.createDataFrame([(four,), ("One only sentence.",), (None,)], "t string").select(segments.sentence_windows(F.col("t"))).collect()
    assert got[0][0] == ["First sentence here. Second sentence here. Third sentence here.", "Second sentence here. Third sentence here. Fourth sentence here."]
    assert got[1][0] == ["One only sentence."] and got[2][0] == [""]


def test_best_segment(spark):
    para = "Containers are filled by best fit, largest items first of all."
    s = spark.createDataFrame([(1, para + "\n\nA wholly different paragraph about something else entirely.")], "src_id long, text string")
    c = spark.createDataFrame([(7, "Unrelated opening sentence. Another one follows it. " + para + " The end is near now.")], "cand_id long, text string")
    rows = segments.best_segments(s.select("src_id").crossJoin(c.select("cand_id")), s, c).collect()
    assert rows[0]["paragraph_index"] == 0 and rows[0]["source_paragraph"] == para and rows[0]["overlap"] > 300
