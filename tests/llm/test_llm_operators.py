import itertools
import random
import unicodedata

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lexiloom.llm import canonical, entity_match, near_duplicates, packing, reading_level, shared_spans, token_ids, truncation, words

WORDS = [f"{a}{b}{c}" for a in ("ba", "do", "ki", "lu", "me") for b in ("ra", "so", "ti", "vu", "xe") for c in ("n", "l", "m", "r", "s", "th")]


def text(seed, n):
    r = random.Random(seed)
    return " ".join(r.choices(WORDS, k=n))


# --- problem 4 ---------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("raw, want, found", [
    (None, None, False), ("", "", False), ("plain text", "plain text", False), ("a​b", "ab", True), ("a b", "a b", True),
    ("ｃｏｄｅ １２", "code 12", True), ("conﬁned traﬃc", "confined traffic", True), ("Café", "Café", True), ("Café", "Café", False),
    ("mаtter", "matter", True), ("Анализ систем", "Анализ систем", False), ("σ² = λ", "σ² = λ", False), ("“q” – x…", "“q” – x…", False),
    ("研究：方法，好。", "研究：方法，好。", False), ("end．", "end.", True), ("soft­hyphen", "softhyphen", True), ("a\nb\tc", "a\nb\tc", False),
])
def test_canonical_cases(raw, want, found):
    assert canonical.canonical(raw) == (want, found)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab аеο é́​ ｅ１ﬁ漢，。…σ².-　", max_size=40))
def test_canonical_is_stable_and_splices(raw):
    once, _ = canonical.canonical(raw)
    assert canonical.canonical(once) == (once, False) or canonical.canonical(once)[0] == once
    # parts apart by a plain space and newline canonicalize alone as they do together (outside Chinese text)
    if not any(unicodedata.category(c) == "Lo" or c in "，。" for c in raw):
        assert canonical.canonical_text(raw + " \n" + raw) == f"{once} \n{once}"


def test_every_character_comes_out_in_nfc_and_stable():
    for k in [*range(0xD800), *range(0xE000, 0x30000), *range(0xE0000, 0xE0200)]:
        for raw in (chr(k), f"a{chr(k)}b", f"={chr(k)}", f"{chr(k)}\u0301"):
            once = canonical.canonical_text(raw)
            assert unicodedata.is_normalized("NFC", once) and canonical.canonical_text(once) == once, hex(k)


def test_greek_may_stay_and_more_forms_are_plain():
    assert canonical.canonical("NF\u03baB") == ("NFkB", True) and canonical.canonical("NF\u03baB", greek=False) == ("NF\u03baB", False)
    assert canonical.canonical_text("\uff76\uff9e \U0001d400x \u212b \u3164y\U000e0041") == "\u30ac Ax \u00c5 y"
    assert canonical.canonical("a\x00b\x9fc\td") == ("abc\td", True)


def test_unstable_fields_in_spark(spark):
    df = spark.createDataFrame([(1, "a​", None, 0), (1, "a​", None, 1), (2, "x", "mаtter", 0), (3, None, None, 0)], "cand_id long, title string, abstract string, key int")
    assert {tuple(r) for r in canonical.unstable_fields(df, "cand_id", "title", "abstract").collect()} == {(1, "title"), (2, "abstract")}
    assert canonical.unstable_fields(df.limit(0), "cand_id", "title", "abstract").count() == 0
    assert canonical.canonicalize(df, "cand_id", "title", "abstract").count() == 4


# --- problem 1 ---------------------------------------------------------------------------------------------------

def brute(rows, threshold, least):
    sets = {}
    for i, t in rows:
        w = words.words_of(t)
        if len(w) >= max(least, 1) and i is not None:
            sets[i] = w
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def near_rows():
    rows = []
    for g in range(6):
        base = text(g, 160).split()
        for k in range(4):
            r = random.Random(100 * g + k)
            own = [w if r.random() > 0.03 * k else r.choice(WORDS) + "z" for w in base]
            r.shuffle(own)
            rows.append((10 * g + k, " ".join(own)))
    return [*rows, (90, rows[0][1]), (91, rows[0][1].upper()), (90, rows[0][1]), (92, None), (93, ""), (94, "too short"), (95, " ".join(f"w{k}" for k in range(30_000))), (None, rows[0][1])]


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows()
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "id long, t string, class int").repartition(3)
    want = brute(rows, 0.7, 75)
    got = {tuple(r) for r in near_duplicates.near_duplicate_pairs(df, "id", ("t",)).collect()}
    # the method may miss pairs that barely reach the threshold, never pairs well above it
    assert len(want) > 20 and got <= want and got >= brute(rows, 0.78, 75)
    groups = {r["id"]: r["group_id"] for r in near_duplicates.near_duplicate_groups(df, "id", ("t",)).collect()}
    assert set(groups) == {i for i, _ in rows if i is not None}
    assert all(groups[a] == groups[b] for a, b in got) and groups[92] == 92 and groups[95] == 95 and groups[91] == 0
    assert near_duplicates.near_duplicate_pairs(df.limit(0), "id", ("t",)).count() == 0


def test_signature_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(0)
    for share in (0.5, 0.8):
        common = rng.integers(0, 2**32, 800, dtype=np.uint32)
        own = [np.unique(np.r_[common, rng.integers(0, 2**32, int(800 * (1 - share) / share / 2), dtype=np.uint32)]) for _ in range(2)]
        low = near_duplicates.minima(own)
        equal = ((low[0] ^ low[1]) & 3 == 0).mean()
        assert abs((equal - 0.25) / 0.75 - share) < 0.2


# --- problem 5 ---------------------------------------------------------------------------------------------------

def test_shared_spans_equal_brute_force(spark):
    a = text(1, 150)
    abstracts = [(1, a), (2, text(2, 40) + a[300:430] + text(3, 30)), (3, text(4, 60) + a[100:219] + "#"), (4, "x" + a[500:621]), (5, a), (6, None), (7, ""), (8, "ab" * 400), (9, "ab" * 300 + "c"), (1, a), (10, "語" * 50 + a[10:130])]
    segs = [(100, 1, a[0:300], a[200:400]), (101, 2, "none", a[600:719]), (102, None, None, None), (100, 1, a[0:300], a[200:400]), (103, 9, "", a[700:820])]
    c = spark.createDataFrame([(i, t, "k") for i, t in abstracts], "cand_id long, abstract string, class string").repartition(3)
    s = spark.createDataFrame(segs, "seg_id long, cand_id long, source_paragraph string, candidate_snippet string")

    def share(x, y):
        return bool(x and y) and any(x[p : p + 120] in y for p in range(len(x) - 119))

    texts, rows = dict(abstracts), {x[0]: x for x in segs}
    want = {("abstract", i, j) for i, j in itertools.combinations(sorted(texts), 2) if share(texts[i], texts[j])}
    want |= {("paragraph", i, k) for i in texts for k, x in rows.items() if share(texts[i], x[2])}
    want |= {("snippet", i, k) for i in texts for k, x in rows.items() if share(texts[i], x[3]) and x[1] != i}
    assert {tuple(r) for r in shared_spans.shared_pairs(c, s).collect()} == want
    report = {(r["kind"], r["id"]): r for r in shared_spans.shared_report(c, s).collect()}
    assert report["abstract", 2]["shared_chars"] == 130 and report["abstract", 2]["n_spans"] == 1
    assert report["abstract", 3]["shared_chars"] == 0 and report["abstract", 1]["shared_chars"] == len(a)
    assert report["snippet", 100]["shared_chars"] == 200 and ("abstract", 6) not in report and report["abstract", 7]["n_chars"] == 0
    assert shared_spans.shared_pairs(c.limit(0), s.limit(0)).count() == 0


def test_shared_report_counts_every_other_record(spark):
    a, b, c = text(11, 60), text(12, 60), text(13, 60)
    abstracts = [(1, a), (2, c[:110]), (3, b[:150]), (3, b[20:150] + "#")]
    segs = [(10, 9, c[:200], b[200:330]), (11, 9, c[50:250], text(14, 40)), (12, 9, c[:200], b[190:340]), (13, 1, text(15, 40), a[40:180]), (14, 9, None, "")]
    cands = spark.createDataFrame(abstracts, "cand_id long, abstract string")
    s = spark.createDataFrame(segs, "seg_id long, cand_id long, source_paragraph string, candidate_snippet string")
    records = {("abstract", i, t) for i, t in abstracts}
    records |= {(k, x[0], x[n]) for x in segs for k, n in (("paragraph", 2), ("snippet", 3)) if x[n] is not None}

    def covered(kind, i, t):
        at = {p + k for p in range(len(t) - 119) for x in records if x[:2] != (kind, i) and t[p : p + 120] in x[2] for k in range(120)}
        return kind, i, len(t), len(at), sum(p - 1 not in at for p in at)

    got = sorted(tuple(r) for r in shared_spans.shared_report(cands, s).collect())
    assert got == sorted(covered(*r) for r in records)
    by = {r[:2]: r[3] for r in got}
    # paragraph with paragraph, snippet with snippet, a snippet with its own candidate's abstract
    assert (by["paragraph", 10], by["paragraph", 11], by["snippet", 12], by["snippet", 13], by["abstract", 1]) == (200, 150, 130, 140, 140)


# --- problem 6 ---------------------------------------------------------------------------------------------------

HARD = ["", " ", "a", "  a  b ", "x" * 5000, " " * 3000 + "a b" * 400, "日本語 テキスト" * 300, "<|endoftext|> hi " * 40, "it's we'll  don 't" * 50, "a\n\n b\tc  d" * 99, "naïve 😀 ½ ² " * 80]


def test_pieces_encode_exactly():
    encode = token_ids.encoder("byte_bpe_50k", token_ids.tokenizer_folder()).encode_ordinary
    for t in [*HARD, text(5, 4000)]:
        parts = token_ids.pieces(t)
        assert "".join(parts) == t and [i for p in parts for i in encode(p)] == encode(t)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab 1'\n\t.é漢😀  ", max_size=300))
def test_pieces_encode_exactly_on_random_texts(t):
    encode = token_ids.encoder("byte_bpe_50k", token_ids.tokenizer_folder()).encode_ordinary
    assert [i for p in token_ids.pieces(t) for i in encode(p)] == encode(t)


def test_encode_corpus(spark):
    encode = token_ids.encoder("byte_bpe_50k", token_ids.tokenizer_folder()).encode_ordinary
    rows = [(k, t) for k, t in enumerate([*HARD, text(5, 900), text(5, 900)])] + [(50, None), (1, " ")]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, key string").repartition(3)
    got = {r["doc_id"]: r["ids"] for r in token_ids.encode_corpus(df).collect()}
    assert got == {i: encode(t) if t else [] for i, t in rows}
    counts = {r["doc_id"]: r["n_tokens"] for r in token_ids.count_tokens(df).collect()}
    assert counts == {i: len(encode(t)) for i, t in rows if t}
    assert token_ids.encode_corpus(df.limit(0)).count() == 0


# --- problem 7 ---------------------------------------------------------------------------------------------------

def test_packing_keeps_capacity_and_everything(spark):
    r = random.Random(1)
    docs = [(i, r.choice(["en", "en", "de", None, "xx"]), r.choice([1, 5, 40, 99, 100, 101, 250, r.randint(1, 90)])) for i in range(1500)] + [(9000, "en", 0), (9001, "en", None)]
    limits = spark.createDataFrame([("en", 100), ("de", 64), ("und", 50)], "lang string, capacity int")
    sized = spark.createDataFrame(docs, "doc_id long, lang string, n_tokens int")
    rows = packing.pack(sized, limits, group_items=200).collect()
    cap = {"en": 100, "de": 64, "und": 50, "xx": 50}
    fill, got = {}, {}
    for x in rows:
        fill.setdefault((x["lang"], x["container_id"]), []).append(x["n_tokens"])
        got.setdefault(x["doc_id"], []).append((x["part"], x["start_token"], x["n_tokens"]))
    assert all(sum(v) <= cap[k[0]] for k, v in fill.items())
    assert len({k[1] for k in fill}) == len(fill)
    want = {i: n for i, _, n in docs if n}
    assert {i: sum(p[2] for p in v) for i, v in got.items()} == want
    lang = {i: g or "und" for i, g, _ in docs}
    assert all(len(v) == -(-want[i] // cap[lang[i]]) for i, v in got.items())
    for g in ("en", "de"):  # as good as one best fit over everything, but for a few percent
        items = [p[2] for i, v in got.items() if lang[i] == g for p in v]
        assert sum(1 for k in fill if k[0] == g) <= 1.03 * len(packing.best_fit(items, cap[g])) + 1
    assert packing.pack(sized.limit(0), limits).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit(sizes):
    bins = packing.best_fit(sizes, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 50 for b in bins)


# --- problem 8 ---------------------------------------------------------------------------------------------------

def test_reading_levels(spark):
    r = random.Random(3)
    easy, hard = ["it works", "i like it", "the box was fine"], [f"{w}isation notwithstanding {w}ological considerations substantially mitigates {w}" for w in WORDS[:40]]
    docs, labels = [], []
    for i in range(160):
        level = i % 2
        t = ". ".join(r.choices(easy, k=16)) if not level else ". ".join(" ".join(r.sample(hard, 3)) for _ in range(3))
        docs.append((i, t + ".", "en"))
        if i < 100:
            labels.append((i, 1, "advanced" if level else "basic"))
    docs += [(900, None, "en"), (901, "", None), (902, "12 34", None), (903, "It is short.", "en")]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    l = spark.createDataFrame([*labels, labels[0], (1, 2, None)], "doc_id long, rater_id int, reading_level string")
    got = {x["doc_id"] for x in reading_level.advanced_documents(d, l).collect()}
    assert got == {i for i in range(160) if i % 2}
    levels = {x["doc_id"]: x for x in reading_level.reading_levels(d, l).collect()}
    assert len(levels) == len(docs) and levels[900]["level"] is None and levels[901]["n_words"] == 0 and levels[0]["level"] == "basic"
    assert reading_level.advanced_documents(d.limit(0), l.limit(0)).count() == 0


def test_documents_without_language_evidence_are_not_lost(spark):
    docs = [(i, text(i, 64), None) for i in range(20)] + [(50, text(50, 40), "en"), (51, "Слово за словом " * 20, None), (52, "Слово " * 40, "xx"), (53, None, None), (54, "12 34", "en")]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in reading_level.reading_levels(d, spark.createDataFrame([], "doc_id long, rater_id int, reading_level string")).collect()}
    assert len(got) == len(docs) and all(got[i]["n_words"] == 64 and got[i]["level"] is not None and got[i]["lang"] == "en" for i in range(20))
    assert got[51]["lang"] == "xx" and got[53]["level"] is None and (got[54]["n_words"], got[54]["level"]) == (2, None)
    alone = reading_level.reading_levels(d.where("doc_id < 3"), spark.createDataFrame([], "doc_id long, rater_id int, reading_level string")).collect()
    assert [(x["lang"], x["n_words"]) for x in alone] == [("und", 64)] * 3


def test_coverage_ranks_equal_brute_force(spark):
    import collections
    import math

    docs = [(i, " ".join(random.Random(i).choices(WORDS[: 10 + 3 * i], k=50 + i)), "en") for i in range(25)]
    rows = {r["doc_id"]: r for r in reading_level.features(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    counts = collections.Counter(w for _, t, _ in docs for w in t.split())
    by_count = collections.Counter(counts.values())
    rank = {w: sum(k for c, k in by_count.items() if c >= n) for w, n in counts.items()}  # equal counts share the last rank
    for i, t, _ in docs:
        ranks = sorted(rank[w] for w in t.split())
        for share in reading_level.SHARES:
            assert abs(rows[i][f"cover_{int(share * 100)}"] - math.log(ranks[math.ceil(share * len(ranks) - 1e-9) - 1])) < 1e-9


# --- problem 3 ---------------------------------------------------------------------------------------------------

def test_truncation(spark):
    full = [f"The {WORDS[k % 50]} method lowers the error rate. We conclude that the {WORDS[(k * 7) % 50]} design deserves attention." for k in range(200)]
    cases = {
        1000: ("The method lowers the error ra", True), 1001: ("We conclude that the design deserves attent…", True), 1002: ("We conclude that the design", True),
        1003: ("The method lowers the error rate", False), 1004: ("The method lowers the error rate [12]", False), 1005: ("The method lowers the error rate. See https://x.example/1", False),
        1006: ("The method lowers the error rate. Keywords: error; rate", False), 1007: ("The method lowers the err</p>", True), 1008: ("The method lowers the error rate.</jats:p>", False),
        1009: ("The design deserves atten-", True), 1010: ("It ends.\n\nReferences", False), 1011: (None, False), 1012: ("  ", False), 1013: ("x" * 5000, False),
    }
    rows = [("t", i, "s", t) for i, t in enumerate(full)] + [("t", i, "s", c[0]) for i, c in cases.items()] + [("t", 1000, "s", cases[1000][0])]
    df = spark.createDataFrame(rows, "tbl string, rec_key long, origin string, text string")
    out = truncation.judged(df)
    cut = {r["rec_key"] for r in out.where("is_cut").collect()}
    assert cut == {i for i, c in cases.items() if c[1]}
    rate = truncation.cut_rates(out).first()
    assert rate["cut"] == len(cut) and rate["records"] == len(full) + len(cases) - 2
    assert truncation.judged(df.limit(0)).count() == 0


# --- problem 2 ---------------------------------------------------------------------------------------------------

def test_names_and_titles():
    assert entity_match.names("Yan, L.; Nopevin, Q.") == [{"yan"}, {"nopevin"}] and entity_match.names("PETH and others") == [{"peth"}]
    assert entity_match.names("Rar Peth, Jaordon Detenet et al.") == [{"rar", "peth"}, {"jaordon", "detenet"}] and entity_match.names(None) == []
    bag = lambda t: {x for k, x in entity_match.terms(t, None, None, None) if k == entity_match.TITLE}
    assert bag("Leanring Tturnaround") == bag("Learning turnaround") and bag("Part 12") != bag("Part 21") and bag("稀疏檢索") == {"稀疏", "疏檢", "檢索"}
    assert entity_match.part_number("A trial, Stage 2.") == "2" and entity_match.part_number("A trial") is None


def test_matches(spark):
    cands = [(i, f"{WORDS[i].title()}omar: adaptive filter for {WORDS[(i * 3) % 140]} control", f"An {WORDS[i].title()}a, Bo {WORDS[-i - 1].title()}o", 2000 + i % 20, None) for i in range(60)]
    cands += [(100, None, "X", 2000, None), (101, "", None, None, None), (102, cands[5][1], "Other Person", 2011, None), (103, "Series of bins, Part 1", "Cy Dax", 2001, None), (104, "Series of bins, Part 2", "Cy Dax", 2001, None), cands[0]]
    recs = [(500 + i, c[1].upper().replace(": ", " - "), f"{c[2].split(',')[0].split()[1]}, A.; {c[2].split()[-1]}, B.", c[3] + i % 2, None) for i, c in enumerate(cands[:40])]
    recs += [(700, "Series of bins, Part 2", "Dax, C.", 2002, None), (701, None, None, None, None), (702, cands[50][1].replace("adaptive", "adaptvie"), None, cands[50][3], None), (703, cands[51][1], None, cands[51][3] + 9, None), recs[0]]
    schema = "{} long, title string, authors string, year int, url string"
    got = {(r["cand_id"], r["rec_id"]) for r in entity_match.matches(spark.createDataFrame(cands, schema.format("cand_id")), spark.createDataFrame(recs, schema.format("rec_id"))).where("confidence >= 0.5").collect()}
    assert got == {(i, 500 + i) for i in range(40)} | {(104, 700), (50, 702)}
    empty = spark.createDataFrame(cands, schema.format("cand_id")).limit(0)
    assert entity_match.matches(empty, spark.createDataFrame(recs, schema.format("rec_id"))).count() == 0


def test_retrieval_equals_brute_force(spark):
    """Every pair above its floor is found, whatever the sketches, cells and parts drop."""
    import collections
    import math

    r = random.Random(7)
    pool, people = WORDS[:60], [f"{w}ovik" for w in WORDS[:40]]

    def row(i):
        title = " ".join(r.choices(pool, k=r.randint(1, 9)))
        authors = r.choice([None, "", ", ".join(f"Q {p}" for p in r.sample(people, r.randint(1, 5)))])
        return (i, title, authors, r.choice([None, 2001, 2002]), r.choice([None, None, f"https://x.example/10.5555/{r.randint(1, 60)}"]))

    cands, recs = [row(i) for i in range(300)], [row(1000 + i) for i in range(120)]
    schema = "{} long, title string, authors string, year int, url string"
    sides = spark.createDataFrame([*cands, cands[0], (None, "x", None, None, None)], schema.format("cand_id")), spark.createDataFrame([*recs, recs[0]], schema.format("rec_id"))
    found = entity_match.scored_pairs(*sides).collect()
    # the same with every token cut into parts
    assert {(x["cand_id"], x["rec_id"]) for x in entity_match.scored_pairs(*sides, part_load=20).collect()} == {(x["cand_id"], x["rec_id"]) for x in found}
    bags = {x[0]: set(entity_match.terms(*x[1:])) for x in [*cands, *recs]}
    df = collections.Counter(t for x in [*cands, cands[0], *recs, recs[0]] for t in bags[x[0]])
    n = len(cands) + len(recs) + 2
    w = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
    want = set()
    for rec in recs:
        own = bags[rec[0]]
        t_all, a_top = sum(w[t] for t in own if t[0] == entity_match.TITLE), sum(sorted((w[t] for t in own if t[0] == entity_match.AUTHOR), reverse=True)[:3])
        for cand in cands:
            both = own & bags[cand[0]]
            title, names = (sum(w[t] for t in both if t[0] == k) for k in (entity_match.TITLE, entity_match.AUTHOR))
            known = all(any(t[0] == entity_match.AUTHOR for t in b) for b in (own, bags[cand[0]]))
            names = min(names, a_top)
            enough = names > 0 and title + names >= 0.6 * (t_all + a_top) - 1e-9 if known else title >= 0.8 * t_all - 1e-9
            if enough or any(t[0] == entity_match.URL for t in both):
                want.add((cand[0], rec[0]))
    assert len(want) > 50 and {(x["cand_id"], x["rec_id"]) for x in found} == want
    assert len(found) <= len(want) * 1.1 + 10  # once a pair, but for repeated rows


def test_misspelt_record_stays_beside_an_exact_copy(spark):
    title = "Packet scheduling: latency evidence: Vabebiornetolu"
    cands = [(1, title, "Korth Dawirum", 2020, None)] + [(10 + i, f"{WORDS[i]} filter for {WORDS[i + 40]} control", f"An {WORDS[i]}a", 2001, None) for i in range(30)]
    recs = [(500, title, "Dawirum, K.", 2020, None), (501, "Packet shceduling: latency evideence: Vabebiornetolu", "Dawirum, K.", 2020, None)]
    schema = "{} long, title string, authors string, year int, url string"
    got = entity_match.matches(spark.createDataFrame(cands, schema.format("cand_id")), spark.createDataFrame(recs, schema.format("rec_id")))
    assert {(r["cand_id"], r["rec_id"]) for r in got.collect()} == {(1, 500), (1, 501)}


def test_registered_queries_name_the_contract():
    from lexiloom.llm import registry

    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 8)} | {"p6_ids", "p7_packed"} <= set(registry.QUERIES)
    assert F is not None
