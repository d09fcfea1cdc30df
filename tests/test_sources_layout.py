import json

from lexiloom.core.links import components, member_pairs
from lexiloom.operators import documents, layout
from lexiloom.plans import labels, report
from lexiloom.sources import catalog, payloads


def frame(spark, *bodies):
    return spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "resp long, payload string")


def test_semantic_rows(spark):
    body = {"data": [
        {"title": "A", "abstract": "text", "year": 2001, "authors": [{"name": n} for n in "abcd"], "url": "", "externalIds": {"DBLP": "conf/other/x", "DOI": "10.1007/9"}},
        {"title": None, "abstract": "t2", "authors": None, "openAccessPdf": {"url": "http://pdf"}, "externalIds": None},
        {"title": "C", "abstract": ""},
    ]}
    rows = payloads.semantic_rows(frame(spark, json.dumps(body), "not json", None)).orderBy("pos").collect()
    assert [(r["title"], r["authors"], r["url"], r["source"]) for r in rows] == [
        ("A", "a, b, c et al.", "https://doi.org/10.1007/9", "Springer"), ("", "", "http://pdf", "Semantic Scholar"),
    ]
    assert payloads.payload_errors(frame(spark, json.dumps(body), "not json"), payloads.SEMANTIC_SCHEMA).count() == 1


def test_crossref_rows(spark):
    long = "<jats:p>An abstract of more than thirty characters.</jats:p>"
    items = [{"title": ["T"], "abstract": long, "author": [{"family": "Doe"}, {"given": "J", "family": "Roe"}], "published": {"date-parts": [[]]}, "published-print": {"date-parts": [[1999, 2]]}, "DOI": "10.1145/1", "container-title": []},
             {"title": [], "abstract": "<p>short</p>"}, {"abstract": long, "URL": "http://x", "container-title": ["IEEE Things"]}]
    rows = payloads.crossref_rows(frame(spark, json.dumps({"message": {"items": items}}))).orderBy("pos").collect()
    assert [(r["title"], r["authors"], r["year"], r["url"], r["source"]) for r in rows] == [("T", "Doe, J Roe", 1999, "https://doi.org/10.1145/1", "ACM"), ("", "", None, "http://x", "IEEE")]


def test_atom_rows(spark):
    feed = '<entry><title>T &amp; U</title><summary> S\n s </summary><published>2011-01</published><name>a</name><link href="u1"/><link type="text/html" href="u2"/></entry><entry><title>x</title></entry>'
    (row,) = payloads.atom_rows(frame(spark, feed)).collect()
    assert (row["title"], row["abstract"], row["year"], row["authors"], row["url"]) == ("T &amp; U", "S\n s", 2011, "a", "u2")


def test_scholar_and_springer_rows(spark):
    pubs = [{"bib": {"title": "A long title", "author": ["a", "b"], "pub_year": "x"}, "eprint_url": "e"}, {"bib": {"title": "tiny"}}, {"bib": {"title": "Another title", "abstract": "abs", "author": "Solo", "pub_year": "2003"}}]
    rows = payloads.scholar_rows(frame(spark, *map(json.dumps, pubs))).orderBy("resp").collect()
    assert [(r["abstract"], r["authors"], r["year"], r["url"]) for r in rows] == [("A long title", "a, b", None, "e"), ("abs", "Solo", 2003, "")]
    rec = {"records": [{"title": "T", "abstract": "x" * 30, "url": [{"value": "v"}], "creators": [{"creator": "c"}], "publicationDate": "2020-01"}, {"abstract": " short "}]}
    (row,) = payloads.springer_rows(frame(spark, json.dumps(rec)), "L").collect()
    assert (row["url"], row["year"], row["source"]) == ("v", 2020, "L")
    both = frame(spark, "a", "b", "c")
    assert payloads.springer_search(both, both, "resp", 1).count() == 2


def test_springer_split_limits_each_paper(spark, tmp_path):
    from lexiloom.plans.registry import springer_split

    # papers 1 and 2 exceed the limit of 5 journals and 6 books, paper 3 does not
    rows = [(1 + k // 2 % 2, 100 + k, "springer", k) for k in range(40)] + [(3, 200 + k, "springer", 40 + k) for k in range(3)] + [(3, 300, "arxiv", 43)]
    spark.createDataFrame(rows, "src_id long, cand_id long, source string, arrival_seq long").write.parquet(f"{tmp_path}/candidates.parquet")
    of = {c: s for s, c, *_ in rows}
    got = sorted((of[r["cand_id"]], r["arrival_seq"] % 2) for r in springer_split(spark, str(tmp_path)).collect())
    assert got == [(1, 0)] * 5 + [(1, 1)] * 6 + [(2, 0)] * 5 + [(2, 1)] * 6 + [(3, 0)] * 2 + [(3, 1)]


def test_thesis_strategies(spark):
    table = "<table><tr><td>1<td><a href='/t/1'>A title of some length</a><td>作者: 王小明 2019</tr><tr><td>An abstract in the next row, longer than thirty.</td></tr></table>"
    block = "<div class='thesis-item'><h3>Block title long</h3><a href='http://x/2'>go</a><p>" + "words " * 12 + "</p></div>"
    link = "<a href='/thesis/3'>A bare link title</a><a href='/other'>Not a thesis at all</a>"
    rows = payloads.thesis_rows(frame(spark, table, block, link, None, "<p")).orderBy("resp").collect()
    assert [(r["resp"], r["title"], r["year"], r["url"]) for r in rows] == [
        (0, "A title of some length", 2019, "https://ndltd.ncl.edu.tw/t/1"), (1, "Block title long", None, "http://x/2"), (2, "A bare link title", None, "https://ndltd.ncl.edu.tw/thesis/3"),
    ]
    assert rows[0]["authors"] == "王小明" and rows[0]["abstract"].startswith("An abstract")


def test_registry_and_union(spark):
    reg = catalog.registry(spark)
    assert reg.count() == 6 and catalog.enabled(reg, []).count() == 0 and catalog.enabled(reg, ["arxiv"]).count() == 1
    both = catalog.union_sources({"springer": frame(spark, "x"), "semantic": frame(spark, "y")})
    assert [r["payload"] for r in both.orderBy("ordinal").collect()] == ["y", "x"]


def test_tei(spark):
    tei = "<TEI xmlns='http://www.tei-c.org/ns/1.0'><teiHeader><fileDesc><titleStmt><title level='a'>T</title></titleStmt></fileDesc><profileDesc><abstract><p>One <ref>r</ref> lost</p><p>two</p></abstract><textClass><keywords><term>k</term><term> </term></keywords></textClass></profileDesc></teiHeader><text><body><p>B</p></body></text></TEI>"
    rows = {r["doc_id"]: r["paper"] for r in documents.parse_tei(spark.createDataFrame([(1, tei), (2, None), (3, "<a/>")], "doc_id long, tei string")).collect()}
    assert (rows[1]["title"], rows[1]["abstract"], rows[1]["keywords"], rows[1]["body"]) == ("T", "One two", ["k"], "B")
    assert 2 not in rows and rows[3] is None


def _word(doc, text, x0, top, w=600.0, h=800.0):
    return (doc, 1, w, h, text, float(x0), float(x0 + 30), float(top), float(top + 10))


def test_columns_and_reading_order(spark):
    rows = [_word(1, "wide", 260, 100)] + [_word(1, f"l{k}", 60 + (k * 13) % 210, 300 + 12 * (k // 5)) for k in range(60)] + [_word(1, f"r{k}", 330 + (k * 13) % 210, 300 + 12 * (k // 5)) for k in range(60)]
    rows += [_word(2, f"s{k}", 40 + (k * 7) % 500, 300 + k) for k in range(300)]
    schema = "doc_id long, page int, page_w double, page_h double, text string, x0 double, x1 double, top double, bottom double"
    words = spark.createDataFrame(rows, schema)
    split = {r["doc_id"]: r["split_x"] for r in layout.column_split(words).collect()}
    assert 250 < split[1] < 330 and split[2] is None
    order = layout.reading_order(words.where("doc_id = 1")).orderBy("region", "line").collect()
    assert order[0]["text"] == "wide" and order[1]["text"].startswith("l0 l1") and order[-1]["text"].startswith("r")
    assert layout.words_to_lines(words.limit(0)).count() == 0


def test_font_title(spark):
    def line(text, top, size, x=50.0):
        return [(1, 1, 800.0, c, x + i * size / 2, x + (i + 1) * size / 2, top, size) for i, c in enumerate(text) if c != " "]

    rows = line("RUNNING HEADER", 20.0, 30.0) + line("A", 300.0, 40.0) + line("The title of it all", 100.0, 20.0) + line("in two lines", 122.0, 20.0) + line("body text here", 200.0, 10.0)
    chars = spark.createDataFrame(rows, "doc_id long, page int, page_h double, text string, x0 double, x1 double, top double, size double")
    assert layout.font_title(chars).first()["title"] == "The title of it all in two lines"


def test_components_and_member_pairs(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 3), (8, 9)], "a long, b long")
    assert {r["vertex"]: r["label"] for r in components(links).collect()} == {3: 3, 4: 3, 5: 3, 8: 8, 9: 8}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r["label"] for r in components(chain).collect()} == {0}
    members = spark.createDataFrame([(1, i) for i in range(7)] + [(2, 20)], "class long, id long")
    pairs = member_pairs(spark.createDataFrame([(1, 1), (1, 2)], "class_a long, class_b long"), members, block=2)
    assert pairs.count() == 7 * 6 // 2 + 7


def test_labels(spark):
    asked = spark.createDataFrame([("risk_high", "en"), ("risk_high", "xx"), ("nope", "ja")], "key string, lang string")
    got = {(r["key"], r["lang"]): r["label"] for r in labels.translated(asked, labels.labels(spark)).collect()}
    assert got == {("risk_high", "en"): "High Risk", ("risk_high", "xx"): "高風險", ("nope", "ja"): "nope"}


def test_stream_scores_files_once(spark, tmp_path):
    from lexiloom.streaming import arrivals

    papers = spark.createDataFrame([(1, "T", "We pack the bins tightly.", ["bins"], "")], "doc_id long, title string, abstract string, keywords array<string>, body string")
    cands = spark.createDataFrame([(1, k, f"title {k % 3}", "We pack the bins tightly.", k) for k in range(6)], "src_id long, cand_id long, title string, abstract string, arrival_seq long")
    cands.repartition(2).write.parquet(str(tmp_path / "in"))
    q = arrivals.score_stream(arrivals.candidate_stream(spark, str(tmp_path / "in"), cands.schema, 1), papers, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert sorted(r["cand_id"] for r in arrivals.latest(spark, str(tmp_path / "out")).collect()) == [0, 1, 2]
    report.write_csv(arrivals.latest(spark, str(tmp_path / "out")).drop("matched_keywords"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
