import io
import zipfile

from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import documents
from lexiloom.sources import catalog, payloads


def test_broken_tei_stops_nothing(spark):
    rows = [
        (1, "<TEI><a></TEI>"), (2, "<p>a & b</p>"), (3, None), (4, ""), (5, "no mark-up"),
        (6, "<TEI xmlns='http://www.tei-c.org/ns/1.0'><titleStmt><title level='a'> T </title></titleStmt><text><body><p><ref>r</ref> tail</p><p>head <b>x</b> y</p></body></text></TEI>"),
        (7, "<TEI><profileDesc><abstract>All <i>of</i> it</abstract><textClass><keywords><term> k </term><term/></keywords></textClass></profileDesc></TEI>"), (8, "<TEI><body/></TEI>"),
    ]
    got = {r["doc_id"]: r for r in documents.parse_tei(spark.createDataFrame(rows, "doc_id long, tei string")).collect()}
    assert {k for k, r in got.items() if r["error"]} == {1, 2, 4, 5} and 3 not in got
    assert got[6]["paper"].asDict() == {"title": "T", "abstract": "", "keywords": [], "body": " head"}
    assert got[7]["paper"]["abstract"] == "All of it" and got[7]["paper"]["keywords"] == ["k"] and got[8]["paper"] is None


def test_headers_with_no_break_spaces(spark):
    raw = "Some title of it\n\nAbstract \nThe text.\n \n1 Introduction\nMore"
    row = spark.createDataFrame([(raw,)], "r string").select(T.extract_abstract(F.col("r")).alias("a")).first()
    assert row["a"] == "The text."


def test_file_names_choose_the_way(spark):
    paper = "struct<title:string,abstract:string,keywords:array<string>,body:string>"
    parse = lambda *ids: spark.createDataFrame([(i, (t, "", [], "")) for i, t in ids], f"doc_id long, paper {paper}")
    docs = spark.createDataFrame([(1, "a.PDF"), (2, "b.pdf"), (3, "c.pdf"), (4, "d.docx"), (5, "e.pdf"), (6, None)], "doc_id long, name string")
    out = documents.first_success(docs, parse((1, "t"), (4, "t")), parse((1, "l"), (2, "l"), (4, "l")), parse((1, "r"), (2, "r"), (3, "r"), (4, "r"), (6, "r")))
    assert {r["doc_id"]: (r["title"], r["parse_source"]) for r in out.collect()} == {
        1: ("t", "grobid"), 2: ("l", "layout"), 3: ("r", "regex"), 4: ("r", "regex"), 5: (None, None), 6: ("r", "regex"),
    }


def test_docx_files(spark, tmp_path):
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in ("First", " ", "Second &amp; last"))
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>')
    (tmp_path / "a.docx").write_bytes(made.getvalue())
    (tmp_path / "b.docx").write_bytes(b"no archive")
    got = {r["path"][-6:]: r for r in documents.read_files(spark, str(tmp_path)).collect()}
    assert got["a.docx"]["raw_text"] == "First\nSecond & last" and got["b.docx"]["raw_text"] is None and got["b.docx"]["error"]


def test_limits_count_usable_rows_only(spark):
    records = [(k, '{"bib": {"title": "%s"}}' % t) for k, t in enumerate(["abc", "A title", "Another one", "x", "A third"])]
    df = spark.createDataFrame(records, "seq int, payload string")
    assert [r["title"] for r in payloads.scholar_search(df, "seq", 2).orderBy("seq").collect()] == ["A title", "Another one"]
    page = "<table>" + "".join(f"<tr><td>{k}</td><td><a href='/x'>A long enough title {k}</a></td></tr>" for k in range(4)) + "</table>"
    assert payloads.thesis_rows(spark.createDataFrame([(page,)], "payload string"), 3).count() == 3


def test_sources_without_a_limit_are_not_active(spark):
    registry = catalog.registry(spark)
    limits = spark.createDataFrame([("arxiv", 5), ("semantic", 0), ("other", 3)], "id string, chosen int")
    assert [r["id"] for r in catalog.active(registry, limits).collect()] == ["arxiv"]
    assert catalog.active(registry, limits.where("chosen = 0")).count() == 0


def test_thesis_authors_and_years(spark):
    texts = [["no. 12", "year 1850 or 2011"], ["作者： Wang x"], ["甲乙丙丁戊己 庚辛"], ["甲"], []]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t array<string>")
    got = {r["k"]: (r["y"], r["a"]) for r in df.select("k", payloads.thesis_year(F.col("t")).alias("y"), payloads.thesis_author(F.col("t")).alias("a")).collect()}
    assert got == {0: (2011, ""), 1: (None, "Wang"), 2: (None, "甲乙丙丁戊己"), 3: (None, ""), 4: (None, "")}


def test_gutter_bands_follow_the_page_width(spark):
    import random

    from lexiloom.operators import layout

    r = random.Random(4)
    pages = [(k, w, [round(r.uniform(0, w), 2) if r.random() < 0.3 else round(r.choice((0.1, 0.3, 0.52)) * w + r.uniform(0, 0.15 * w), 2) for _ in range(300)]) for k, w in enumerate((595.32, 612.0, 600.1, 419.53, 841.89))]
    rows = [(k, 1, w, 800.0, "t", x, x + 5, 400.0, 410.0) for k, w, xs in pages for x in xs]
    words = spark.createDataFrame(rows, "doc_id long, page int, page_w double, page_h double, text string, x0 double, x1 double, top double, bottom double")
    got = {x["doc_id"]: x["split_x"] for x in layout.column_split(words).collect()}
    for k, w, xs in pages:
        starts = [w * 0.30]
        while starts[-1] + w * 0.02 / 2 < w * 0.70:
            starts.append(starts[-1] + w * 0.02 / 2)
        counts = [sum(s <= x < s + w * 0.02 for x in xs) for s in starts]
        least = counts.index(min(counts))
        assert got[k] == (starts[least] + w * 0.02 / 2 if min(counts) / max(counts) < 0.10 else None)
