"""Queries of the core by name; their SQL counterparts are in ``oracle``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexiloom.core import storage
from lexiloom.core.tables import load
from lexiloom.functions import grams, text as T
from lexiloom.operators import documents, layout, scoring, segments
from lexiloom.plans import labels, oracle, report
from lexiloom.sources import catalog, payloads
from lexiloom.streaming import arrivals

QUERIES: dict = {}


def query(f):
    """Register a query under its own name."""
    QUERIES[f.__name__] = f
    return f


def _papers(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "papers")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "candidates")


def _sources(spark: SparkSession, d: str) -> DataFrame:
    # by key before the fingerprints, which are larger than the texts and joined by it
    p = _papers(spark, d).dropDuplicates(["doc_id"])
    return p.select(F.col("doc_id").alias("src_id"), T.source_text(F.col("title"), F.col("abstract"), F.col("body")).alias("text"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("cand_id", T.text("abstract").alias("text")).dropDuplicates(["cand_id"])


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("src_id", "cand_id").distinct()


@query
def ranked_report(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: scored, de-duplicated, ranked candidates of every paper."""
    rows = report.ranked_report(_candidates(spark, d), _papers(spark, d))
    return rows.select("src_id", "cand_id", "arrival_seq", F.col("tf").alias("tfidf_tenths"), F.col("kw").alias("keyword_tenths"), F.col("fp").alias("fingerprint_tenths"), F.col("score").alias("combined_tenths"), "risk_tier", F.col("rank").cast("long").alias("rank"))


@query
def streamed_scores(spark: SparkSession, d: str) -> DataFrame:
    """The candidates arriving as a stream of files, scored batch by batch; the first arrival of each title."""
    folder = f"{storage.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    # a file or a folder of files: the pattern names either
    stream = arrivals.candidate_stream(spark, f"{d}/candidates.parque[t]", _candidates(spark, d).schema)
    arrivals.score_stream(stream, _papers(spark, d), f"{folder}/out", f"{folder}/state").awaitTermination()
    return arrivals.latest(spark, f"{folder}/out").select("src_id", "cand_id", "arrival_seq", F.col("score").alias("combined_tenths"))


@query
def risk_tier_summary(spark: SparkSession, d: str) -> DataFrame:
    return report.summary(report.ranked_report(_candidates(spark, d), _papers(spark, d)))


@query
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("cand_id", grams.normalize(F.col("text")).alias("normalized"))


@query
def char_kgram_counts(spark: SparkSession, d: str) -> DataFrame:
    one = _texts(spark, d).select("cand_id", grams.normalize(F.col("text")).alias("n"))
    return one.select("cand_id", F.size(grams.char_grams(F.col("n"))).cast("long").alias("n_grams"), F.size(F.array_distinct(grams.char_grams(F.col("n")))).cast("long").alias("n_distinct"))


@query
def word_ngram_counts(spark: SparkSession, d: str) -> DataFrame:
    one = _texts(spark, d).select("cand_id", grams.normalize(F.col("text")).alias("n"))
    return one.select("cand_id", F.size(grams.word_grams(F.col("n"))).cast("long").alias("n_grams"))


@query
def fingerprint_sizes(spark: SparkSession, d: str) -> DataFrame:
    return scoring.fingerprints(_texts(spark, d), "cand_id").select("cand_id", F.size("fp").cast("long").alias("n_hashes"))


@query
def fingerprint_hashes(spark: SparkSession, d: str) -> DataFrame:
    return scoring.fingerprints(_sources(spark, d), "src_id").select("src_id", F.explode("fp").alias("h"))


@query
def fingerprint_jaccard(spark: SparkSession, d: str) -> DataFrame:
    met = scoring.fingerprint_scores(_pairs(spark, d), _sources(spark, d), _texts(spark, d))
    return met.select("src_id", "cand_id", "common", F.col("united").cast("long").alias("united"), scoring.tenths(F.col("common"), F.col("united")).alias("tenths"))


@query
def topk_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest candidates of each paper, among all candidates."""
    left = scoring.fingerprints(_sources(spark, d).withColumnRenamed("src_id", "id_l"), "id_l")
    right = scoring.fingerprints(_texts(spark, d).withColumnRenamed("cand_id", "id_r"), "id_r")
    best = scoring.topk_jaccard(left, right, 10)
    return best.select(F.col("id_l").alias("src_id"), F.col("id_r").alias("cand_id"), "common", "united", F.col("rank").cast("long").alias("rank"))


@query
def tfidf_terms(spark: SparkSession, d: str) -> DataFrame:
    weights = scoring.gram_weights(_sources(spark, d), "src_id")
    return weights.groupBy("src_id").agg(F.count("*").alias("n_terms"), F.round(F.sum(F.col("w") * F.col("w")), 4).alias("sum_w2"))


@query
def tfidf_cosine(spark: SparkSession, d: str) -> DataFrame:
    met = scoring.tfidf_scores(_pairs(spark, d), _sources(spark, d), _texts(spark, d))
    return met.select("src_id", "cand_id", F.round("cosine", 6).alias("cosine"))


@query
def keyword_overlap(spark: SparkSession, d: str) -> DataFrame:
    rows = _candidates(spark, d).join(_papers(spark, d).select(F.col("doc_id").alias("src_id"), "keywords"), "src_id")
    matched, share = scoring.keyword_overlap(F.col("keywords"), F.col("abstract"))
    return rows.select("arrival_seq", F.array_join(matched, "|").alias("matched"), share.alias("tenths"))


@query
def combined_score(spark: SparkSession, d: str) -> DataFrame:
    """Stored scores combined anew, beside the stored value."""
    s = load(spark, d, "scores")
    t = lambda c: F.coalesce(F.floor(F.col(c) * 10 + 0.5), F.lit(0)).cast("long")
    c = scoring.combined_tenths(t("tfidf_score"), t("keyword_overlap"), t("fingerprint_score"))
    return s.select("src_id", "cand_id", c.alias("combined_tenths"), scoring.risk_tier(c).alias("tier"), (F.abs(c - t("combined_score")) > 1).alias("is_stale"))


@query
def dedup_titles(spark: SparkSession, d: str) -> DataFrame:
    return scoring.first_arrivals(_candidates(spark, d)).select("src_id", "cand_id", "arrival_seq")


@query
def important_words(spark: SparkSession, d: str) -> DataFrame:
    return _papers(spark, d).select("doc_id", F.array_join(T.important_words(F.col("abstract")), " ").alias("words"))


@query
def search_query(spark: SparkSession, d: str) -> DataFrame:
    return _papers(spark, d).select("doc_id", T.search_query(F.col("title"), F.col("keywords"), F.col("abstract")).alias("query"))


@query
def paragraph_split(spark: SparkSession, d: str) -> DataFrame:
    return _papers(spark, d).select("doc_id", F.posexplode(segments.paragraphs(F.col("body"))).alias("pos", "paragraph"))


@query
def sentence_windows(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("cand_id", F.posexplode(segments.sentence_windows(F.col("text"))).alias("pos", "win"))


def _segments(spark: SparkSession, d: str, top: int) -> DataFrame:
    return segments.best_segments(_pairs(spark, d), _sources(spark, d), _texts(spark, d), top)


@query
def segment_best_match(spark: SparkSession, d: str) -> DataFrame:
    """The best window of every paragraph that reaches the least overlap."""
    return _segments(spark, d, 2**31 - 1)


@query
def segment_top5(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d, segments.TOP)


@query
def segment_colours(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "segments", "seg_id", "overlap_score").distinct()
    return s.select("seg_id", segments.segment_colour(F.col("overlap_score")).alias("colour"))


@query
def extract_title(spark: SparkSession, d: str) -> DataFrame:
    return _papers(spark, d).select("doc_id", T.extract_title(F.col("raw_text")).alias("title"))


@query
def extract_abstract(spark: SparkSession, d: str) -> DataFrame:
    return _papers(spark, d).select("doc_id", T.extract_abstract(F.col("raw_text")).alias("abstract"))


@query
def extract_keywords(spark: SparkSession, d: str) -> DataFrame:
    return _papers(spark, d).select("doc_id", F.array_join(T.extract_keywords(F.col("raw_text")), "|").alias("keywords"))


@query
def extract_body(spark: SparkSession, d: str) -> DataFrame:
    return _papers(spark, d).select("doc_id", T.extract_body(F.col("raw_text")).alias("body"))


@query
def content_start(spark: SparkSession, d: str) -> DataFrame:
    return _papers(spark, d).select("doc_id", T.content_start(F.col("raw_text")).alias("at"))


@query
def long_enough(spark: SparkSession, d: str) -> DataFrame:
    return _papers(spark, d).select("doc_id", documents.long_enough(F.col("raw_text")).alias("ok"))


@query
def parse_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Papers through TEI, layout and patterns; the best parse wins, files other than .pdf have patterns only."""
    p = _papers(spark, d)
    esc = lambda c: F.replace(F.replace(T.text(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    tei = F.when(F.col("parse_source") == "grobid", F.concat(
        F.lit("<TEI><teiHeader><fileDesc><titleStmt><title type='main'>"), esc("title"), F.lit("</title></titleStmt></fileDesc><profileDesc><abstract><p>"),
        esc("abstract"), F.lit("</p></abstract></profileDesc></teiHeader><text><body><p>"), esc("body"), F.lit("</p></body></text></TEI>"),
    ))
    by_tei = documents.parse_tei(p.select("doc_id", tei.alias("tei")))
    pattern = documents.parse_text(p.where(documents.long_enough(F.col("raw_text")))).select("doc_id", F.struct("title", "abstract", "keywords", "body").alias("paper"))
    files = p.select("doc_id", F.concat(F.lit("file"), F.when(F.col("parse_source") == "regex", ".docx").otherwise(".PDF")).alias("name"))
    by_layout = documents.parse_layout(_words(spark, d), _chars(spark, d))
    return documents.first_success(files, by_tei, by_layout, pattern).select("doc_id", "title", "parse_source")


@query
def tei_errors(spark: SparkSession, d: str) -> DataFrame:
    """TEI documents of which every third is cut off: the broken ones give an error, the others a paper."""
    p = _papers(spark, d).select("doc_id", F.concat(F.lit("<TEI><titleStmt><title>x"), F.when(F.col("doc_id") % 3 > 0, "</title></titleStmt></TEI>").otherwise("</title>")).alias("tei"))
    return documents.parse_tei(p).select("doc_id", F.col("paper.title").alias("title"), F.col("error").isNotNull().alias("broken"))


@query
def join_hyphens(spark: SparkSession, d: str) -> DataFrame:
    """Titles broken into a line for each word or half word, and joined again."""
    broken = F.replace(F.replace(T.text("title"), F.lit("-"), F.lit("-\n")), F.lit(" "), F.lit(" -\n"))
    return _papers(spark, d).select("doc_id", T.join_hyphens(broken).alias("joined"))


@query
def line_kinds(spark: SparkSession, d: str) -> DataFrame:
    """What each line of a raw first page is taken for."""
    lines = _papers(spark, d).select("doc_id", F.posexplode(T.lines(T.text("raw_text"))).alias("pos", "line"))
    return lines.select("doc_id", "pos", T.is_author_line(F.col("line")).alias("is_authors"), T.is_front_matter(F.col("line")).alias("is_front"))


@query
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return _papers(spark, d).select("doc_id", T.clean(F.replace(T.text("body"), F.lit(". "), F.lit(" .  \n\n\n\n"))).alias("cleaned"))


def _payload(spark: SparkSession, d: str, source: str, make) -> DataFrame:
    rows = _candidates(spark, d).where(F.col("source") == source)
    return rows.select("arrival_seq", make.alias("payload"))


def _name_array():
    return F.filter(F.split(F.regexp_replace(T.text("authors"), " et al\\.$", ", Q. More"), ", "), lambda a: a != "")


@query
def s2_rows(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct("title", "abstract", "year", F.transform(_name_array(), lambda a: F.struct(a.alias("name"))).alias("authors"), "url",
                    F.struct(F.lit(None).cast("string").alias("url")).alias("openAccessPdf"),
                    F.struct(F.when(F.col("cand_id") % 3 == 0, "conf/acm/x").alias("DBLP"), F.when(F.col("cand_id") % 5 == 0, "1").alias("ArXiv"), F.lit(None).cast("string").alias("PubMed"), F.concat(F.lit("10.1109/"), "cand_id").alias("DOI")).alias("externalIds"))
    return payloads.semantic_rows(_payload(spark, d, "semantic", F.to_json(F.struct(F.array(item).alias("data")))))


@query
def crossref_rows(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct(F.array("title").alias("title"), F.concat(F.lit("<jats:p>"), T.text("abstract"), F.lit("</jats:p>")).alias("abstract"),
                    F.transform(_name_array(), lambda a: F.struct(F.split(a, " ")[0].alias("given"), F.get(F.split(a, " "), F.lit(1)).alias("family"))).alias("author"),
                    F.struct(F.array(F.array("year")).alias("date-parts")).alias("published"), F.col("url").alias("URL"), F.concat(F.lit("10.1016/"), "cand_id").alias("DOI"))
    return payloads.crossref_rows(_payload(spark, d, "crossref", F.to_json(F.struct(F.struct(F.array(item).alias("items")).alias("message")))))


@query
def springer_rows(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct("title", "abstract", F.when(F.col("cand_id") % 2 == 0, F.concat(F.lit("10.1007/"), "cand_id")).alias("doi"), F.array(F.struct(F.col("url").alias("value"))).alias("url"),
                    F.transform(_name_array(), lambda a: F.struct(a.alias("creator"))).alias("creators"), F.concat(F.col("year").cast("string"), F.lit("-05-01")).alias("publicationDate"))
    return payloads.springer_rows(_payload(spark, d, "springer", F.to_json(F.struct(F.array(item).alias("records")))), "Springer Journal")


@query
def springer_split(spark: SparkSession, d: str) -> DataFrame:
    """Each paper's search: its first journals and books, told apart here by arrival_seq."""
    rows = _candidates(spark, d).where("source = 'springer'").select("src_id", "cand_id", "arrival_seq")
    found = payloads.springer_search(rows.where("arrival_seq % 2 = 0"), rows.where("arrival_seq % 2 = 1"), "arrival_seq", 11, ("src_id",))
    return found.select("cand_id", "arrival_seq")


@query
def atom_entries(spark: SparkSession, d: str) -> DataFrame:
    names = F.array_join(F.transform(_name_array(), lambda a: F.concat(F.lit("<author><name>"), a, F.lit("</name></author>"))), "")
    entry = F.concat(F.lit("<feed><entry><title>"), T.text("title"), F.lit("</title><summary> "), T.text("abstract"), F.lit(" </summary><published>"),
                     F.coalesce(F.col("year").cast("string"), F.lit("none")), F.lit("-01-01</published>"), names, F.lit('<link rel="alternate" type="text/html" href="'), T.text("url"), F.lit('"/></entry></feed>'))
    return payloads.atom_rows(_payload(spark, d, "arxiv", entry))


@query
def scholar_rows(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct(F.struct("title", "abstract", F.to_json(_name_array()).alias("author"), F.col("year").cast("string").alias("pub_year")).alias("bib"), F.col("url").alias("pub_url"))
    return payloads.scholar_rows(_payload(spark, d, "gscholar", F.to_json(item)))


@query
def thesis_rows(spark: SparkSession, d: str) -> DataFrame:
    esc = lambda c: F.replace(F.replace(T.text(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.concat(F.lit("<table><tr><td>1</td><td><a href='/thesis?id="), F.col("cand_id").cast("string"), F.lit("'>"), esc("title"), F.lit("</a></td><td>"),
                    F.coalesce(F.col("year").cast("string"), F.lit("")), F.lit("</td></tr><tr><td>"), esc("abstract"), F.lit("</td></tr></table>"))
    return payloads.thesis_rows(_payload(spark, d, "ndltd", page))


@query
def venue_detect(spark: SparkSession, d: str) -> DataFrame:
    rows = _candidates(spark, d).select("cand_id", "url", "title").distinct()
    return rows.select("cand_id", "url", "title", payloads.venue_of_url(F.col("url"), F.col("title")).alias("venue"))


@query
def authors_et_al(spark: SparkSession, d: str) -> DataFrame:
    names = F.filter(F.split(T.text("authors"), r"\s*;\s*"), lambda a: a != "")
    return load(spark, d, "catalog_records").select("rec_id", "title", T.authors_et_al(names).alias("authors")).distinct()


@query
def source_limit(spark: SparkSession, d: str) -> DataFrame:
    """The first rows of each source for each paper, up to the source's limit."""
    limits = load(spark, d, "connectors", "source", "max_results")
    rows = _candidates(spark, d).join(F.broadcast(limits), "source")
    most = limits.agg(F.max("max_results")).first()[0]
    return payloads.limited(rows, ["src_id", "source"], "arrival_seq", F.col("max_results"), most).select("src_id", "source", "cand_id", "arrival_seq")


@query
def source_registry(spark: SparkSession, d: str) -> DataFrame:
    return catalog.registry(spark)


@query
def progress(spark: SparkSession, d: str) -> DataFrame:
    return report.progress(_candidates(spark, d), load(spark, d, "connectors", "source", "max_results"))


@query
def report_projection(spark: SparkSession, d: str) -> DataFrame:
    c, p = _candidates(spark, d), _papers(spark, d)
    rows = storage.materialize(report.ranked_report(c, p), "report")  # read twice
    return report.projection(rows, report.matched_segments(rows, p, c)).withColumn("rank", F.col("rank").cast("long"))


@query
def detail_view(spark: SparkSession, d: str) -> DataFrame:
    return report.detail(report.ranked_report(_candidates(spark, d), _papers(spark, d)))


@query
def detail_segments(spark: SparkSession, d: str) -> DataFrame:
    """The matched segments of the reported results as a detail view shows them."""
    c, p = _candidates(spark, d), _papers(spark, d)
    return report.detail_segments(report.matched_segments(report.ranked_report(c, p), p, c))


@query
def progress_text(spark: SparkSession, d: str) -> DataFrame:
    """The progress of each paper's sources as shown, in three languages."""
    rows = report.progress(_candidates(spark, d), load(spark, d, "connectors", "source", "max_results"))
    shown = [labels.filled("progress_fmt", x, source=F.col("source"), count=F.col("done"), pct=F.floor(F.col("share") * 100)).alias(f"text_{x}") for x in labels.LANGUAGES]
    return rows.select("src_id", "source", *shown)


@query
def i18n_labels(spark: SparkSession, d: str) -> DataFrame:
    asked = load(spark, d, "scores").select("risk_tier").distinct().select(F.concat(F.lit("risk_"), F.coalesce("risk_tier", F.lit("none"))).alias("key"))
    every = asked.select("key", F.explode(F.array(F.lit("zh"), F.lit("en"), F.lit("ja"), F.lit("xx"))).alias("lang"))
    return labels.translated(every, labels.labels(spark))


def _words(spark: SparkSession, d: str) -> DataFrame:
    """Raw first pages laid out: a line every 12 points, a word every 30."""
    p = _papers(spark, d).where("raw_text is not null").select("doc_id", F.posexplode(F.split("raw_text", "\n")).alias("line", "t"))
    w = p.select("doc_id", "line", F.posexplode(F.split("t", " ")).alias("k", "text")).where("text <> ''")
    x0 = (F.col("k") % 16) * 36.0 + F.when(F.col("k") % 16 >= 8, 24.0).otherwise(0.0)
    top = 20.0 + F.col("line") * 60.0 + F.floor(F.col("k") / 16) * 12.0
    return w.select("doc_id", F.lit(1).alias("page"), F.lit(612.0).alias("page_w"), F.lit(792.0).alias("page_h"), "text", x0.alias("x0"), (x0 + 30.0).alias("x1"), top.alias("top"), (top + 10.0).alias("bottom"))


@query
def column_split(spark: SparkSession, d: str) -> DataFrame:
    return layout.column_split(_words(spark, d))


@query
def words_to_lines(spark: SparkSession, d: str) -> DataFrame:
    return layout.words_to_lines(_words(spark, d))


@query
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return layout.reading_order(_words(spark, d))


def _chars(spark: SparkSession, d: str) -> DataFrame:
    """First pages whose first line is set larger, a character each."""
    p = _papers(spark, d).where("raw_text is not null").select("doc_id", F.posexplode(F.split("raw_text", "\n")).alias("line", "t"))
    ch = p.select("doc_id", "line", F.posexplode(F.split("t", "")).alias("k", "text")).where("text <> '' and text <> ' '")
    size = F.when(F.col("line") == 0, 18.0).otherwise(10.0)
    return ch.select("doc_id", F.lit(1).alias("page"), F.lit(792.0).alias("page_h"), "text", (F.col("k") * size * 0.5).alias("x0"), ((F.col("k") + 1) * size * 0.5).alias("x1"), (60.0 + F.col("line") * 20.0).alias("top"), size.alias("size"))


@query
def font_title(spark: SparkSession, d: str) -> DataFrame:
    return layout.font_title(_chars(spark, d))


@query
def active_sources(spark: SparkSession, d: str) -> DataFrame:
    """The sources of the connectors table with a limit above zero."""
    limits = load(spark, d, "connectors").select(F.col("source").alias("id"), F.when(F.col("source") != "ndltd", F.col("default_results")).otherwise(0).alias("chosen"))
    return catalog.active(catalog.registry(spark), limits).select("ordinal", "id", "chosen")


@query
def payload_errors(spark: SparkSession, d: str) -> DataFrame:
    """Responses of which every fourth is cut in the middle: the sources and payloads that failed."""
    item = F.to_json(F.struct(F.array(F.struct("title", "abstract")).alias("data")))
    rows = _candidates(spark, d).where("source = 'semantic' and length(title) > 20")
    cut = rows.select("arrival_seq", F.when(F.col("arrival_seq") % 4 == 0, F.substring(item, 1, 20)).otherwise(item).alias("payload"))
    return payloads.payload_errors(cut, payloads.SEMANTIC_SCHEMA).select("arrival_seq")


@query
def springer_without_key(spark: SparkSession, d: str) -> DataFrame:
    """The publisher's rows from the registry: journals and books of each paper by type and DOI prefix."""
    kind = F.when(F.col("arrival_seq") % 2 == 0, "journal-article").otherwise("book-chapter")
    item = F.struct(F.array("title").alias("title"), "abstract", F.concat(F.when(F.col("cand_id") % 5 == 0, "10.1016/").otherwise("10.1007/"), "cand_id").alias("DOI"), kind.alias("type"))
    rows = _candidates(spark, d).where("source = 'springer'")
    made = rows.select("src_id", "arrival_seq", kind.alias("kind"), F.to_json(F.struct(F.struct(F.array(item).alias("items")).alias("message"))).alias("payload"))
    return payloads.springer_found(made, "arrival_seq", 5, False, ("src_id",)).select("src_id", "arrival_seq", "title", "url", "source")


@query
def source_union(spark: SparkSession, d: str) -> DataFrame:
    """Rows of three connectors put together in registry order."""
    parts = {"crossref": crossref_rows(spark, d), "semantic": s2_rows(spark, d), "springer": springer_rows(spark, d)}
    return catalog.union_sources(parts).groupBy("ordinal").agg(F.count("*").alias("n"), F.min("arrival_seq").alias("first_seq"))


ORACLE = {k: v for k, v in oracle.SQL.items() if k in QUERIES}
