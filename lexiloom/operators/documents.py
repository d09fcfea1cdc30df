"""Parsing of source documents into structured papers."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexiloom.functions.text import extract_abstract, extract_body, extract_keywords, extract_title, join_hyphens, strip, text
from lexiloom.operators import layout

MIN_LENGTH, MOST_BODY = 100, 4000
PAPER = "title string, abstract string, keywords array<string>, body string"


def long_enough(raw: Column) -> Column:
    """Whether a raw text is worth parsing."""
    return F.length(strip(text(raw))) >= MIN_LENGTH


def parse_text(docs: DataFrame) -> DataFrame:
    """``doc_id, title, abstract, keywords, body`` of ``docs(doc_id, raw_text)`` by patterns."""
    raw = join_hyphens(F.col("raw_text"))
    return docs.select(
        "doc_id", extract_title(raw).alias("title"), extract_abstract(raw).alias("abstract"), extract_keywords(raw).alias("keywords"), extract_body(raw).alias("body")
    )


_PAPER_TYPE = pa.struct([("title", pa.string()), ("abstract", pa.string()), ("keywords", pa.list_(pa.string())), ("body", pa.string())])


def _heads(root: ET.Element, path: str) -> list[str]:
    """Stripped texts of the elements on a path, each up to its first child."""
    return [(e.text or "").strip() for e in root.iterfind(path)]


def tei_paper(tei: str) -> dict | None:
    """The paper in a TEI document, None without title and abstract; raises on malformed XML."""
    root = ET.fromstring(tei)
    listed = ".//{*}titleStmt/{*}title"
    # of each kind of title the first element counts
    firsts = [root.find(listed + kind) for kind in ("[@type='main']", "[@level='a']", "")]
    title = ([(e.text or "").strip() for e in firsts if e is not None and e.text] or [""])[0]
    summary = ".//{*}profileDesc/{*}abstract"
    abstract = " ".join(_heads(root, summary + "//{*}p")).strip()
    if not abstract and (whole := root.find(summary)) is not None:
        abstract = "".join(whole.itertext()).strip()
    if not title and not abstract:
        return None
    keywords = [k for k in _heads(root, ".//{*}profileDesc/{*}textClass/{*}keywords/{*}term") if k]
    body = " ".join(_heads(root, ".//{*}text/{*}body//{*}p"))[:MOST_BODY]
    return {"title": title, "abstract": abstract, "keywords": keywords, "body": body}


def parse_tei(docs: DataFrame) -> DataFrame:
    """``doc_id, paper, error`` of ``docs(doc_id, tei)``; a null paper without title and abstract.

    Only the text before an element's first child counts, as in titles and
    paragraphs with inline marks.  A null document gives no row; a broken one
    gives a null paper and the parser's message, and stops nothing.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            papers, errors = [], []
            for tei in batch.column("tei").to_pylist():
                try:
                    papers.append(tei_paper(tei))
                    errors.append(None)
                except (ET.ParseError, ValueError) as broken:
                    papers.append(None)
                    errors.append(str(broken))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "paper": pa.array(papers, _PAPER_TYPE), "error": pa.array(errors, pa.string())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    paper = "struct<title:string,abstract:string,keywords:array<string>,body:string>"
    return docs.where("tei is not null").select("doc_id", "tei").mapInArrow(parse, f"doc_id {kind}, paper {paper}, error string")


def parse_layout(words: DataFrame, chars: DataFrame) -> DataFrame:
    """``doc_id, paper``: the title by font size, the rest from the text in reading order.

    ``words`` and ``chars`` as in :mod:`lexiloom.operators.layout`.  Documents
    without text or without a title by font give no row.
    """
    raw = join_hyphens(F.col("raw_text"))
    parts = layout.page_texts(words).select("doc_id", raw.alias("raw")).where(strip(F.col("raw")) != "")
    titled = parts.join(layout.font_title(chars).where("title <> ''"), "doc_id")
    t = F.col("raw")
    paper = F.struct("title", extract_abstract(t).alias("abstract"), extract_keywords(t).alias("keywords"), extract_body(t).alias("body"))
    return titled.select("doc_id", paper.alias("paper"))


def is_pdf(name: Column) -> Column:
    """Whether a file's name says that TEI and layout may be tried."""
    return F.endswith(F.lower(text(name)), F.lit(".pdf"))


def first_success(docs: DataFrame, tei: DataFrame, layouts: DataFrame, pattern: DataFrame) -> DataFrame:
    """The best parse of each document: TEI, then layout, then patterns.

    ``docs(doc_id)``, or ``docs(doc_id, name)``: files that are not named .pdf go
    to the patterns alone.  Each other input is ``(doc_id, paper)``;
    ``parse_source`` tells which was taken.
    """
    named = [(d.select("doc_id", F.col("paper").alias(n)), n) for d, n in ((tei, "grobid"), (layouts, "layout"), (pattern, "regex"))]
    out = docs.select("doc_id", (is_pdf(F.col("name")) if "name" in docs.columns else F.lit(True)).alias("paged"))
    for d, _ in named:
        out = out.join(d, "doc_id", "left")
    ways = [(F.when(F.col("paged"), F.col("grobid")), "grobid"), (F.when(F.col("paged"), F.col("layout")), "layout"), (F.col("regex"), "regex")]
    source = F.coalesce(*[F.when(w.isNotNull(), F.lit(n)) for w, n in ways])
    return out.select("doc_id", F.coalesce(*[w for w, _ in ways]).alias("paper"), source.alias("parse_source")).select("doc_id", "paper.*", "parse_source")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str | None:
    """Non-blank paragraphs of a word-processor file, or None if it is none."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ET.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ET.ParseError):
        return None
    paras = ("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in root.iter(f"{_W}p"))
    return "\n".join(p for p in paras if p.strip())


def read_files(spark: SparkSession, path: str, glob: str = "*.docx") -> DataFrame:
    """``path, raw_text, error`` of the word-processor and text files in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def convert(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            raw = [docx_text(c) if re.search(r"\.docx?$", p, re.I) else c.decode("utf-8", "replace") for p, c in zip(frame["path"], frame["content"], strict=True)]
            yield pd.DataFrame({"path": frame["path"], "raw_text": raw, "error": [None if r is not None else "not a readable document" for r in raw]})

    return files.mapInPandas(convert, "path string, raw_text string, error string")

