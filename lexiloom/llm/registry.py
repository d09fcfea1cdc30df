"""The pN_ queries of this folder, by name, and the SQL of those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexiloom.core.tables import load
from lexiloom.llm import canonical, entity_match, near_duplicates, oracle, packing, reading_level, shared_spans, token_ids, truncation

_TEXTS = ("title", "abstract")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of near-duplicate candidates."""
    pairs = near_duplicates.near_duplicate_pairs(load(spark, sf_dir, "candidates", "cand_id", *_TEXTS), "cand_id", _TEXTS)
    return pairs.select(F.col("id_a").alias("cand_a"), F.col("id_b").alias("cand_b"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each candidate's group of near-duplicates and its number of links."""
    groups = near_duplicates.near_duplicate_groups(load(spark, sf_dir, "candidates", "cand_id", *_TEXTS), "cand_id", _TEXTS)
    return groups.withColumnRenamed("id", "cand_id")


def p2_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutually nearest pairs of candidates and catalogue records with confidence."""
    attributes = ("title", "authors", "year", "url")
    return entity_match.matches(load(spark, sf_dir, "candidates", "cand_id", *attributes), load(spark, sf_dir, "catalog_records", "rec_id", *attributes))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates and catalogue records that describe the same work."""
    return p2_matches(spark, sf_dir).where("confidence >= 0.5").select("cand_id", "rec_id")


def _cut_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    abstracts = load(spark, sf_dir, "candidates", "cand_id", "source", "abstract")
    bodies = load(spark, sf_dir, "papers", "doc_id", "parse_source", "body")
    return abstracts.select(F.lit("candidates").alias("tbl"), F.col("cand_id").alias("rec_key"), F.col("source").alias("origin"), F.col("abstract").alias("text")).union(
        bodies.select(F.lit("papers"), "doc_id", "parse_source", "body")
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates' abstracts and papers' bodies that were cut off."""
    return truncation.judged(_cut_records(spark, sf_dir)).where("is_cut").select("tbl", "rec_key")


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of cuts for each source and parse_source."""
    return truncation.cut_rates(truncation.judged(_cut_records(spark, sf_dir)))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates' fields that hold a look-alike or invisible character."""
    return canonical.unstable_fields(load(spark, sf_dir, "candidates", "cand_id", *_TEXTS), "cand_id", *_TEXTS)


def p4_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates' titles and abstracts in canonical form, one row per candidate."""
    done = canonical.canonicalize(load(spark, sf_dir, "candidates", "cand_id", *_TEXTS), "cand_id", *_TEXTS)
    return done.select("cand_id", *_TEXTS).distinct()


def _span_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return (
        load(spark, sf_dir, "candidates", "cand_id", "abstract"),
        load(spark, sf_dir, "segments", "seg_id", "cand_id", "source_paragraph", "candidate_snippet"),
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records that share at least 120 characters."""
    return shared_spans.shared_pairs(*_span_tables(spark, sf_dir))


def p5_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each abstract, paragraph and snippet occurs elsewhere."""
    return shared_spans.shared_report(*_span_tables(spark, sf_dir))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every review text by byte_bpe_50k."""
    return token_ids.encode_corpus(load(spark, sf_dir, "documents", "doc_id", "text"))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document part with its container."""
    documents = load(spark, sf_dir, "documents", "doc_id", "text", "lang")
    sized = token_ids.count_tokens(documents.select("doc_id", "text")).join(documents.select("doc_id", "lang").dropDuplicates(["doc_id"]), "doc_id")
    return packing.pack(sized, load(spark, sf_dir, "pack_limits"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each language are."""
    return packing.fill_report(p7_packed(spark, sf_dir), load(spark, sf_dir, "pack_limits"))


def _level_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return load(spark, sf_dir, "documents", "doc_id", "text", "lang"), load(spark, sf_dir, "level_labels")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text as a whole is at level advanced."""
    return reading_level.advanced_documents(*_level_tables(spark, sf_dir))


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimated level of every document."""
    return reading_level.reading_levels(*_level_tables(spark, sf_dir))


def p8_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the levels are estimated from: language, coverage ranks and sentence complexity of every document with words."""
    rows = reading_level.features(_level_tables(spark, sf_dir)[0])
    ranks = [F.round(F.exp(c)).cast("long").alias(c) for c in ("cover_50", "cover_70", "cover_80", "cover_90")]
    return rows.select("doc_id", "own", *ranks, F.round(F.exp("sentence_mean"), 6).alias("sentence_mean"), F.round(F.exp("sentence_max")).cast("int").alias("sentence_max"), F.round("word_length", 6).alias("word_length"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_groups, p2_found, p2_matches, p3_found, p3_rates, p4_found, p4_canonical, p5_found, p5_shared, p6_ids, p7_packed, p7_fill, p8_found, p8_levels, p8_features)
}
ORACLE: dict[str, str] = oracle.SQL
