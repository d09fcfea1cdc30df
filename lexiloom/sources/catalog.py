"""The registry of sources and the union of their rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexiloom.core.tables import literal_rows


@dataclass(frozen=True)
class Source:
    """One source: its limits, and whether it takes a key or has a help text."""

    id: str
    display_name: str
    least: int
    most: int
    default: int
    has_help: bool = False
    key_field: str | None = None


# The six sources in their order.
SOURCES = (
    Source("semantic", "Semantic Scholar", 5, 50, 20, key_field="semantic"),
    Source("arxiv", "arXiv", 5, 20, 10),
    Source("crossref", "CrossRef", 5, 20, 10),
    Source("ndltd", "NDLTD", 5, 20, 10),
    Source("gscholar", "Google Scholar", 5, 20, 10, has_help=True),
    Source("springer", "Springer", 5, 20, 10, has_help=True, key_field="springer"),
)


def registry(spark: SparkSession) -> DataFrame:
    """The sources as a table, with their ordinal."""
    rows = [(k, s.id, s.display_name, s.least, s.most, s.default, s.has_help, s.key_field) for k, s in enumerate(SOURCES)]
    return literal_rows(
        spark, rows, "ordinal int, id string, display_name string, least int, most int, default_limit int, has_help boolean, key_field string"
    )


def enabled(registry_rows: DataFrame, chosen: list[str]) -> DataFrame:
    """The chosen sources; an empty choice gives an empty table."""
    return registry_rows.where(F.col("id").isin(chosen)) if chosen else registry_rows.where(F.lit(False))


def active(registry_rows: DataFrame, limits: DataFrame) -> DataFrame:
    """The sources with a chosen limit above zero, in order: ``limits(id, chosen)``.

    With no source or no limit the table is empty, and so is every search over
    it: that is how a run without sources stops.
    """
    return registry_rows.join(limits.where("chosen > 0"), "id").orderBy("ordinal")


def union_sources(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of several sources in registry order, with ``ordinal``; ``pos`` orders within."""
    out = None
    for k, s in enumerate(SOURCES):
        if s.id in parts:
            part = parts[s.id].withColumn("ordinal", F.lit(k))
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no source was given")
    return out
