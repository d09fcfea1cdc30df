"""Table loading with explicit column selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read one parquet table and keep the named columns (all when none named)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small constant table as a local relation: no job and no Python worker."""
    import pandas as pd
    from pyspark.sql.types import _parse_datatype_string

    parsed = _parse_datatype_string(schema)
    frame = pd.DataFrame(rows, columns=[f.name for f in parsed.fields], dtype=object)
    return spark.createDataFrame(frame, schema=parsed)
