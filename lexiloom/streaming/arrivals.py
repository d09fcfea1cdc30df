"""Candidates arriving as files: scored as they come, first arrivals kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lexiloom.operators.scoring import first_arrivals, score_pairs


def candidate_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 10) -> DataFrame:
    """New parquet files of a folder as a stream of candidate rows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def score_stream(stream: DataFrame, papers: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Score each batch against the papers and write it under its batch number.

    A batch is written to its own folder, overwritten if the batch is retried,
    so each row appears once.  Titles are de-duplicated within a batch here and
    across batches by :func:`latest`.
    """

    def write(batch: DataFrame, number: int) -> None:
        score_pairs(first_arrivals(batch), papers).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """All scored rows so far, the first arrival of each title."""
    return first_arrivals(spark.read.parquet(out).drop("batch"))
