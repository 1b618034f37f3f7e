"""The hygiene scan over files as they arrive, and windowed counts of findings.

The same operator as in batch runs on the stream; late deliveries are dropped by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.hygiene import active, line_hits


def read_stream(spark: SparkSession, folder: str, schema, most_files: int = 16) -> DataFrame:
    """Parquet files of ``folder`` as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(folder)


def new_files(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """Each file once while its deliveries lie within the watermark."""
    return stream.withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["file_id"])


def findings(stream: DataFrame) -> DataFrame:
    """Findings of the core rules in the files of a stream."""
    return line_hits(stream, active())


def counts(stream: DataFrame, every: str = "1 day", late: str = "7 days") -> DataFrame:
    """Files and bytes that arrive per window and repository."""
    return (
        stream.withWatermark("ingested_at", late)
        .groupBy(F.window("ingested_at", every).alias("w"), "repo")
        .agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
        .select(F.col("w.start").alias("start"), "repo", "files", "bytes")
    )
