"""Binary files written and read by Spark's own sources.

Spark has no sink for raw bytes, but its text sink writes a string column byte for byte and
puts a line separator after each row.  A file format whose separator means nothing to its
readers (an empty skippable frame, an end mark) can therefore be written with Spark's commit
protocol, to any file system that Spark reaches: one row is one blob, one partition one file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_blobs(blobs: DataFrame, blob: str, path: str, separator: str, suffix: str) -> None:
    """Write each partition of ``blobs`` as one file: its blobs in order, each with the separator."""
    (
        blobs.select(F.col(blob).cast("string").alias("value"))
        .write.option("lineSep", separator).option("compression", "none").option("fileExtension", suffix)
        .text(path)
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """One row (path, content) per file; the writers bound the size of a file."""
    return spark.read.format("binaryFile").load(path).select("path", "content")
