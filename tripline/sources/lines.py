"""Raw log lines, from files or from any DataFrame with a text column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripline.functions.text import EXTRA_LINE_BREAKS, strip

FILE_COLUMNS = ("file_path", "file_name", "file_block_start")


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Non-blank, trimmed lines of text files with the file each came from.

    Bytes that are not UTF-8 become U+FFFD.  Compressed files are read as the
    text source reads them, and large plain files are split over tasks.
    """
    text = spark.read.text(paths).select(
        F.make_valid_utf8("value").alias("text"), *[F.col(f"_metadata.{name}").alias(name) for name in FILE_COLUMNS]
    )
    return to_lines(text, "text")


def to_lines(df: DataFrame, column: str) -> DataFrame:
    """Replaces a text column by ``line``: one row per non-blank, trimmed line."""
    others = [c for c in df.columns if c != column]
    pieces = F.explode(F.split(F.col(column), rf"\r\n|[\r\n]|{EXTRA_LINE_BREAKS}"))
    return df.select(*others, pieces.alias("line")).withColumn("line", strip(F.col("line"))).where(F.col("line") != "")
