"""Guessing a log's format from its head."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripline.functions.text import FLAGS, NONSPACE
from tripline.operators.parsing.eve import one_json_value

# Lines looked at, and the shapes that give a format away.
HEAD = 25
EVE_KEYS = ("event_type", "src_ip", "flow_id")
_SSHD = rf"{FLAGS}\bsshd\[\d+\]:[\s\x1c-\x1f]"
_ACCESS = rf'{FLAGS}\A{NONSPACE}+ {NONSPACE}+ {NONSPACE}+ \[[^\]]+\] "[A-Z]+ {NONSPACE}+ [^"]+" \d{{3}} '


def line_format(line: Column) -> Column:
    """The format one line gives away, or null."""
    keys = F.map_keys(F.when(F.startswith(line, F.lit("{")), one_json_value(line, "map<string,string>")))
    eve = F.coalesce(F.arrays_overlap(keys, F.array(*[F.lit(k) for k in EVE_KEYS])), F.lit(False))
    return F.when(eve, "suricata").when(line.rlike(_SSHD), "auth_log").when(line.rlike(_ACCESS), "nginx")


def read_heads(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file_path, place, line``: the first non-blank lines of every file.

    Tasks open the files themselves and stop reading after the head, so judging
    a hundred terabytes of logs reads some kilobytes of each file.
    """
    files = spark.read.text(paths).inputFiles()
    tasks = max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism))
    listed = spark.createDataFrame([(f,) for f in files], "file_path string").repartition(tasks)
    limit = HEAD

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for uri in batch["file_path"]:
                system, path = fs.FileSystem.from_uri(uri)
                found: list[str] = []
                with system.open_input_stream(path) as raw, io.BufferedReader(raw) as stream:
                    for text in io.TextIOWrapper(stream, "utf-8", errors="replace"):
                        found += [line.strip() for line in text.splitlines() if line.strip()]
                        if len(found) >= limit:
                            break
                # File metadata writes local paths with a single slash.
                name = re.sub("^file:/+", "file:/", uri)
                rows = [(name, place, line) for place, line in enumerate(found[:limit])]
                yield pd.DataFrame(rows, columns=["file_path", "place", "line"], dtype=object)

    return listed.mapInPandas(heads, "file_path string, place int, line string")


def sniff_paths(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file_path, source_type`` of text files, from their heads alone; files
    that tell nothing are missing."""
    return sniff_groups(read_heads(spark, paths), "file_path", "place").where(F.col("source_type").isNotNull())


def sniff_files(lines: DataFrame) -> DataFrame:
    """``file_path, source_type`` (null when unknown) for lines as read from files.

    For file systems that only Spark can open: reads all lines.  Lines of one
    split are numbered in reading order, so a split's first telling line and
    its offset come out of a plain aggregate: nothing is sorted, and one row
    per split is shuffled.
    """
    splits = (
        lines.select("file_path", "file_block_start", F.monotonically_increasing_id().alias("at"), "line")
        .withColumn("told", line_format(F.col("line")))
        .groupBy("file_path", "file_block_start")
        .agg(
            F.count(F.lit(1)).alias("lines"),
            F.min("at").alias("start"),
            F.min(F.when(F.col("told").isNotNull(), F.struct("at", "told"))).alias("hit"),
        )
    )
    before = Window.partitionBy("file_path").orderBy("file_block_start").rowsBetween(Window.unboundedPreceding, -1)
    place = F.coalesce(F.sum("lines").over(before), F.lit(0)) + F.col("hit.at") - F.col("start")
    return (
        splits.withColumn("place", place)
        .groupBy("file_path")
        .agg(F.min_by(F.when(F.col("place") < HEAD, F.col("hit.told")), "place").alias("source_type"))
    )


def sniff_groups(lines: DataFrame, group: str, order: str) -> DataFrame:
    """``group, source_type`` for lines that carry their own order.

    The ranking limit is applied in every task before the shuffle, so at most
    25 lines per group and task travel.
    """
    head = Window.partitionBy(group).orderBy(order)
    return (
        lines.select(group, order, "line")
        .withColumn("place", F.row_number().over(head))
        .where(F.col("place") <= HEAD)
        .withColumn("told", line_format(F.col("line")))
        .groupBy(group)
        .agg(F.min(F.when(F.col("told").isNotNull(), F.struct("place", "told"))).getField("told").alias("source_type"))
    )
