"""JSONL session rollouts as a source: files to lines to records, with per-file status."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LINE_CAP = 16 * 1024 * 1024
META_CAP = 10 * 1024 * 1024


def inside(root: str, path: str) -> str:
    """The real place of ``path``, links followed; ValueError if that is not below ``root``."""
    top, real = os.path.realpath(root), os.path.realpath(path)
    if os.path.commonpath([top, real]) != top:
        raise ValueError(f"{path} is outside {root}")
    return real


def lines(spark: SparkSession, root: str, pattern: str = "rollout-*.jsonl") -> DataFrame:
    """(file_path, line_no, line) of every file below ``root`` whose name matches; numbered from 1 in file order with blank lines, which are then left out; an unterminated last line is kept.

    Files are read in splits, so a large file is spread over tasks: a line's place is that of its split's block and, in it, of the reading order.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("lineSep", "\n").text(root)
    rows = files.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))
    numbered = rows.withColumn("line_no", F.row_number().over(Window.partitionBy("file_path").orderBy("block", "place")))
    return numbered.where("line <> ''").select("file_path", "line_no", "line")


def file_status(rows: DataFrame, cap: int = LINE_CAP) -> DataFrame:
    """(file_path, lines, malformed, too_long): a file with a line over the cap counts as unreadable."""
    env = F.from_json("line", "timestamp string, type string, payload string")
    return rows.groupBy("file_path").agg(F.count("*").alias("lines"), F.count_if(env["type"].isNull()).alias("malformed"), F.max(F.octet_length("line") > cap).alias("too_long"))


def records(rows: DataFrame, cap: int = LINE_CAP) -> DataFrame:
    """(record_id, file_path, line_no, rec_ts, rec_type, payload) of the readable lines; files with a line over the cap are left out whole."""
    bad = file_status(rows, cap).where("too_long").select("file_path")
    env = F.from_json("line", "timestamp string, type string, payload string")
    ok = rows.join(bad, "file_path", "left_anti").withColumn("e", env).where(F.col("e.type").isNotNull())
    return ok.select(F.col("line_no").cast("bigint").alias("record_id"), "file_path", F.col("line_no").cast("int").alias("line_no"), F.col("e.timestamp").alias("rec_ts"), F.col("e.type").alias("rec_type"), F.col("e.payload").alias("payload"))
