"""Line sources: compressed text, damaged bytes, and positions across files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ranking import global_index


def read_lines(spark: SparkSession, paths: str | list[str], spread: int | None = None) -> DataFrame:
    """Lines with their place: (line, file, block, at).

    gz, bz2 and zst are read by suffix; other compression has to be undone before. Bytes that
    are no UTF-8 are replaced. (file, block, at) orders lines as the files do; ``at`` is unique
    and grows inside a block. ``spread`` redistributes the lines of an unsplittable file before
    costly parsing.
    """
    listed = [paths] if isinstance(paths, str) else list(paths)
    closed = [p for p in listed if p.endswith((".xz", ".lzma"))]
    if closed:
        raise ValueError(f"no Spark codec for {closed}")
    raw = spark.read.text(listed).select(
        F.make_valid_utf8("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    lines = raw.withColumn("at", F.monotonically_increasing_id())
    return lines.repartition(spread) if spread else lines


def invalid_bytes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines per file that are not valid UTF-8."""
    raw = spark.read.text(paths)
    return raw.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count(F.when(~F.is_valid_utf8("value"), 1)).alias("invalid_lines")
    )


def positioned(rows: DataFrame, name: str = "source_position") -> DataFrame:
    """Add the 1-based place of each row over all files in path order (one distributed sort)."""
    indexed = global_index(rows, ["file", "block", "at"], name)
    return indexed.withColumn(name, F.col(name) + 1)
