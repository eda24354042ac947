"""Line-oriented text sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(
    spark: SparkSession,
    paths: str | list[str],
    strip: str | None = None,
    depth: int = 0,
    label: tuple[str, str] | list[tuple[str, str]] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Lines of files, directories or globs as ``value``, ``src``, ``seq``.

    ``strip`` removes these characters from both ends (``",\\n"`` for line-wise
    JSON). ``depth`` appends that many ``/*`` levels to every path. ``label``
    names a column and the pattern whose first group finds it in the file path, or
    several of both: one job then covers all hosts or splits. ``partitions`` asks for a number of
    partitions; without it the scan sizes its own splits.

    ``seq`` is the place of the line: file, offset of the file block, running
    number. It orders lines as the file does and is the same on every attempt.
    """
    given = [paths] if isinstance(paths, str) else list(paths)
    value = F.col("value") if strip is None else F.btrim("value", F.lit(strip))
    path = F.col("_metadata.file_path")
    columns = [
        value.alias("value"),
        path.alias("src"),
        F.struct(
            path.alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("seq"),
    ]
    for name, pattern in [label] if isinstance(label, tuple) else label or []:
        columns.append(F.regexp_extract(path, pattern, 1).alias(name))
    lines = spark.read.text([p.rstrip("/") + "/*" * depth for p in given]).select(*columns)
    return lines if partitions is None else lines.repartition(partitions)


def number_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``lines`` of ``read_lines``, with ``seq`` as (``file``, ``line``), two numbers, and the files' numbers and paths.

    Files are numbered by path and lines as in their file, from 1. Every block of a file
    counts its lines; sums over the blocks before give the number of its first one. Rows
    carry no path any more, the second table has it. The lines are read twice, the first
    time only to be counted; repartition them afterwards, not before.
    """
    place = lines.select(F.col("seq.file").alias("path"), F.col("seq.block").alias("block"), F.col("seq.row").alias("row"))
    blocks = place.groupBy("path", "block").agg(F.count(F.lit(1)).alias("count"), F.min("row").alias("first"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    # one row a file, so that one task may number them
    files = place.select("path").distinct().select("path", (F.row_number().over(Window.orderBy("path")) - 1).alias("file"))
    starts = placed.join(files, "path").select(
        F.struct("path", "block").alias("_block"), "file", (F.col("before") - F.col("first") + 1).alias("_shift")
    )
    both = lines.withColumn("_block", F.struct(F.col("seq.file").alias("path"), F.col("seq.block").alias("block"))).join(F.broadcast(starts), "_block")
    seq = F.struct("file", (F.col("seq.row") + F.col("_shift")).alias("line"))
    return both.withColumn("seq", seq).drop("src", "_block", "file", "_shift"), files


def read_entities(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Distinct entity ids, one per line, exactly as written."""
    given = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.text(given).select(F.col("value").alias("entity_id")).distinct()
