"""Writers. All but ``write_parts`` refuse to write over an existing result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Typed hand-off table."""
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_parts(df: DataFrame, path: str, by: list[str]) -> None:
    """Parts of a table, one for each value of ``by``: those in ``df`` are replaced whole, the
    others stay, so writing the same again adds nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object per line, for readers outside Spark."""
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def write_ids(ids: DataFrame, path: str) -> None:
    """One id per line."""
    ids.select(F.col("entity_id").alias("value")).write.mode("errorifexists").text(path)
