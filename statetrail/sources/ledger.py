"""Which files were read before, so that a job that runs again reads only what is new.

The ledger is a table of ``path, size, time, batch``. A batch counts as done once the caller
says so; files of batches that aren't are read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from statetrail.operators.lineage import settle_rounds

LEDGER = "path string, size bigint, time timestamp, batch bigint"


def _is_there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def latest(spark: SparkSession, path: str, column: str) -> int:
    """The largest number that a table's folders have for ``column``; 0 where nothing was written yet."""
    if not _is_there(spark, path):
        return 0
    return spark.read.parquet(path).agg(F.max(column)).first()[0] or 0


def _noted(spark: SparkSession, ledger: str) -> DataFrame:
    if _is_there(spark, ledger):
        return spark.read.schema(LEDGER).parquet(ledger)
    return spark.createDataFrame([], StructType.fromDDL(LEDGER))


def listed_files(spark: SparkSession, paths: str | list[str], depth: int = 0) -> DataFrame:
    """``path, size, time`` of the files that a glob names; none of them is opened."""
    given = [p.rstrip("/") + "/*" * depth for p in ([paths] if isinstance(paths, str) else paths)]
    files = spark.read.format("binaryFile").load(given)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("time"))


def labelled(files: DataFrame, labels: list[tuple[str, str]]) -> DataFrame:
    """Adds a column for each name and pattern: the pattern's first group in the path."""
    return files.select("*", *[F.regexp_extract("path", pattern, 1).alias(name) for name, pattern in labels])


def new_files(spark: SparkSession, paths: str | list[str], ledger: str, done: int | None = None, depth: int = 0) -> DataFrame:
    """Files that are in no batch up to ``done`` (in none at all, without it) with this size and time."""
    before = _noted(spark, ledger)
    if done is not None:
        before = before.where(F.col("batch") <= done)
    return settle_rounds(listed_files(spark, paths, depth).join(before, ["path", "size", "time"], "left_anti"))


def with_their_parts(files: DataFrame, found: DataFrame, labels: list[tuple[str, str]]) -> DataFrame:
    """All of ``files`` in the parts (values of ``labels``) that one of ``found`` is in: parts are written whole."""
    parts = labelled(found, labels).select(F.struct(*[n for n, _ in labels]).alias("_part")).distinct()
    placed = labelled(files, labels).withColumn("_part", F.struct(*[n for n, _ in labels]))
    return placed.join(parts, "_part", "left_semi").select(*files.columns)


def write_batch(files: DataFrame, ledger: str, batch: int) -> None:
    """Notes files as those of a batch; noting a batch again replaces it."""
    files.select("path", "size", "time").write.mode("overwrite").parquet(f"{ledger}/batch={batch}")
