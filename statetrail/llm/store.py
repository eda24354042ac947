"""Keys of documents and tables that cut lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALLEST = -(2**63)


def settle(frame: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder of the session.

    A folder of our own is made only where ``spark.checkpoint.dir`` is unset, as in tests.
    """
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp())
    return frame.checkpoint()


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: bool = False) -> DataFrame:
    """``k`` and ``h`` name a document, ``text`` is its text; ``rows`` keeps its other columns in ``row``.

    A null id counts as the smallest id, a null text as empty. Rows equal in id and
    text are one document, rows that share an id but not the text are several.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    columns = [
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(SMALLEST)).alias("k"),
        F.xxhash64(text).alias("h"),
        text.alias("text"),
    ]
    if rows:
        columns.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"))
    return docs.select(*columns)


def id_of(key: Column) -> Column:
    """The id that a key stands for."""
    return F.when(key != F.lit(SMALLEST), key)


def with_text(row: str, columns: list[str], text: Column) -> list[Column]:
    """The columns packed in ``row`` with a new text and, where there is one, its new length."""
    changed = {"text": text, "n_chars": F.char_length(text).cast("bigint")}
    return [changed.get(c, F.col(f"{row}.`{c}`")).alias(c) for c in columns]
