"""Look-ups in lists that travel with the plan: sorted values and Bloom filters."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statetrail.functions.let import let

#: Bits of a Bloom filter, and how many of them each value sets.
BITS, HASHES = 1 << 22, 4


def literal_list(items: list[str], kind: T.DataType) -> Column:
    """One literal array of values given as JSON texts; a plan does not grow with their number."""
    return F.from_json(F.lit("[" + ",".join(items) + "]"), T.ArrayType(kind))


def count_not_above(listed: Column, size: int, value: Column) -> Column:
    """How many of the ``size`` values of a sorted array are not above ``value``, by binary search."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(size.bit_length()))])

    def search(wanted: Column) -> Column:
        def onward(at: Column, step: Column) -> Column:
            return F.when((at + step <= size) & (F.get(listed, at + step - 1) <= wanted), at + step).otherwise(at)

        return F.aggregate(steps, F.lit(0), onward)

    return let(value, search) if size else F.lit(0)


def with_count_not_above(df: DataFrame, name: str, items: list[str], kind: T.DataType, value: Column) -> DataFrame:
    """``df`` with the count of ``count_not_above`` as a column ``name``; the sorted ``items`` are JSON texts.

    Each step of the search is a column over the one before, so it is compiled; a lambda is
    interpreted, which for every row of a table is most of the work. A step has those items
    alone that it compares, so all steps together have each item once.
    """
    # of the type that items are read as, so that steps do not convert it
    df = df.withColumns({"_sought": value.cast(kind.simpleString()), name: F.lit(0)})
    for bit in reversed(range(len(items).bit_length())):
        step, at = 1 << bit, F.col(name)
        # beyond the end there is no item, and the comparison is not true
        own = F.get(literal_list(items[step - 1 :: 2 * step], kind), F.shiftright(at, bit + 1))
        df = df.withColumn(name, F.when(own <= F.col("_sought"), at + step).otherwise(at))
    return df.drop("_sought")


def is_listed(listed: Column, size: int, value: Column) -> Column:
    """Whether a sorted array of ``size`` values, none NULL, holds ``value``."""
    if not size:
        return F.lit(False)
    return let(value, lambda v: F.coalesce(F.get(listed, count_not_above(listed, size, v) - 1) == v, F.lit(False)))


def _bits(value: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), value), F.lit(bits)) for i in range(HASHES)]


def bloom_words(values: DataFrame, column: str, bits: int = BITS) -> list[int]:
    """The 64-bit words of a Bloom filter of a column, worked out by an aggregate; as many for any number of values."""
    spots = values.where(F.col(column).isNotNull()).select(F.explode(F.array(*_bits(F.col(column), bits))).alias("bit"))
    word, mask = F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))")
    words = [0] * (bits // 64)
    for r in spots.groupBy(word).agg(F.bit_or(mask).alias("mask")).toArrow().to_pylist():
        words[r["word"]] = r["mask"]
    return words


def may_hold(words: list[int] | Column, value: Column, bits: int = BITS) -> Column:
    """Whether a Bloom filter may hold a value: true for every one it was made of, and by chance for some others."""
    listed = words if isinstance(words, Column) else literal_list(list(map(str, words)), T.LongType())

    def test(bit: Column) -> Column:
        word = F.get(listed, F.shiftright(bit, 6).cast("int"))
        return F.call_function("getbit", word, F.pmod(bit, F.lit(64)).cast("int")) == 1

    found = test(_bits(value, bits)[0])
    for bit in _bits(value, bits)[1:]:
        found = found & test(bit)
    return found


def that_may_hold(rows: DataFrame, words: list[int], values: Column, bits: int = BITS) -> DataFrame:
    """Rows with an array of values of which a Bloom filter may hold some.

    The filter is a table of one row, known to be small, so the join broadcasts it. As a literal
    it would be written out in the text of the plan, which the driver keeps for every query and
    every change of its plan.
    """
    listed = rows.sparkSession.createDataFrame(pa.table({"_words": [words]}))
    return rows.join(listed, F.exists(values, lambda v: may_hold(F.col("_words"), v, bits)), "left_semi")
