"""Line dedup with a suffix array over sequences of line ids.

Every text is a sequence of its lines that aren't blank. Ranks of suffixes are found by
prefix doubling: lines that occur twice or more get ranks in order of their ids; then
pairs of ranks, a doubled distance apart, get ranks in order of the pair, until the prefix
is as long as the shortest run that counts. Suffixes of equal rank are a
longest-common-prefix interval of that depth: their texts repeat there. All but the
earliest start copies; chains of such starts are the maximal repeated runs, which go.

Suffixes that are alone in their interval can't repeat at any greater depth, so each
doubling handles only what the one before left. Ids are two 64-bit hashes of a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statetrail.llm.store import id_of, keyed, settle, with_text

#: Lines that a repeated run has at least.
MIN_LINES = 2
BLANK = " \t\r"


def line_sequence(docs: DataFrame) -> DataFrame:
    """``k, h, pos, seq, a, b``: place of each line that isn't blank, among all lines and among these, and its id."""
    lines = F.split("text", "\n", -1)
    ids = F.transform(lines, lambda x, i: F.struct(
        i.alias("pos"), (F.btrim(x, F.lit(BLANK)) == "").alias("blank"),
        F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b"),
    ))
    full = F.filter(ids, lambda x: ~x["blank"])
    return docs.select("k", "h", F.posexplode(full).alias("seq", "line")).select("k", "h", "seq", "line.pos", "line.a", "line.b")


def ranked(suffixes: DataFrame, first: str, second: str) -> DataFrame:
    """``suffixes`` in intervals of two or more that agree in both columns, with ``rank``, in their order.

    The ranks of the distinct pairs come from one distributed sort and are written once,
    since numbering is not the same when it is done again.
    """
    pairs = suffixes.groupBy(first, second).count().where("count > 1").select(first, second)
    names = settle(pairs.orderBy(first, second).withColumn("named", F.monotonically_increasing_id()))
    return suffixes.join(names, [first, second]).drop(first, second).withColumnRenamed("named", "rank")


def repeated_starts(lines: DataFrame, min_lines: int) -> DataFrame:
    """``k, h, seq`` of suffixes whose first ``min_lines`` lines also start an earlier one."""
    suffixes = ranked(lines.select("k", "h", "seq", "a", "b"), "a", "b")
    depth = 1
    while depth < min_lines:
        step = min(depth, min_lines - depth)
        ahead = suffixes.select("k", "h", (F.col("seq") - step).alias("seq"), F.col("rank").alias("ahead"))
        pairs = suffixes.join(ahead, ["k", "h", "seq"])
        depth += step
        if depth < min_lines:
            suffixes = ranked(pairs, "rank", "ahead").select("k", "h", "seq", "rank")
        else:
            suffixes = pairs.select("k", "h", "seq", F.struct("rank", "ahead").alias("rank"))
    earliest = suffixes.groupBy("rank").agg(F.min(F.struct("k", "h", "seq")).alias("first"), F.count("*").alias("n"))
    copies = suffixes.join(earliest.where("n > 1").select("rank", "first"), "rank")
    return copies.where(F.struct("k", "h", "seq") != F.col("first")).select("k", "h", "seq")


def kept(lines: Column, runs: Column) -> Column:
    """``lines`` without the ``runs``, a sorted array of structs ``start`` (from 0) and ``length``."""
    n = F.size(runs)

    def between(i: Column) -> Column:
        before = F.get(runs, i - 1)
        start = F.when(i > 0, before["start"] + before["length"]).otherwise(0)
        stop = F.when(i < n, F.get(runs, i)["start"]).otherwise(F.size(lines))
        return F.slice(lines, start + 1, F.greatest(stop - start, F.lit(0)))

    return F.flatten(F.transform(F.sequence(F.lit(0), n), between))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, rows: bool = False
) -> DataFrame:
    """``doc_id, text, n_lines, n_removed``: each text without lines of runs that also start earlier.

    A run has ``min_lines`` consecutive lines at least; blank lines are passed over, never
    counted as part of a run and always kept. Earlier is a smaller id, of equal ids a smaller
    hash of the text, of one text a smaller place. Runs are judged on the input. A null id
    counts as the smallest, a null text as empty (one blank line). Rows equal in id and text
    are one document and get the same result; every row of ``docs`` gives one, with its other
    columns in ``row`` if ``rows`` is set.
    """
    whole = keyed(docs, id_col, text_col, rows)
    lines = line_sequence(whole).distinct()
    starts = repeated_starts(lines, min_lines)
    gone = starts.select("k", "h", F.explode(F.sequence("seq", F.col("seq") + (min_lines - 1))).alias("seq")).distinct()
    placed = gone.join(lines.select("k", "h", "seq", "pos"), ["k", "h", "seq"])
    chained = placed.selectExpr("k", "h", "pos", "pos - row_number() over (partition by k, h order by pos) as chain")
    runs = chained.groupBy("k", "h", "chain").agg(F.min("pos").alias("start"), F.count("*").cast("int").alias("length"))
    by_doc = runs.groupBy("k", "h").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("runs"))
    all_lines = F.split("text", "\n", -1)
    removed = F.when(F.col("runs").isNull(), F.lit(0)).otherwise(F.aggregate("runs", F.lit(0), lambda s, r: s + r["length"]))
    text = F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(kept(all_lines, F.col("runs")), "\n"))
    return whole.join(by_doc, ["k", "h"], "left").select(
        id_of(F.col("k")).alias("doc_id"), text.alias("text"), F.size(all_lines).cast("bigint").alias("n_lines"),
        removed.cast("bigint").alias("n_removed"), *(["row"] if rows else []),
    )


def line_stage(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns and the texts that ``dedup_lines`` leaves; a document left without any line goes."""
    out = dedup_lines(docs, rows=True)
    some = (F.col("n_removed") == 0) | (F.btrim("text", F.lit(BLANK + "\n")) != "")
    return out.where(some).select(*with_text("row", docs.columns, F.col("text")))
