"""Mixing of sources to target weights by a low-discrepancy schedule, in built-in functions.

The documents of a source, shuffled by a hash, are one stream of words, which is cut into
blocks of equal size and begins anew when it ends. The mix is a row of slots for one block
each. The points of the golden-ratio sequence, one for each slot, fall into the sources'
shares of the unit interval, so every stretch of the mix has all sources close to their
weights. The r-th slot of a source takes the r-th block of its stream: a join.

No window holds a whole source: streams are summed up inside buckets of their hashes and
slots are ranked inside chunks of the schedule, and one row for each bucket or chunk carries
the sum of those before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statetrail.llm.store import settle

#: Words of a block, and how often a stream may be taken at most.
BLOCK, EPOCHS = 128, 3
#: Weights of the sources in their order, repeating.
WEIGHTS = (1, 2, 3)
#: Slots that are ranked together; hexadecimal digits of the hash that documents are summed up by.
CHUNK, DIGITS = 1 << 16, 4
#: Tasks that the documents of one source are dealt to, at least, where they meet its numbers.
SALTS = 64
#: 2**32 divided by the golden ratio, an odd number: multiples of it, modulo 2**32, are the points.
GOLDEN, RANGE = 2654435769, 1 << 32
SPACES = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of words between the spaces 0x20 and 0x09 to 0x0D; 0 for null."""
    marks = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.translate(marks, SPACES, "")), F.lit(0)).cast("bigint")


def point(slot: Column) -> Column:
    """The slot's point, from 0 to 2**32 - 1: its number times GOLDEN modulo 2**32, by halves that don't overflow."""
    low, high = slot % F.lit(1 << 16), F.floor(slot / F.lit(1 << 16)) % F.lit(1 << 16)
    return (low * F.lit(GOLDEN) + (high * F.lit(GOLDEN)) % F.lit(1 << 16) * F.lit(1 << 16)) % F.lit(RANGE)


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """``source, size, weight`` for ``source, size``: weights repeat over the sources by code point, null last.

    Sources are numbered inside the ranges that a sort deals them into, then range by range.
    """
    spread = settle(sizes.repartitionByRange(F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()))
    counts = spread.groupBy("part").agg(F.count(F.lit(1)).alias("count"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))
    place = F.row_number().over(own) - 1
    numbered = spread.withColumn("own", place).join(F.broadcast(ahead), "part")
    weights = F.array(*map(F.lit, WEIGHTS))
    weight = F.get(weights, ((F.col("own") + F.col("before")) % len(WEIGHTS)).cast("int")).cast("bigint")
    return numbered.select("source", "size", weight.alias("weight"))


def with_targets(sources: DataFrame) -> DataFrame:
    """Adds ``target``: shares of all sizes by weight, none above ``EPOCHS`` times its size.

    In the order of cap to weight the sources at their caps come first. If those before one
    are at theirs, what is left for a unit of weight is a quotient of sums; the first source
    whose cap is above its share by that quotient gives it for all others. The sums are
    carried over ranges as in ``ranked_sources``.
    """
    ratio = F.col("size") / F.col("weight")
    spread = settle(sources.withColumn("ratio", ratio).repartitionByRange(F.col("ratio"), F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()))
    whole = spread.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    none = F.lit(0).cast("bigint")
    before = (Window.unboundedPreceding, -1)
    totals = spread.groupBy("part").agg(F.sum("size").alias("size"), F.sum("weight").alias("weight"))
    over = Window.orderBy("part").rowsBetween(*before)
    ahead = totals.select("part", *[F.coalesce(F.sum(c).over(over), none).alias(f"{c}_far") for c in ("size", "weight")])
    near = Window.partitionBy("part").orderBy("ratio", F.asc_nulls_last("source")).rowsBetween(*before)
    summed = spread.withColumns({f"{c}_near": F.coalesce(F.sum(c).over(near), none) for c in ("size", "weight")}).join(F.broadcast(ahead), "part")
    left = F.lit(whole["size"] or 0) - EPOCHS * (F.col("size_near") + F.col("size_far"))
    shared = F.lit(whole["weight"] or 0) - F.col("weight_near") - F.col("weight_far")
    free = summed.withColumns({"left": left, "shared": shared}).where(EPOCHS * F.col("size") * F.col("shared") > F.col("weight") * F.col("left"))
    first = free.agg(F.min_by(F.struct("left", "shared"), F.struct("ratio", F.col("source").isNull(), "source")).alias("level")).first()["level"]
    cap = (EPOCHS * F.col("size")).cast("double")
    if first is None:
        return sources.withColumn("target", cap)
    share = (F.col("weight") * F.lit(first["left"])).cast("double") / F.lit(first["shared"])
    return sources.withColumn("target", F.least(cap, share))


def shares(sources: DataFrame, block: int = BLOCK) -> tuple[DataFrame, int, int]:
    """``source, low, high``: the stretch of whole words, of all targets in a row, that each source has; their sum and the slots."""
    whole = sources.withColumn("words", F.floor("target")).where("words > 0")
    spread = settle(whole.repartitionByRange(F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()))
    totals = spread.groupBy("part").agg(F.sum("words").alias("words"))
    none = F.lit(0).cast("bigint")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select("part", F.coalesce(F.sum("words").over(before), none).alias("far"))
    near = Window.partitionBy("part").orderBy(F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    low = F.col("far") + F.coalesce(F.sum("words").over(near), none)
    placed = spread.withColumn("near", F.coalesce(F.sum("words").over(near), none)).join(F.broadcast(ahead), "part")
    placed = placed.select("source", (F.col("near") + F.col("far")).alias("low"), (F.col("near") + F.col("far") + F.col("words")).alias("high"))
    total = totals.agg(F.sum("words").alias("words")).first()["words"] or 0
    return placed, total, -(-total // block)


def schedule(placed: DataFrame, total: int, slots: int) -> DataFrame:
    """``slot, source, block``: the source of each slot, and which block of its stream the slot takes.

    Points meet the stretches they fall into by cells of the line, about one for each stretch.
    """
    spark = placed.sparkSession
    cell = max(1, total // max(1, 4 * placed.count()))
    cells = F.explode(F.sequence(F.floor(F.col("low") / cell), F.floor((F.col("high") - 1) / cell)))
    stretches = placed.select("source", "low", "high", cells.alias("cell"))
    at = F.least(F.floor(point(F.col("slot")) / F.lit(float(RANGE)) * F.lit(float(total))), F.lit(total - 1))
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn("at", at).withColumn("cell", F.floor(F.col("at") / cell))
    met = points.join(stretches, "cell").where((F.col("at") >= F.col("low")) & (F.col("at") < F.col("high")))
    # a struct compares a missing source as equal
    met = met.select("slot", F.struct("source").alias("of"), F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = met.groupBy("of", "chunk").agg(F.count(F.lit(1)).alias("count"))
    before = Window.partitionBy("of").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("of", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("far"))
    own = F.row_number().over(Window.partitionBy("of", "chunk").orderBy("slot")) - 1
    ranked = met.withColumn("near", own).join(ahead, ["of", "chunk"])
    return ranked.select("slot", "of", (F.col("near") + F.col("far")).alias("block"))


def streams(rows: DataFrame) -> DataFrame:
    """Adds ``start``, the words before a document in its source's stream, to ``of, doc_id, size, key`` of documents with words.

    Equal rows are placed as one and dealt out again.
    """
    same = rows.groupBy("of", "key", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies"))
    same = same.withColumns({"bucket": F.substring("key", 1, DIGITS), "words": F.col("size") * F.col("copies")})
    before = (Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    # buckets are summed up inside groups of 256, then the 256 groups of a source
    totals = same.groupBy("of", "bucket").agg(F.sum("words").alias("words")).withColumn("group", F.substring("bucket", 1, DIGITS // 2))
    inner = F.coalesce(F.sum("words").over(Window.partitionBy("of", "group").orderBy("bucket").rowsBetween(*before)), none)
    outer = F.coalesce(F.sum("words").over(Window.partitionBy("of").orderBy("group").rowsBetween(*before)), none)
    groups = totals.groupBy("of", "group").agg(F.sum("words").alias("words")).select("of", "group", outer.alias("outer"))
    ahead = totals.withColumn("inner", inner).join(groups, ["of", "group"]).select("of", "bucket", (F.col("inner") + F.col("outer")).alias("far"))
    near = F.coalesce(F.sum("words").over(Window.partitionBy("of", "bucket").orderBy("key", "doc_id", "size").rowsBetween(*before)), none)
    placed = same.withColumn("near", near).join(ahead, ["of", "bucket"])
    each = placed.select("of", "doc_id", "size", "near", "far", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("copy"))
    return each.select("of", "doc_id", "size", (F.col("near") + F.col("far") + F.col("copy") * F.col("size")).alias("start"))


def with_source(rows: DataFrame, table: DataFrame, *by: str) -> DataFrame:
    """``rows`` with what ``table`` has for their ``of``; the rows of one source are dealt to ``SALTS`` tasks by other columns."""
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")).alias("salt")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)))
    return salted.join(table.select("*", salt), ["of", "salt"]).drop("salt")


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, size`` and ``key``, the hash of the id (of the text, where that is null) that shuffles documents."""
    doc_id = F.col(id_col).cast("bigint")
    key = F.md5(F.coalesce(doc_id.cast("string"), F.col(text_col).cast("string"), F.lit("")))
    return docs.select(
        doc_id.alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size"), key.alias("key")
    )


def mix(rows: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix of ``documents`` by the targets of ``sources``: ``slot, of, doc_id, size, start, from_word, words``.

    A row for each piece of a document: ``words`` words from ``from_word`` on, in slot ``slot``.
    Pieces of a slot are in order of ``start``, the document's place in the stream of its source
    ``of.source``, and of ``epoch``, how often the stream was taken before.
    """
    placed, total, slots = shares(sources, block)
    slot = settle(schedule(placed, total, slots))
    of = F.struct("source").alias("of")
    taken = slot.groupBy("of").agg(F.max("block").alias("last"))
    sized = sources.select(of, F.col("size").alias("stream")).join(taken, "of")
    own = with_source(streams(rows.where("size > 0").select("*", of)), sized, "start")
    epochs = F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1))).alias("epoch")
    begin = F.col("start") + F.col("epoch") * F.col("stream")
    turns = own.select("*", epochs).withColumn("begin", begin).where(F.floor(F.col("begin") / block) <= F.col("last"))
    last = F.least(F.floor((F.col("begin") + F.col("size") - 1) / block), F.col("last"))
    pieces = turns.select("*", F.explode(F.sequence(F.floor(F.col("begin") / block), last)).alias("block"))
    low = F.greatest(F.col("block") * block, F.col("begin"))
    high = F.least((F.col("block") + 1) * block, F.col("begin") + F.col("size"))
    cut = pieces.select("of", "block", "doc_id", "size", "start", "epoch", (low - F.col("begin")).alias("from_word"), (high - low).alias("words"))
    return cut.join(slot, ["of", "block"]).select("slot", "of", "doc_id", "size", "start", "epoch", "from_word", "words")


def source_targets(rows: DataFrame) -> DataFrame:
    """``source, size, weight, target`` of ``documents``."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("size"))
    return settle(with_targets(ranked_sources(sizes)))


def mix_words(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for each row of ``docs``.

    ``size`` counts the words of the text, ``target`` is what the mix is to take of the
    document's source and ``taken`` the words that it takes of the document, repeats counted,
    at most ``EPOCHS`` times its size. Null texts have no words, a null source is one of its
    own and the last, null ids are shuffled by their texts. Rows equal in id, source and size
    are documents by themselves. Without words all targets are 0.
    """
    rows = settle(documents(docs))
    sources = source_targets(rows)
    of = F.struct("source").alias("of")
    none = F.lit(0).cast("bigint")
    pieces = mix(rows, sources, block).select("of", "doc_id", "size", "start", "words")
    whole = streams(rows.where("size > 0").select("*", of)).withColumn("words", none)
    # a place in a stream is one document's
    taken = whole.unionByName(pieces).groupBy("of", "start", "doc_id", "size").agg(F.sum("words").alias("taken"))
    empty = rows.where("size = 0").select(of, "doc_id", "size", none.alias("taken"))
    known = sources.select(of, F.col("size").alias("source_size"), "target")
    found = with_source(taken.select("of", "doc_id", "size", "taken").unionByName(empty), known, "doc_id", "size", "taken")
    return found.select("doc_id", "size", "source_size", "target", "taken")
