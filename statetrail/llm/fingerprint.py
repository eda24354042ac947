"""Document fingerprints: a homomorphic hash of the multiset of a text's paragraphs.

Every paragraph (a line) is hashed to a wide vector, and a document's fingerprint is the
sum of the vectors modulo 2**16. The order of paragraphs doesn't matter; a paragraph is
inserted by adding its vector and deleted by subtracting it (``combine``).

The first 16 components are pieces of xxhash64 values of the whole paragraph: they settle
equality. The other 128 are sums of a random sign for each piece of up to five words of the
paragraph. Such sums estimate inner products of the multisets of pieces, so likeness
follows from two fingerprints alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statetrail.llm.store import id_of, keyed, settle

#: Seeds of the hashes of paragraphs and of pieces.
WHOLE, SIGNS = (1, 2, 3, 4), (11, 12)
MODULUS = 1 << 16
EQUAL_LANES, LIKE_LANES = 4 * len(WHOLE), 64 * len(SIGNS)
#: A piece ends with a word whose last letter is one of a few, or is the fifth word: where pieces
#: end follows from the words themselves, so a word put in changes the pieces next to it only.
PIECE = r"(?:[^ \t\r\n]++(?<![aent])[ \t\r]++){0,4}[^ \t\r\n]++"
LOW_BITS = 0x0000000100000001


def units(text: Column) -> Column:
    """Paragraphs, each marked by a leading line feed, and their pieces of up to five words."""
    paragraphs = F.transform(F.split(text, "\n", -1), lambda p: F.concat(F.lit("\n"), p))
    return F.concat(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), paragraphs)


def sums(unit: Column) -> list[Column]:
    """Aggregates over units. Two counts of 32 bits share a BIGINT, so nothing overflows."""
    whole = unit.startswith("\n")
    piece = ~whole
    none = F.lit(0).cast("bigint")
    out = [F.count_if(piece).alias("n")]
    for i, seed in enumerate(WHOLE):
        h = F.when(whole, F.xxhash64(F.lit(seed), unit)).otherwise(none)
        for j in range(4):
            part = F.shiftrightunsigned(h, 16 * j).bitwiseAND(F.lit(MODULUS - 1))
            out.append(F.sum(part).alias(f"e{4 * i + j}"))
    for i, seed in enumerate(SIGNS):
        h = F.when(piece, F.xxhash64(F.lit(seed), unit)).otherwise(none)
        for j in range(32):
            out.append(F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(LOW_BITS))).alias(f"s{32 * i + j}"))
    return out


def wrapped(x: Column) -> Column:
    """``x`` modulo 2**16, as a SMALLINT from -32768 on."""
    return (F.pmod(x + MODULUS // 2, F.lit(MODULUS)) - MODULUS // 2).cast("smallint")


def lanes() -> Column:
    """The vector, from ``sums``."""
    low, n = F.lit(0xFFFFFFFF), F.col("n")
    equal = [F.col(f"e{i}") for i in range(EQUAL_LANES)]
    ones = [x for i in range(32 * len(SIGNS)) for x in (F.col(f"s{i}").bitwiseAND(low), F.shiftrightunsigned(f"s{i}", 32))]
    return F.transform(F.array(*equal, *[2 * x - n for x in ones]), wrapped)


def render(vector: Column) -> Column:
    """A vector as text, four hexadecimal digits a component."""
    digits = F.transform(vector, lambda x: F.lpad(F.hex(F.pmod(x.cast("int"), F.lit(MODULUS))), 4, "0"))
    return F.lower(F.array_join(digits, ""))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Vector of the paragraphs of both; with ``sign=-1`` those of ``b`` are taken out of ``a``."""
    return F.zip_with(a, b, lambda x, y: wrapped(x.cast("int") + sign * y.cast("int")))


def likeness(a: Column, b: Column) -> Column:
    """Estimated 2<a,b> / (<a,a> + <b,b>) of the multisets of pieces, in 0 to 1; equal vectors: 1."""
    like = lambda v: F.transform(F.slice(v, EQUAL_LANES + 1, LIKE_LANES), lambda x: x.cast("double"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    product = total(F.zip_with(like(a), like(b), lambda x, y: x * y))
    norms = total(F.zip_with(like(a), like(b), lambda x, y: x * x + y * y))
    share = F.when(norms > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * product / norms))).otherwise(0.0)
    return F.when(a == b, 1.0).otherwise(share)


def fingerprints(texts: DataFrame, keys: list[str], text: str, name: str) -> DataFrame:
    """``keys`` and the vector ``name`` of each text; ``keys`` must tell the texts apart."""
    exploded = texts.select(*keys, F.explode(units(F.col(text))).alias("unit"))
    return exploded.groupBy(*keys).agg(*sums(F.col("unit"))).select(*keys, lanes().alias(name))


def followed(keys: DataFrame) -> DataFrame:
    """``k, h, size`` of distinct documents with ``nk, nh``, the next by descending key; the last's is the first.

    Keys are dealt out by range and written once, so that neighbours inside a part follow from
    a window, and the parts are linked by one row for each.
    """
    placed = settle(
        keys.repartitionByRange(F.desc("k"), F.desc("h")).withColumn("part", F.spark_partition_id())
    )
    heads = placed.groupBy("part").agg(F.max(F.struct("k", "h")).alias("head"))
    heads = heads.selectExpr(
        "part", "coalesce(lead(head) over (order by part), first(head) over (order by part)) as after"
    )
    inside = placed.selectExpr(
        "*", "lead(struct(k, h)) over (partition by part order by k desc, h desc) as following"
    )
    follow = F.coalesce("following", "after")
    return inside.join(F.broadcast(heads), "part").select(
        "k", "h", "size", follow["k"].alias("nk"), follow["h"].alias("nh")
    )


def edited(dealt: DataFrame, order: DataFrame) -> DataFrame:
    """``k, h, text`` of distinct documents with ``nk, nh, size`` of ``order`` (see ``followed``) and the edited
    text: the last half of the code points replaced by as many first ones, or all, of the following text.

    Besides the texts, only the part travels that each sends to the document before it.
    """
    sent = order.selectExpr("nk as k", "nh as h", "k as to_k", "h as to_h", "size", "cast(size div 2 as int) as half")
    heads = dealt.join(sent, ["k", "h"]).select(
        F.col("to_k").alias("k"), F.col("to_h").alias("h"), F.col("k").alias("nk"), F.col("h").alias("nh"),
        "size", "half", F.substring(F.col("text"), F.lit(1), F.col("half")).alias("head"),
    )
    kept = F.substring(F.col("text"), F.lit(1), (F.col("size") - F.col("half")).cast("int"))
    return dealt.join(heads, ["k", "h"]).withColumn("edited", F.concat(kept, F.col("head")))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """A row for each document with its fingerprint, that of its edited text, and how alike it is
    to the edited text's and to the next document's.

    A null id counts as the smallest id and a null text as empty. Rows equal in id and text are
    one document and give one row. An empty text has one empty paragraph. No documents, no rows.
    Likeness compares pieces of words; see ``PIECE``. Texts of any length are one row of a join.
    """
    slim = keyed(docs)
    order = followed(slim.select("k", "h", F.char_length("text").alias("size")).distinct())
    dealt = slim.repartition("k", "h").dropDuplicates(["k", "h"])
    both = edited(dealt, order).withColumn("edited_sha256", F.sha2("edited", 256))
    keys = ["k", "h", "nk", "nh", "size", "edited_sha256"]
    versions = both.select(*keys, F.explode(F.array(
        F.struct(F.lit(False).alias("new"), F.col("text").alias("text")),
        F.struct(F.lit(True).alias("new"), F.col("edited").alias("text")),
    )).alias("v")).select(*keys, "v.*")
    vectors = settle(fingerprints(versions, [*keys, "new"], "text", "vector"))
    own = vectors.where(~F.col("new")).select("k", "h", F.col("vector").alias("own"))
    following = own.toDF("nk", "nh", "following")
    pair = vectors.where("new").withColumnRenamed("vector", "changed").join(own, ["k", "h"])
    return pair.join(following, ["nk", "nh"]).select(
        id_of(F.col("k")).alias("doc_id"), F.col("size").cast("bigint").alias("n_chars"), "edited_sha256",
        render(F.col("own")).alias("fingerprint"), render(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
