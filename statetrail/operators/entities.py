"""Which entities a line mentions, and which of those are wanted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statetrail.functions.patterns import UUID_V4
from statetrail.functions.search import bloom_words, is_listed, literal_list, that_may_hold
from statetrail.operators.apart import distinct_apart
from statetrail.operators.lineage import settle_rounds

#: Bytes of ids that are broadcast to all executors, at most.
BROADCAST_BYTES = 100_000_000
#: Bytes of ids that travel in the plan as a sorted list, at most.
LISTED_BYTES = 1_000_000


def mentioned(text: Column, pattern: str = UUID_V4, normalize: bool = False) -> Column:
    """Distinct ids in a line, in order of appearance.

    As written by default, so dashed and undashed forms are different ids;
    ``normalize`` ignores case and dashes.
    """
    if normalize:
        text = F.lower(text)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if normalize:
        found = F.transform(found, lambda u: F.replace(u, F.lit("-"), F.lit("")))
    return F.array_distinct(found)


def extract_entities(
    lines: DataFrame, text: str = "value", pattern: str = UUID_V4, normalize: bool = False
) -> DataFrame:
    """One row per line and distinct id in it; lines without an id disappear."""
    return lines.withColumn("entity_id", F.explode(mentioned(F.col(text), pattern, normalize)))


def fits_broadcast(entities: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether the distinct ids have at most ``max_bytes``, 24 counted for each besides
    its text. An aggregate, so ids of any number and length stay where they are."""
    ids = entities.select("entity_id").distinct()
    size = ids.agg(F.sum(F.coalesce(F.octet_length("entity_id"), F.lit(0)) + 24)).first()[0]
    return (size or 0) <= max_bytes


def match_entities(
    lines: DataFrame,
    entities: DataFrame,
    text: str = "value",
    pattern: str = UUID_V4,
    broadcast: str | bool = "auto",
    max_broadcast_bytes: int = BROADCAST_BYTES,
    normalize: bool = False,
) -> DataFrame:
    """One row per line and wanted id in it.

    ``broadcast="auto"`` measures the ids and broadcasts them when they are few, so
    the lines stay where they are. Beyond that a Bloom filter of the ids, of fixed
    size, keeps most mentions that match nothing out of the shuffle, and the join
    shuffles, with nothing hinted; adaptive execution then splits the partition of a
    hot id. Pass the outcome of ``fits_broadcast`` to measure once for several sources.
    """
    if normalize:
        plain = F.lower(F.replace("entity_id", F.lit("-"), F.lit("")))
        entities = entities.select(plain.alias("entity_id"))
    if broadcast == "auto":
        broadcast = fits_broadcast(entities, max_broadcast_bytes)
    mentions = extract_entities(lines, text, pattern, normalize)
    if broadcast:
        wanted = F.broadcast(entities.select("entity_id").distinct())
    else:
        wanted = distinct_apart(entities, ["entity_id"])
        mentions = that_may_hold(mentions, bloom_words(entities, "entity_id"), F.array("entity_id"))
    return mentions.join(wanted, "entity_id", "left_semi")


@dataclass(frozen=True)
class Wanted:
    """Ids made ready for ``match_lines``: a sorted list when they are few, else a Bloom filter and the written ids."""

    ids: DataFrame
    listed: list[str] | None = None
    words: list[int] | None = None


def wanted_ids(entities: DataFrame, listed_bytes: int = LISTED_BYTES) -> Wanted:
    """Distinct ids, worked out once for any number of sources; listed up to ``listed_bytes``."""
    ids = settle_rounds(entities.select("entity_id").where("entity_id is not null").distinct())
    if fits_broadcast(ids, listed_bytes):
        texts = ids.orderBy("entity_id").select(F.to_json(F.array("entity_id")).alias("id")).toPandas()["id"]
        return Wanted(ids, listed=[t[1:-1] for t in texts])
    return Wanted(ids, words=bloom_words(ids, "entity_id"))


def match_lines(
    lines: DataFrame, entities: DataFrame | Wanted | None, text: str = "value", pattern: str = UUID_V4, place: str = "seq"
) -> DataFrame:
    """One row per line that mentions a wanted id (any id, without ``entities``), with all of
    these in ``entity_ids``: what is done to lines before ``per_entity`` is done once for each.

    Few ids are a sorted list in the plan, in which a line's ids are looked up where the
    line is. Of more ids a Bloom filter of fixed size tells which lines may match; the
    mentions of those meet the ids in a join and are folded back on ``place``, which names
    a line.
    """
    found = mentioned(F.col(text), pattern)
    wanted = wanted_ids(entities) if isinstance(entities, DataFrame) else entities
    if wanted is not None and wanted.listed is not None:
        listed = literal_list(wanted.listed, T.StringType())
        found = F.filter(found, lambda u: is_listed(listed, len(wanted.listed), u))
    # a generator: the search is not done again where the array is used
    likely = lines.withColumn("entity_ids", F.explode(F.filter(F.array(found), lambda a: F.size(a) > 0)))
    if wanted is None or wanted.listed is not None:
        return likely
    likely = that_may_hold(likely, wanted.words, F.col("entity_ids"))
    mentions = likely.select(F.col(place).alias("_place"), F.posexplode("entity_ids").alias("_nth", "entity_id"))
    met = mentions.join(distinct_apart(wanted.ids, ["entity_id"]), "entity_id", "left_semi")
    folded = met.groupBy("_place").agg(F.array_sort(F.collect_list(F.struct("_nth", "entity_id"))).alias("_ids"))
    both = likely.drop("entity_ids").withColumn("_place", F.col(place)).join(folded, "_place").drop("_place")
    return both.withColumn("entity_ids", F.transform("_ids", lambda i: i["entity_id"])).drop("_ids")


def per_entity(rows: DataFrame) -> DataFrame:
    """A row for each of ``entity_ids``, as ``entity_id``."""
    return rows.select("*", F.explode("entity_ids").alias("entity_id")).drop("entity_ids")


def filter_lines(lines: DataFrame, entities: DataFrame, key: list[str], **options) -> DataFrame:
    """Lines that mention at least one wanted id, each once.

    ``key`` identifies a line. With one id per line this is ``match_entities``;
    several matches of one line are folded on the key.
    """
    return match_entities(lines, entities, **options).drop("entity_id").dropDuplicates(key)


def entity_ids(histories: DataFrame, key: str = "entity_id") -> DataFrame:
    """Ids that have a history."""
    return histories.select(F.col(key).alias("entity_id")).distinct()
