"""Mixing against a word-by-word walk of the schedule."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from statetrail.llm import mixing


def size_of(text):
    return len([w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w])


def targets_of(sizes):
    """Shares by weight, the excess over three times a size given to the others again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left, free = total - sum(3 * sizes[s] for s in capped), [s for s in order if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {s: share.get(s, 3.0 * sizes[s]) for s in order}
        capped |= over


def brute(docs, block):
    sizes = Counter()
    for _, text, source in docs:
        sizes[source] += size_of(text)
    targets = targets_of(sizes)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    whole = {s: int(targets[s]) for s in order}
    total, high = sum(whole.values()), 0
    highs = [(high := high + whole[s], s) for s in order]
    slots = Counter()
    for slot in range(-(-total // block)):
        at = min(int((slot * mixing.GOLDEN) % mixing.RANGE / float(mixing.RANGE) * total), total - 1)
        slots[next(s for h, s in highs if at < h)] += 1
    taken = defaultdict(int)
    for source in order:
        own = [(hashlib.md5((str(i) if i is not None else t or "").encode()).hexdigest(), i if i is not None else -1, size_of(t), n) for n, (i, t, s) in enumerate(docs) if s == source]
        stream = [n for *_, size, n in sorted(own) for _ in range(size)]
        for n in (stream * 3)[: slots[source] * block]:
            taken[n] += 1
    return sorted(((-1 if i is None else i), size_of(t), sizes[s], targets[s], taken[n]) for n, (i, t, s) in enumerate(docs))


def rows(frame):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in frame.collect())


DOCS = [(i, " ".join(["w"] * (i * 7 % 90 + 1)), f"s{i % 3}") for i in range(120)]
DOCS += [(200 + i, f"a\tb\x0bc\x85d　e {i}", None) for i in range(30)] + [(300, "x " * 900, "tiny"), (301, None, "tiny"), (302, " \n ", "blank")]
DOCS += [(None, "no id", "s1"), (None, "other no id", "s1"), (None, None, None), (5, "w w w", "s1"), (400, "same text", "é"), (400, "same text", "é")]
DOCS += [(500 + i, "few", "z-few") for i in range(3)]


@pytest.mark.parametrize("block", [16, 128])
def test_mix_equals_the_walk(spark, block):
    docs = spark.createDataFrame([(*d, 1, 2.0) for d in DOCS], "doc_id bigint, text string, source string, size int, target double").repartition(3)
    got, want = rows(mixing.mix_words(docs, block)), brute(DOCS, block)
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], rel=1e-12)
    assert all(r[4] <= 3 * r[1] for r in got)


def test_sources_come_near_their_targets(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string, source string")
    got = mixing.mix_words(docs.withColumn("source", F.coalesce("source", F.lit("none"))), 4).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 12 for r in got)


def test_the_mix_is_in_slots(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string, source string")
    rows_ = mixing.documents(docs)
    pieces = mixing.mix(rows_, mixing.source_targets(rows_), 16).collect()
    words, sources = Counter(), defaultdict(set)
    for p in pieces:
        words[p["slot"]] += p["words"]
        sources[p["slot"]].add(p["of"]["source"])
        assert 0 <= p["from_word"] and p["from_word"] + p["words"] <= p["size"] and p["words"] > 0
    assert set(words.values()) <= set(range(1, 17)) and Counter(words.values()).most_common(1)[0][0] == 16
    assert all(len(s) == 1 for s in sources.values())


def test_points_are_exact(spark):
    slots = [0, 1, 65_535, 65_536, 123_456_789, 2**31, 2**32 - 1, 2**32, 2**45 + 12_345]
    frame = spark.createDataFrame([(s,) for s in slots], "slot bigint").select("slot", mixing.point(F.col("slot")).alias("at"))
    assert {r["slot"]: r["at"] for r in frame.collect()} == {s: s * mixing.GOLDEN % mixing.RANGE for s in slots}


def test_no_rows_no_words_and_reruns(spark):
    schema = "doc_id bigint, text string, source string"
    assert mixing.mix_words(spark.createDataFrame([], schema)).count() == 0
    none = spark.createDataFrame([(1, None, "a"), (2, "", None), (2, "", None)], schema)
    assert rows(mixing.mix_words(none)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    docs = spark.createDataFrame(DOCS, schema)
    assert rows(mixing.mix_words(docs)) == rows(mixing.mix_words(docs.repartition(7)))


def test_one_source_and_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "w " * 1_000_000, "a"), (2, "q" * 3_000_000, "a")], "doc_id bigint, text string, source string")
    got = rows(mixing.mix_words(docs))
    assert [r[:4] for r in got] == [(1, 1_000_000, 1_000_001, 1_000_001.0), (2, 1, 1_000_001, 1_000_001.0)]
    assert abs(sum(r[4] for r in got) - 1_000_001) < 128
