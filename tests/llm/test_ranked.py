"""Ranked search against scores of all documents, worked out one by one."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from statetrail.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, count):
    cut = [(i, Counter(terms(t))) for i, t in docs]
    docs_, total = sum(bool(c) for _, c in cut), sum(sum(c.values()) for _, c in cut)
    df = Counter(t for _, c in cut for t in c)
    out = []
    for item, text in set(items):
        own, scored = terms(text), []
        for i, c in cut:
            m = 100 - 25 + 25 * sum(c.values()) * docs_ // total if total else 0
            score = sum(
                math.floor(1000 * math.log((2 * docs_ + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in own if c[t]
            )
            if score > 0:
                scored.append((-score, i))
        out += [(item, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:count])]
    return sorted(out)


def rows(frame):
    return sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in frame.collect())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = [f"W{i}" for i in range(300)] + ["the", "ñandú", "漢字", "x1", "Ünï"]
    weights = [1 / (i + 1) for i in range(300)] + [2, 0.1, 0.05, 0.3, 0.01]
    texts = [" - ".join(rng.choices(words, weights, k=rng.choice([0, 1, 5, 40, 400]))) for _ in range(700)]
    texts += [texts[5], texts[5], texts[7]] * 20 + [None, "", "...", "the the the", " ".join(words) * 30]
    docs = list(enumerate(texts))
    items = [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 3, 12, 60])))) for i in range(40)]
    items += [(100, "the W1 W1 W1 the"), (101, "nowhere W0"), (102, ""), (103, None), (104, "???"), (100, "W2"), (100, "W2")]
    return docs, items


@pytest.mark.parametrize(("shard", "block"), [(ranked.SHARD_BYTES, ranked.BLOCK_TERMS), (4000, 60)])
def test_search_equals_all_scores(spark, corpus, shard, block):
    docs, items = corpus
    table = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, score int").repartition(3)
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    index = ranked.settle(ranked.build_index(table, shard_bytes=shard))
    assert index.count() > (shard == 4000) * 3
    for count in (20, 3):
        assert rows(ranked.search(index, asked, count, block_terms=block)) == brute(docs, items, count)


def test_long_and_short_lists_skip_nothing(spark, corpus, monkeypatch):
    docs, items = corpus
    for block, short in ((4, 0.5), (1000, 0.0), (64, 1.0)):
        monkeypatch.setattr(ranked, "BLOCK", block)
        monkeypatch.setattr(ranked, "SHORT", short)
        held = {}
        batch = next(iter_batches(docs))
        names = ("names", "at", "doc", "times", "ids", "sizes")
        held = {n: x for n, x in zip(names, (ranked._arrays(batch, 0, (n,))[n] for n in names), strict=True)}
        whole = {"docs": batch["docs"][0].as_py(), "terms": batch["terms"][0].as_py()}
        want = brute(docs, items, 20)
        for item, text in {x for x in items if x[0] != 100}:
            asked = Counter(terms(text))
            hashes = ranked.np.array([hash_of(t) for t in asked], ranked.np.uint64)
            df = [held["at"][i + 1] - held["at"][i] if i < len(held["names"]) and held["names"][i] == h else 0 for h, i in zip(hashes, ranked.np.searchsorted(held["names"], hashes), strict=True)]
            if not len(hashes):
                continue
            lists = ranked.Lists(held, hashes, ranked.weigh(whole["docs"], ranked.np.array(df)), whole["docs"], whole["terms"])
            best = ranked.Best(20)
            lists.search(ranked.np.arange(len(hashes)), ranked.np.array(list(asked.values())), best)
            got = [(item, n + 1, int(i), int(s)) for n, (i, s) in enumerate(zip(best.ids, best.scores, strict=True))]
            assert got == [r for r in want if r[0] == item]


def hash_of(term):
    batch = ranked.pa.RecordBatch.from_arrays([ranked.pa.array([term])], names=["text"])
    return next(ranked._terms(batch))[3][0]


def iter_batches(docs):
    shard = ranked._Shard()
    batch = ranked.pa.RecordBatch.from_arrays([ranked.pa.array([t for _, t in docs], ranked.pa.string())], names=["text"])
    ids = ranked.np.array([i for i, _ in docs])
    for row, count, owner, term, times, size in ranked._terms(batch):
        shard.add(ids[row : row + count], owner, term, times, size)
    yield shard.row()


def test_null_ids_repeated_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "red fox"), (1, "red fox"), (1, "red fox"), (2, "blue"), (None, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(None, "RED"), (5, "blue")], "item_id bigint, text string")
    got = ranked.rank_documents(docs, items).collect()
    assert sorted((r["rank"], r["doc_id"]) for r in got if r["item_id"] is None) == [(1, None), (2, 1), (3, 1)]
    assert [(r["rank"], r["doc_id"]) for r in got if r["item_id"] == 5] == [(1, 2)]
    assert ranked.rank_documents(docs.limit(0), items).count() == ranked.rank_documents(docs, items.limit(0)).count() == 0
    assert ranked.rank_documents(docs.where("text is null"), items).count() == 0


def test_a_very_long_text(spark):
    text = " ".join(f"w{i % 5000}" for i in range(300_000))
    docs = spark.createDataFrame([(1, text), (2, "w1 w2"), (3, "z" * 2_000_000)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "w1 w2"), (2, "z" * 2_000_000)], "item_id bigint, text string")
    got = rows(ranked.rank_documents(docs, items))
    assert got == brute([(1, text), (2, "w1 w2"), (3, "z" * 2_000_000)], [(1, "w1 w2"), (2, "z" * 2_000_000)], 20)
