"""Operators that map documents: BPE, packing, licences, toxicity, and the helpers they share."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from statetrail.llm import arrays, bpe, hnsw, licenses, packing, pieces, toxicity

RANKS, MODEL = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, " ", "\n\n a", "don't 's ''s 'tis", "x" * 700, "1 22٣ 漢字 😀  \t", "a\x00b", "A b\r\nc", "word " * 400]
ROWS = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, "no id", "y"), (3, ODD[3], "x")]
SCHEMA = "doc_id bigint, text string, k string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(2)


def reference():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(st.lists(st.text(alphabet="aAé 's\n\t٣x　'rel'd!漢😀", max_size=30), max_size=6))
@settings(max_examples=150, deadline=None)
def test_pieces_are_those_of_the_pattern(texts):
    for row, data, borders in arrays.blocks(pa.array(texts, pa.string())):
        start, end, first = pieces.split(data, borders)
        raw = data.tobytes()
        found = [raw[a:b].decode() for a, b in zip(start, end, strict=True)]
        for i in range(len(borders) - 1):
            assert found[first[i] : first[i + 1]] == regex.findall(public_tokenizers.PATTERN, texts[row + i])


@given(st.lists(st.text(max_size=40), max_size=6))
@settings(max_examples=60, deadline=None)
def test_words_and_hashes(texts):
    for row, data, borders in arrays.blocks(pa.array(texts, pa.string()), 64):
        words = arrays.Words(data, borders, ~arrays.SPACE)
        raw = data.tobytes()
        found = [raw[a:b] for a, b in zip(words.start, words.end, strict=True)]
        for i in range(len(borders) - 1):
            assert found[words.first[i] : words.first[i + 1]] == re.findall(rb"[^\x20\x09-\x0D]+", texts[row + i].encode())
        h = words.hashes()
        assert len(set(h.tolist())) == len(set(found))
        assert len({(a, b) for a, b in zip(found, h.tolist(), strict=True)}) == len(set(found))


def test_bpe_matches_and_comes_back(docs):
    enc = reference()
    got = sorted(bpe.digest_round_trip(docs, RANKS).collect(), key=str)
    want = []
    for i, t, _ in ROWS:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_bpe_ids_decode(docs):
    back = bpe.decode_ids(bpe.encode_texts(docs, RANKS), RANKS).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, bytes(r.decoded)) for r in back) == sorted(
        (i is None, i or 0, (t or "").encode()) for i, t, _ in ROWS
    )


def test_bpe_long_piece():
    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(5000))
    ids, counts = bpe.ranks_of(RANKS).encode([text.encode()])
    assert ids.tolist() == reference().encode_ordinary(text) and counts.tolist() == [len(ids)]


def test_packing_is_whole(spark, docs):
    more = spark.createDataFrame([(100 + i, f"shared words {i % 7} " * (40 + 13 * i), "z") for i in range(40)], SCHEMA)
    rows = packing.pack(docs.union(more), MODEL).collect()
    tokenizer = Tokenizer.from_file(MODEL)
    tokenizer.encode_special_tokens = True
    texts = {(r.doc_id): r.text for r in docs.union(more).collect()}
    sequences = {}
    for r in rows:
        ids = np.array(tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [0], "<u4")
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        sequences.setdefault(r.sequence_id, []).append(r)
    for part in sequences.values():
        at = 0
        for r in sorted(part, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
    short = [p for p in sequences.values() if sum(r.length for r in p) < packing.WINDOW]
    assert len(short) <= docs.union(more).rdd.getNumPartitions()


def test_packing_of_added_tokens(spark):
    mark = "<|endoftext|>"
    texts = [f"a {mark} b", mark, f"é{mark}{mark}'s  {mark}\n\n x", "<|endof", "text|>", f"it{mark}'ll <|endoftext|", "plain 's", None]
    tokenizer = Tokenizer.from_file(MODEL)
    assert tokenizer.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1), MODEL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [0], "<u4")
        assert (r.start, r.length, r.doc_tokens, r.ids_crc32) == (0, len(ids), len(ids), zlib.crc32(ids.tobytes()))


def test_packing_prefers_neighbours():
    terms = [np.array(x, np.uint64) for x in ([1, 2, 3], [7, 8], [1, 2, 4], [9, 8])]
    index = packing.Index(terms, [np.ones(len(t)) for t in terms])
    assert index.neighbours(0, np.ones(4, bool)).tolist() == [2]
    assert index.neighbours(0, np.array([True, True, False, True])).tolist() == []


def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, lab) for p, lab in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_licenses(spark):
    texts = [
        "Released under the MIT-License. under the mit license", "Apache License, Version 2.0", "cc by nc cc by nc", "under themit license",
        "SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0\nmore", "SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0",
        None, "", "é under\x00the_mit license é",
    ]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licenses(t)
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    assert got[4].labels == "apache-2,gpl-2,mit" and got[5].labels == "gpl-2" and got[5].score == 0.4


def test_expressions():
    assert licenses.postfix(["a", "or", "b", "and", "c"]) == ["a", "b", "c", "and", "or"]
    assert licenses.postfix(["(", "a", "or", "b", ")", "and", "c"]) == ["a", "b", "or", "c", "and"]
    assert licenses.postfix(["a", "or"]) is None and licenses.postfix(["(", "a"]) is None and licenses.postfix(["a", ")"]) is None
    assert licenses.evaluate("mit or gpl-3.0")[1] == 1.0 and licenses.evaluate("mit and gpl-3.0")[1] == 0.4
    assert licenses.evaluate("") == (set(), 0.0)


def test_long_expressions(spark):
    long = " AND ".join(["MIT"] * 200)
    tag = "SPDX-License-Identifier: "
    texts = [
        f"{tag}{long} AND GPL-3.0-only", f"{tag}{'(' * 90}{long}{')' * 90} AND CC-BY-NC-4.0 */ more", f"{tag}MIT {'x ' * 300}{tag}GPL-2.0",
        f"{tag}{long} AND (GPL-3.0-only\nAGPL-3.0", f"{tag}MIT AND {tag}Apache-2.0 OR",
    ]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert [(r.labels, r.score) for r in sorted(got)] == [("gpl-3,mit", 0.4), ("cc-by-nc,mit", 0.1), ("gpl-2,mit", 0.4), ("mit", 1.0), ("apache-2,mit", 1.0)]
    names, freedom = licenses.evaluate(" and ".join(f"own-{i}" for i in range(50_000)) + " and")
    assert len(names) == 50_000 and freedom == 0.5


SEPARATORS = [" ", "-", "\n", "\r\n", "\t \t", " - " * 5, "_", "\x00", "\n\n# ", "...", ":-/"]


def test_tags_with_any_separators(spark):
    texts = [f"SPDX{a}License{b}Identifier{c}MIT OR GPL-3.0\nnext line" for a in SEPARATORS for b in SEPARATORS for c in (": ", "\t", " (", "--\n")]
    texts += ["SPDX License\nIdentifier: MIT", "spdx license identifier", "SPDX-License-Identifier:\nMIT", "xspdx license identifier mit"]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [r.labels for r in got] == [("" if "(" in t or "--\n" in t else "gpl-3,mit") for t in texts[:-4]] + ["mit", "", "", ""]


def test_tags_of_one_line(spark):
    text = "SPDX-License-Identifier: MIT SPDX-License-Identifier: BSD-3-Clause AND own-1\nSPDX-License-Identifier: Apache-2.0"
    got = licenses.scan_licenses(spark.createDataFrame([(1, text, 2)], "doc_id bigint, text string, labels int")).first()
    assert got.labels == "apache-2,bsd,mit,own-1" and got.score == 0.5 and got.base_labels == ""


@pytest.mark.parametrize("part", ["under the mit license ", "SPDX-License-Identifier: MIT ", "spdx license identifier\n(mit\n"])
def test_many_places_take_time_in_proportion(part):
    raw = (part * (10_000_000 // len(part))).encode()
    begin = time.perf_counter()
    row = licenses._scan(raw, licenses._automaton())
    assert time.perf_counter() - begin < 30
    words = len(part.replace("-", " ").replace(":", " ").replace("(", " ").split())
    assert row[0] == words * (10_000_000 // len(part))
    if "under" in part:
        assert row[1:4] == (row[0] // 4, 0, row[0] - 4) and row[4] == "mit"


@given(st.lists(st.sampled_from(["a", "b", "and", "or", "with", "(", ")"]), max_size=12))
def test_longest_beginning(tokens):
    read, whole = licenses.beginning(tokens)
    assert whole == max((n for n in range(1, len(tokens) + 1) if licenses.postfix(tokens[:n])), default=0) and read == tokens[: len(read)]


def test_toxicity_finds_the_sentences(spark):
    rng = random.Random(3)
    plain = [f"w{i}" for i in range(200)]

    def text(bad):
        parts = [" ".join(rng.choice(plain) for _ in range(8)) for _ in range(5)]
        if bad:
            parts[2] += f" vile{rng.choice('abc')}"
        return ". ".join(parts) + "."

    rows = [(i, text(i % 3 == 0)) for i in range(600)]
    docs = spark.createDataFrame([*rows, (None, "no id"), (900, None), (901, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)] + [(None, 1), (1, None), (2, 5)], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == 603 and all(0 <= r.score <= 1 for r in got.values())
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in range(600) if got[i].held_out} == set(held)
    assert np.mean([got[i].predicted == (i % 3 == 0) for i in held]) > 0.95
    hit = next(i for i in held if i % 3 == 0)
    (span,) = got[hit].sentences
    assert "vile" in rows[hit][1][span.from_byte : span.to_byte]
    left = toxicity.toxicity_stage(docs, labels)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, r in got.items() if r.score < 0.5}


def test_toxicity_of_long_texts(spark):
    rng = random.Random(4)
    plain = [f"w{i}" for i in range(200)]

    def text(sentences, bad=0):
        parts = [" ".join(rng.choice(plain) for _ in range(8)) for _ in range(sentences)]
        for i in range(bad):
            parts[i] += " vile"
        return ". ".join(parts) + "."

    rows = [(i, text(800, 2 * (i % 3 == 0))) for i in range(90)]
    assert min(len(t) for _, t in rows) > 20_000
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id bigint, toxic int")
    more = [(1000, text(10_000)), (1001, "zq zp. " * 10_000), (1002, text(10_000, 2)), (1003, text(3, 1))]
    docs = spark.createDataFrame(rows + more, "doc_id bigint, text string")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert got[1001].score == 0 and got[1000].score < 0.1 and got[1002].score > 0.5 and got[1003].score > 0.5
    assert all(got[i].predicted == (i % 3 == 0) for i in range(90))
    assert {r.doc_id for r in toxicity.toxicity_stage(docs, labels).collect()} == {i for i, r in got.items() if r.score < 0.5}


def test_patterns_are_whole():
    owner, place, feature = np.array([0, 0, 1, 1, 1]), np.array([0, 0, 1, 2, 3, 4, 4]), np.array([5, 6, 5, 7, 5, 6, 5])
    got = toxicity.patterns(owner, place, feature, 3)
    assert [len(t) for _, _, t in got] == [2, 3, 0] and all(t.tolist() == [1] * len(t) for _, _, t in got)
    again = toxicity.patterns(np.zeros(4, int), np.array([0, 1, 1, 2, 3, 3]), np.array([5, 6, 7, 5, 7, 6]), 1)
    assert sorted(again[0][2].tolist()) == [2, 2] and sorted(again[0][0].tolist()) == [5, 6, 7]


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.toxicity(docs, none).first().predicted == 0


def brute_nearest(vectors, count, every):
    good = {i: np.array(v, float) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, x in good.items():
        if q % every == 0:
            out[q] = [i for _, i in sorted((-float((x * y).sum()), i) for i, y in good.items() if i != q)][:count]
    return out


def test_nearest_recall_ties_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, rng.normal(size=8).round(3).tolist()) for i in range(900)]
    vectors += [(i, [1.0] * 8) for i in range(1000, 1060)]
    vectors += [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [None] + [1.0] * 7), (None, [1.0] * 8), (2004, [float("inf")] * 8)]
    frame = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>")
    exact = [(r.vec_id, r.embedding) for r in frame.collect()]
    got = {}
    for r in hnsw.nearest(frame, 10, 20, shard_points=300).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute_nearest(exact, 10, 20)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) / sum(map(len, want.values())) >= 0.95
    assert got[1000] == want[1000] and set(range(1001, 1007)) & set(got[1000])
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id bigint, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in hnsw.nearest(few).collect()] == [(0, 1, 1, 0.5)]


def test_nearest_in_blocks_of_queries(spark):
    rng = np.random.default_rng(6)
    frame = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(600)], "vec_id bigint, embedding array<double>")
    queries = frame.toDF("query_id", "query")
    groups = {(r.shard, r.block): r["count"] for r in hnsw.dealt(queries, 3, 8).groupBy("shard", "block").count().collect()}
    assert groups.keys() == {(s, b) for s in range(3) for b in range(8)} and max(groups.values()) < 150
    one, many = (sorted(hnsw.nearest(frame, 5, 2, shard_points=200, block_queries=n).collect()) for n in (10_000, 40))
    assert one == many and len(one) == 300 * 5


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack(none, MODEL).count() == bpe.digest_round_trip(none, RANKS).count() == licenses.scan_licenses(none).count() == 0
    assert toxicity.toxicity(none, spark.createDataFrame([], "doc_id bigint, toxic int")).count() == 0
    assert hnsw.nearest(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
