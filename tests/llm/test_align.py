"""Alignment of two tokenizers' tokens against the tokenizers themselves and all pairs of tokens."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from statetrail.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "the quick brown fox", "the quick brown fox", "  two  spaces \n\n lines\tand tabs ", "", None, " ", "x▁y", "▁ foo",
    "<s> <0x41> </s> <|endoftext|> [INST]", "日本語 テキスト 😀😀 ñandú", "a\x00b\x85c　d", "don't we'll 12345 ...!!!", "z" * 3000,
    "Lorem ipsum dolor sit amet " * 60, "it's" + " " * 40 + "far",
]


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(texts, tokenizers):
    """Every pair of tokens compared, from the tokenizers' own results on whole texts."""
    a, b = tokenizers
    letters = {c: x for x, c in align._byte_letters().items()}
    out, links = [], Counter()
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        raw_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            out.append(([], [], [], []))
            continue
        ends_a, ends_b = (np.cumsum([len(x) for x in raw]) for raw in (raw_a, raw_b))
        own, j = [], 0
        for i, stop in enumerate(ends_a):
            start = ends_a[i - 1] if i else 0
            while ends_b[j] <= start:
                j += 1
            k = j
            while k < len(ends_b) and (ends_b[k - 1] if k else 0) < stop:
                own.append((ids_a[i], ids_b[k]))
                k += 1
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            to_a, to_b = list(ends_a).index(end) + 1, list(ends_b).index(end) + 1
            groups.append((ids_a[i:to_a], ids_b[j:to_b]))
            i, j = to_a, to_b
        links.update(own)
        out.append((ids_a, ids_b, groups, own))
    most = Counter()
    for (_, second), n in links.items():
        most[second] = max(most[second], n)
    rows = []
    for ids_a, ids_b, groups, own in out:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((
            len(ids_a), len(ids_b), len(groups), len(own), sum(links[p] == most[p[1]] for p in own), sum(links[p] for p in own),
            hashlib.sha256(text.encode()).hexdigest() if text else "",
        ))
    return rows


@pytest.mark.parametrize("known", [align.KNOWN, 60])
def test_align_equals_all_pairs(spark, tokenizers, known):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, row string, a int")
    got = align.align(docs.repartition(3), A, B, known=known).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute(TEXTS, tokenizers)


def test_groups_as_text(spark, tokenizers):
    docs = spark.createDataFrame([(1, "the quick"), (2, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in align.align(docs, A, B, groups=True).collect()}
    assert hashlib.sha256(got[1]["groups"].encode()).hexdigest() == got[1]["groups_sha256"]
    assert got[2]["groups"] == "" and got[2]["groups_sha256"] == ""


def test_repeated_rows_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "one text"), (None, "one text"), (7, "")], "doc_id bigint, text string")
    got = align.align(docs, A, B).collect()
    twice = [r for r in got if r["doc_id"] is None]
    assert len(got) == 3 and len(twice) == 2 and twice[0] == twice[1] and twice[0]["count_sum"] == 2 * twice[0]["n_links"]
    assert align.align(docs.limit(0), A, B).count() == 0


def test_a_very_long_text(spark, tokenizers):
    text = " ".join(f"word{i % 977} ñu{i}" for i in range(60_000)) + "q" * 200_000
    got = align.align(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), A, B).first()
    assert got["n_a"] == len(tokenizers[0].encode(" " + text, add_special_tokens=False).ids)
    assert got["n_b"] == len(tokenizers[1].encode(text))


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 400)), st.sets(st.integers(0, 400)))
def test_gallop_counts_smaller_values(short, long):
    short, long = np.array(sorted(short), np.int64), np.array(sorted(long), np.int64)
    assert (align.gallop(short, long) == np.searchsorted(long, short)).all()
