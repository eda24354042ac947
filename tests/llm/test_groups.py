"""Operators that compare documents, against brute force on small tables; chat; the pipeline."""

from __future__ import annotations

import hashlib
import importlib.util
import random
import re

import pytest
from pyspark.sql import functions as F

from statetrail.llm import chat, debruijn, fingerprint, jaccard, linedup
from statetrail.llm.store import keyed

SPACES = "[^\\x20\\x09-\\x0D]+"
SCHEMA = "doc_id bigint, text string, k string"


def texts(seed: int, n: int = 60) -> list[tuple]:
    """Random lines, shared passages, exact and near copies, periodic and odd texts."""
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randint(0, 400))
    shared = [" ".join(word() for _ in range(30)) for _ in range(4)]
    out = []
    for i in range(n):
        lines = [" ".join(word() for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 9))]
        for _ in range(rng.randint(0, 2)):
            lines.insert(rng.randint(0, len(lines)), rng.choice(shared))
        out.append((i, "\n".join(lines), "x"))
    for i in range(n // 2):
        base = rng.choice(out)[1].split(" ")
        for _ in range(rng.randint(0, 2)):
            base[rng.randrange(len(base))] = word()
        out.append((n + i, " ".join(base), "y"))
    odd = [None, "", " \n ", "a b", "A  B", "one", "a " * 50, "a b " * 30, "p\nq\np\nq\np\nq", "é x\vy"]
    out += [(1000 + i, t, None) for i, t in enumerate(odd)]
    return [*out, out[3], out[-1], (None, out[5][1], "n")]


@pytest.fixture(scope="module", params=[1, 2])
def rows(request):
    return texts(request.param)


def key(row):
    return -(2**63) if row[0] is None else row[0]


def unique(rows):
    return sorted({(key(r), r[1] or "") for r in rows})


def brute_substrings(rows):
    seen, out = set(), {}
    for k, t in unique(rows):
        words = re.findall(SPACES, t)
        gone = set()
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone.update(range(i, i + 20))
            seen.add(window)
        out[k, t] = (len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone))
    return out


def test_substrings(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = debruijn.dedup_substrings(frame, rows=True).select(
        "doc_id", "n_words", "n_removed", debruijn.words_joined(F.col("text")).alias("t"), "row.k"
    ).collect()
    want = brute_substrings(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.t) for r in got) == sorted(
        (r[0] is None, r[0] or 0, *want[key(r), r[1] or ""]) for r in rows
    )
    assert sum(r.n_removed for r in got) > 100


def brute_lines(rows, least):
    seen, out = set(), {}
    for k, t in unique(rows):
        lines = t.split("\n")
        full = [i for i, x in enumerate(lines) if x.strip(" \t\r")]
        gone = set()
        for j in range(len(full) - least + 1):
            run = tuple(lines[i] for i in full[j : j + least])
            if run in seen:
                gone.update(full[j : j + least])
            seen.add(run)
        out[k, t] = (len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_lines(spark, rows, least):
    got = linedup.dedup_lines(spark.createDataFrame(rows, SCHEMA), min_lines=least).collect()
    want = brute_lines(rows, least)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_lines, r.n_removed, r.text) for r in got) == sorted(
        (r[0] is None, r[0] or 0, *want[key(r), r[1] or ""]) for r in rows
    )


def shingles(text):
    words = re.findall(SPACES, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_components(rows):
    docs = unique(rows)
    sets, root = [shingles(t) for _, t in docs], list(range(len(docs)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return {d: (len(sets[i]), docs[root[i]][0]) for i, d in enumerate(docs)}


@pytest.mark.parametrize("few", [48, 2])
def test_near_duplicates(spark, rows, few, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 3)
    monkeypatch.setattr(jaccard, "SAMPLE", 2)
    monkeypatch.setattr(jaccard, "SEEN", 2)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute_components(rows)
    found = sorted((r.k, r.n_shingles, -(2**63) if r.component_id is None else r.component_id) for r in got)
    assert found == sorted((key(r), *want[key(r), r[1] or ""]) for r in rows)
    assert len({c for _, c in want.values()}) < len(want)


def test_near_stage_keeps_one_of_each(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    left = jaccard.near_stage(frame)
    want = brute_components(rows)
    assert left.columns == frame.columns
    lone = [d for d in want if not want[d][0]]
    assert left.count() == len(lone) + len({c for n, c in want.values() if n})


def test_near_stage_tells_documents_of_one_id_apart(spark):
    passage = lambda c: " ".join(f"{c}{i}" for i in range(40))
    alone = [(None, passage("a"), "x"), (None, passage("b"), "x"), (7, passage("c"), "x"), (7, passage("d"), "x")]
    bare = [(None, "", "x"), (None, "", "x"), (3, " \n", "x"), (3, " \n", "x"), (4, None, "y"), (4, None, "y")]
    copies = [(9, passage("c") + " e", "x"), (None, passage("d"), "x"), (7, passage("c"), "x")]
    left = jaccard.near_stage(spark.createDataFrame(alone + bare + copies, SCHEMA)).collect()
    want = [alone[0], alone[1], alone[2], copies[1], *bare]
    assert sorted((key(r), r[1] or "") for r in left) == sorted((key(r), r[1] or "") for r in want)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "u bigint, v bigint")
    got = {r.s: r.root for r in jaccard.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_fingerprints(spark, rows):
    got = {(-(2**63) if r.doc_id is None else r.doc_id, r.n_chars): r for r in fingerprint.fingerprint_edits(spark.createDataFrame(rows, SCHEMA)).collect()}
    docs = unique(rows)
    prints = {}
    hashed = {(r.k, r.text): r.h for r in keyed(spark.createDataFrame(rows, SCHEMA)).collect()}
    order = sorted(docs, key=lambda d: (d[0], hashed[d]), reverse=True)
    for i, (k, t) in enumerate(order):
        r, half = got[k, len(t)], len(t) // 2
        follow = order[(i + 1) % len(order)][1]
        edited = t[: len(t) - half] + follow[:half]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint == r.edited_fingerprint) == (sorted(edited.split("\n")) == sorted(t.split("\n")))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints.setdefault(t, set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in prints.values()) and len({min(x) for x in prints.values()}) == len(prints)


def test_fingerprints_add_up(spark):
    frame = spark.createDataFrame([(1, "a b c\nd e f g"), (2, "d e f g\na b c"), (3, "a b c"), (4, "d e f g")], "id int, t string")
    v = {r.id: r.v for r in fingerprint.fingerprints(frame, ["id"], "t", "v").collect()}
    assert v[1] == v[2]
    both = spark.createDataFrame([(v[3], v[4], v[1])], "a array<smallint>, b array<smallint>, c array<smallint>").select(
        fingerprint.combine(F.col("a"), F.col("b")).alias("sum"), fingerprint.combine(F.col("c"), F.col("b"), -1).alias("rest"),
        fingerprint.likeness(F.col("c"), F.col("c")).alias("same"),
    ).first()
    assert both["sum"] == v[1] and both["rest"] == v[3] and both.same == 1.0


@pytest.mark.parametrize("at", [0, 3, 150, 299])
def test_likeness_outlives_an_inserted_word(spark, at):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(2, 9))) for _ in range(300)]
    other = " ".join("".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(2, 9))) for _ in range(300))
    texts = [" ".join(words), " ".join([*words[:at], "inserted", *words[at:]]), other]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    v = {r.id: r.v for r in fingerprint.fingerprints(frame, ["id"], "t", "v").collect()}
    pair = spark.createDataFrame([(v[0], v[1], v[2])], "a array<smallint>, b array<smallint>, c array<smallint>")
    got = pair.select(fingerprint.likeness(F.col("a"), F.col("b")).alias("near"), fingerprint.likeness(F.col("a"), F.col("c")).alias("far")).first()
    assert got.near > 0.9 and got.far < 0.35


def test_fold(spark):
    log = [
        (1, "a", 0, "open", "user", None), (1, "a", 1, "delta", None, "he"), (1, "a", 2, "delta", None, "llo"),
        (1, "b", 3, "open", "assistant", None), (1, "b", 4, "delta", None, "no"), (1, "b", 5, "regenerate", None, None),
        (1, "b", 6, "delta", None, "yes"), (1, "a", 7, "edit", None, "hi"), (1, "a", 8, "delta", None, "!"), (1, "c", 9, "delta", None, "lost"),
        (2, "a", 0, "open", None, None), (2, "a", 1, "bogus", None, "x"),
    ]
    frame = spark.createDataFrame(log, "conv_id bigint, msg string, seq int, kind string, role string, text string")
    got = sorted(map(tuple, chat.fold(frame).collect()))
    assert got == [(1, "a", "user", "hi!"), (1, "b", "assistant", "yes"), (2, "a", "", "")]


def test_chat_reads_back(spark):
    turns = [
        (1, 0, "user", "a < b \\ </turn>\n"), (1, 1, "assistant", "x" * 700 + "<turn user>"), (1, 1, "assistant", "tie"), (1, None, None, None),
        (None, 0, "assistant", ""), (2, 5, "ro>le", "é😀"), (2, 5, "ro>le", "é😀"),
    ]
    frame = spark.createDataFrame([(*t, "more") for t in turns], "conv_id bigint, turn bigint, role string, text string, msg string")
    got = {r.conv_id: r for r in chat.format_conversations(frame).collect()}
    groups = {}
    for c, t, r, x in turns:
        groups.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert got.keys() == groups.keys()
    for c, part in groups.items():
        part = sorted(part)
        said = [x for _, r, x in part if r == "assistant"]
        r = got[c]
        assert r.n_turns == len(part)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in part).encode()).hexdigest()
        assert r.loss_chars == len("".join(said)) and r.loss_sha256 == hashlib.sha256("".join(said).encode()).hexdigest()


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert debruijn.dedup_substrings(none).count() == linedup.dedup_lines(none).count() == jaccard.near_duplicates(none).count() == 0
    assert fingerprint.fingerprint_edits(none).count() == 0
    assert chat.format_conversations(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    if importlib.util.find_spec("corpus_pipeline") is None:
        pytest.skip("the pipeline isn't there")
    import corpus_pipeline

    rows = [(i if i is not None else None, t, None, f"s{i}", None) for i, t, _ in texts(4, 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "substring dedup", "packing"]
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in now.collect()]
        out = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        now = spark.read.parquet(f"{tmp_path}/{i}")
        if name == "toxicity":
            assert now.count() == len(before)
        if name == "line dedup":
            want = brute_lines(before, 2)
            left = [(key(r), *want[key(r), r[1] or ""]) for r in before]
            assert sorted((key(r), r.text) for r in now.collect()) == sorted((k, t) for k, _, gone, t in left if not gone or t.strip())
        if name == "substring dedup":
            want = brute_substrings(before)
            left = [(key(r), *want[key(r), r[1] or ""]) for r in before]
            assert sorted((key(r), " ".join(re.findall(SPACES, r.text))) for r in now.collect()) == sorted(
                (k, t) for k, n, gone, t in left if not gone or gone < n
            )
    assert now.count() > 0 and corpus_pipeline.run(spark, str(tmp_path)).count() > 0
