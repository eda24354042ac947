"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's complement is that of the logistic of a sum of
weights of its words and of their beginnings, divided by that of a sentence without any: so it
scores 0 without evidence, however many there are. A document scores the noisy-or of its
sentences over the score of chance, one minus the product of their complements. Weights are learned from labels of whole
documents of any length, the bias of a sentence and the score of chance on a part of these labels kept from that fit, and the sentences that carry a document over the threshold are located
from their own scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statetrail.llm import arrays
from statetrail.llm.store import settle

#: Words have a weight if they are in this many documents of the sample at least, and toxic ones
#: among these exceed the number expected by chance by so many standard deviations. Weights of all
#: other words would be learned by heart.
LEAST_DOCS, LEAST_Z = 5, 5.0
#: Bytes of a word that count as its beginnings, besides the whole word.
BEGINNINGS = (5, 7)
#: Labelled documents that the weights are fitted on, at most.
TRAIN_ROWS = 8_000
STEPS, RATE, DECAY = 80, 0.2, 1e-4
#: Share of documents that the fit takes to be labelled toxic without evidence, whatever their length.
LEAK = 0.05
#: Biases of a sentence that the fit chooses from, on learning rows of remainder INNER. The evidence that a
#: clean sentence has on average there, times MARGIN, is what documents of any length are allowed a sentence.
BIASES, INNER, MARGIN = (-4.0, -6.0, -8.0), 1, 2.0
#: Bytes that end a sentence: full stop, exclamation and question mark, line feed.
ENDS = np.isin(arrays.BYTES, [0x2E, 0x21, 0x3F, 0x0A])


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; null ids count as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


class Bags:
    """Sentences of the texts of a block, as hashed features."""

    def __init__(self, data: np.ndarray, borders: np.ndarray):
        lower = arrays.LOWER[data]
        words = arrays.Words(lower, borders, arrays.ALNUM)
        ends = np.concatenate([[0], np.cumsum(ENDS[data])])
        owner = words.owner()
        sentence = ends[words.start] + owner  # grows at sentence ends and from text to text
        new = np.ones(len(words), bool)
        new[1:] = sentence[1:] != sentence[:-1]
        #: First word of each sentence, and the text it is in.
        self.begin = np.flatnonzero(new)
        self.owner = owner[self.begin]
        #: Bytes of the block that each sentence covers.
        self.from_byte = words.start[self.begin]
        self.to_byte = words.end[np.append(self.begin[1:], len(words))[: len(self.begin)] - 1] if len(words) else self.begin
        #: The hash of each word and beginning, and the sentence it is in, in order of sentences.
        seen = [words.hashes(), *(words.beginnings(n) ^ np.uint64(n) for n in BEGINNINGS)]
        self.words = np.stack(seen, axis=1).ravel()
        self.place = np.repeat(np.arange(len(self.begin)), len(seen) * np.diff(np.append(self.begin, len(words))))


class Weights:
    """Weights of words, by their sorted hashes, the bias of a sentence and the evidence that it may have by chance."""

    def __init__(self, words: np.ndarray, values: np.ndarray, bias: float, chance: float = 0.0):
        self.words, self.values, self.bias, self.chance = words, values, bias, chance

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words have a weight, and its number."""
        if not len(self.words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        known = np.flatnonzero(self.words[at] == words)
        return known, at[known]


def evidence(values: np.ndarray, bias: float, feature: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """The negative logarithm of each sentence's complement: 0 without a word that has a weight."""
    z = np.bincount(place, values[feature], n) + bias
    return np.logaddexp(0, z) - np.logaddexp(0, bias)


def noisy_or(found: np.ndarray, owner: np.ndarray, sentences: np.ndarray, chance: float, times: np.ndarray | float = 1.0) -> np.ndarray:
    """Scores of documents of so many sentences: every complement is taken relative to that of chance,
    so that weak evidence doesn't add up with their length."""
    return -np.expm1(-np.maximum(np.bincount(owner, found * times, len(sentences)) - chance * sentences, 0))


def vocabulary(counts: DataFrame) -> tuple[np.ndarray, int]:
    """Sorted words that toxic documents hold more often than chance, and how many documents there are.

    ``word, docs, toxic``: in how many documents and toxic documents each word is; the row
    without a word has the numbers of all documents.
    """
    counts = settle(counts.groupBy("word").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic")))
    total = counts.where("word is null").first()
    if total is None:
        return np.zeros(0, np.uint64), 0
    share = F.col("docs") / F.lit(total["docs"])
    chance = F.lit(total["toxic"]) * share
    often = (F.col("docs") >= LEAST_DOCS) & (F.col("toxic") - chance >= LEAST_Z * F.sqrt(chance * (1 - share)))
    names = counts.where(F.col("word").isNotNull() & often).select("word").toPandas()["word"]
    return np.sort(names.to_numpy(np.int64).view(np.uint64)), total["docs"]


def patterns(owner: np.ndarray, place: np.ndarray, feature: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sentences with evidence of each text: features, the sentence of each, and how often each sentence occurs.

    Sentences of a text with the same features are one, so a text takes no more room than it has different ones.
    """
    sentence, place = np.unique(place, return_inverse=True)
    mixed = arrays.mix(feature.astype(np.uint64) + np.uint64(1))
    name = np.zeros(len(sentence), np.uint64)
    np.add.at(name, place, mixed)
    order = np.lexsort((name, owner[sentence]))
    new = np.ones(len(order), bool)
    new[1:] = (name[order[1:]] != name[order[:-1]]) | (owner[sentence[order[1:]]] != owner[sentence[order[:-1]]])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(order)))
    number = np.full(len(sentence), -1)
    number[order[first]] = np.arange(len(first))
    kept = number[place] >= 0
    by = np.argsort(number[place[kept]], kind="stable")
    feature, number = feature[kept][by], number[place[kept]][by]
    sentence_at = np.searchsorted(owner[sentence[order[first]]], np.arange(n + 1))
    feature_at = np.searchsorted(number, sentence_at)
    return [
        (feature[a:b], number[a:b] - i, times[i:j])
        for i, j, a, b in zip(sentence_at, sentence_at[1:], feature_at, feature_at[1:], strict=False)
    ]


Bag = tuple[np.ndarray, np.ndarray, np.ndarray]


def flat(bags: list[Bag]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of all sentences, the sentence of each, how often each sentence occurs, and its document."""
    counts = np.array([len(times) for _, _, times in bags], np.int64)
    none = [np.zeros(0, np.int64)]
    feature = np.concatenate([*none, *(f for f, _, _ in bags)]).astype(np.int64)
    place = np.concatenate([*none, *(s + b for (_, s, _), b in zip(bags, np.cumsum(counts) - counts, strict=True))]).astype(np.int64)
    times = np.concatenate([*none, *(t for _, _, t in bags)]).astype(np.float64)
    return feature, place, times, np.repeat(np.arange(len(bags)), counts)


def fit(label: np.ndarray, bags: list[Bag], size: int, total: float, bias: float) -> np.ndarray:
    """Weights of ``size`` words, by Adam on the log-likelihood of the labels, with a quadratic penalty.

    ``bags`` has what ``patterns`` finds in each document, ``total`` is the number of all
    documents with those that hold no word of the vocabulary. Weights are not negative.
    """
    feature, place, times, owner = flat(bags)
    n, m = len(label), len(times)
    w, mean, square = np.zeros((3, size))
    base = 1 / (1 + np.exp(-bias))
    for step in range(1, STEPS + 1):
        found = evidence(w, bias, feature, place, m)
        whole = 1 - (1 - LEAK) * np.exp(-np.bincount(owner, found * times, n))
        slope = np.where(label == 1, -(1 - whole) / whole, 1.0)[owner] * times
        # the logistic, from the logarithm of its complement
        p = 1 - (1 - base) * np.exp(-found)
        grad = np.bincount(feature, (slope * p)[place], size) / total + DECAY * w
        mean = 0.9 * mean + 0.1 * grad
        square = 0.99 * square + 0.01 * grad * grad
        w = np.maximum(w - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6), 0)
    return w


def tuned(label: np.ndarray, bags: list[Bag], sentences: np.ndarray, inner: np.ndarray, size: int, total: int) -> tuple[float, float]:
    """The bias and the evidence of chance, from the ``inner`` documents and weights fitted on the others.

    The bias is the one whose scores of the inner documents lose least.
    """
    pick = lambda mask: [b for b, x in zip(bags, mask, strict=True) if x]
    feature, place, times, owner = flat(pick(inner))
    told, count = label[inner], sentences[inner]
    best = (np.inf, BIASES[0], 0.0)
    for bias in BIASES:
        w = fit(label[~inner], pick(~inner), size, max(1.0, total * float((~inner).mean())), bias)
        found = evidence(w, bias, feature, place, len(times))
        clean = np.bincount(owner, found * times, len(told))[told == 0].sum()
        chance = MARGIN * clean / max(1, count[told == 0].sum())
        score = np.clip(noisy_or(found, owner, count, chance, times), 0.01, 0.99)
        loss = float(-np.where(told == 1, np.log(score), np.log1p(-score)).sum())
        best = min(best, (loss, bias, chance))
    return best[1], best[2]


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Weights:
    """Weights from at most ``rows`` labelled documents outside the held-out fold, each with its whole text.

    Which rows: the smallest hashes of ids, alike at every size. Labels other than 0 and 1
    and rows without an id are not learned from; of several labels the largest counts.
    The sample is bounded, so its ids are broadcast. Its words are counted where they are
    read; one task fits the weights on what is left of them, sentences with words of the vocabulary.
    Without labels no word has a weight.
    """
    wanted = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold_of(F.col("doc_id")) != 0))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(rows)
    )
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = texts.join(F.broadcast(wanted), "doc_id")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, borders in arrays.blocks(batch["text"]):
                b, n = Bags(data, borders), len(borders) - 1
                toxic = batch["toxic"].slice(row, n).to_numpy(zero_copy_only=False).astype(np.int64)
                owner = b.owner[b.place]
                order = np.lexsort((b.words, owner))
                word, owner = b.words[order], owner[order]
                new = np.ones(len(word), bool)
                new[1:] = (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])
                names, code = np.unique(word[new], return_inverse=True)
                docs, bad = np.bincount(code, minlength=len(names)), np.bincount(code, toxic[owner[new]], len(names)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [arrays.int64(names), pa.array(docs, pa.int64()), pa.array(bad, pa.int64())], names=["word", "docs", "toxic"]
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None], pa.int64()), pa.array([n], pa.int64()), pa.array([int(toxic.sum())], pa.int64())], names=["word", "docs", "toxic"]
                )

    known, total = vocabulary(sample.mapInArrow(counted, "word bigint, docs bigint, toxic bigint"))
    none = Weights(known[:0], np.zeros(0), BIASES[0])
    if not len(known):
        return none
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Weights(shared.value, np.zeros(len(shared.value)), 0.0)
        for batch in batches:
            for row, data, borders in arrays.blocks(batch["text"]):
                b, n = Bags(data, borders), len(borders) - 1
                at, feature = lookup.find(b.words)
                found = patterns(b.owner, b.place[at], feature, n)
                columns = [pa.array([x[i].astype(np.int64).tobytes() for x in found], pa.binary()) for i in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(row, n), batch["toxic"].slice(row, n), pa.array(np.bincount(b.owner, minlength=n), pa.int64()), *columns],
                    names=["id", "toxic", "sentences", "feature", "place", "times"],
                )

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "feature", "place", "times"], kind="stable")
        found = [tuple(np.frombuffer(x, np.int64) for x in r) for r in zip(rows["feature"], rows["place"], rows["times"], strict=True)]
        label, size = rows["toxic"].to_numpy(), len(shared.value)
        bias, chance = tuned(label, found, rows["sentences"].to_numpy(), rows["inner"].to_numpy(bool), size, total)
        return pd.DataFrame({"weights": [fit(label, found, size, total, bias).tobytes()], "bias": [bias], "chance": [chance]})

    bagged = sample.mapInArrow(bags, "id bigint, toxic int, sentences bigint, feature binary, place binary, times binary")
    bagged = bagged.withColumns({"one": F.lit(1), "inner": fold_of(F.col("id")) == INNER})
    got = bagged.groupBy("one").applyInPandas(fitted, "weights binary, bias double, chance double").first()
    return none if got is None else Weights(known, np.frombuffer(got["weights"]), got["bias"], got["chance"])


def score(docs: DataFrame, weights: Weights) -> DataFrame:
    """``doc_id``, ``score`` and ``sentences``: where (in bytes) those sentences are that score 0.5 or more by themselves.

    A row for each row of ``docs``. Null and empty texts have no sentence and score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    schema = "doc_id bigint, score double, sentences array<struct<from_byte bigint, to_byte bigint>>"
    span = pa.struct([("from_byte", pa.int64()), ("to_byte", pa.int64())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for row, data, borders in arrays.blocks(batch["text"]):
                b, n = Bags(data, borders), len(borders) - 1
                known, feature = w.find(b.words)
                found = evidence(w.values, w.bias, feature, b.place[known], len(b.begin))
                whole = noisy_or(found, b.owner, np.bincount(b.owner, minlength=n), w.chance)
                bad = np.flatnonzero(-np.expm1(-found) >= 0.5)
                at = np.searchsorted(b.owner[bad], np.arange(n + 1)).astype(np.int32)
                text_at = borders[:-1][b.owner[bad]]
                spans = pa.StructArray.from_arrays(
                    [pa.array(b.from_byte[bad] - text_at, pa.int64()), pa.array(b.to_byte[bad] - text_at, pa.int64())], fields=list(span)
                )
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(row, n), pa.array(np.clip(whole, 0, 1)), pa.ListArray.from_arrays(pa.array(at), spans)],
                    names=["doc_id", "score", "sentences"],
                )

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(scored, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``score`` of each row of ``docs`` with weights learned from ``labels`` outside the held-out fold."""
    held = fold_of(F.col("doc_id")) == 0
    return score(docs, learn(docs, labels)).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentences"
    )


def toxicity_stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows whose texts score 0.5 or more; all else stays as it is."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for row, data, borders in arrays.blocks(batch["text"]):
                b, n = Bags(data, borders), len(borders) - 1
                known, feature = w.find(b.words)
                found = evidence(w.values, w.bias, feature, b.place[known], len(b.begin))
                yield batch.slice(row, n).filter(pa.array(noisy_or(found, b.owner, np.bincount(b.owner, minlength=n), w.chance) < 0.5))

    return docs.mapInArrow(kept, docs.schema)
