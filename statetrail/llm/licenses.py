"""Licence scans: identifier tags and notice phrases found together in one pass.

An Aho-Corasick automaton of phrases runs over the words of a text, joined by single
spaces. Where it meets an identifier tag, the licence expression behind the tag is read
from the text up to the end of its line, brought into postfix order by the shunting-yard method and evaluated.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: phrase and label.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Further notice phrases of this method, with their labels.
MORE = {
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl-3",
    "mozilla public license": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "creative commons attribution": "cc-by",
    "all rights reserved": "all-rights-reserved",
}
#: Words that begin an identifier tag.
TAG = "spdx license identifier"
#: How freely a text under a licence may be used, 1 at most; unknown licences count 0.5.
FREEDOM = {
    "mit": 1.0, "apache-2": 1.0, "bsd": 1.0, "cc-by": 0.9, "mpl-2": 0.7, "lgpl": 0.6,
    "gpl-2": 0.4, "gpl-3": 0.4, "agpl-3": 0.3, "cc-by-nc": 0.1, "all-rights-reserved": 0.0,
}
#: Short names of identifiers in tags, tried as prefixes of the lower-cased identifier.
SHORT = ("apache-2", "mit", "bsd", "gpl-2", "gpl-3", "lgpl", "agpl-3", "mpl-2", "cc-by-nc", "cc-by")

LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)
TOKEN = re.compile(r"\(|\)|[a-z0-9][a-z0-9.+-]*")
#: Binding strength of the operators of expressions.
STRENGTH = {"or": 1, "and": 2, "with": 3}


def beginning(tokens: Iterable[str]) -> tuple[list[str], int]:
    """The tokens up to the first that no expression can have there, and how many of
    them, from the first on, the longest whole expression has."""
    read: list[str] = []
    whole = depth = 0
    operand = False
    for t in tokens:
        closes = t == ")" or t in STRENGTH
        if closes != operand or (t == ")" and not depth):
            break
        depth += (t == "(") - (t == ")")
        operand = t != "(" and t not in STRENGTH
        read.append(t)
        if operand and not depth:
            whole = len(read)
    return read, whole


def _ordered(tokens: list[str]) -> list[str]:
    """A whole expression in postfix order, by the shunting-yard method."""
    out: list[str] = []
    held: list[str] = []
    for t in tokens:
        if t in STRENGTH:
            while held and held[-1] != "(" and STRENGTH[held[-1]] >= STRENGTH[t]:
                out.append(held.pop())
            held.append(t)
        elif t == "(":
            held.append(t)
        elif t == ")":
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        else:
            out.append(t)
    return out + held[::-1]


def postfix(tokens: Iterable[str]) -> list[str] | None:
    """The expression in postfix order; None when it is not one."""
    tokens = list(tokens)
    whole = beginning(tokens)[1]
    return _ordered(tokens) if whole and whole == len(tokens) else None


def label_of(identifier: str) -> str:
    return next((s for s in SHORT if identifier.startswith(s)), identifier)


def evaluate(expression: str) -> tuple[set[str], float]:
    """Licences of an expression and its freedom: "or" takes the freer side, "and" the
    stricter, "with" the licence it adds an exception to. Of text that is no whole
    expression, the longest beginning that is one counts; without any, nothing and 0."""
    tokens, whole = beginning(m[0] for m in TOKEN.finditer(expression))
    stack: list[tuple[set[str], float]] = []
    for t in _ordered(tokens[:whole]):
        if t in STRENGTH:
            b, a = stack.pop(), stack.pop()
            value = a[1] if t == "with" else (max if t == "or" else min)(a[1], b[1])
            if t != "with":
                small, large = sorted((a[0], b[0]), key=len)
                large |= small
                a = large, value
            stack.append((a[0], value))
        else:
            stack.append(({label_of(t)}, FREEDOM.get(label_of(t), 0.5)))
    return stack[0] if stack else (set(), 0.0)


def expressions(raw: bytes, tags: list[int]) -> Iterator[str]:
    """What stands behind each identifier tag of a text, lower-cased, up to the end of the line or the next tag.

    ``tags`` has the number of the last word of each tag, in order.
    """
    letter = np.frombuffer(raw.translate(WORDS), np.uint8) != 0x20
    edge = np.diff(letter.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = len(TAG.split()) - 1
    stops = [*(int(begin[t - first]) for t in tags[1:]), len(raw)]
    for tag, stop in zip(tags, stops, strict=True):
        start = int(end[tag])
        line = raw.find(b"\n", start, stop)
        yield raw[start : stop if line < 0 else line].translate(LOWER).decode("utf-8", "replace")


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase, label in {**BASE, **MORE, TAG: None}.items():
        key = f" {phrase} "
        found.add_word(key, (len(phrase.split()), label, phrase in BASE))
    found.make_automaton()
    return found


def _scan(raw: bytes, found) -> tuple:
    joined = b" ".join(raw.translate(WORDS).split())
    if not joined:
        return 0, 0, None, None, "", "", 0.0
    text = f" {joined.decode('latin-1')} "
    base, labels, places, scores, tags = set(), set(), [], [], []
    read = words = 0
    for end, (length, label, is_base) in found.iter(text):
        # hits come by their ends: the words up to one are those up to the last and those between
        words += text.count(" ", read, end)
        read = end
        if label is None:
            tags.append(words - 1)
            continue
        labels.add(label)
        scores.append(FREEDOM[label])
        if is_base:
            base.add(label)
            places.append(words - length)
    for expression in expressions(raw, tags) if tags else ():
        names, freedom = evaluate(expression)
        labels |= names
        scores += [freedom] * bool(names)
    ends = (min(places), max(places)) if places else (None, None)
    return text.count(" ") - 1, len(places), *ends, ",".join(sorted(base)), ",".join(sorted(labels)), min(scores, default=0.0)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licences named in each text, a row for each row of ``docs``.

    ``n_base`` counts the places of base phrases, ``first_word`` and ``last_word`` are the
    smallest and largest start of one; ``base_labels`` and ``labels`` (with those of this
    method) are distinct, sorted and joined by commas. ``score`` is the freedom that the
    strictest licence found leaves, 0 if none is found. A null id stays null, a null text
    is empty: no words, no labels. Repeated rows give repeated results. Time and memory are
    in proportion to a text, however many phrases and tags it holds.
    """
    schema = (
        "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
        "base_labels string, labels string, score double"
    )
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _automaton()
        for batch in batches:
            rows = [_scan(x.as_buffer().to_pybytes() if x.is_valid else b"", found) for x in batch["text"]]
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *arrays], names=[c.split()[0] for c in schema.split(", ")])

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(scanned, schema)
