"""Licence scans: an Aho-Corasick automaton finds notice phrases and identifier tags, a shunting-yard
parser evaluates licence expressions.

Notice phrases are matched on words, so line breaks and punctuation do not matter; identifier
tags (``SPDX-License-Identifier: MIT OR Apache-2.0``) are read with their punctuation, to the end
of the line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codescan.llm.words import ALNUM, LOWER, Words, blocks, text_bytes

# Phrase (words as they are scanned) and the label it gives.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICE_PHRASES = {
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "apache license": "apache-2.0",
    "licensed under the apache license version 2 0": "apache-2.0",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "affero general public license": "agpl",
    "eclipse public license": "epl",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0",
    "creative commons zero": "cc0",
    "creative commons attribution": "cc-by",
    "public domain": "public-domain",
    "unlicense": "unlicense",
    "proprietary and confidential": "proprietary",
}
TAG = "spdx-license-identifier:"

# How freely a text under a label may be used, 0 to 1.  A label not listed counts 0.5.
PERMISSION = {
    "public-domain": 1.0, "cc0": 1.0, "cc0-1.0": 1.0, "unlicense": 1.0, "0bsd": 1.0, "mit": 0.95, "isc": 0.95,
    "bsd": 0.95, "bsd-2-clause": 0.95, "bsd-3-clause": 0.95, "apache-2.0": 0.9, "cc-by": 0.9, "cc-by-4.0": 0.9,
    "mpl": 0.7, "mpl-2.0": 0.7, "epl": 0.6, "epl-2.0": 0.6, "lgpl": 0.6, "cc-by-sa": 0.6, "gpl": 0.4, "gpl-2.0": 0.4,
    "gpl-3.0": 0.4, "agpl": 0.3, "cc-by-nc": 0.2, "cc-by-nd": 0.2, "proprietary": 0.0, "reserved": 0.0,
}
EXCEPTION_BONUS = 0.2  # a "with" exception opens a licence a little
UNKNOWN = 0.5
_TOKEN = re.compile(r"[ \t]*(\(|\)|[a-z0-9.+\-]+)")
_STRENGTH = {"or": 1, "and": 2, "with": 3}


def permission(label: str) -> float:
    for name in (label, label.rstrip("+"), re.sub(r"-(only|or-later)$", "", label), re.sub(r"-[0-9.]+(-only|-or-later|\+)?$", "", label)):
        if name in PERMISSION:
            return PERMISSION[name]
    return UNKNOWN


def _tokens(text: str, at: int) -> Iterator[str]:
    while token := _TOKEN.match(text, at):
        yield token[1]
        at = token.end()


def evaluate(text: str, at: int = 0) -> tuple[list[str], float] | None:
    """(licences, permission) of the expression at a place of a lower-case text; None if there is none.

    ``or`` leaves the choice, so the freer side counts; ``and`` binds to both; ``with`` adds an
    exception to a licence.  What follows the expression is ignored; it ends with the line at most.
    """
    values, waiting, licences = [], [], []

    def apply() -> bool:
        word = waiting.pop()
        if word == "(" or len(values) < 2:
            return False
        right, left = values.pop(), values.pop()
        values.append({"or": max(left, right), "and": min(left, right), "with": min(1.0, left + EXCEPTION_BONUS)}[word])
        return True

    operand = True  # the next token is to be a licence or an open bracket
    for token in _tokens(text, at):
        if operand and token == "(":
            waiting.append(token)
        elif operand and token not in _STRENGTH and token != ")":
            if waiting and waiting[-1] == "with":
                values.append(0.0)
            else:
                licences.append(token)
                values.append(permission(token))
            operand = False
        elif not operand and token in _STRENGTH:
            while waiting and waiting[-1] != "(" and _STRENGTH[waiting[-1]] >= _STRENGTH[token]:
                if not apply():
                    return None
            waiting.append(token)
            operand = True
        elif not operand and token == ")" and "(" in waiting:
            while waiting[-1] != "(":
                if not apply():
                    return None
            waiting.pop()
        else:
            break
    if operand and waiting and waiting[-1] in _STRENGTH:
        waiting.pop()  # an operator that nothing follows
    while waiting:
        if waiting[-1] == "(":
            waiting.pop()
        elif not apply():
            return None
    return (licences, values[-1]) if values else None


class Scanner:
    """The automata of one task: phrases over joined words, and the tag over the text itself."""

    def __init__(self, base: dict[str, str], notices: dict[str, str]):
        self.phrases, self.tags = ahocorasick.Automaton(), ahocorasick.Automaton()
        found: dict[str, tuple] = {}
        for i, phrases in enumerate((base, notices)):
            for phrase, label in phrases.items():
                mine = found.setdefault(f" {phrase} ".encode().decode("latin-1"), (len(phrase.encode()), [None, None]))
                mine[1][i] = label
        for text, value in found.items():
            self.phrases.add_word(text, value)
        self.phrases.make_automaton()
        self.tags.add_word(TAG, len(TAG))
        self.tags.make_automaton()

    def __call__(self, texts: pa.Array) -> Iterator[tuple[int, list[int], set[str], set[str], list[float]]]:
        """(words, starts of base places, base labels, the method's labels, permissions) of each text."""
        words = Words(texts, ALNUM, lower=True)
        data, begin, hole = words.joined()
        joined = data.tobytes().decode("latin-1")  # a character is a byte, so places are bytes
        raw, offsets = text_bytes(texts)
        raw = LOWER[raw].tobytes().decode("latin-1")
        for i in range(words.n_docs):
            first, last = int(words.first[i]), int(words.first[i + 1])
            places, base, more, values = [], set(), set(), []
            if last > first:
                lo, hi = int(begin[first]), int(hole[last - 1])
                ends = []
                for end, (size, labels) in self.phrases.iter(" " + joined[lo:hi] + " "):
                    if labels[0]:
                        ends.append(end - size)  # where the phrase begins in the text
                        base.add(labels[0])
                    if labels[1]:
                        more.add(labels[1])
                places = np.searchsorted(begin[first:last], lo + np.array(ends, dtype=np.int64) - 1).tolist()
            text = raw[offsets[i]:offsets[i + 1]]
            for end, _ in self.tags.iter(text):
                result = evaluate(text, end + 1)
                if result:
                    more.update(result[0])
                    values.append(result[1])
            yield last - first, places, base, more, values


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None,
         notices: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, n_words, places, base_labels, labels, score) for each row.

    ``places`` are the word numbers where base phrases begin, ``labels`` the base labels and those
    of notices and identifier tags.  ``score`` says how freely the text may be used: all that is
    found binds, so the least permission counts.  A tag counts by its expression and stands for
    the notices beside it.  No licence, a null or an empty text: 0.
    """
    base, notices = BASE_PHRASES if base is None else base, NOTICE_PHRASES if notices is None else notices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, notices)
        for block in blocks(batches):
            n_words, places, own, all_labels, score = [], [], [], [], []
            for n, at, first, more, values in scanner(block.column(1)):
                tagged = [permission(x) for x in first | more] if not values else [
                    *values, *(permission(x) for x in first)]
                n_words.append(n)
                places.append(sorted(at))
                own.append(sorted(first))
                all_labels.append(sorted(first | more))
                score.append(min(tagged) if tagged else 0.0)
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array(n_words, pa.int64()), pa.array(places, pa.list_(pa.int64())),
                 pa.array(own, strings), pa.array(all_labels, strings), pa.array(score, pa.float64())],
                ["doc_id", "n_words", "places", "base_labels", "labels", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, places array<long>, base_labels array<string>, "
                                "labels array<string>, score double")
