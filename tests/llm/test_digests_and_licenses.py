"""Quartile digests and licence scans against plain versions."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from codescan.llm import digests, licenses
from codescan.llm.words import text_bytes


def plain_digest(text):
    """The same digest byte by byte."""
    data, counts = (text or "").encode(), [0] * 256
    for salt, places in enumerate(digests.TRIPLETS, 1):
        for i in range(len(data) - places[2]):
            a, b, c = (data[i + p] for p in places)
            code = ((a << 16 | b << 8 | c) + (salt << 24)) * 0x9E3779B1 % 2**32
            counts[code >> 24] += 1
    ranked = sorted(counts)
    q1, q2, q3 = ranked[63], ranked[127], ranked[191]
    length = min(int(np.floor(np.log1p(len(data)) / digests.LENGTH_STEP)), 255)
    return [length, q1 * 100 // max(q3, 1) % 16, q2 * 100 // max(q3, 1) % 16, *((c > q1) + (c > q2) + (c > q3) for c in counts)]


def test_digest_is_the_plain_one(texts):
    got = digests.digest_bytes(*text_bytes(pa.array(texts, pa.string())))
    assert got.tolist() == [plain_digest(t) for t in texts]
    assert all(len(x) == 2 * (2 + 64) for x in digests.encode(got))


@pytest.mark.parametrize("parts", [1, 4])
def test_edited_and_next(docs, rows, spark, parts):
    def key(row):
        text = spark.createDataFrame([(row[1],)], "t string").selectExpr("xxhash64(coalesce(t, ''))").first()[0]
        return (row[0] is not None, row[0] or 0, text)

    ordered = sorted(rows, key=key) if parts == 4 else None
    got = digests.edit_with_next(docs, parts=parts).collect()
    assert len(got) == len(rows)
    if ordered:
        expected = []
        for (doc_id, text), (_, after) in zip(ordered, [*ordered[1:], ordered[0]]):
            text, after = text or "", after or ""
            n = len(text) // 4
            expected.append((doc_id, len(text), hashlib.sha256((text[:len(text) - n] + after[:n]).encode()).hexdigest()))
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(expected, key=str)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    own = {(r.doc_id, r.n_chars): r.fingerprint for r in got}
    assert all(own[d, len(t or "")] == digests.encode(digests.digest_bytes(*text_bytes(pa.array([t], pa.string()))))[0]
               for d, t in rows if d is not None and d > 20)


def test_one_document_and_none(spark, empty):
    one = spark.createDataFrame([(4, "abcdefgh")], "doc_id long, text string")
    got = digests.edit_with_next(one).collect()
    assert [(r.doc_id, r.edited_sha256, r.near_next) for r in got] == [(4, hashlib.sha256(b"abcdefab").hexdigest(), 1.0)]
    assert digests.edit_with_next(empty).collect() == [] and digests.digests(empty).collect() == []


def test_likeness():
    a = digests.digest_bytes(*text_bytes(pa.array(["the quick brown fox " * 20, "", "the quick brown fox " * 19 + "jumped over", "0123456789" * 40])))
    assert digests.likeness(a, a).tolist() == [1.0] * 4
    near = digests.likeness(a[[0, 0, 0]], a[[2, 3, 1]])
    assert near[0] > near[1] and near[0] > near[2]


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_places(text):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    return len(words), sorted(places), sorted(labels)


LICENSED = [
    "Licensed under CC BY-NC 4.0.\ncc by\n CC, by! cc by cc by", "the GNU General\nPublic   License, version 3",
    "All rights\nreserved all rights reservedly", "SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND Apache-2.0\nrest and gpl",
    "// spdx-license-identifier: GPL-2.0-or-later WITH Classpath-exception-2.0", "SPDX-License-Identifier:", "ccby ccc by", None, "",
    "É cc by É", "cc by " * 3000]


def test_phrases_and_labels(spark, docs, rows):
    more = [(1000 + i, t) for i, t in enumerate(LICENSED)]
    both = docs.select("doc_id", "text", "score", "batch").unionByName(spark.createDataFrame(more, "doc_id long, text string"), True)
    got = sorted(((r.doc_id, (r.n_words, r.places, r.base_labels)) for r in licenses.scan(both).collect()), key=str)
    assert got == sorted(((d, plain_places(t)) for d, t in [*rows, *more]), key=str)
    own = {r.doc_id: r for r in licenses.scan(both).where("doc_id >= 1000").collect()}
    assert own[1000].labels == ["cc-by", "cc-by-nc"] and own[1000].score == 0.2
    assert own[1001].labels == ["gpl", "gpl-3.0"] and own[1002].score == 0.0 and own[1002].labels == ["reserved"]
    assert own[1003].labels == ["apache-2.0", "gpl-3.0-only", "mit"] and own[1003].score == 0.9
    assert own[1004].labels == ["gpl-2.0-or-later"] and own[1004].score == pytest.approx(0.6)
    assert own[1005].labels == [] and own[1005].score == 0.0 and own[1010].places[-1] == 5998


@pytest.mark.parametrize("text,expected", [
    ("mit", (["mit"], 0.95)), ("mit or gpl-3.0", (["mit", "gpl-3.0"], 0.95)), ("mit and gpl-3.0", (["mit", "gpl-3.0"], 0.4)),
    ("gpl-3.0 or mit and agpl-3.0", (["gpl-3.0", "mit", "agpl-3.0"], 0.4)),
    ("(gpl-3.0 or mit) and agpl-3.0", (["gpl-3.0", "mit", "agpl-3.0"], 0.3)),
    ("gpl-2.0 with some-exception or agpl-3.0", (["gpl-2.0", "agpl-3.0"], 0.6000000000000001)), ("((mit))", (["mit"], 0.95)),
    ("mit or", (["mit"], 0.95)), ("(mit", (["mit"], 0.95)), ("mit) or x", (["mit"], 0.95)), ("mit mit", (["mit"], 0.95)),
    ("", None), ("or mit", None), (")", None), ("strange-1.0", (["strange-1.0"], 0.5)), ("mit\nand gpl-3.0", (["mit"], 0.95)),
])
def test_expressions(text, expected):
    assert licenses.evaluate(text) == expected
