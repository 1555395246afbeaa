"""Word arrays against regular expressions."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from codescan.llm import words as w

from .conftest import prose

ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TEXTS = ["", None, " a", "b", "c ", "é\x0bß  x\n", "A1-b_c", *(prose(random.Random(i), 40) for i in range(5))]


@pytest.mark.parametrize("part", [TEXTS, TEXTS[3:], TEXTS[:2], []])
def test_words_are_those_of_the_pattern(part):
    for table, pattern, lower in ((w.NOT_BLANK, rb"[^\x20\x09-\x0D]+", False), (w.ALNUM, None, True)):
        got = w.Words(pa.array(["skipped", *part], pa.string()).slice(1), table, lower)
        for i, text in enumerate(part):
            own = [got.data[a:b].tobytes() for a, b in list(zip(got.start, got.end))[got.first[i]:got.first[i + 1]]]
            if pattern:
                assert own == re.findall(pattern, (text or "").encode())
            else:
                plain = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
                assert own == [x.encode() for x in re.findall(ALNUM, plain)]


def test_hashes_agree_exactly_where_words_do():
    got = w.Words(pa.array(TEXTS, pa.string()))
    spans, code = w.Spans(got.hashes()), got.hashes()
    words = [got.data[a:b].tobytes() for a, b in zip(got.start, got.end)]
    for n in (1, 2, 5):
        start = np.arange(len(words) - n + 1)
        by_hash = {}
        for s, h in zip(start, spans(start, start + n)):
            by_hash.setdefault(int(h), set()).add(tuple(words[s:s + n]))
        assert all(len(x) == 1 for x in by_hash.values())
        assert len(by_hash) == len({tuple(words[s:s + n]) for s in start})
    assert len(code) == len(words)


def test_joined_words():
    got = w.Words(pa.array(["a  b\nc", "", "d"]))
    data, start, end = got.joined()
    assert data.tobytes() == b"a b c d " and [data[a:b].tobytes() for a, b in zip(start, end)] == [b"a", b"b", b"c", b"d"]
    assert got.joined(np.array([True, False, True, True]))[0].tobytes() == b"a c d "


def test_sliding_minimum_takes_the_first_of_equal_ones():
    values = np.array([5, 3, 3, 9, 1, 7, 7, 7], dtype=np.uint64) << np.uint64(32)
    for size in (1, 2, 3, 5, 8):
        assert w.sliding_min_at(values, size).tolist() == [
            i + int(np.argmin(values[i:i + size])) for i in range(len(values) - size + 1)]


def test_blocks_hold_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["x" * 9, None, "", "y" * 30, "z", "z"])], ["i", "text"])
    parts = list(w.blocks(iter([batch]), limit=10))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(6)) and len(parts) > 2
