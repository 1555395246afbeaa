"""Length buckets, batches and importance resampling."""

import itertools
import random

import numpy as np
import pytest

from codescan.llm import packing, quality
from codescan.llm.queries import op4_packing


def padding(lengths, counts, chosen):
    return sum(c * (min(b for b in chosen if b >= n) - n) for n, c in zip(lengths, counts))


@pytest.mark.parametrize("seed", range(6))
def test_buckets_are_the_best(seed):
    rng = random.Random(seed)
    lengths = sorted(rng.sample(range(60), 9))
    counts = [rng.randint(1, 20) for _ in lengths]
    for k in (1, 2, 4, 20):
        chosen = packing.bucket_lengths(np.array(lengths), np.array(counts), k)
        best = min(padding(lengths, counts, [*c, lengths[-1]]) for n in range(min(k, 9)) for c in itertools.combinations(lengths[:-1], n))
        assert len(chosen) <= k and chosen[-1] == lengths[-1] and padding(lengths, counts, chosen) == best
    assert packing.bucket_lengths(np.array([]), np.array([]), 3) == []


def check_batches(got, budget):
    slots = {}
    for r in got:
        assert r.n_tokens <= r.bucket_len
        slots.setdefault((r.bucket, r.batch), []).append(r.slot)
        each = max(1, budget // max(1, r.bucket_len))
        assert r.slot < each
    for (bucket, batch), s in slots.items():
        assert sorted(s) == list(range(len(s)))
        if (bucket, batch + 1) in slots:  # only the last batch of a bucket may have room
            assert len(s) == max(1, budget // max(1, next(r.bucket_len for r in got if r.bucket == bucket)))


def test_pack(docs, rows):
    got = packing.pack(docs, max_len=100, buckets=4, budget=300, shard_rows=7).collect()
    check_batches(got, 300)
    whole = {}
    for r in got:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.n_tokens
    expected = {}
    for doc_id, text in rows:
        expected[doc_id] = expected.get(doc_id, 0) + len((text or "").split())
    assert whole == expected
    assert len({r.bucket_len for r in got}) <= 4
    assert all(r.first_token == 100 * r.piece for r in got)


def test_query(spark):
    got = op4_packing(spark, "/root/testdata/sf0.001").collect()
    check_batches(got, packing.BUDGET)
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert sum(r.n_tokens for r in got) == sum(len(t.text.split()) for t in texts)


def test_empty(empty, spark):
    assert packing.pack(empty).collect() == []
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.resample(empty, labels).collect() == []


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(8)
    good, junk = [f"g{i}" for i in range(200)], [f"j{i}#" for i in range(200)]
    rows = [(i, " ".join(rng.choice(junk if i % 4 == 0 else good) for _ in range(rng.randint(5, 60))), 1.5) for i in range(400)]
    rows += [(400, None, 1.5), (401, "", 1.5), (None, "g1 g2", 1.5), (7, rows[7][1], 1.5)]
    labels = [(i, int(i % 4 > 0)) for i in range(0, 400, 2)] + [(None, 1), (1000, 1), (8, None)]
    return (spark.createDataFrame(rows, "doc_id long, text string, log_weight double"),
            spark.createDataFrame(labels, "doc_id long, quality int"), rows)


def test_sample_prefers_the_target(mixed):
    docs, labels, rows = mixed
    got = quality.resample(docs, labels, fraction=0.5, buckets=256).collect()  # few texts, so few buckets
    assert len(got) == len(rows)
    kept = [r for r in got if r.kept]
    assert len(rows) // 2 <= len(kept) <= len(rows) // 2 + 1  # a repeated row may tie
    # A plain sample would hold some 50 of the 100 junk texts.
    assert sum(r.doc_id is not None and r.doc_id % 4 == 0 and r.doc_id < 400 for r in kept) <= 10
    assert {r.log_weight for r in got if r.doc_id in (400, 401)} == {0.0}
    assert min(r.gumbel_key for r in kept) >= max(r.gumbel_key for r in got if not r.kept)


@pytest.mark.parametrize("ids", [quality.BLOCK_IDS, 40])
def test_weights_are_those_of_the_counts(mixed, monkeypatch, ids):
    """Against plain counting of the same buckets, with the target's ids in one block or in several."""
    monkeypatch.setattr(quality, "BLOCK_IDS", ids)
    docs, labels, rows = mixed
    wanted = {r.doc_id for r in labels.where("quality = 1").collect()} - {None}
    import pyarrow as pa

    from codescan.llm.words import Words
    target, raw, mine = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS), []
    for doc_id, text, _ in rows:
        _, code = quality._features(Words(pa.array([text], pa.string())), quality.BUCKETS)
        mine.append(code)
        np.add.at(raw, code, 1)
        if doc_id in wanted:
            np.add.at(target, code, 1)
    ratio = quality.log_ratio(target, raw)
    got = sorted(r.log_weight for r in quality.resample(docs, labels).collect())
    assert np.allclose(got, sorted(ratio[c].sum() for c in mine))


def test_gumbel_keys_sample_by_weight(spark):
    """Of rows with weights 1 and e**2 the heavier ones win as often as they should."""
    docs = spark.createDataFrame([(i, "h" if i % 2 else "l") for i in range(4000)], "doc_id long, text string")
    ratio = np.zeros(quality.BUCKETS)
    import pyarrow as pa

    from codescan.llm.words import Words
    _, code = quality._features(Words(pa.array(["h"])), quality.BUCKETS)
    ratio[code] = 2.0
    rows = quality.log_weights(docs, ratio).collect()
    key = {r.doc_id: r.gumbel_key for r in rows}
    won = np.mean([key[i + 1] > key[i] for i in range(0, 4000, 2)])
    assert abs(won - np.exp(2) / (1 + np.exp(2))) < 0.03


@pytest.mark.parametrize("k", [1, 3, 500, 999, 1000])
def test_kth_largest(spark, k):
    values = [float(x) for x in [5, 5, 5, *range(-300, 690), 1e9, -1e9, 0.5, 5, 5, 5, 5]]
    df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(2)
    assert quality.kth_largest(df, "v", k, few=20, bins=7) == sorted(values)[-k]
