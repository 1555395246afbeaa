"""Toxicity: held-out accuracy, and what may not matter."""

import random
import zlib

import numpy as np
import pytest

from codescan.llm import toxicity as tx
from codescan.llm.queries import op3_toxicity

WORDS = ["river", "stone", "cloud", "table", "garden", "window", "paper", "light", "green", "small", "house", "bread"]
BAD = ["zorgoth", "zorgify", "zorgish", "blarnak", "blarnok"]


@pytest.fixture(scope="module")
def corpus(spark):
    """Invented insults with two beginnings; a third of the labelled texts hold some."""
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(600):
        words = [rng.choice(WORDS) + rng.choice(["", "s", "ly", str(rng.randint(0, 30))]) for _ in range(rng.randint(20, 80))]
        toxic = i % 3 == 0
        for _ in range(rng.randint(1, 3) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "e", "ul", "ing"]))
        docs.append((i, " ".join(words), 0.1))
        labels.append((i, 1, int(toxic)))
    docs += [(600, None, 0.1), (601, "", 0.1), (None, "river stone", 0.1), (602, "x" * 200_000, 0.1), (5, docs[5][1], 0.1)]
    labels += [(3, 1, None), (None, 1, 1), (4, 1, 0), (900, 1, 1)]
    return docs, labels


def frames(spark, docs, labels):
    return (spark.createDataFrame(docs, "doc_id long, text string, other double"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_held_out_rows_are_told_apart_and_not_learnt_from(spark, corpus):
    docs, labels = corpus
    d, la = frames(spark, docs, labels)
    model = tx.fit(d, la)
    got = tx.score(d, model)
    assert got.columns == ["doc_id", "text", "other", "score"]
    scores = {}
    for r in got.collect():
        scores.setdefault(r.doc_id, []).append(r.score)
    assert len(scores[5]) == 2 and scores[5][0] == scores[5][1]  # repeated rows agree
    assert scores[600] == scores[601]  # null and empty texts
    assert all(0 <= s <= 1 for x in scores.values() for s in x)
    truth = {i: t for i, _, t in labels[:600]}
    own = [i for i in truth if is_held_out(i)]
    predicted = {i: scores[i][0] >= tx.THRESHOLD for i in own}
    assert np.mean([predicted[i] == bool(truth[i]) for i in own]) >= 0.95
    # Other labels of held-out rows change nothing.
    _, turned = frames(spark, docs, [(i, q, 1 - t if t is not None and is_held_out(i) else t) for i, q, t in labels])
    again = tx.fit(d, turned)
    assert np.array_equal(again.features, model.features) and np.allclose(again.feature_weights, model.feature_weights)
    kept = d.where("doc_id < 600 or doc_id is null")
    rows = tx.reject_toxic(kept, la)
    assert rows.columns == d.columns and 380 <= rows.count() <= 420


def test_without_labels_the_lists_vote(spark):
    d, la = frames(spark, [(1, "you idiot, you moron", 0.0), (2, "a quiet river", 0.0)], [])
    got = {r.doc_id: r.score for r in tx.score(d, tx.fit(d, la)).collect()}
    assert got[1] >= got[2]
    none, _ = frames(spark, [], [])
    assert tx.score(none, tx.fit(none, la)).collect() == []


def test_held_out_column(spark):
    df = spark.createDataFrame([(i,) for i in [*range(40), None]], "doc_id long")
    assert {r[0]: r[1] for r in df.select("doc_id", tx.held_out()).collect()} == {
        i: is_held_out(i) for i in [*range(40), None]}


def test_correlated_voters_count_for_less():
    rng = np.random.default_rng(1)
    y = rng.random(20_000) < 0.2
    hits = np.zeros((len(y), tx.VOTERS), dtype=bool)
    for j in range(3):  # three voters of their own, and two that repeat the first one's mistakes
        hits[:, j] = np.where(y, rng.random(len(y)) < 0.6, rng.random(len(y)) < 0.05)
    hits[:, 3] = hits[:, 4] = np.where(y, rng.random(len(y)) < 0.3, rng.random(len(y)) < 0.1)
    masks = (hits @ (1 << np.arange(tx.VOTERS))).astype(np.int64)
    import pyarrow as pa

    mask, n = np.unique(masks, return_counts=True)
    corpus = pa.table({"mask": mask, "n": n})
    seen = pa.table({"toxic": y[:500].astype(np.int32), "mask": masks[:500], "count": np.ones(500, dtype=np.int64)})
    model = tx.Model(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    tx._label_model(model, corpus, seen, int(y[:500].sum()), int((~y[:500]).sum()))
    # Single abstentions are not weighed, so the rate of the smaller class comes out somewhat low.
    assert np.allclose(model.hit_toxic[:3], 0.6, atol=0.15) and np.allclose(model.hit_clean[:3], 0.05, atol=0.04)
    assert model.correlation[3, 4] > 0.8 and (model.weight[3:5] < 0.6).all() and (model.weight[:3] > 0.8).all()


def test_query(spark):
    got = op3_toxicity(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == 200 and all(r.predicted == (r.score >= 0.3) and r.held_out == is_held_out(r.doc_id) for r in rows)
