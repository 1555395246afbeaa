"""The pipeline against its parts and a plain version."""

import random

import corpus_pipeline as cp
import pytest

from codescan.llm import decontaminate, line_templates, simhash, toxicity
from tests.llm.test_decontaminate import plain as plain_hits
from tests.llm.test_simhash import plain as plain_groups


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with toxic texts, a line that recurs, copies and a benchmark passage."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(15))
    line = "this very line is on all the pages"
    docs, labels = [], []
    for i in range(160):
        body = [rng.choice(words) for _ in range(60)]
        if i % 4 == 0:
            body.insert(rng.randrange(60), rng.choice(["idiot", "moron", "scum"]))
        text = " ".join(body)
        if i % 16 == 3:
            text += " " + passage
        if i % 2:
            text = line + "\n" + text
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, 1, int(i % 4 == 0)))
    docs += [(200 + i, docs[2][1].upper() if i else docs[2][1], "en", "s", 1) for i in range(3)]
    docs += [(300, None, None, None, None), (301, "", "en", "s", 0)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, line, passage


def test_every_stage(spark, folder):
    path, rows, line, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [name for name, _ in cp.STAGES] == ["toxicity", "lines", "near copies", "benchmark", "packing"]
    clean = toxicity.cut_lineage(cp.drop_toxic(spark, docs, path))
    assert clean.columns == docs.columns
    left = {r.doc_id: r.text for r in clean.collect()}
    assert sum(i % 4 == 0 for i in left if i < 160) <= 4 and sum(i % 4 > 0 for i in left if i < 160) >= 116
    unlined = line_templates.cut_lineage(cp.drop_lines(spark, clean, path))
    assert unlined.columns == docs.columns
    lined = {r.doc_id: r.text for r in unlined.collect()}
    first = min(i for i, t in left.items() if t and line in t)
    assert lined == {i: t if t is None or i == first else t.removeprefix(line + "\n") for i, t in left.items() if i < 200 or i >= 300} | {
        i: lined[i] for i in range(200, 203)}
    unique = simhash.cut_lineage(cp.drop_near_copies(spark, unlined, path))
    assert unique.columns == docs.columns
    kept = {r.doc_id: r.text for r in unique.collect()}
    assert set(kept) == {c for _, _, c in plain_groups(list(lined.items()))}
    assert not set(kept) & {200, 201, 202}
    tested = decontaminate.scan(unique, spark.read.parquet(f"{path}/benchmark.parquet"))
    assert tested.count() == len(kept)
    final = cp.drop_benchmark(spark, unique, path)
    assert final.columns == docs.columns
    hits = {d for d, _, n, _ in plain_hits(list(kept.items()), [("1", passage)], 10) if n}
    names = {r.doc_id for r in final.collect()}
    assert names == set(kept) - hits and hits
    packed = cp.run(spark, path).collect()
    assert {r.doc_id for r in packed} == names
    assert sum(r.n_tokens for r in packed) == sum(len((kept[i] or "").split()) for i in names)


def test_empty(spark, tmp_path):
    schemas = {"documents": "doc_id long, text string, lang string, source string, n_chars long",
               "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []
