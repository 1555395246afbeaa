"""Documents written by many tasks are one file, whole and in order."""

import functools
import gzip
import json
import pathlib
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codescan.operators import findings as fd
from codescan.session import shared_dir
from codescan.sources import documents, reports


def leftovers(folder):
    return [p.name for p in folder.iterdir() if ".parts-" in p.name]


def test_many_tasks_one_file(spark, tmp_path):
    path = tmp_path / "out.json"
    rows = spark.range(5000).repartition(7).orderBy(F.desc("id")).select(F.to_json(F.struct("id")))
    documents.write_document(rows, str(path), '{"rows":[\n', ",\n", "\n]}\n")
    assert [r["id"] for r in json.loads(path.read_text())["rows"]] == list(range(4999, -1, -1))
    assert not leftovers(tmp_path)


@pytest.mark.parametrize("join_bytes", [0, 1 << 30])
def test_replaced_and_beyond_the_bound(spark, tmp_path, join_bytes):
    path = tmp_path / "out"
    for n in (300, 40):
        documents.write_document(spark.range(n).repartition(3).orderBy("id").select(F.col("id").cast("string")), f"file://{path}",
                                 "[", ",", "]", join_bytes=join_bytes)
    text = path.read_text() if path.is_file() else "".join(p.read_text() for p in sorted(path.iterdir()))
    assert path.is_dir() == (join_bytes == 0) and json.loads(text) == list(range(40))
    assert not leftovers(tmp_path)


def test_no_rows_nulls_and_empty_texts(spark, tmp_path):
    path = tmp_path / "out"
    documents.write_document(spark.createDataFrame([], "value string"), str(path), "[", ",", "]")
    assert path.read_text() == "[]"
    documents.write_document(spark.createDataFrame([(None,), ("",), ("ä",), (None,)], "value string").coalesce(1), str(path), "[", ",", "]")
    assert path.read_text() == "[,ä]"


def test_failed_job_keeps_the_older_document(spark, tmp_path):
    path = tmp_path / "out"
    path.write_text("old")
    bad = spark.range(100).repartition(4).select(F.when(F.col("id") == 57, F.raise_error(F.lit("stop"))).otherwise(F.lit("x")).alias("v"))
    with pytest.raises(Exception, match="stop"):
        documents.write_document(bad, str(path))
    assert path.read_text() == "old" and not leftovers(tmp_path)


def test_late_task_leaves_nothing(tmp_path, monkeypatch):
    """A task that gets to its first row after the job was given up finds no folder and makes none."""
    task = SimpleNamespace(partitionId=lambda: 0, taskAttemptId=lambda: 1)
    monkeypatch.setattr(documents, "TaskContext", SimpleNamespace(get=lambda: task))
    writer = documents.DocumentSource({"path": str(tmp_path / "out")}).writer(None, True)
    writer.abort([])
    with pytest.raises(FileNotFoundError):
        writer.write(iter([pa.RecordBatch.from_pydict({"value": ["x"]})]))
    assert not leftovers(tmp_path)


@pytest.fixture
def findings(spark):
    rows = [(f"f{i % 3}.py", i, "HIGH" if i % 2 else "LOW", f"R{i % 4}", "go" if i % 5 else "python", 'say "x"\n', f"c{i % 7}", "LOW", "CWE-89", None, "")
            for i in range(60)]
    return spark.createDataFrame(rows, "file string, line int, severity string, rule_id string, language string, message string, "
                                 "code_snippet string, confidence string, cwe string, owasp string, ai_explanation string").repartition(5)


def test_report_sarif_and_baseline(spark, findings, tmp_path):
    reports.write_report_document(findings, str(tmp_path / "r.json"), fd.count_suppressed(findings, fd.fingerprints(findings)))
    doc = json.loads((tmp_path / "r.json").read_text())
    assert (doc["total"], doc["high"], doc["suppressed"], doc["by_language"]) == (60, 30, 60, {"go": 48, "python": 12})
    assert [(f["file"], f["line"]) for f in doc["findings"]] == sorted((f"f{i % 3}.py", i) for i in range(60))
    assert doc["findings"][0]["message"] == 'say "x"\n' and doc["findings"][0]["owasp"] is None
    reports.write_sarif_document(findings, str(tmp_path / "r.sarif"))
    run = json.loads((tmp_path / "r.sarif").read_text())["runs"][0]
    assert len(run["results"]) == 60 and [r["id"] for r in run["tool"]["driver"]["rules"]] == ["R0", "R1", "R2", "R3"]
    reports.write_baseline_document(findings, str(tmp_path / "b.json"))
    base = json.loads((tmp_path / "b.json").read_text())
    want = {r[0] for r in fd.fingerprints(findings).collect()}
    assert base["version"] == 1 and base["count"] == len(want) and base["fingerprints"] == sorted(want)
    assert {r[0] for r in reports.read_baseline(spark, str(tmp_path / "b.json")).collect()} == want


def test_benchmark(spark, tmp_path):
    tools = spark.createDataFrame([("b", 14, 5, 6, 9), ("a", 16, 2, 4, 12)], "tool string, TP int, FP int, FN int, TN int")
    truth = spark.createDataFrame([(i < 20,) for i in range(34)], "vulnerable boolean")
    times = spark.createDataFrame([("a", 0.21)], "tool string, scan_time_s double")
    reports.write_benchmark_documents(tools, truth, str(tmp_path / "out"), times)
    doc = json.loads((tmp_path / "out.json").read_text())
    assert doc["corpus"] == {"total": 34, "vulnerable": 20, "safe": 14} and list(doc["tools"]) == ["a", "b"]
    assert doc["tools"]["a"]["metrics"]["f1"] == 0.8421 and doc["tools"]["a"]["scan_time_s"] == 0.21 and doc["tools"]["b"]["scan_time_s"] is None
    lines = (tmp_path / "out.csv").read_text().splitlines()
    assert lines == ["tool,TP,FP,FN,TN,precision,recall,f1,fpr,scan_time_s", "a,16,2,4,12,0.8889,0.8,0.8421,0.1429,0.21",
                     "b,14,5,6,9,0.7368,0.7,0.7179,0.3571,"]


@pytest.mark.parametrize("join_bytes", [0, 1 << 30])
def test_large_reports_take_little_disk(spark, findings, tmp_path, monkeypatch, join_bytes):
    """Parts that stay are compressed, those that are joined become plain text; copies of the rows and their shuffles go."""
    monkeypatch.setattr(reports, "write_document", functools.partial(documents.write_document, join_bytes=join_bytes))
    shared = pathlib.Path(shared_dir(spark).removeprefix("file:"))
    before = set(shared.iterdir())
    many = findings.crossJoin(spark.range(200).select(F.col("id").alias("n"))).withColumn("line", F.expr("line + 60 * int(n)")).drop("n")
    reports.write_report_document(many, str(tmp_path / "r"))
    reports.write_sarif_document(many, str(tmp_path / "s"))
    reports.write_baseline_document(many, str(tmp_path / "b"))
    assert set(shared.iterdir()) == before

    def text(name):
        path = tmp_path / name
        if path.is_file():
            return path.read_text()
        parts = sorted(path.iterdir())
        found = "".join(gzip.decompress(p.read_bytes()).decode() for p in parts)
        assert sum(p.stat().st_size for p in parts) < len(found) / 5 or len(found) < 10_000
        return found

    assert (tmp_path / "r").is_dir() == (join_bytes == 0)
    doc = json.loads(text("r"))
    assert doc["total"] == 12_000 and sorted(f["line"] for f in doc["findings"]) == list(range(12_000))
    assert len(json.loads(text("s"))["runs"][0]["results"]) == 12_000
    assert set(json.loads(text("b"))["fingerprints"]) == {r[0] for r in fd.fingerprints(findings).collect()}
    read = spark.read.text(str(tmp_path / "r"))
    assert read.where(F.col("value").startswith('{"file"')).count() == 12_000


def test_sarif_of_findings_that_share_their_place(spark, findings, tmp_path):
    """The first of several results of one file, line and rule has no comma before it."""
    same = findings.withColumns({"file": F.lit("f"), "line": F.lit(1), "rule_id": F.lit("R")}).withColumn("message", F.concat(F.lit("m"), "code_snippet"))
    reports.write_sarif_document(same, str(tmp_path / "s"))
    assert len(json.loads((tmp_path / "s").read_text())["runs"][0]["results"]) == 60
    reports.write_sarif(same, str(tmp_path / "t"))
    assert len(json.loads("".join(p.read_text() for p in sorted((tmp_path / "t").glob("part-*"))))["runs"][0]["results"]) == 60
