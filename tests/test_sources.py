"""Manifests, patches, archives, reports and tool files."""

import json
import re
import zipfile

import pytest

import pandas as pd
from pyspark.sql import functions as F

from codescan import schemas
from codescan.functions import text as tx
from codescan.operators import dependencies as dp
from codescan.operators import evaluate as ev
from codescan.operators import findings as fd
from codescan.operators import report as rp
from codescan.operators.skew import salted_lookup
from codescan.plans import q_files
from codescan.sources import advisories, corpus, manifests, patches, reports
from tests.conftest import rows


def test_manifests(spark):
    files = spark.createDataFrame([
        ("a/requirements-dev.txt", "# c\n\n-r x\nDjango[argon2]>=3.2 ; python_version>'3'\nflask\n"),
        ("b/package.json", '{"dependencies": {"a": "^1.2.3", "w": "*"}, "peerDependencies": {"p": "~2"}}'),
        ("c/package.json", "{oops"),
        ("d/go.mod", "module m\n\nrequire a.b/c v1.2.3\nrequire (\n\tx.y/z v0.1.0-beta // x\n)\n"),
        ("e/pom.xml", "<project xmlns='u'><dependency><groupId>g</groupId><artifactId>a</artifactId>"
                      "<version>${v}</version></dependency><!-- <dependency><artifactId>no</artifactId></dependency> --></project>"),
        ("f/readme.txt", "flask==1"),
    ], "file string, content string")
    assert rows(manifests.read_dependencies(files), "file", "line", "ecosystem", "name", "version") == {
        ("a/requirements-dev.txt", 4, "PyPI", "Django", "3.2"), ("a/requirements-dev.txt", 5, "PyPI", "flask", ""),
        ("b/package.json", 1, "npm", "a", "1.2.3"), ("b/package.json", 1, "npm", "w", ""), ("b/package.json", 1, "npm", "p", "2"),
        ("d/go.mod", 3, "Go", "a.b/c", "1.2.3"), ("d/go.mod", 5, "Go", "x.y/z", "0.1.0-beta"),
        ("e/pom.xml", 1, "Maven", "g:a", "v")}


def test_advisories(spark):
    table = spark.createDataFrame(
        [("npm", "a", v, i, f"{v}-{i}", "s", [("X", s)]) for v in ("1", "2") for i, s in enumerate(["9.0", "x", "4.0", "1.0", "8.0"])],
        "ecosystem string, name string, version string, seq int, id string, summary string, severity array<struct<type:string,score:string>>")
    deps = spark.createDataFrame([("f", 1, "npm", "a", "1"), ("g", 1, "npm", "a", ""), ("h", 1, "npm", "b", "1")],
                                 "file string, line int, ecosystem string, name string, version string")
    got = dp.scan_dependencies(deps, table).collect()
    assert sorted((r.file, r.severity) for r in got) == [
        ("f", "HIGH"), ("f", "HIGH"), ("f", "MEDIUM"), ("g", "HIGH"), ("g", "HIGH"), ("g", "HIGH")]
    assert all(r.message.startswith("[SCA] npm package 'a'") for r in got)


def test_advisory_and_patch_files(spark, tmp_path):
    osv = {"id": "X-1", "summary": "s", "severity": [{"type": "CVSS_V3", "score": "8.1"}],
           "affected": [{"package": {"ecosystem": "npm", "name": "a"}, "versions": ["1", "2"]}]}
    (tmp_path / "osv.json").write_text(json.dumps(osv) + "\n")
    rows_ = advisories.read_osv_dump(spark, str(tmp_path / "osv.json"))
    assert rows(rows_, "ecosystem", "name", "version", "id") == {("npm", "a", "1", "X-1"), ("npm", "a", "2", "X-1")}
    rows_.write.parquet(str(tmp_path / "table"))
    assert advisories.read_advisories(spark, str(tmp_path / "table"), "parquet").count() == 2
    (tmp_path / "p.json").write_text(json.dumps({"sha": "s", "commit_ts": "2024-01-01T00:00:00Z", "patch": "x"}))
    assert patches.read_patches(spark, str(tmp_path / "p.json")).first().commit_ts.year == 2024


def test_cvss(spark):
    df = spark.createDataFrame([("CVSS:3.1/AV:N/S:7.0",), ("CVSS:3.1/AV:N",), ("6.9",), ("3.9",), ("none",)], "s string")
    got = df.select(tx.cvss_severity(F.col("s")).alias("a"), tx.cvss_severity(F.col("s"), compat=True).alias("b")).collect()
    assert [r.a for r in got] == ["HIGH", None, "MEDIUM", "LOW", None]
    assert [r.b for r in got] == ["HIGH", "LOW", "MEDIUM", "LOW", None]


def test_patches(spark):
    patch = """commit abc
diff --git a/x.py b/x.py
--- a/x.py
+++ b/x.py
@@ -1,2 +1,3 @@
+one
-old
+two
@@ -9 +20 @@ def f():
+three
diff --git a/y y.txt b/y y.txt
@@ -0,0 +5 @@
+four
+++ not added
"""
    df = spark.createDataFrame([("s1", patch), ("s2", "")], "sha string, patch string")
    assert rows(patches.added_lines(df), "sha", "file", "line", "text") == {
        ("s1", "x.py", 1, "one"), ("s1", "x.py", 2, "two"), ("s1", "x.py", 20, "three"), ("s1", "y y.txt", 5, "four")}
    commits = spark.createDataFrame([(f"c{i}", f"2024-01-0{i} 00:00:00") for i in range(1, 6)], "sha string, t string").withColumn(
        "commit_ts", F.to_timestamp("t"))
    assert rows(patches.recent_commits(commits, 2), "sha") == {("c5",), ("c4",)}
    assert rows(patches.recent_commits(commits, 9, "2024-01-04"), "sha") == {("c5",), ("c4",)}


def test_archives(spark, tmp_path):
    for name, members in {"good": ["a.py", "d/b.py"], "bad": ["a.py", "../evil.py"], "abs": ["/etc/x"]}.items():
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            for m in members:
                z.writestr(m, f"code {m}")
    (tmp_path / "no.zip").write_text("no archive")
    zips = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    got = corpus.expand_archives(zips)
    assert rows(got, "file", "content") == {("a.py", "code a.py"), ("d/b.py", "code d/b.py")}


def test_archive_members_come_in_batches(tmp_path):
    """Members of many archives share a frame; what is unsafe is found without reading any member."""
    blobs = []
    for i in range(5):
        with zipfile.ZipFile(tmp_path / f"{i}.zip", "w") as z:
            z.writestr("a.py", f"code {i}")
            z.writestr("../b.py" if i == 3 else "b.py", "x")
        blobs.append((tmp_path / f"{i}.zip").read_bytes())
    batch = pd.DataFrame({"path": list("01234"), "content": blobs})
    (made,) = corpus._entries(iter([batch]))
    assert len(made) == 10 and list(made["content"])[::2] == [f"code {i}" for i in range(5)]
    assert [list(f["path"]) for f in corpus._unsafe(iter([batch]))] == [["3"]]


def test_reports_are_bound_into_few_files(spark, tmp_path):
    """Files of reports grow with what they hold, not with the number of reports."""
    spark.range(4000).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit("R").alias("l_returnflag")).write.parquet(
        str(tmp_path / "lineitem.parquet"))
    truth = q_files.ground_truth(spark, str(tmp_path))
    assert truth.count() == 4000 and truth.select("id").distinct().count() == 4000
    assert len(truth.inputFiles()) == 2
    found = q_files.tool_reports(spark, str(tmp_path))
    assert rows(found.groupBy("tool").agg(F.sum("n").alias("n")), "tool", "n") == {("bandit", 4000), ("semgrep", 4000), ("safety", 4000)}


def test_changed_files(spark):
    files = spark.createDataFrame([("a", "x"), ("b", "y")], "file string, content string")
    assert rows(corpus.changed_files(files, spark.createDataFrame([("b",), ("b",), ("c",)], "file string")), "file") == {("b",)}


@pytest.fixture(scope="module")
def findings(spark):
    data = [("f.py", i, sev, rule, "python" if i % 2 else "go", f"m{i}", f"code {i}", "LOW", "CWE-89" if rule == "SEC004" else "", "", "")
            for i, (sev, rule) in enumerate([("HIGH", "SEC004"), ("LOW", "SEC010"), ("CRITICAL", "SEC136"), ("MEDIUM", "SEC004")])]
    return spark.createDataFrame(data, schemas.FINDING)


def test_baseline_roundtrip(spark, findings, tmp_path):
    path = str(tmp_path / "base")
    assert reports.read_baseline(spark, path).count() == 0
    reports.write_baseline(findings.where("line < 2"), path)
    known = reports.read_baseline(spark, path)
    assert rows(known, "fingerprint") == {("SEC004:f.py:code 0",), ("SEC010:f.py:code 1",)}
    assert rows(fd.suppress_baseline(findings, known), "line") == {(2,), (3,)}
    assert fd.count_suppressed(findings, known).first()[0] == 2
    (tmp_path / "broken").write_text("not json")
    assert reports.read_baseline(spark, str(tmp_path / "broken")).count() == 0


def test_report_files(spark, findings, tmp_path):
    reports.write_report(findings, str(tmp_path / "r"), fd.count_suppressed(findings, fd.fingerprints(findings)))
    head = spark.read.json(str(tmp_path / "r/summary")).first()
    assert (head.total, head.critical, head.high, head.suppressed) == (4, 1, 1, 4)
    assert head.by_language.asDict() == {"go": 2, "python": 2}
    assert spark.read.schema(schemas.FINDING).json(str(tmp_path / "r/findings")).count() == 4


def test_sarif_file_is_one_document(spark, findings, tmp_path):
    path = tmp_path / "s"
    reports.write_sarif(findings.repartition(3), str(path))
    doc = json.loads("\n".join(p.read_text() for p in sorted(path.glob("part-*"))))
    run = doc["runs"][0]
    assert doc["version"] == "2.1.0" and len(run["results"]) == 4
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["SEC004", "SEC010", "SEC136"]
    assert run["tool"]["driver"]["rules"][0]["helpUri"].endswith("/89.html")
    assert {r["ruleId"]: r["level"] for r in run["results"]}["SEC136"] == "note"


def test_ingest(spark):
    doc = {"findings": [{"file": "a", "severity": "high", "line": 3}, {"severity": "critical", "language": "go"}]}
    raw = spark.createDataFrame([(1, json.dumps(doc)), (2, json.dumps({"by_language": {"php": 2}, "findings": []})), (3, "{}")],
                                "id long, json string").select(
        "id", F.lit("n").alias("name"), F.lit("s").alias("source"), F.current_timestamp().alias("uploaded_at"),
        F.lit(None).cast("long").alias("parent_id"), "json")
    heads, found = reports.ingest_reports(raw)
    got = {r.id: r for r in heads.collect()}
    assert (got[1].total, got[1].critical, got[1].high) == (2, 1, 1)
    assert json.loads(got[1].by_language) == {"?": 1, "go": 1} and json.loads(got[2].by_language) == {"php": 2}
    assert got[3].total == 0
    assert rows(found, "report_id", "file", "line", "severity", "confidence") == {(1, "a", 3, "HIGH", "LOW"), (1, "", 0, "CRITICAL", "LOW")}


def test_tools_gate_and_truth(spark, tmp_path):
    (tmp_path / "bandit.json").write_text(json.dumps({"results": [{"issue_severity": "High", "filename": "x/corpus/a.py", "line_number": 1}]}))
    (tmp_path / "safety.json").write_text(json.dumps({"vulnerabilities": [{"id": 1}, {"id": 2}]}))
    (tmp_path / "safety2.json").write_text(json.dumps([{"id": 1}]))
    (tmp_path / "semgrep.json").write_text(json.dumps({"results": [{"path": "corpus/b.py", "start": {"line": 2}, "extra": {"severity": "ERROR"}}]}))
    (tmp_path / "truth.json").write_text(json.dumps({"tests": [
        {"id": "1", "file": "corpus/a.py", "language": "python", "category": "sqli", "vulnerable": True},
        {"id": "2", "file": "corpus/q/b.py", "language": "python", "category": "xss", "vulnerable": False},
        {"id": "3", "file": "corpus/c.py", "language": "go", "category": "xss", "vulnerable": True}]}))
    tools = reports.read_tool_reports(spark, {t: str(tmp_path / f"{t}.json") for t in ("bandit", "safety", "semgrep")})
    assert {r.tool: (r.high, r.medium) for r in ev.tool_severity(tools).collect()} == {"bandit": (1, 0), "safety": (2, 0), "semgrep": (0, 0)}
    assert reports.read_safety(spark, str(tmp_path / "safety2.json")).count() == 1
    assert ev.gate(tools).first().failed and not ev.gate(tools.where("tool = 'semgrep'")).first().failed
    truth = reports.read_ground_truth(spark, str(tmp_path / "truth.json"))
    seen = ev.detected_cases(truth, tools.where("file is not null"))
    assert {r.id: r.result for r in ev.detail_rows(seen).collect()} == {"1": "TP", "2": "FP", "3": "FN"}
    assert {r.id: r.result for r in ev.detail_rows(ev.detected_cases(truth, tools, exact_only=True)).collect()}["2"] == "TN"
    per_tool = ev.confusion(seen).where("scope = 'all'").withColumn("tool", F.lit("x"))
    reports.write_benchmark(per_tool, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out/csv")).first()["precision"] == "0.5"


def test_metrics_arithmetic(spark):
    """The published counts give the published scores."""
    counts = spark.createDataFrame([("a", 16, 2, 4, 12), ("b", 14, 5, 6, 9), ("c", 6, 2, 14, 12), ("d", 0, 0, 0, 0)],
                                   "tool string, TP int, FP int, FN int, TN int")
    got = {r.tool: (r.precision, r.recall, r.f1, r.fpr) for r in ev.metrics(counts, 4).collect()}
    assert got == {"a": (0.8889, 0.8, 0.8421, 0.1429), "b": (0.7368, 0.7, 0.7179, 0.3571), "c": (0.75, 0.3, 0.4286, 0.1429),
                   "d": (0.0, 0.0, 0.0, 0.0)}


def test_repo_urls(spark):
    df = spark.createDataFrame([("https://GitHub.com/o/r.git",), ("http://github.com/o/r",), ("https://evil.com/o/r",),
                                ("https://gitlab.com/o",), (" https://codeberg.org/o/r/tree/main ",), ("",)], "u string")
    got = [r[0] and tuple(r[0]) for r in df.select(corpus.validate_repo_url(F.col("u"))).collect()]
    assert got == [("https://github.com/o/r.git", "o/r"), None, None, None, ("https://codeberg.org/o/r.git", "o/r"), None]


def test_hot_key_lookup(spark):
    """One key holds most rows; the salted join still equals the plain one."""
    left = spark.range(5000).select(F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(0, 5000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert rows(salted_lookup(left, right, ["k"]), "id", "v") == rows(left.join(right, "k"), "id", "v")
    assert rows(salted_lookup(left, right, ["k"], how="left"), "id", "v") == rows(left.join(right, "k", "left"), "id", "v")
    # The copies of a lookup are never broadcast: its size does not tell Spark how many there are.
    assert "Broadcast" not in salted_lookup(left, right, ["k"])._jdf.queryExecution().executedPlan().toString()


def test_copies_of_names_are_shuffled(spark):
    """One base name holds most cases: the salted names of findings are not broadcast, and every case keeps its verdict."""
    file = lambda root: F.concat(F.lit(root), "id", F.lit("/"), F.when(F.col("id") % 3 < 2, "index.js").otherwise(F.col("id").cast("string")))
    truth = spark.range(900).select(F.col("id").cast("string").alias("id"), file("/tmp/corpus/").alias("file"), (F.col("id") % 2 == 0).alias("vulnerable"))
    hits = spark.range(2, 900, 9).select(file("/srv/corpus/").alias("file")).union(spark.range(5, 900, 9).select(F.concat(F.lit("/b/"), "id").alias("file")))
    assert hits.where(F.col("file").endswith("index.js")).count() == 0
    seen = ev.detail_rows(ev.detected_cases(truth, hits))
    found = {i: i % 9 in (2, 5) for i in range(900)}
    want = {str(i): ("TP" if found[i] else "FN") if i % 2 == 0 else ("FP" if found[i] else "TN") for i in found}
    assert {r.id: r.result for r in seen.collect()} == want
    everywhere = ev.detected_cases(truth, hits.union(spark.sql("SELECT '/c/index.js'")))
    assert {int(r.id) for r in everywhere.where("found").collect()} == {i for i in found if found[i] or i % 3 < 2}
    plan = [(re.search(r"[A-Za-z*]", line).start(), line) for line in seen._jdf.queryExecution().executedPlan().toString().splitlines()
            if re.search("[A-Za-z]", line)]
    above = []  # the nodes over a line
    for depth, line in plan:
        above = [(d, x) for d, x in above if d < depth] + [(depth, line)]
        assert "Generate" not in line or not any("BroadcastExchange" in x for _, x in above)
    assert any("Generate" in line for _, line in plan)


def test_lineage(spark):
    data = [(1, "2024-01-05", 5, None), (2, "2024-02-01", 7, 1), (3, "2025-02-01", 7, 1), (4, "2023-01-01", 1, 1), (9, "2024-01-01", 3, None)]
    df = spark.createDataFrame(data, "id long, t string, high long, parent_id long").withColumn("uploaded_at", F.to_timestamp("t"))
    want = {(1, 0, "first"), (4, -4, "better"), (2, 6, "worse"), (3, 0, "same"), (9, 0, "first")}
    for bucket in ("month", "year"):
        assert rows(rp.lineage_delta(df, bucket), "id", "delta", "trend") == want


def test_ages_and_paths(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", "/r/a/b.py", 900), ("2024-01-02 23:59:00", "/x", 61000), (None, "/r", 120000)],
                               "t string, p string, ms int")
    got = df.select(tx.age_text(F.to_timestamp("t"), F.lit("2024-01-03").cast("timestamp")), tx.relative_path(F.col("p"), "/r"),
                    tx.duration_text(F.col("ms"))).collect()
    assert [tuple(r) for r in got] == [("2d ago", "a/b.py", "900ms"), ("1m ago", "/x", "1m 1s"), ("", "/r", "2m")]


def test_versions_sort_as_versions(spark):
    from codescan.operators.dependencies import version_key

    order = ["0.9", "1.0-alpha", "1.0-rc1", "1.0-rc2", "1.0-rc10", "1", "1.0.1", "1.2", "1.10", "v2.0", "10"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(order)], "i int, v string").repartition(3)
    assert [r.v for r in df.orderBy(version_key(F.col("v"))).collect()] == order
    same = spark.createDataFrame([("1.0", "v1"), ("1.0.0", "1"), ("2+build", "2.0")], "a string, b string")
    assert same.where(version_key(F.col("a")) == version_key(F.col("b"))).count() == 3
