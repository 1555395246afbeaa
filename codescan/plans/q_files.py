"""Queries that write files derived from the tables and read them back with the library's readers."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyarrow import fs
from pyspark.sql import functions as F

from codescan.functions import text as tx
from codescan.plans import tables as tb
from codescan.plans.tables import derive, duck
from codescan.session import work_folder
from codescan.sources import archives, corpus, reports

# Fifty orders make one report of a tool; a report is one JSON document, hence one file.
_REPORT = "CAST(floor(l_orderkey / 50) AS BIGINT)"
FOUND_SQL = f"""
SELECT {_REPORT} AS report, concat('src/o', CAST(l_orderkey AS STRING), '.py') AS file, CAST(l_linenumber AS INT) AS line,
       CASE l_returnflag WHEN 'R' THEN 'High' WHEN 'A' THEN 'medium' ELSE 'LOW' END AS severity
FROM {{lineitem}}
"""
FOUND = duck(FOUND_SQL, "lineitem")


def _bound(report):
    """Forty reports bound into one document, a few megabytes: a table of any size makes few files for what they hold."""
    return F.floor(F.col(report) / 40)


def _write(rows, path: str) -> str:
    rows.write.option("maxRecordsPerFile", 1).json(path)
    return path


def tool_reports(spark, sf):
    """Findings of three tools, read from their own report formats."""
    found = derive(spark, sf, FOUND_SQL, "lineitem").withColumn("report", _bound("report"))
    bandit = found.groupBy("report").agg(F.collect_list(F.struct(
        F.col("severity").alias("issue_severity"), F.col("file").alias("filename"), F.col("line").alias("line_number"))).alias("results"))
    semgrep = found.groupBy("report").agg(F.collect_list(F.struct(
        F.col("file").alias("path"), F.struct("line").alias("start"), F.struct("severity").alias("extra"))).alias("results"))
    safety = found.groupBy("report").agg(F.collect_list(F.struct("file")).alias("vulnerabilities"))
    paths = {tool: _write(rows.drop("report"), work_folder(spark, tool))
             for tool, rows in (("bandit", bandit), ("semgrep", semgrep), ("safety", safety))}
    return reports.read_tool_reports(spark, paths).groupBy("tool", "file", "severity").agg(
        F.count("*").alias("n"), F.sum("line").alias("lines"))


TOOL_REPORTS = f"""
SELECT tool, file, upper(severity) AS severity, count(*) AS n, sum(line) AS lines
FROM ({FOUND}), (SELECT unnest(['bandit', 'semgrep']) AS tool) GROUP BY ALL
UNION ALL SELECT 'safety', NULL, 'HIGH', count(*), 0 FROM ({FOUND})"""

TRUTH_SQL = f"""
SELECT {_REPORT} AS report, CAST(l_orderkey AS STRING) AS id, concat('src/o', CAST(l_orderkey AS STRING), '.py') AS file,
       'python' AS language, CASE l_orderkey % 4 WHEN 0 THEN 'sqli' WHEN 1 THEN 'xss' WHEN 2 THEN 'cmdi' ELSE 'path' END AS category,
       l_orderkey % 3 > 0 AS vulnerable
FROM {{lineitem}} GROUP BY l_orderkey
"""


def ground_truth(spark, sf):
    """Labelled cases, read from their files."""
    rows = derive(spark, sf, TRUTH_SQL, "lineitem").withColumn("report", _bound("report"))
    tests = rows.groupBy("report").agg(F.collect_list(F.struct("id", "file", "language", "category", "vulnerable")).alias("tests"))
    path = _write(tests.drop("report"), work_folder(spark, "truth"))
    return reports.read_ground_truth(spark, path).select("id", "file", "language", "category", "vulnerable")


GROUND_TRUTH = f"SELECT id, file, language, category, vulnerable FROM ({duck(TRUTH_SQL, 'lineitem')})"


def report_files(spark, sf):
    """A scan report and its baseline, written and read back."""
    found = derive(spark, sf, tb.FINDINGS_SQL, "lineitem").drop("engine_ord", "ord")
    path, base = work_folder(spark, "report"), work_folder(spark, "baseline")
    reports.write_report(found, path)
    reports.write_baseline(found.where("severity = 'HIGH'"), base)
    head = spark.read.schema("total long, high long, by_language map<string,long>").json(f"{path}/summary")
    rows = spark.read.schema("file string, line int").json(f"{path}/findings")
    value = lambda df, agg, name: df.agg(agg.alias(name)).scalar().alias(name)
    return head.select(
        "total", "high", F.col("by_language")["python"].alias("python"), value(rows, F.count("*"), "rows"),
        value(rows, F.sum("line"), "lines"), value(rows, F.countDistinct("file"), "files"),
        value(reports.read_baseline(spark, base), F.count("*"), "known"))


_F = duck(tb.FINDINGS_SQL, "lineitem")
REPORT_FILES = f"""
SELECT count(*) AS total, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (language = 'python') AS python, count(*) AS rows,
  sum(line) AS lines, count(DISTINCT file) AS files,
  count(DISTINCT CASE WHEN severity = 'HIGH' THEN rule_id || ':' || file || ':' || substr(code_snippet, 1, 80) END) AS known FROM ({_F})"""



def report_documents(spark, sf):
    """A report, a SARIF log and a baseline as one file each, their lines read back."""
    found = derive(spark, sf, tb.FINDINGS_SQL, "lineitem").drop("engine_ord", "ord")
    path = {kind: work_folder(spark, kind) for kind in ("report", "sarif", "baseline")}
    reports.write_report_document(found, path["report"])
    reports.write_sarif_document(found, path["sarif"])
    reports.write_baseline_document(found.where("severity = 'HIGH'"), path["baseline"])
    text = {kind: spark.read.text(p) for kind, p in path.items()}
    element = F.from_json(F.regexp_replace("value", ",$", ""), "rule_id string, line int, total long, high long")
    rows = text["report"].select(element.alias("e")).where("e.rule_id IS NOT NULL").groupBy("e.rule_id").agg(
        F.count("*").alias("n"), F.sum("e.line").alias("lines"))
    head = text["report"].select(F.from_json(F.concat("value", F.lit("]}")), "total long, high long").alias("h")).where("h.total IS NOT NULL")
    each = lambda key: F.regexp_extract_all("value", F.lit(key), F.lit(1))
    results = text["sarif"].select(F.explode(F.arrays_zip(
        each('"ruleId":"([^"]*)"').alias("rule_id"), each('"startLine":([0-9]+)').alias("line"))).alias("r"))
    known = text["baseline"].where("value LIKE '\"%'")
    return (
        rows.select(F.lit("report").alias("kind"), "rule_id", "n", "lines")
        .unionByName(head.select(F.lit("head").alias("kind"), F.lit(None).cast("string").alias("rule_id"),
                                 F.col("h.total").alias("n"), F.col("h.high").alias("lines")))
        .unionByName(results.groupBy("r.rule_id").agg(F.count("*").alias("n"), F.sum(F.col("r.line").cast("long")).alias("lines"))
                     .select(F.lit("sarif").alias("kind"), "rule_id", "n", "lines"))
        .unionByName(known.groupBy(F.regexp_extract("value", '^"([^:]*):', 1).alias("rule_id")).agg(F.count("*").alias("n"))
                     .select(F.lit("baseline").alias("kind"), "rule_id", "n", F.lit(None).cast("long").alias("lines"))))


REPORT_DOCUMENTS = f"""
WITH f AS ({_F})
SELECT kind, rule_id, count(*) AS n, CAST(sum(line) AS BIGINT) AS lines FROM f, (VALUES ('report'), ('sarif')) k(kind) GROUP BY kind, rule_id
UNION ALL SELECT 'head', NULL, count(*), count(*) FILTER (severity = 'HIGH') FROM f
UNION ALL SELECT 'baseline', rule_id, count(DISTINCT file || ':' || substr(code_snippet, 1, 80)), NULL FROM f WHERE severity = 'HIGH' GROUP BY rule_id"""

# --- folders, single files, archives ------------------------------------------------
def corpus_folder(spark, sf):
    """Documents written as text files, then read as a folder and, one of the files, alone."""
    path = work_folder(spark, "corpus")
    docs = derive(spark, sf, "SELECT doc_id, text FROM {documents}", "documents")
    docs.select("text").repartition(16, "text").write.text(path)
    folder = corpus.read_corpus(spark, path)
    named = folder.where(~F.col("file").endswith("_SUCCESS")).select(
        tx.relative_path(F.col("file"), re.sub("^file:/+", "/", path)).alias("name"), "file", "content")
    first = named.agg(F.min("file")).first()[0]
    alone = corpus.read_corpus(spark, first).select("content")
    lines = lambda rows, kind: rows.select(F.explode(F.split(F.regexp_replace("content", r"\n\z", ""), "\n")).alias("line")).groupBy(
        F.md5("line").alias("line_md5")).agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
    rooted = named.where(F.col("name").contains("/")).count()
    same = named.where(F.col("file") == first).select("content").exceptAll(alone).count()
    assert not rooted and not same
    return lines(named, "folder")


CORPUS_FOLDER = """SELECT md5(line) AS line_md5, count(*) AS n, 'folder' AS kind FROM (
  SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1"""


def _zipped(rows: pd.DataFrame) -> pd.DataFrame:
    """One archive of a group of documents; every seventh has an entry that leaves it."""
    number = int(rows["archive"].iloc[0])
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as z:
        for doc_id, text in zip(rows["doc_id"], rows["text"]):
            z.writestr(f"src/d{doc_id}.py", text)
        z.writestr("src/", "")
        if number % 7 == 3:
            z.writestr("../evil.py", "x")
    return pd.DataFrame({"path": [f"a{number}.zip"], "content": [body.getvalue() if number % 7 != 5 else b"no archive"]})


def archive_entries(spark, sf):
    """Archives of documents, expanded; archives with an unsafe entry and what is no archive are left out."""
    docs = derive(spark, sf, "SELECT doc_id, text, floor(doc_id / 25) AS archive FROM {documents}", "documents")
    path = work_folder(spark, "archives")
    docs.groupBy("archive").applyInPandas(_zipped, "path string, content binary").write.parquet(path)
    found = corpus.expand_archives(spark.read.parquet(path))
    return found.select("archive", "file", F.md5("content").alias("content_md5"))


ARCHIVES = """SELECT 'a' || CAST(floor(doc_id / 25) AS BIGINT) || '.zip' AS archive, 'src/d' || doc_id || '.py' AS file, md5(text) AS content_md5
FROM documents WHERE CAST(floor(doc_id / 25) AS BIGINT) % 7 NOT IN (3, 5)"""

def _zip_file(folder: str):
    def write(rows: pd.DataFrame) -> pd.DataFrame:
        made = _zipped(rows).iloc[0]
        filesystem, inner = fs.FileSystem.from_uri(folder)
        filesystem.create_dir(inner)
        with filesystem.open_output_stream(f"{inner}/{made['path']}") as out:
            out.write(made["content"])
        return pd.DataFrame({"path": [made["path"]]})
    return write


def archive_source(spark, sf):
    """Archives of documents as files, read in ranges of 16 kB, so that each is several tasks."""
    docs = derive(spark, sf, "SELECT doc_id, text, floor(doc_id / 100) AS archive FROM {documents}", "documents")
    path = work_folder(spark, "zips")
    docs.groupBy("archive").applyInPandas(_zip_file(path), "path string").write.format("noop").mode("overwrite").save()
    found = archives.read_archives(spark, path, split_bytes=16 << 10)
    return found.select(F.substring_index("archive", "/", -1).alias("archive"), "file", F.md5("content").alias("content_md5"))


ARCHIVE_SOURCE = ARCHIVES.replace("/ 25", "/ 100")

# --- benchmark files ----------------------------------------------------------------
SCORES_SQL = """
SELECT CASE l_suppkey % 3 WHEN 0 THEN 'ours' WHEN 1 THEN 'semgrep' ELSE 'bandit' END AS tool,
       count(CASE WHEN l_returnflag = 'R' AND l_linenumber < 4 THEN 1 END) AS TP, count(CASE WHEN l_returnflag <> 'R' AND l_linenumber < 3 THEN 1 END) AS FP,
       count(CASE WHEN l_returnflag = 'R' AND l_linenumber >= 4 THEN 1 END) AS FN, count(CASE WHEN l_returnflag <> 'R' AND l_linenumber >= 3 THEN 1 END) AS TN
FROM {lineitem} GROUP BY 1
"""


def benchmark_files(spark, sf):
    """Metrics of tools, written as CSV and JSON and read back."""
    path = work_folder(spark, "benchmark")
    reports.write_benchmark(derive(spark, sf, SCORES_SQL, "lineitem"), path)
    schema = "tool string, TP long, FP long, FN long, TN long, precision double, recall double, f1 double"
    csv = spark.read.option("header", True).csv(f"{path}/csv")
    both = [rows.select("tool", *[F.col(c).cast("long").alias(c) for c in ("TP", "FP", "FN", "TN")],
                        *[F.col(c).cast("double").alias(c) for c in ("precision", "recall", "f1")], F.lit(kind).alias("kind"))
            for rows, kind in ((csv, "csv"), (spark.read.schema(schema).json(f"{path}/json"), "json"))]
    return both[0].unionByName(both[1])


BENCHMARK_FILES = f"""
WITH s AS ({duck(SCORES_SQL, 'lineitem')}),
m AS (SELECT *, TP / (TP + FP) AS p, TP / (TP + FN) AS r FROM s)
SELECT tool, TP, FP, FN, TN, round(p, 4) AS precision, round(r, 4) AS recall, round(2 * p * r / (p + r), 4) AS f1, kind
FROM m, (VALUES ('csv'), ('json')) k(kind)"""



def benchmark_documents(spark, sf):
    """Metrics of tools over labelled cases as one CSV and one JSON file, read back."""
    path = work_folder(spark, "benchmark")
    times = derive(spark, sf, TIMES_SQL, "lineitem")
    reports.write_benchmark_documents(derive(spark, sf, SCORES_SQL, "lineitem"), derive(spark, sf, TRUTH_SQL, "lineitem"), path, times)
    scores = "TP long, FP long, FN long, TN long, precision double, recall double, f1 double, fpr double"
    csv = spark.read.option("header", True).schema(f"tool string, {scores}, scan_time_s double").csv(f"{path}.csv")
    form = f"corpus struct<total: long, vulnerable: long, safe: long>, tools map<string, struct<metrics: struct<{scores}>, scan_time_s: double>>"
    json = spark.read.schema(form).option("multiLine", True).json(f"{path}.json")
    return (
        json.select("corpus", F.explode("tools").alias("tool", "t")).select("tool", "t.metrics.*", "t.scan_time_s", "corpus.vulnerable", "corpus.safe")
        .unionByName(csv, allowMissingColumns=True))


TIMES_SQL = """
SELECT CASE l_suppkey % 3 WHEN 0 THEN 'ours' ELSE 'semgrep' END AS tool, round(count(*) / 64, 2) AS scan_time_s
FROM {lineitem} WHERE l_suppkey % 3 < 2 GROUP BY 1
"""
BENCHMARK_DOCUMENTS = f"""
WITH s AS ({duck(SCORES_SQL, 'lineitem')}), m AS (SELECT *, TP / (TP + FP) AS p, TP / (TP + FN) AS r FROM s),
a AS (SELECT tool, TP, FP, FN, TN, round(p, 4) AS precision, round(r, 4) AS recall, round(2 * p * r / (p + r), 4) AS f1,
  round(FP / (FP + TN), 4) AS fpr, scan_time_s FROM m LEFT JOIN ({duck(TIMES_SQL, 'lineitem')}) USING (tool)),
c AS (SELECT count(*) FILTER (vulnerable) AS vulnerable, count(*) FILTER (NOT vulnerable) AS safe FROM ({duck(TRUTH_SQL, 'lineitem')}))
SELECT a.*, vulnerable, safe FROM a, c UNION ALL SELECT a.*, NULL, NULL FROM a"""

QUERIES = {
    "report_documents": (report_documents, REPORT_DOCUMENTS),
    "benchmark_documents": (benchmark_documents, BENCHMARK_DOCUMENTS),
    "corpus_folder": (corpus_folder, CORPUS_FOLDER),
    "archive_entries": (archive_entries, ARCHIVES),
    "archive_source": (archive_source, ARCHIVE_SOURCE),
    "benchmark_files": (benchmark_files, BENCHMARK_FILES),
    "tool_reports": (tool_reports, TOOL_REPORTS),
    "ground_truth": (ground_truth, GROUND_TRUTH),
    "report_files": (report_files, REPORT_FILES),
}
