"""Scan reports, baselines, tool reports and benchmark files: readers and writers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codescan import schemas
from codescan.operators import evaluate, findings as fd, report as rp
from codescan.session import cut_lineage, lent
from codescan.sources.documents import write_document


# --- baseline -------------------------------------------------------------------
def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Known fingerprints; a missing or unreadable baseline is empty.

    Takes one indented document as well as the JSON lines of ``write_baseline``: a reader
    of the other kind finds no or only the first record.
    """
    try:
        reader = spark.read.schema(schemas.BASELINE)
        rows = reader.json(path).unionByName(reader.option("multiLine", True).json(path))
        return rows.select(F.explode("fingerprints").alias("fingerprint")).distinct()
    except AnalysisException:
        return spark.createDataFrame([], "fingerprint string")


def write_baseline(findings: DataFrame, path: str) -> None:
    """One JSON record per fingerprint chunk, sorted, with version and overall count.

    Fingerprints are range-partitioned and each record holds a bounded slice, so the set
    is never gathered in one task; the reader takes the union of all records.
    """
    prints = fd.fingerprints(findings)
    count = prints.agg(F.count("*")).scalar()
    chunk = F.substring(F.sha2("fingerprint", 256), 1, 4)
    (prints.groupBy(chunk.alias("chunk"))
     .agg(F.sort_array(F.collect_list("fingerprint")).alias("fingerprints"))
     .select(F.lit(1).alias("version"), count.alias("count"), "fingerprints")
     .write.mode("overwrite").json(path))


# --- scan report ----------------------------------------------------------------
def report_header(findings: DataFrame, suppressed: DataFrame | None = None) -> DataFrame:
    """Totals and findings per language in one row."""
    totals = rp.severity_totals(findings)
    langs = rp.by_language(findings).agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct("language", "n")))).alias("by_language"))
    count = suppressed.select("suppressed").scalar() if suppressed is not None else F.lit(0)
    return totals.withColumn("suppressed", count).withColumn("by_language", langs.scalar())


def write_report(findings: DataFrame, path: str, suppressed: DataFrame | None = None) -> None:
    """``path/summary`` (one JSON row) and ``path/findings`` (JSON lines)."""
    report_header(findings, suppressed).write.mode("overwrite").json(f"{path}/summary")
    findings.select(*schemas.FINDING_COLUMNS).write.mode("overwrite").json(f"{path}/findings")


def write_sarif(findings: DataFrame, path: str) -> None:
    """A SARIF log whose part files, taken in order, form one document."""
    rp.sarif_document(findings).orderBy(*rp.sarif_order()).select("value").write.mode("overwrite").text(path)


def _json(*columns) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def write_report_document(findings: DataFrame, path: str, suppressed: DataFrame | None = None) -> None:
    """The report as one JSON file: totals, findings per language, then the findings by (file, line, rule), one a line."""
    order = ["file", "line", "rule_id", *[c for c in schemas.FINDING_COLUMNS if c not in ("file", "line", "rule_id")]]
    with lent(findings.select(*schemas.FINDING_COLUMNS)) as rows:
        head = report_header(rows, suppressed).select(_json("*")).first()[0]
        write_document(rows.orderBy(*order).select(_json(*schemas.FINDING_COLUMNS)), path,
                       head[:-1] + ',"findings":[\n', ",\n", "\n]}\n", packed=True)


def write_sarif_document(findings: DataFrame, path: str) -> None:
    """A SARIF log as one file."""
    with lent(findings) as rows:
        write_document(rp.sarif_lines(rows).orderBy(*rp.sarif_order()).select("value"), path, packed=True)


def write_baseline_document(findings: DataFrame, path: str) -> None:
    """A baseline as one JSON file of sorted fingerprints, one a line."""
    with lent(fd.fingerprints(findings).select("fingerprint")) as prints:
        write_document(prints.orderBy("fingerprint").select(F.regexp_extract(F.to_json(F.array("fingerprint")), r"(?s)^\[(.*)\]$", 1)), path,
                       f'{{"version":1,"count":{prints.count()},"fingerprints":[\n', ",\n", "\n]}\n", packed=True)


def ingest_reports(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Report rows and finding rows of (id, name, source, uploaded_at, parent_id, json).

    Counts are recomputed from the findings; missing fields get their defaults; the
    language map falls back to a count of the findings.
    """
    parsed = raw.withColumn("_r", F.from_json("json", schemas.SCAN_REPORT))
    rows = parsed.select("id", F.explode_outer("_r.findings").alias("f")).where(F.col("f").isNotNull())
    text = lambda c, default="": F.coalesce(F.col(f"f.{c}"), F.lit(default)).alias(c)
    found = rows.select(
        F.col("id").alias("report_id"), text("file"), F.coalesce("f.line", F.lit(0)).alias("line"),
        F.upper(F.coalesce("f.severity", F.lit(""))).alias("severity"), text("rule_id"), text("language"),
        text("message"), text("code_snippet"), text("confidence", "LOW"), text("ai_explanation"))
    own = F.coalesce(F.col("_r.findings"), F.array().cast(schemas.SCAN_REPORT["findings"].dataType))
    count = lambda s: F.size(F.filter(own, lambda f: F.upper(f["severity"]) == s)).alias(s.lower())
    langs = F.transform(own, lambda f: F.coalesce(f["language"], F.lit("?")))
    counted = F.map_from_entries(F.transform(F.array_distinct(langs), lambda v: F.struct(
        v, F.size(F.filter(langs, lambda w: w == v)))))
    given = F.col("_r.by_language")
    reports = parsed.select(
        "id", "name", "source", "uploaded_at", F.size(own).alias("total"),
        *[count(s) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")],
        F.to_json(F.when(F.size(F.coalesce(given, F.create_map().cast("map<string,int>"))) > 0, given)
                  .otherwise(counted)).alias("by_language"), "parent_id")
    return reports, found


# --- third-party tools and benchmark --------------------------------------------
def read_bandit(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(schemas.BANDIT).option("multiLine", True).json(path)
    return rows.select(F.explode("results").alias("r")).select(
        F.lit("bandit").alias("tool"), F.col("r.filename").alias("file"), F.col("r.line_number").alias("line"),
        F.upper("r.issue_severity").alias("severity"))


def read_semgrep(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(schemas.SEMGREP).option("multiLine", True).json(path)
    return rows.select(F.explode("results").alias("r")).select(
        F.lit("semgrep").alias("tool"), F.col("r.path").alias("file"),
        F.coalesce("r.start.line", F.lit(0)).alias("line"), F.upper("r.extra.severity").alias("severity"))


def read_safety(spark: SparkSession, path: str) -> DataFrame:
    """One row per issue; the file is a list, or a dict with the list under one of three keys."""
    text = spark.read.option("wholetext", True).text(path)
    lists = F.coalesce(
        F.from_json("value", "array<string>"),
        *[F.from_json(F.get_json_object("value", f"$.{k}"), "array<string>")
          for k in ("issues", "vulnerabilities", "results")])
    return text.select(F.explode(lists).alias("i")).select(
        F.lit("safety").alias("tool"), F.lit(None).cast("string").alias("file"), F.lit(0).alias("line"),
        F.lit("HIGH").alias("severity"))


TOOL_READERS = {"bandit": read_bandit, "semgrep": read_semgrep, "safety": read_safety}


def read_tool_reports(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(tool, file, line, severity) of all given reports; register readers in TOOL_READERS."""
    return fd.union_engines(*[TOOL_READERS[tool](spark, path) for tool, path in paths.items()])


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(schemas.GROUND_TRUTH).option("multiLine", True).json(path)
    return rows.select(F.explode("tests").alias("t")).select("t.*")


def write_benchmark(per_tool: DataFrame, path: str) -> None:
    """Metrics per tool, rounded to 4 digits, as CSV and JSON."""
    rows = evaluate.metrics(per_tool.select("tool", "TP", "FP", "FN", "TN"), digits=4)
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    rows.write.mode("overwrite").json(f"{path}/json")


def write_benchmark_documents(per_tool: DataFrame, truth: DataFrame, path: str, times: DataFrame | None = None) -> None:
    """``path.csv`` and ``path.json``, a file each: metrics of every tool, its seconds where ``times`` (tool, scan_time_s)
    knows them, and in JSON the size of the corpus."""
    rows = evaluate.metrics(per_tool.select("tool", "TP", "FP", "FN", "TN"), digits=4)
    rows = cut_lineage(rows.withColumn("scan_time_s", F.lit(None).cast("double")) if times is None else rows.join(times, "tool", "left"))
    shown = ["TP", "FP", "FN", "TN", "precision", "recall", "f1", "fpr"]
    columns = ["tool", *shown, "scan_time_s"]
    rows = rows.orderBy("tool")
    write_document(rows.select(F.to_csv(F.struct(*columns))), f"{path}.csv", ",".join(columns) + "\n")
    corpus = truth.agg(F.count("*").alias("total"), F.count_if("vulnerable").alias("vulnerable"),
                       F.count_if(~F.col("vulnerable")).alias("safe")).select(_json("*")).first()[0]
    entry = F.to_json(F.create_map("tool", F.struct(F.struct(*shown).alias("metrics"), "scan_time_s")), {"ignoreNullFields": "false"})
    write_document(rows.select(F.regexp_extract(entry, r"(?s)^\{(.*)\}$", 1)), f"{path}.json",
                   f'{{"corpus":{corpus},"tools":{{\n', ",\n", "\n}}\n")
