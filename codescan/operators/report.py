"""Report aggregates and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codescan.functions import text as tx
from codescan.rules.languages import SARIF_LEVEL
from codescan.rules.metadata import HELP_BY_CWE
from codescan.session import cut_lineage


def severity_totals(findings: DataFrame, *by: str) -> DataFrame:
    """total, critical, high, medium, low – overall or per group."""
    sev = F.upper("severity")
    return findings.groupBy(*by).agg(
        F.count("*").alias("total"),
        *[F.count_if(sev == s.upper()).alias(s) for s in ("critical", "high", "medium", "low")])


def by_language(findings: DataFrame) -> DataFrame:
    return findings.groupBy("language").agg(F.count("*").alias("n"))


def summary_rows(findings: DataFrame) -> DataFrame:
    """Console summary: findings and rules per severity and language."""
    return findings.groupBy("severity", "language").agg(F.count("*").alias("n"), F.countDistinct("rule_id").alias("rules"))


def severity_share(findings: DataFrame) -> DataFrame:
    """Chart shares of high, medium and low among all findings."""
    t = severity_totals(findings)
    share = lambda c: F.when(F.col("total") > 0, F.round(F.col(c) / F.col("total"), 6)).otherwise(0.0)
    return t.select("total", *[share(c).alias(f"{c}_share") for c in ("high", "medium", "low")])


def top_values(findings: DataFrame, column: str, k: int = 10) -> DataFrame:
    """Most common values; ties go to the smaller value, which keeps the result stable."""
    return findings.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def top_rules(findings: DataFrame, k: int = 10) -> DataFrame:
    return top_values(findings, "rule_id", k)


def top_files(findings: DataFrame, k: int = 10) -> DataFrame:
    return top_values(findings, "file", k)


def rule_drilldown(findings: DataFrame, rule_id: str) -> DataFrame:
    """All occurrences of a rule with guidance on its weakness."""
    title = F.create_map(*[F.lit(v) for c, (t, _) in HELP_BY_CWE.items() for v in (c, t)])
    fix = F.create_map(*[F.lit(v) for c, (_, f) in HELP_BY_CWE.items() for v in (c, f)])
    rows = findings.where(F.col("rule_id") == rule_id)
    return (
        rows.withColumn("title", F.coalesce(F.element_at(title, F.col("cwe")), F.col("rule_id")))
        .withColumn("fix", F.coalesce(F.element_at(fix, F.col("cwe")), F.lit("")))
    )


def rule_head(findings: DataFrame, rule_id: str) -> DataFrame:
    """The head of a drill-down: worst severity, findings, files, and the guidance; no row for an unknown rule."""
    worst = F.min_by("severity", F.when(F.col("severity") == "CRITICAL", 0).when(F.col("severity") == "HIGH", 1)
                     .when(F.col("severity") == "MEDIUM", 2).otherwise(3))
    return rule_drilldown(findings, rule_id).groupBy("rule_id").agg(
        worst.alias("severity"), F.count("*").alias("findings"), F.countDistinct("file").alias("files"),
        F.min("title").alias("title"), F.min("fix").alias("fix"))


def finding_lines(findings: DataFrame) -> DataFrame:
    """The lines with findings of every file, one row each, so a file with very many stays spread."""
    return findings.select("file", "line").distinct()


def files_with_findings(findings: DataFrame) -> DataFrame:
    """Distinct lines per file, counted rather than collected."""
    return findings.groupBy("file").agg(F.countDistinct("line").alias("n_lines"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """One row per rule: the message of its first finding and a help link."""
    first = F.struct("file", "line", "message")
    return (
        findings.groupBy("rule_id")
        .agg(F.min_by("message", first).alias("text"), F.min_by("cwe", first).alias("cwe"),
             F.min_by("owasp", first).alias("owasp"))
        .withColumn("help_uri", F.when(F.col("cwe") != "", F.concat(
            F.lit("https://cwe.mitre.org/data/definitions/"), F.replace("cwe", F.lit("CWE-"), F.lit("")),
            F.lit(".html"))).otherwise(""))
    )


def sarif_level(severity):
    level = F.create_map(*[F.lit(v) for kv in SARIF_LEVEL.items() for v in kv])
    return F.coalesce(F.element_at(level, severity), F.lit("note"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """One SARIF result object per finding, as JSON text."""
    result = F.struct(
        F.col("rule_id").alias("ruleId"), sarif_level(F.col("severity")).alias("level"),
        F.struct(F.col("message").alias("text")).alias("message"),
        F.array(F.struct(F.struct(
            F.struct(F.col("file").alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"),
            F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))).alias("locations"),
        F.struct("confidence", "language", "cwe", "owasp").alias("properties"))
    return findings.select("file", "line", "rule_id", F.to_json(result).alias("json"))


def sarif_document(findings: DataFrame) -> DataFrame:
    """The SARIF log as ordered text lines (section, key, value).

    Written in ``sarif_order`` the part files concatenate to one valid
    document, so no task ever holds all results.
    """
    return sarif_lines(cut_lineage(findings))


def sarif_order() -> list[Column]:
    """Where keys are equal, the element without a comma leads."""
    return [F.col("section"), F.col("key"), F.col("value").startswith(","), F.col("value")]


def sarif_lines(findings: DataFrame) -> DataFrame:
    """``sarif_document`` of a table that may be read several times."""
    spark = findings.sparkSession
    head = ('{"$schema":"https://schemastore.azurewebsites.net/schemas/json/sarif-2.1.0-rtm.5.json","version":"2.1.0",'
            '"runs":[{"tool":{"driver":{"name":"codescan","version":"1.0.0","rules":[')
    rules = sarif_rules(findings).select(
        F.lit(1).alias("section"), F.col("rule_id").alias("key"),
        F.to_json(F.struct(
            F.col("rule_id").alias("id"), F.col("rule_id").alias("name"),
            F.struct(F.col("text")).alias("shortDescription"), F.col("help_uri").alias("helpUri"),
            F.struct(F.array(F.lit("security")).alias("tags"), "cwe", "owasp").alias("properties"))).alias("value"))
    results = sarif_results(findings).select(
        F.lit(3).alias("section"),
        F.format_string("%s\u0001%010d\u0001%s", "file", F.col("line").cast("int"), "rule_id").alias("key"),
        F.col("json").alias("value"))

    def separated(rows: DataFrame) -> DataFrame:
        # A comma leads every element but the first.  The first element and those equal to it become one row.
        least = rows.agg(F.min(F.struct("key", "value")).alias("least"))
        first = (F.col("key") == least.select("least.key").scalar()) & (F.col("value") == least.select("least.value").scalar())
        head = rows.where(first).groupBy("section", "key", "value").count().select(
            "section", "key", F.expr("concat(value, repeat(concat(',', value), int(count) - 1))").alias("value"))
        return head.unionByName(rows.where(~first).withColumn("value", F.concat(F.lit(","), F.col("value"))))

    frame = spark.createDataFrame(
        [(0, "", head), (2, "", ']}},"results":['), (4, "", "]}]}")], "section int, key string, value string")
    return frame.unionByName(separated(rules)).unionByName(separated(results))


def lineage_delta(reports: DataFrame, bucket: str = "day") -> DataFrame:
    """Change in HIGH findings against the previous scan of the same root report.

    The lag runs per (root, time bucket); only the first scan of a bucket looks at the
    previous bucket's last scan, found in the per-bucket summary.  So a root that owns a
    third of all reports is spread over its buckets instead of sorted in one task.
    """
    r = (
        reports.withColumn("root", F.coalesce("parent_id", "id"))
        .withColumn("_b", F.date_trunc(bucket, "uploaded_at"))
        .withColumn("_key", F.struct(F.when(F.col("parent_id").isNull(), 0).otherwise(1), "uploaded_at", "id"))
    )
    # The root itself leads its chain whatever its time.
    r = r.withColumn("_b", F.when(F.col("parent_id").isNull(), F.lit("0001-01-01").cast("timestamp"))
                     .otherwise(F.col("_b")))
    within = Window.partitionBy("root", "_b").orderBy("_key")
    summary = r.groupBy("root", "_b").agg(F.max_by("high", "_key").alias("_last"))
    carried = summary.select(
        "root", "_b", F.lag("_last").over(Window.partitionBy("root").orderBy("_b")).alias("_carry"))
    with_prev = (
        r.withColumn("_prev", F.lag("high").over(within)).withColumn("_rn", F.row_number().over(within))
        .join(carried, ["root", "_b"])
        .withColumn("previous_high", F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col("_prev")))
    )
    delta = F.col("high") - F.col("previous_high")
    return with_prev.select(
        "root", "id", "uploaded_at", "high", F.coalesce(delta, F.lit(0)).alias("delta"),
        F.when(delta > 0, "worse").when(delta < 0, "better").when(delta == 0, "same").otherwise("first").alias("trend"))


def recent_reports(reports: DataFrame, k: int = 10) -> DataFrame:
    return reports.orderBy(F.desc("uploaded_at"), F.desc("id")).limit(k)


def page(rows: DataFrame, order: list, number: int = 1, limit: int = 20) -> DataFrame:
    """One page of a listing; the limit is clamped to 1..100."""
    limit = min(100, max(1, limit))
    return rows.orderBy(*order).offset((max(1, number) - 1) * limit).limit(limit)


def page_by_range(rows: DataFrame, key: Column, bucket: Column, order: list, number: int = 1, limit: int = 20,
                  descending: bool = False) -> DataFrame:
    """A page of a long listing that sorts one range of its leading key instead of all rows.

    ``bucket`` is a coarser value of the key that keeps its order, such as a day.  Rows are counted for each
    bucket; only the buckets that the page lies in, of which a row each is gathered, are read and sorted.
    """
    limit = min(100, max(1, limit))
    skip = (max(1, number) - 1) * limit
    upto = Window.orderBy(F.desc_nulls_last("b") if descending else F.asc_nulls_first("b")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    counts = rows.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(upto))
    hit = counts.where((F.col("upto") > skip) & (F.col("upto") - F.col("n") < skip + limit)).orderBy("upto").collect()
    if not hit:
        return rows.limit(0)
    inside = F.lit(False)
    for r in hit:
        inside = inside | bucket.eqNullSafe(F.lit(r["b"]))
    return rows.where(inside).orderBy(*order).offset(skip - (hit[0]["upto"] - hit[0]["n"])).limit(limit)


def page_counts(rows: DataFrame, limit: int = 20) -> DataFrame:
    limit = min(100, max(1, limit))
    return rows.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / limit))


def with_age(rows: DataFrame, column: str, now) -> DataFrame:
    return rows.withColumn("age", tx.age_text(F.col(column), F.lit(now).cast("timestamp")))
