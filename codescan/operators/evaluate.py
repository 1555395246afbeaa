"""Scoring of findings against labelled cases, tool comparison, the build gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codescan.operators.skew import salted_lookup


def normalise_path(path: Column, root: str = "corpus") -> Column:
    """Path from the first ``root`` component on, else the base name."""
    parts = F.split(path, "/")
    at = F.array_position(parts, root)
    return F.when(at > 0, F.array_join(F.slice(parts, F.greatest(at, F.lit(1)), F.size(parts)), "/")).otherwise(
        F.element_at(parts, -1))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def detected_cases(cases: DataFrame, findings: DataFrame, exact_only: bool = False) -> DataFrame:
    """Cases with a flag: some finding has the same path, or failing that the same base name."""
    files = findings.select(normalise_path(F.col("file")).alias("path")).distinct()
    by_path = files.withColumn("_exact", F.lit(True))
    out = cases.withColumn("path", normalise_path(F.col("file"))).join(by_path, "path", "left")
    if exact_only:
        return out.withColumn("found", F.coalesce("_exact", F.lit(False))).drop("_exact", "path")
    names = files.select(base_name(F.col("path")).alias("name")).distinct().withColumn("_named", F.lit(True))
    return (
        salted_lookup(out.withColumn("name", base_name(F.col("file"))), names, ["name"], how="left")
        .withColumn("found", F.coalesce("_exact", "_named", F.lit(False))).drop("_exact", "_named", "path", "name")
    )


def verdict(vulnerable: Column, found: Column) -> Column:
    return (F.when(vulnerable & found, "TP").when(vulnerable, "FN").when(found, "FP").otherwise("TN"))


def detail_rows(detected: DataFrame) -> DataFrame:
    v = verdict(F.col("vulnerable"), F.col("found"))
    return detected.withColumn("result", v).withColumn("wrong", v.isin("FN", "FP"))


def confusion(detected: DataFrame, language: str | None = None) -> DataFrame:
    """TP, FP, FN, TN overall, per category and per language in one pass."""
    rows = detected.where(F.col("language") == language) if language else detected
    v = verdict(F.col("vulnerable"), F.col("found"))
    return (
        rows.withColumn("result", v)
        .groupingSets([[], ["category"], ["language"]], "category", "language")
        .agg(F.grouping_id().alias("_level"), *[F.count_if(F.col("result") == r).alias(r) for r in ("TP", "FP", "FN", "TN")])
        .withColumn("scope", F.when(F.col("_level") == 3, "all").when(F.col("_level") == 1, "category").otherwise("language"))
        .select("scope", F.coalesce("category", "language", F.lit("")).alias("value"), "TP", "FP", "FN", "TN")
    )


def metrics(counts: DataFrame, digits: int | None = None) -> DataFrame:
    """precision, recall, f1 and fpr; 0 where a denominator is 0."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("TP", "FP", "FN", "TN"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    out = {"precision": precision, "recall": recall, "f1": ratio(2 * precision * recall, precision + recall),
           "fpr": ratio(fp, fp + tn)}
    return counts.select("*", *[(F.round(c, digits) if digits is not None else c).alias(n) for n, c in out.items()])


def tool_compare(per_tool: DataFrame, tools: list[str], measures=("precision", "recall", "f1", "fpr")) -> DataFrame:
    """Measures as rows, tools as columns; NULL where a tool was not run."""
    long = per_tool.select("tool", F.explode(F.array(
        *[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in measures])).alias("x")).select("tool", "x.*")
    return long.groupBy("measure").pivot("tool", tools).agg(F.max("v"))


def tool_severity(tool_findings: DataFrame) -> DataFrame:
    """HIGH, MEDIUM and LOW counts per tool; other severities are ignored."""
    sev = F.upper("severity")
    return tool_findings.groupBy("tool").agg(*[F.count_if(sev == s).alias(s.lower()) for s in ("HIGH", "MEDIUM", "LOW")])


def gate(tool_findings: DataFrame, block_critical: bool = False) -> DataFrame:
    """One row: whether the build fails, and why.

    A HIGH of the code scanners or any vulnerable dependency blocks.  CRITICAL blocks only
    with ``block_critical``.
    """
    sev = F.upper("severity")
    code = F.col("tool").isin("bandit", "codescan")
    return (
        tool_findings.agg(
            F.count_if(code & (sev == "HIGH")).alias("high"),
            F.count_if(code & (sev == "CRITICAL")).alias("critical"),
            F.count_if(F.col("tool") == "safety").alias("dependencies"))
        .withColumn("failed", (F.col("high") > 0) | (F.col("dependencies") > 0)
                    | (F.lit(block_critical) & (F.col("critical") > 0)))
    )


def scan_gate(findings: DataFrame) -> DataFrame:
    """Whether a scan fails by itself: any CRITICAL or HIGH finding."""
    return findings.agg(F.count_if(F.col("severity").isin("CRITICAL", "HIGH")).alias("blocking")).withColumn(
        "failed", F.col("blocking") > 0)


def corpus_profile(cases: DataFrame) -> DataFrame:
    return cases.agg(
        F.count("*").alias("cases"), F.count_if("vulnerable").alias("vulnerable"),
        F.count_if(~F.col("vulnerable")).alias("safe"), F.countDistinct("language").alias("languages"),
        F.countDistinct("category").alias("categories"))
