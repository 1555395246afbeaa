"""CI build reports: validation, ownership, de-duplication, listing, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codescan.operators.skew import salted_lookup
from codescan.rules.languages import BUILD_STATUSES


def _blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def validation_errors(prefix: str = "") -> Column:
    """Array of messages; empty for a valid report."""
    col = lambda name: F.col(prefix + name)
    checks = [F.when(_blank(col(f)), F.lit(f"Missing required field: {f}")) for f in ("buildId", "branch")]
    checks.append(F.when(col("commit").isNull(), F.lit("Missing required field: commit")))
    checks += [F.when(_blank(col(f)), F.lit(f"Missing required field: {f}")) for f in ("status", "timestamp")]
    checks.append(F.when(~_blank(col("status")) & ~col("status").isin(*BUILD_STATUSES),
                         F.lit("status must be one of: success, failure, cancelled")))
    for part in ("sha", "author"):
        checks.append(F.when(col("commit").isNotNull() & _blank(col(f"commit.{part}")),
                             F.lit(f"commit.{part} is required")))
    return F.array_compact(F.array(*checks))


def validate_builds(reports: DataFrame) -> DataFrame:
    return reports.withColumn("errors", validation_errors())


def valid_builds(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("errors") == 0).drop("errors")


def rejected_builds(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("errors") > 0)


def flatten_builds(reports: DataFrame) -> DataFrame:
    """Stored columns of a report; ``received_at`` and ``webhook_secret`` pass through."""
    extra = [c for c in ("received_at", "webhook_secret", "owner_id") if c in reports.columns]
    count = lambda f: F.coalesce(F.col(f"testResults.{f}"), F.lit(0)).alias(f"test_{f}")
    body = [c for c in reports.columns if c not in extra]
    return reports.select(
        *extra, F.col("buildId").alias("build_id"), "branch", F.col("commit.sha").alias("commit_sha"),
        F.col("commit.message").alias("commit_message"), F.col("commit.author").alias("author"), "status",
        F.col("duration").alias("duration_ms"), F.col("pipeline.name").alias("pipeline_name"),
        F.col("pipeline.url").alias("pipeline_url"), count("passed"), count("failed"), count("skipped"),
        F.to_json(F.struct(*body)).alias("raw_json"))


def assign_owner(reports: DataFrame, owners: DataFrame) -> DataFrame:
    """Owner by webhook secret; reports with an unknown secret are left out."""
    o = owners.select(F.col("id").alias("owner_id"), F.col("username").alias("owner_username"), "webhook_secret")
    return salted_lookup(reports, o, ["webhook_secret"]).drop("webhook_secret")


def unowned(reports: DataFrame, owners: DataFrame) -> DataFrame:
    return salted_lookup(reports, owners.select("webhook_secret"), ["webhook_secret"], how="left_anti")


def first_builds(reports: DataFrame, order: str = "received_at") -> DataFrame:
    """The first report per build id; map-side combined."""
    rest = [c for c in reports.columns if c != "build_id"]
    return (reports.groupBy("build_id").agg(F.min_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order]))
            .alias("_r")).select("build_id", "_r.*"))


def new_builds(reports: DataFrame, stored: DataFrame) -> DataFrame:
    """Reports whose build id is not stored yet, the first of each id."""
    return first_builds(reports).join(stored.select("build_id"), "build_id", "left_anti")


def conflicting_builds(reports: DataFrame, stored: DataFrame) -> DataFrame:
    return reports.join(stored.select("build_id").distinct(), "build_id", "left_semi")


def scope_builds(builds: DataFrame, role: str, user_id: int | None, branch: str = "", status: str = "",
                 branch_like: str = "") -> DataFrame:
    """Members see their own rows, admins all; optional exact or substring filters."""
    out = builds if role == "admin" else builds.where(F.col("owner_id") == user_id)
    if branch:
        out = out.where(F.col("branch") == branch)
    if status:
        out = out.where(F.col("status") == status)
    if branch_like:
        out = out.where(F.lower("branch").contains(branch_like.strip().lower()))
    return out


def owner_enrich(builds: DataFrame, owners: DataFrame) -> DataFrame:
    names = owners.select(F.col("id").alias("owner_id"), F.col("username").alias("owner_username"))
    return salted_lookup(builds, names, ["owner_id"], how="left")


def build_summary(builds: DataFrame, now, *by: str) -> DataFrame:
    """Number of builds, 30-day success rate, mean duration over all rows, last status."""
    recent = F.col("received_at") >= F.lit(now).cast("timestamp") - F.expr("interval 30 days")
    n_recent = F.count_if(recent)
    return builds.groupBy(*by).agg(
        F.count("*").alias("total_builds"),
        F.when(n_recent > 0, F.floor(F.count_if(recent & (F.col("status") == "success")) * 100 / n_recent + 0.5))
        .cast("long").alias("success_rate"),
        F.floor(F.avg("duration_ms") + 0.5).cast("long").alias("avg_duration"),
        F.max_by("status", F.struct("received_at", "build_id")).alias("last_status"))


def owner_report_counts(owners: DataFrame, builds: DataFrame) -> DataFrame:
    """Reports per owner, 0 included; builds are counted before the join."""
    counts = builds.groupBy("owner_id").agg(F.count("*").alias("n"))
    return (
        owners.join(counts, owners["id"] == counts["owner_id"], "left")
        .select(owners["*"], F.coalesce("n", F.lit(0)).alias("report_count"))
    )
