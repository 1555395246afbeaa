"""Queries: build reports, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from codescan.operators import builds as bd
from codescan.operators import findings as fd
from codescan.operators import report as rp
from codescan.operators import secrets
from codescan.plans import tables as tb
from codescan.plans.q_lines import DOC_SCAN, documents
from codescan.plans.tables import derive, duck
from codescan.schemas import FINDING
from codescan.session import work_folder
from codescan.sources import reports as rep
from codescan.streaming import builds as sb
from codescan.streaming import scan as ss

BUILDS = duck(tb.BUILDS_SQL, "events")
# Customers own the builds.
OWNERS_SQL = """
SELECT c_custkey AS id, c_name AS username, concat('secret', CAST(c_custkey AS STRING)) AS webhook_secret,
       CASE WHEN c_custkey % 10 = 0 THEN 'admin' ELSE 'member' END AS role FROM {customer}
"""
OWNERS = duck(OWNERS_SQL, "customer")
# Raw reports, some of them incomplete.
RAW_SQL = """
SELECT CASE WHEN event_id % 17 = 0 THEN NULL ELSE concat('b', CAST(event_id AS STRING)) END AS buildId,
       CASE WHEN event_id % 19 = 0 THEN '' ELSE 'main' END AS branch,
       CASE WHEN event_id % 23 = 0 THEN NULL ELSE named_struct('sha', CASE WHEN event_id % 29 = 0 THEN '' ELSE 'abc' END,
            'message', 'm', 'author', CASE WHEN event_id % 31 = 0 THEN NULL ELSE 'me' END) END AS commit,
       CASE WHEN event_id % 37 = 0 THEN 'green' ELSE 'success' END AS status,
       CASE WHEN event_id % 41 = 0 THEN NULL ELSE '2024-01-01T00:00:00Z' END AS timestamp,
       CAST(value AS BIGINT) AS duration, named_struct('name', 'ci', 'url', 'u') AS pipeline,
       named_struct('passed', 1, 'failed', CAST(NULL AS INT), 'skipped', 0) AS testResults, props AS artifacts,
       props AS metadata, CAST(ts AS TIMESTAMP) AS received_at,
       concat('secret', CAST(user_id * 7 AS STRING)) AS webhook_secret, event_id
FROM {events}
"""


def builds(spark, sf):
    return derive(spark, sf, tb.BUILDS_SQL, "events")


def owners(spark, sf):
    return derive(spark, sf, OWNERS_SQL, "customer")


def raw(spark, sf):
    return derive(spark, sf, RAW_SQL, "events")


def build_validate(spark, sf):
    return bd.validate_builds(raw(spark, sf)).select("event_id", F.array_join("errors", "; ").alias("errors"))


VALIDATE = """
SELECT event_id, array_to_string(list_filter([
  CASE WHEN event_id % 17 = 0 THEN 'Missing required field: buildId' END,
  CASE WHEN event_id % 19 = 0 THEN 'Missing required field: branch' END,
  CASE WHEN event_id % 23 = 0 THEN 'Missing required field: commit' END,
  CASE WHEN event_id % 41 = 0 THEN 'Missing required field: timestamp' END,
  CASE WHEN event_id % 37 = 0 THEN 'status must be one of: success, failure, cancelled' END,
  CASE WHEN event_id % 23 <> 0 AND event_id % 29 = 0 THEN 'commit.sha is required' END,
  CASE WHEN event_id % 23 <> 0 AND event_id % 31 = 0 THEN 'commit.author is required' END], lambda x: x IS NOT NULL), '; ') AS errors
FROM events"""
BAD = " OR ".join(f"event_id % {k} = 0" for k in (17, 19, 23, 29, 31, 37, 41))


def build_flatten(spark, sf):
    rows = bd.flatten_builds(bd.valid_builds(bd.validate_builds(raw(spark, sf))).drop("event_id"))
    return rows.select("build_id", "commit_sha", "author", "status", "duration_ms", "pipeline_name", "test_passed",
                       "test_failed", "test_skipped", F.get_json_object("raw_json", "$.buildId").alias("raw_id"))


FLATTEN = f"""SELECT 'b' || event_id AS build_id, 'abc' AS commit_sha, 'me' AS author, 'success' AS status,
  CAST(trunc(value) AS BIGINT) AS duration_ms, 'ci' AS pipeline_name, 1 AS test_passed, 0 AS test_failed, 0 AS test_skipped,
  'b' || event_id AS raw_id FROM events WHERE NOT ({BAD})"""


def build_owner(spark, sf):
    own = owners(spark, sf)
    rows = raw(spark, sf)
    hit = bd.assign_owner(rows, own).groupBy("owner_username").agg(F.count("*").alias("n"))
    lost = bd.unowned(rows, own).agg(F.count("*").alias("n")).select(F.lit("unowned").alias("owner_username"), "n")
    return hit.unionByName(lost)


OWNER = f"""SELECT coalesce(o.username, 'unowned') AS owner_username, count(*) AS n
FROM events e LEFT JOIN ({OWNERS}) o ON 'secret' || (e.user_id * 7) = o.webhook_secret GROUP BY 1
UNION ALL SELECT 'unowned', 0 WHERE (SELECT count(*) FROM events e WHERE 'secret' || (e.user_id * 7) NOT IN (SELECT webhook_secret FROM ({OWNERS}))) = 0"""


def build_dedupe(spark, sf):
    """Two deliveries: the second half of the events repeats some ids of the first."""
    rows = builds(spark, sf)
    early = rows.where(F.col("received_at") < F.lit("2024-01-16").cast("timestamp"))
    stored = bd.first_builds(early)
    fresh = bd.new_builds(rows.where(F.col("received_at") >= F.lit("2024-01-16").cast("timestamp")), stored)
    return stored.unionByName(fresh).select("build_id", "status", "branch", F.date_format("received_at", "yyyy-MM-dd").alias("day"))


BUILD_DEDUPE = f"""SELECT build_id, status, branch, strftime(received_at, '%Y-%m-%d') AS day FROM (
  SELECT *, row_number() OVER (PARTITION BY build_id ORDER BY received_at) AS rn FROM ({BUILDS})) WHERE rn = 1"""


def build_conflicts(spark, sf):
    rows = builds(spark, sf)
    cut = F.lit("2024-01-16").cast("timestamp")
    out = bd.conflicting_builds(rows.where(F.col("received_at") >= cut), bd.first_builds(rows.where(F.col("received_at") < cut)))
    return out.groupBy("status").agg(F.count("*").alias("n"))


CONFLICTS = f"""SELECT status, count(*) AS n FROM ({BUILDS}) WHERE received_at >= TIMESTAMP '2024-01-16' AND build_id IN (
  SELECT build_id FROM ({BUILDS}) WHERE received_at < TIMESTAMP '2024-01-16') GROUP BY status"""


def build_summary(spark, sf):
    rows = builds(spark, sf)
    overall = bd.build_summary(rows, "2024-02-15 00:00:00").withColumn("branch", F.lit("all"))
    return overall.unionByName(bd.build_summary(rows, "2024-02-15 00:00:00", "branch"))


_SUM = """count(*) AS total_builds,
  CAST(floor(count(*) FILTER (recent AND status = 'success') * 100.0 / count(*) FILTER (recent) + 0.5) AS BIGINT) AS success_rate,
  CAST(floor(avg(duration_ms) + 0.5) AS BIGINT) AS avg_duration, arg_max(status, {'a': received_at, 'b': build_id}) AS last_status"""
SUMMARY = f"""WITH b AS (SELECT *, received_at >= TIMESTAMP '2024-02-15' - INTERVAL 30 DAY AS recent FROM ({BUILDS}))
SELECT 'all' AS branch, {_SUM} FROM b UNION ALL SELECT branch, {_SUM} FROM b GROUP BY branch"""


def owner_report_counts(spark, sf):
    return bd.owner_report_counts(owners(spark, sf), builds(spark, sf)).select("id", "username", "report_count")


OWNER_COUNTS = f"""SELECT o.id, o.username, count(b.owner_id) AS report_count FROM ({OWNERS}) o LEFT JOIN ({BUILDS}) b ON b.owner_id = o.id GROUP BY ALL"""


def build_scope(spark, sf):
    rows = builds(spark, sf)
    mine = bd.scope_builds(rows, "member", 7, status="success").withColumn("who", F.lit("member"))
    everyone = bd.scope_builds(rows, "admin", None, branch_like=" FEAT").withColumn("who", F.lit("admin"))
    return mine.unionByName(everyone).groupBy("who", "branch", "status").agg(F.count("*").alias("n"))


SCOPE = f"""SELECT 'member' AS who, branch, status, count(*) AS n FROM ({BUILDS}) WHERE owner_id = 7 AND status = 'success' GROUP BY ALL
UNION ALL SELECT 'admin', branch, status, count(*) FROM ({BUILDS}) WHERE contains(lower(branch), 'feat') GROUP BY ALL"""


def owner_enrich(spark, sf):
    rows = bd.owner_enrich(builds(spark, sf), owners(spark, sf).where("role = 'member'"))
    return rows.groupBy("owner_username").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("ms"))


ENRICH = f"""SELECT o.username AS owner_username, count(*) AS n, CAST(sum(duration_ms) AS BIGINT) AS ms FROM ({BUILDS}) b
LEFT JOIN (SELECT * FROM ({OWNERS}) WHERE role = 'member') o ON b.owner_id = o.id GROUP BY 1"""


def page_builds(spark, sf):
    rows = bd.scope_builds(builds(spark, sf), "admin", None, branch="main")
    return rp.page(rows, [F.desc("received_at"), "build_id"], number=3, limit=500).select(
        "build_id", "status", F.date_format("received_at", "yyyy-MM-dd HH:mm:ss").alias("at"))


PAGE = f"""SELECT build_id, status, strftime(received_at, '%Y-%m-%d %H:%M:%S') AS at FROM ({BUILDS}) WHERE branch = 'main'
ORDER BY received_at DESC, build_id LIMIT 100 OFFSET 200"""


def page_deep(spark, sf):
    """The page in the middle of all builds, found by counts per day."""
    rows = builds(spark, sf)
    number = rows.count() // 40 + 1
    return rp.page_by_range(rows, F.col("received_at"), F.date_trunc("day", "received_at"), [F.desc("received_at"), "build_id", "status"],
                            number, descending=True).select("build_id", "status", F.date_format("received_at", "yyyy-MM-dd HH:mm:ss").alias("at"))


PAGE_DEEP = f"""SELECT build_id, status, strftime(received_at, '%Y-%m-%d %H:%M:%S') AS at FROM ({BUILDS})
ORDER BY received_at DESC, build_id, status LIMIT 20 OFFSET (SELECT CAST(count(*) // 40 * 20 AS BIGINT) FROM ({BUILDS}))"""


def page_counts(spark, sf):
    return rp.page_counts(bd.scope_builds(builds(spark, sf), "admin", None, status="failure"), 25)


# --- streams --------------------------------------------------------------------
def arriving(spark, sf, name):
    """A table as a stream of its files, be it one file or a folder of them; only a pattern may match either."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def delivered(spark, sf, turn):
    """The builds as a stream of four deliveries, a batch each; ``turn`` numbers the delivery of a row from 0 to 3."""
    rows = builds(spark, sf).withColumn("turn", turn)
    path = work_folder(spark, "deliveries")
    for i in range(4):
        rows.where(F.col("turn") == i).drop("turn").write.mode("append").parquet(path)
    files = spark.read.parquet(path)
    # A delivery is as many files as there were tasks.
    size = max(1, len(files.inputFiles()) // 4)
    return spark.readStream.schema(files.schema).option("maxFilesPerTrigger", size).parquet(path)


def stream_build_window(spark, sf):
    """Windows of 30 days over four deliveries in order of time, each written once it is closed."""
    sink = work_folder(spark, "rate")
    lo, hi = builds(spark, sf).agg(F.min(F.unix_timestamp("received_at")), F.max(F.unix_timestamp("received_at")) + 1).first()
    turn = F.floor((F.unix_timestamp("received_at") - lo) * 4 / (hi - lo))
    sb.write_success_rate(delivered(spark, sf, turn), sink, work_folder(spark, "state"), once=True).awaitTermination()
    return spark.read.parquet(sink).select(
        F.date_format("start", "yyyy-MM-dd").alias("start"), "builds", "successes", "success_rate")


ROLLING = f"""
SELECT strftime(start, '%Y-%m-%d') AS start, count(*) AS builds, count(*) FILTER (status = 'success') AS successes,
  CAST(floor(count(*) FILTER (status = 'success') * 100.0 / count(*) + 0.5) AS BIGINT) AS success_rate
FROM (SELECT status, unnest(list_transform(range(0, 30), lambda i: date_trunc('day', received_at) - to_days(CAST(i AS INT)))) AS start FROM ({BUILDS}))
GROUP BY 1"""
# A window is closed when the last report is a day beyond its end.
WINDOWS = f"""SELECT * FROM ({ROLLING}) WHERE CAST(start AS TIMESTAMP) + INTERVAL 31 DAY <= (SELECT max(received_at) FROM ({BUILDS}))"""


def rolling_success_rate(spark, sf):
    return sb.success_rate(builds(spark, sf)).select(
        F.date_format("start", "yyyy-MM-dd").alias("start"), "builds", "successes", "success_rate")


def stream_dedupe(spark, sf):
    """Builds that are kept, and every repeat, of four deliveries that repeat each other's ids."""
    sink, repeats = work_folder(spark, "unique"), work_folder(spark, "conflicts")
    turn = F.pmod(F.unix_timestamp("received_at"), F.lit(4))
    sb.dedupe(delivered(spark, sf, turn), sink, repeats, work_folder(spark, "state"), once=True).awaitTermination()
    read = lambda path, kind: spark.read.schema("build_id string").parquet(path).select("build_id", F.lit(kind).alias("kind"))
    return read(sink, "kept").unionByName(read(repeats, "repeat"))


STREAM_DEDUPE = f"""SELECT build_id, CASE WHEN row_number() OVER (PARTITION BY build_id ORDER BY received_at) = 1 THEN 'kept' ELSE 'repeat' END AS kind
FROM ({BUILDS})"""


def stream_ingest(spark, sf):
    reports = spark.sql(RAW_SQL, events=arriving(spark, sf, "events")).drop("event_id")
    good, bad = work_folder(spark, "good"), work_folder(spark, "bad")
    sb.ingest(reports, owners(spark, sf), good, bad, work_folder(spark, "state"), once=True).awaitTermination()
    return spark.read.schema("build_id string").parquet(good).select(F.lit("").alias("reason")).unionByName(
        spark.read.schema("reason string").parquet(bad).select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


STREAM_INGEST = f"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN 'secret' || (user_id * 7) NOT IN (SELECT webhook_secret FROM ({OWNERS}))
  THEN 'unknown secret' ELSE errors END AS reason FROM ({VALIDATE}) JOIN events USING (event_id)) GROUP BY reason"""


def stream_scan(spark, sf):
    """Documents as a stream of files, all rules, findings of a baseline left out; the same as the batch scan."""
    rows = arriving(spark, sf, "documents")
    sink, stored = work_folder(spark, "found"), work_folder(spark, "baseline")
    known = fd.dedupe_findings(secrets.scan_text(documents(spark, sf))).where(F.col("line") % 3 == 0)
    rep.write_baseline(known, stored)
    ss.scan_stream(spark.sql(tb.FILES_SQL, documents=rows), sink, work_folder(spark, "state"),
                   rep.read_baseline(spark, stored), once=True).awaitTermination()
    return spark.read.schema(FINDING).parquet(sink).select("file", "line", "rule_id", "severity")


STREAM_SCAN = f"""WITH found AS ({DOC_SCAN}), known AS (SELECT DISTINCT rule_id || ':' || file || ':' || substr(code_snippet, 1, 80) AS fp FROM found WHERE line % 3 = 0)
SELECT file, line, rule_id, severity FROM found WHERE rule_id || ':' || file || ':' || substr(code_snippet, 1, 80) NOT IN (SELECT fp FROM known)"""

QUERIES = {
    "build_validate": (build_validate, VALIDATE),
    "build_flatten": (build_flatten, FLATTEN),
    "build_owner": (build_owner, OWNER),
    "build_dedupe": (build_dedupe, BUILD_DEDUPE),
    "build_conflicts": (build_conflicts, CONFLICTS),
    "build_summary_30d": (build_summary, SUMMARY),
    "build_scope": (build_scope, SCOPE),
    "report_count": (lambda s, d: builds(s, d).agg(F.count("*").alias("reports")), f"SELECT count(*) AS reports FROM ({BUILDS})"),
    "owner_report_counts": (owner_report_counts, OWNER_COUNTS),
    "owner_enrich": (owner_enrich, ENRICH),
    "page_builds": (page_builds, PAGE),
    "page_deep": (page_deep, PAGE_DEEP),
    "page_counts": (page_counts, f"SELECT count(*) AS total, CAST(ceil(count(*) / 25) AS BIGINT) AS pages FROM ({BUILDS}) WHERE status = 'failure'"),
    "rolling_success_rate": (rolling_success_rate, ROLLING),
    "stream_build_window": (stream_build_window, WINDOWS),
    "stream_dedupe": (stream_dedupe, STREAM_DEDUPE),
    "stream_ingest": (stream_ingest, STREAM_INGEST),
    "stream_scan": (stream_scan, STREAM_SCAN),
}
