"""Build reports in batch and as streams."""

import json

from pyspark.sql import functions as F

from codescan import schemas
from codescan.operators import builds as bd
from codescan.operators import findings as fd
from codescan.operators import report as rp
from codescan.operators import secrets
from codescan.plans import q_builds
from codescan.plans.q_lines import documents
from codescan.streaming import builds as sb
from codescan.streaming import scan as ss
from tests.conftest import rows

VALID = {"buildId": "b1", "branch": "main", "commit": {"sha": "s", "message": "m", "author": "a"}, "status": "success",
         "timestamp": "2024-01-01T00:00:00Z", "duration": 10, "pipeline": {"name": "ci", "url": "u"}}


def reports(spark, *changes):
    docs = [json.dumps({**VALID, **c}) for c in changes]
    return spark.read.schema(schemas.BUILD_REPORT).json(spark.sparkContext.parallelize(docs))


def test_validation(spark):
    got = [r.errors for r in bd.validate_builds(reports(
        spark, {}, {"buildId": None}, {"branch": ""}, {"status": "green"}, {"commit": None}, {"commit": {"sha": "", "author": None}},
        {"status": "cancelled"}, {"timestamp": None, "status": None})).collect()]
    assert got == [[], ["Missing required field: buildId"], ["Missing required field: branch"],
                   ["status must be one of: success, failure, cancelled"], ["Missing required field: commit"],
                   ["commit.sha is required", "commit.author is required"], [],
                   ["Missing required field: status", "Missing required field: timestamp"]]


def test_flatten(spark):
    row = bd.flatten_builds(reports(spark, {"testResults": {"passed": 3}})).first()
    assert (row.build_id, row.author, row.test_passed, row.test_failed, row.pipeline_name) == ("b1", "a", 3, 0, "ci")
    assert json.loads(row.raw_json)["commit"]["sha"] == "s"
    assert bd.flatten_builds(reports(spark, {"pipeline": None})).first().pipeline_name is None


def stored(spark, data):
    return spark.createDataFrame(data, "build_id string, t string, owner_id long, branch string, status string, duration_ms long").withColumn(
        "received_at", F.to_timestamp("t")).drop("t")


def test_uniqueness(spark):
    first = stored(spark, [("a", "2024-01-01", 1, "m", "success", 1), ("a", "2024-01-02", 1, "m", "failure", 2)])
    later = stored(spark, [("a", "2024-01-03", 1, "m", "failure", 1), ("b", "2024-01-03", 1, "m", "failure", 1)])
    kept = bd.first_builds(first)
    assert rows(kept, "build_id", "status") == {("a", "success")}
    assert rows(bd.new_builds(later, kept), "build_id") == {("b",)}
    assert rows(bd.conflicting_builds(later, kept), "build_id") == {("a",)}


def test_summary_and_listing(spark):
    df = stored(spark, [("a", "2024-01-01", 1, "main", "success", 100), ("b", "2024-03-01", 1, "main", "failure", None),
                        ("c", "2024-03-02", 2, "Feature/x", "success", 200), ("d", "2024-03-03", 2, "main", "success", 300)])
    s = bd.build_summary(df, "2024-03-10").first()
    assert tuple(s) == (4, 67, 200, "success")
    assert bd.build_summary(df, "2025-03-10").first().success_rate is None
    assert bd.build_summary(df.where("false"), "2024-03-10").first().total_builds == 0
    assert rows(bd.scope_builds(df, "member", 2), "build_id") == {("c",), ("d",)}
    assert rows(bd.scope_builds(df, "admin", None, branch="main", status="success"), "build_id") == {("a",), ("d",)}
    assert rows(bd.scope_builds(df, "admin", None, branch_like=" feat"), "build_id") == {("c",)}
    assert [r.build_id for r in rp.page(df, [F.desc("received_at")], 2, 3).collect()] == ["a"]
    assert rp.page(df, [F.desc("received_at")], -1, 0).count() == 1
    assert tuple(rp.page_counts(df, 3).first()) == (4, 2)


def test_owners(spark):
    owners = spark.createDataFrame([(1, "ann", "s1"), (2, "bob", "s2"), (3, "cy", "s3")], "id long, username string, webhook_secret string")
    raw = spark.createDataFrame([("a", "s1"), ("b", "s9"), ("c", "s1")], "build_id string, webhook_secret string")
    assert rows(bd.assign_owner(raw, owners), "build_id", "owner_username") == {("a", "ann"), ("c", "ann")}
    assert rows(bd.unowned(raw, owners), "build_id") == {("b",)}
    df = stored(spark, [("a", "2024-01-01", 1, "m", "success", 1), ("b", "2024-01-01", 9, "m", "success", 1)])
    assert rows(bd.owner_report_counts(owners, df), "username", "report_count") == {("ann", 1), ("bob", 0), ("cy", 0)}
    assert rows(bd.owner_enrich(df, owners), "build_id", "owner_username") == {("a", "ann"), ("b", None)}


def stream(spark, df, path):
    df.write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_stream_uniqueness_across_batches(spark, tmp_path):
    source, sink, lost, state = (str(tmp_path / n) for n in ("in", "out", "lost", "state"))
    days = [[("a", "2024-01-01"), ("a", "2024-01-01"), ("b", "2024-01-01")], [("a", "2024-03-01"), ("c", "2024-03-01")],
            [("b", "2024-06-01"), ("d", "2024-06-01")]]
    for batch in days:
        df = stored(spark, [(i, t, 1, "m", "success", 1) for i, t in batch])
        sb.dedupe(stream(spark, df, source), sink, lost, state, once=True).awaitTermination()
    got = [r.build_id for r in spark.read.parquet(sink).collect()]
    assert sorted(got) == ["a", "b", "c", "d"]
    # Repeats inside a batch and long after it are all kept apart.
    assert sorted(r.build_id for r in spark.read.parquet(lost).collect()) == ["a", "a", "b"]


def test_stream_rate_equals_batch(spark, tmp_path):
    df = stored(spark, [(str(i), f"2024-01-{1 + i % 20:02d} 05:00:00", 1, "m", "success" if i % 3 else "failure", 1) for i in range(60)])
    rate = stream(spark, df, str(tmp_path / "in"))
    sb.write_success_rate(rate, str(tmp_path / "all"), str(tmp_path / "s1"), mode="complete", once=True, window="3 days").awaitTermination()
    want = rows(sb.success_rate(df, "3 days"), "start", "builds", "success_rate")
    assert rows(spark.read.parquet(str(tmp_path / "all")), "start", "builds", "success_rate") == want
    # Append mode holds back the windows that are still open.
    sb.write_success_rate(rate, str(tmp_path / "closed"), str(tmp_path / "s2"), once=True, window="3 days").awaitTermination()
    closed = rows(spark.read.parquet(str(tmp_path / "closed")), "start", "builds", "success_rate")
    assert closed and closed < want


def test_stream_ingest(spark, tmp_path):
    owners = spark.createDataFrame([(1, "ann", "s1")], "id long, username string, webhook_secret string")
    raw = reports(spark, {}, {"buildId": "b2", "status": "x"}, {"buildId": "b3"}).withColumn(
        "webhook_secret", F.when(F.col("buildId") == "b3", "zz").otherwise("s1")).withColumn("received_at", F.lit("2024-01-01").cast("timestamp"))
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    sb.ingest(stream(spark, raw, str(tmp_path / "in")), owners, good, bad, str(tmp_path / "state"), once=True).awaitTermination()
    assert rows(spark.read.parquet(good), "build_id", "owner_id") == {("b1", 1)}
    assert rows(spark.read.parquet(bad), "build_id", "reason") == {
        ("b2", "status must be one of: success, failure, cancelled"), ("b3", "unknown secret")}


def test_owners_are_not_broadcast(spark):
    """Owners grow with the input: whoever looks them up shuffles both sides."""
    owners = spark.createDataFrame([(1, "ann", "s1"), (2, "bob", None)], "id long, username string, webhook_secret string")
    raw = spark.createDataFrame([("b1", "s1", 1), ("b2", "zz", 2), ("b3", None, 3)], "buildId string, webhook_secret string, owner_id long")
    lost = bd.unowned(raw, owners)
    assert rows(lost, "buildId") == {("b2",), ("b3",)}
    assert rows(bd.owner_enrich(raw, owners), "buildId", "owner_username") == {("b1", "ann"), ("b2", "bob"), ("b3", None)}
    for df in (lost, bd.owner_enrich(raw, owners)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_streams_of_tables_in_folders(spark, tmp_path):
    """A table may be one file or a folder of files; a stream takes all rows of either."""
    docs = spark.createDataFrame([(i, "web", "en", f"password = 'hunter{i}22'\n") for i in range(6)], "doc_id long, source string, lang string, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = q_builds.stream_scan(spark, str(tmp_path))
    want = fd.dedupe_findings(secrets.scan_text(documents(spark, str(tmp_path)))).where("line % 3 <> 0")
    assert rows(got, "file", "line", "rule_id") == rows(want, "file", "line", "rule_id") and got.count() >= 6


def test_stream_scan(spark, tmp_path):
    files = spark.createDataFrame([("a.py", "python", "password = 'hunter2222'\n"), ("b.js", "javascript", "eval(x)\n")],
                                  "file string, language string, content string")
    baseline = spark.createDataFrame([("SEC002:b.js:eval(x)",)], "fingerprint string")
    sink = str(tmp_path / "out")
    ss.scan_stream(stream(spark, files, str(tmp_path / "in")), sink, str(tmp_path / "state"), baseline, once=True).awaitTermination()
    assert rows(spark.read.parquet(sink), "file", "rule_id") == {("a.py", "SEC001")}
