"""What several steps read is kept once, and a batch is read by its columns."""

import pyarrow as pa
from pyspark.sql import functions as F

from codescan.operators import dependencies as dp
from codescan.operators import findings as fd
from codescan.operators.outline import files_of
from codescan.plans.scan import scan_files
from tests.conftest import rows


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_passes_of_a_scan_run_once(spark, monkeypatch):
    """The filter of unconfirmed findings reads them three times: from a table, not from the passes."""
    seen, keep = [], fd.drop_unconfirmed
    monkeypatch.setattr(fd, "drop_unconfirmed", lambda found: seen.append(found) or keep(found))
    files = spark.createDataFrame([("a.py", "python", "x = eval(data)\n"), ("b.php", "php", "<?php\necho 1;\n")],
                                  "file string, language string, content string")
    assert ("a.py", 1, "SEC002") in rows(scan_files(files), "file", "line", "rule_id")
    assert "Generate" not in plan_of(seen[0]) and "Aggregate" not in plan_of(seen[0])


def test_dependencies_with_ranges_are_read_once(spark):
    deps = spark.range(6).select(
        F.concat(F.lit("f"), "id").alias("file"), F.lit(1).alias("line"), F.lit("PyPI").alias("ecosystem"), F.lit("p").alias("name"),
        F.when(F.col("id") == 5, "").otherwise(F.concat(F.lit("1."), "id")).alias("version"))
    scored = "ecosystem string, name string, {} seq int, id string, summary string, severity array<struct<type:string,score:string>>"
    listed = spark.createDataFrame([("PyPI", "p", "1.0", 0, "A", "s", [])], scored.format("version string,"))
    ranges = spark.createDataFrame([("PyPI", "p", "1.2", "1.4", None, 1, "B", "s", [])],
                                   scored.format("introduced string, fixed string, last_affected string,"))
    found = dp.scan_dependencies(deps, listed, ranges=ranges)
    assert "Range (" not in plan_of(found)
    assert rows(found.withColumn("id", F.regexp_extract("message", r"vulnerability (\S+):", 1)), "file", "id") == {
        ("f0", "A"), ("f2", "B"), ("f3", "B"), ("f5", "A"), ("f5", "B")}


def test_files_of_a_batch():
    fields = [("line_no", pa.int32()), ("raw", pa.string()), ("snippet", pa.string()), ("code", pa.string())]
    lines = [[dict(line_no=i, raw=f"r{i}", snippet=f"s{i}", code=f"c{i}") for i in range(n)] if n is not None else None
             for n in (2, None, 0, 30_000, 1, 15_000, 4_000, 3_000)]
    names = [f"f{i}" for i in range(len(lines))]
    batch = pa.RecordBatch.from_arrays([pa.array(names), pa.array(["go"] * len(lines)), pa.array(lines, pa.list_(pa.struct(fields)))],
                                       ["file", "language", "lines"])
    for first, size in ((0, 8), (2, 4), (0, 0)):
        assert list(files_of(batch.slice(first, size))) == [
            (f, "go", x or []) for f, x in zip(names[first:first + size], lines[first:first + size])]
