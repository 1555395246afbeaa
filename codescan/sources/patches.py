"""Commit patches to added lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codescan.functions import text as tx
from codescan.schemas import PATCHES

FILE_LINE = r"^diff --git a/(.+) b/\1(?:\n|$)"
HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@"


def read_patches(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """(sha, commit_ts, patch) rows, as JSON lines or parquet."""
    return spark.read.schema(PATCHES).format(form).load(path)


def recent_commits(patches: DataFrame, max_commits: int = 100, since: str | None = None) -> DataFrame:
    rows = patches.where(F.col("commit_ts") >= F.lit(since).cast("timestamp")) if since else patches
    return rows.orderBy(F.desc("commit_ts"), "sha").limit(max_commits)


def added_lines(patches: DataFrame, key: tuple[str, ...] = ("sha",)) -> DataFrame:
    """(key, file, line, text) of the lines a patch adds.

    A patch is cut at its file headers, those pieces at their hunk headers, and the added
    lines of a hunk are numbered from its start.  All of it happens inside the patch's
    row: no shuffle, however large a commit is.
    """
    plain = F.regexp_replace("patch", tx.LINE_BREAK, "\n")
    added = F.filter(F.split("_hunk", "\n"), lambda x: x.startswith("+") & ~x.startswith("+++"))
    return (
        patches.select(*key, F.explode(F.split(plain, r"(?m)^(?=diff --git )")).alias("_piece"))
        .select(*key, F.regexp_extract("_piece", FILE_LINE, 1).alias("file"),
                F.explode(F.split("_piece", r"(?m)^(?=@@ )")).alias("_hunk"))
        .where(F.col("_hunk").rlike(HUNK))
        .select(*key, "file", F.regexp_extract("_hunk", HUNK, 1).cast("int").alias("_start"),
                F.posexplode(added).alias("_i", "_raw"))
        .select(*key, "file", (F.col("_start") + F.col("_i")).alias("line"),
                F.substring("_raw", 2, 1 << 30).alias("text"))
    )
