"""Advisory tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codescan.schemas import ADVISORY

OSV = ("id string, summary string, severity array<struct<type:string,score:string>>, "
       "affected array<struct<package:struct<ecosystem:string,name:string>,versions:array<string>,"
       "ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>>>")


def read_advisories(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """Advisories stored with the library's own schema, as JSON lines or parquet."""
    return spark.read.schema(ADVISORY).format(form).load(path)


def _affected(spark: SparkSession, path: str, *more) -> DataFrame:
    rows = spark.read.schema(OSV).json(path)
    return rows.select("id", "summary", "severity", F.explode("affected").alias("a")).select(
        F.col("a.package.ecosystem").alias("ecosystem"), F.col("a.package.name").alias("name"), *more,
        F.lit(0).alias("seq"), "id", "summary", "severity")


def read_osv_dump(spark: SparkSession, path: str) -> DataFrame:
    """A dump of OSV records, one JSON document per line: a row per listed version of an affected package.

    Records have no order of their own; ``seq`` is 0, so the smallest ids come first.
    """
    return _affected(spark, path, F.explode("a.versions").alias("version"))


def read_osv_ranges(spark: SparkSession, path: str) -> DataFrame:
    """The version ranges of the same dump: (ecosystem, name, introduced, fixed, last_affected, ...).

    Every ``introduced`` event opens a range that the event after it closes, if there is one.
    Ranges of commits are left out; no manifest names a commit.
    """
    ranges = F.filter(F.coalesce("a.ranges", F.array().cast("array<struct<type:string,events:array<struct<introduced:string,"
                                                            "fixed:string,last_affected:string>>>>")), lambda r: r["type"] != "GIT")
    spans = F.flatten(F.transform(ranges, lambda r: F.filter(F.transform(r["events"], lambda e, i: F.struct(
        e["introduced"].alias("introduced"), F.get(r["events"], i + 1)["fixed"].alias("fixed"),
        F.get(r["events"], i + 1)["last_affected"].alias("last_affected"))), lambda s: s["introduced"].isNotNull())))
    rows = _affected(spark, path, F.explode(spans).alias("r"))
    return rows.select("ecosystem", "name", "r.introduced", "r.fixed", "r.last_affected", "seq", "id", "summary", "severity")
