"""Dependency manifests to (file, line, ecosystem, name, version) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codescan.functions import text as tx
from codescan.operators.lines import all_lines
from codescan.rules.languages import EXCLUDED_DIRS
from codescan.session import cut_lineage
from codescan.sources.corpus import base_name, in_excluded_dir, named_by_repo

OUT = ["file", "line", "ecosystem", "name", "version"]


def manifest_kind(path: Column) -> Column:
    name = base_name(path)
    return (F.when(name.rlike(r"requirements.*\.txt$"), "requirements")
            .when(name.rlike(r"package\.json$"), "package_json")
            .when(name.rlike(r"go\.mod$"), "go_mod")
            .when(name.rlike(r"pom\.xml$"), "pom"))


def parse_requirements(files: DataFrame) -> DataFrame:
    spec = F.trim(F.substring_index(F.regexp_replace(tx.strip(F.col("line")), r"\[.*?\]", ""), ";", 1))
    pattern = r"^([A-Za-z0-9_\-.]+)\s*(?:[=~!<>]+\s*([\w.]+))?"
    return (
        all_lines(files.select("file", "content"))
        .where(~tx.strip(F.col("line")).rlike("^($|#|-)"))
        .select("file", F.col("line_no").alias("line"), F.lit("PyPI").alias("ecosystem"),
                F.regexp_extract(spec, pattern, 1).alias("name"), F.regexp_extract(spec, pattern, 2).alias("version"))
        .where(F.col("name") != "")
    )


def parse_package_json(files: DataFrame) -> DataFrame:
    section = "map<string,string>"
    doc = F.from_json("content", f"dependencies {section}, devDependencies {section}, peerDependencies {section}")
    one = lambda s: F.coalesce(F.map_entries(F.col(f"d.{s}")), F.array().cast(
        "array<struct<key:string,value:string>>"))
    return (
        files.select("file", doc.alias("d"))
        .select("file", F.explode(F.concat(one("dependencies"), one("devDependencies"), one("peerDependencies"))).alias("e"))
        .select("file", F.lit(1).alias("line"), F.lit("npm").alias("ecosystem"), F.col("e.key").alias("name"),
                F.btrim(F.regexp_replace("e.value", "[^0-9.]", ""), F.lit(".")).alias("version"))
    )


def parse_go_mod(files: DataFrame) -> DataFrame:
    pattern = r"^(?:\s*require\s+|\s+)(\S+)\s+(v[\w.\-]+)"
    return (
        all_lines(files.select("file", "content"))
        .select("file", F.col("line_no").alias("line"), F.lit("Go").alias("ecosystem"),
                F.regexp_extract("line", pattern, 1).alias("name"),
                F.ltrim(F.regexp_extract("line", pattern, 2), F.lit("v")).alias("version"))
        .where(F.col("name") != "")
    )


def parse_pom(files: DataFrame) -> DataFrame:
    tag = lambda t: F.trim(F.regexp_extract("b", rf"(?s)<{t}>(.*?)</{t}>", 1))
    plain = F.regexp_replace("content", r"(?s)<!--.*?-->", "")
    return (
        files.select("file", F.explode(F.regexp_extract_all(plain, F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))).alias("b"))
        .select("file", F.lit(1).alias("line"), F.lit("Maven").alias("ecosystem"),
                F.when(tag("groupId") != "", F.concat(tag("groupId"), F.lit(":"), tag("artifactId")))
                .otherwise(tag("artifactId")).alias("name"),
                F.btrim(tag("version"), F.lit("${}")).alias("version"), tag("artifactId").alias("_a"))
        .where(F.col("_a") != "").drop("_a")
    )


def read_dependencies(files: DataFrame, exclude=EXCLUDED_DIRS) -> DataFrame:
    """All dependencies named in the manifests of a (file, content) table, outside excluded folders.

    The corpus is read once: its manifests, a small part, are kept in the shared folder and parsed there.
    """
    kept = named_by_repo(files)
    kept = kept.where(~in_excluded_dir(F.col("file"), exclude)) if exclude else kept
    kept = cut_lineage(kept.select("file", "content", manifest_kind(F.col("file")).alias("kind")).where(F.col("kind").isNotNull()))
    parsers = {"requirements": parse_requirements, "package_json": parse_package_json, "go_mod": parse_go_mod,
               "pom": parse_pom}
    out = None
    for kind, parse in parsers.items():
        rows = parse(kept.where(F.col("kind") == kind)).select(*OUT)
        out = rows if out is None else out.unionByName(rows)
    return out
