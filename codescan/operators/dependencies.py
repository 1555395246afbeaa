"""Dependencies against advisories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codescan.functions.text import cvss_severity
from codescan.operators.skew import salted_lookup
from codescan.session import cut_lineage

CAP = 3


def first_advisories(advisories: DataFrame, keys: list[str], cap: int = CAP) -> DataFrame:
    """The first ``cap`` advisories per key, as one row with an array.

    ``row_number() <= cap`` prunes each task's rows before the shuffle, so a package that
    owns a third of all advisories sends ``cap`` rows per task.
    """
    w = Window.partitionBy(*keys).orderBy("seq", "id")
    payload = [c for c in advisories.columns if c not in keys and c != "seq"]
    return (
        advisories.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap)
        .groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_rn", *payload))).alias("advisories"))
    )


def version_key(version: Column) -> Column:
    """A text that sorts as versions do: numbers by value, 1.0 like 1, 1.0-rc1 before 1.0.

    Build metadata after ``+`` and a leading ``v`` do not count.
    """
    plain = F.regexp_replace(F.lower(F.trim(version)), r"^v(?=\d)|\+.*$", "")
    release = F.regexp_replace(F.regexp_extract(plain, r"^\d+(?:\.\d+)*", 0), r"(?:\.0+)+$", "")
    rest = F.regexp_replace(F.regexp_replace(plain, r"^\d+(?:\.\d+)*", ""), r"^[.\-_]", "")
    pad = lambda text, cut: F.array_join(F.transform(
        F.split(text, cut), lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 18, "0")).otherwise(p)), ".")
    # '+' sorts before ',' and ',' before '.': first what precedes a release, then the release, then its successors.
    return F.concat(pad(release, r"\."), F.when(rest != "", F.concat(F.lit("+"), pad(rest, r"[.\-_]|(?<=\D)(?=\d)"))).otherwise(","))


PACKAGE = ["ecosystem", "name"]
_DIGITS = 18  # of a number in a version key; so many characters start a key's first part


def _ranked(points: DataFrame) -> DataFrame:
    """Adds rank: how many version keys of the package come before a point (ecosystem, name, key, side).

    Side 0 is a version, -1 a bound before versions of its key, 1 one behind them.  The sweep runs in parts of a
    package, cut by the first number of the version; what a part starts with comes from one row for each part,
    so one package with very many versions is spread over its parts.
    """
    part = [*PACKAGE, "part"]
    points = points.withColumn("part", F.substring("key", 1, _DIGITS))
    is_version = F.when(F.col("side") == 0, 1).otherwise(0)
    within = Window.partitionBy(*part).orderBy("key", "side").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*PACKAGE).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = points.groupBy(*part).agg(F.sum(is_version).alias("n")).select(
        *part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    upto = F.sum(is_version).over(within) - is_version
    return points.withColumn("_in", upto).join(parts, part).withColumn(
        "rank", (F.col("start") + F.col("_in")).cast("int")).drop("part", "start", "_in")


def resolve_ranges(deps: DataFrame, ranges: DataFrame, cap: int | None = None) -> DataFrame:
    """Advisory rows for the versions that occur in ``deps`` and lie in a range; ``fixed`` is outside its range.

    Versions of a package are numbered in order, so a range covers a run of numbers.  A run is cut into
    blocks of 1, 2, 4, ... numbers, of which it needs two of each size at most, and a version lies in one block of
    each size: the join meets only pairs that hold.  With ``cap`` a block keeps so many advisories, the first by (seq, id),
    before it is joined; no version can need more of them.
    """
    used = deps.where(F.col("version") != "").select(*PACKAGE, "version", version_key(F.col("version")).alias("key")).distinct()
    numbered = ranges.withColumn("range", F.monotonically_increasing_id())
    numbered = cut_lineage(numbered)  # the number is stored, so both ends of a range agree on it
    start = F.when(F.col("introduced") != "0", version_key(F.col("introduced")))
    bound = lambda key, side, end: F.struct(key.alias("key"), F.lit(side).alias("side"), F.lit(end).alias("end"))
    bounds = numbered.select(*PACKAGE, "range", F.explode(F.array(
        bound(start, -1, "lo"), bound(version_key(F.col("fixed")), -1, "hi"),
        bound(version_key(F.col("last_affected")), 1, "hi"))).alias("b")).select(*PACKAGE, "range", "b.*").where(F.col("key").isNotNull())
    versions = used.select(*PACKAGE, "key").distinct().withColumn("side", F.lit(0))
    ranked = cut_lineage(_ranked(versions.unionByName(bounds, allowMissingColumns=True)))
    places = ranked.where("side = 0").select(*PACKAGE, "key", "rank")
    runs = ranked.where("side <> 0").groupBy("range").agg(
        F.max(F.when(F.col("end") == "lo", F.col("rank"))).alias("lo"), F.min(F.when(F.col("end") == "hi", F.col("rank"))).alias("hi"))
    counts = places.groupBy(*PACKAGE).agg((F.max("rank") + 1).alias("versions"))
    runs = numbered.join(runs, "range", "left").join(counts, PACKAGE).withColumn("lo", F.coalesce("lo", F.lit(0))).withColumn(
        "hi", F.coalesce("hi", "versions")).where("lo < hi")
    # The blocks of a run, smallest first: an odd number at either end is a block of its own size.
    sizes = F.expr("sequence(0, int(ceil(log2(versions + 1))))")
    cut = F.expr("filter(flatten(transform(sizes, s -> array(named_struct('size', s, 'block', ceil(lo / power(2, s)), 'odd', 1L, "
                 "'other', floor(hi / power(2, s))), named_struct('size', s, 'block', floor(hi / power(2, s)) - 1, 'odd', 0L, 'other', "
                 "ceil(lo / power(2, s)))))), b -> (b.odd = 1 AND b.block % 2 = 1 AND b.block < b.other) OR "
                 "(b.odd = 0 AND b.block % 2 = 0 AND b.block >= b.other))")
    blocks = runs.withColumn("sizes", sizes).withColumn("b", F.explode(cut)).select(
        *numbered.drop("range", "introduced", "fixed", "last_affected").columns, F.col("b.size").alias("size"), F.col("b.block").alias("block"))
    if cap is not None:
        key = [*PACKAGE, "size", "block"]
        first = Window.partitionBy(*key).orderBy("seq", "id")
        blocks = blocks.dropDuplicates([*key, "id"]).withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= cap).drop("_rn")
    inside = places.join(counts, PACKAGE).withColumn("size", F.explode(sizes)).withColumn(
        "block", F.floor(F.col("rank") / F.pow(F.lit(2.0), F.col("size")))).select(*PACKAGE, "key", "size", "block")
    hits = inside.join(blocks, [*PACKAGE, "size", "block"]).drop("size", "block")
    return used.join(hits, [*PACKAGE, "key"]).drop("key").select(
        *PACKAGE, "version", *[c for c in ranges.columns if c not in (*PACKAGE, "introduced", "fixed", "last_affected")])


def scan_dependencies(deps: DataFrame, advisories: DataFrame, compat: bool = False, salts: int = 16,
                      ranges: DataFrame | None = None) -> DataFrame:
    """SCA001 findings; at most three advisories per dependency.

    A dependency without a version matches advisories of any version.  ``ranges`` are advisories that
    name version ranges; one that also lists a version counts once for it.
    """
    if ranges is not None:
        # Kept once: both are read again by each step below, with all manifests and ranges behind them.
        deps = cut_lineage(deps)
        open_ended = ranges.drop("introduced", "fixed", "last_affected").withColumn("version", F.lit(""))
        advisories = cut_lineage(advisories.unionByName(resolve_ranges(deps, ranges, CAP)).unionByName(open_ended).dropDuplicates(
            ["ecosystem", "name", "version", "id"]))
    pinned, open_ = deps.where(F.col("version") != ""), deps.where(F.col("version") == "")
    by_version = salted_lookup(
        pinned, first_advisories(advisories, ["ecosystem", "name", "version"]), ["ecosystem", "name", "version"], salts)
    any_version = advisories.drop("version")
    if ranges is not None:
        any_version = any_version.dropDuplicates(["ecosystem", "name", "id"])
    by_name = salted_lookup(
        open_, first_advisories(any_version, ["ecosystem", "name"]), ["ecosystem", "name"], salts)
    rows = by_version.unionByName(by_name).select("*", F.explode("advisories").alias("a"))
    scored = F.filter(F.transform("a.severity", lambda s: cvss_severity(s["score"], compat)), lambda s: s.isNotNull())
    label = F.when(F.col("version") != "", F.concat(F.lit(" "), F.col("version"))).otherwise("")
    return rows.select(
        "file", "line", F.coalesce(F.get(scored, F.lit(0)), F.lit("HIGH")).alias("severity"),
        F.lit("SCA001").alias("rule_id"), F.lit("sca").alias("language"),
        F.substring(F.concat(
            F.lit("[SCA] "), F.col("ecosystem"), F.lit(" package '"), F.col("name"), F.lit("'"), label,
            F.lit(" has known vulnerability "), F.coalesce("a.id", F.lit("UNKNOWN")), F.lit(": "),
            F.coalesce("a.summary", F.lit("Known vulnerability"))), 1, 300).alias("message"),
        F.concat(F.col("name"), label).alias("code_snippet"), F.lit("HIGH").alias("confidence"),
        F.lit("CWE-1395").alias("cwe"), F.lit("A06:2021").alias("owasp"), F.lit("").alias("ai_explanation"),
        F.lit(20).alias("engine_ord"), F.col("a._rn").alias("ord"))
