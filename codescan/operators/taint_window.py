"""Line-window taint: a source assignment up to 25 lines above a sink that names it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codescan.functions import text as tx
from codescan.operators.match import matching_entries, may_hold
from codescan.rules.metadata import cwe_of, owasp_of
from codescan.session import cut_lineage, work_folder, write_counted
from codescan.rules.taint_tables import WINDOW_SINKS, WINDOW_SOURCES

NAME = r"[A-Za-z_]\w*"
# Lines of one (file, name) are split into blocks of this many lines; a block also gets
# the sources of the preceding window, so a variable used throughout a huge file is
# spread over tasks.
BLOCK = 1000


def assigned_name(language: Column, line: Column) -> Column:
    """Variable a line assigns, NULL if none; PHP names without the leading ``$``."""
    s = tx.strip(line)

    def first(pattern):
        got = F.regexp_extract(s, pattern, 1)
        return F.when(got != "", got)

    return F.coalesce(
        F.when(language == "php", first(rf"^\$({NAME})\s*[.+]?=(?:[^=]|$)")),
        F.when(language == "java", first(rf"^(?:\w+(?:\s*<[^>]*>)?\s+)+({NAME})\s*=(?:[^=]|$)")),
        first(rf"^({NAME})\s*:="),
        first(rf"^(?:const|let|var|final)\s+({NAME})\s*=(?:[^=]|$)"),
        first(rf"^({NAME})\s*=(?:[^=>]|$)"))


DEFAULT_LANGUAGES = ("python", "javascript", "php", "java", "go")


def candidate_files(files: DataFrame, languages: tuple[str, ...] = DEFAULT_LANGUAGES) -> DataFrame:
    """Files whose text may hold a source and a sink; the others are not split into lines."""
    language, content = F.col("language"), F.col("content")
    sources = [(lang, pattern, "") for lang, pattern in WINDOW_SOURCES.items()]
    sinks = [(lang, pattern, "") for lang, _, _, pattern, _ in WINDOW_SINKS]
    return files.where(language.isin(*languages) & may_hold(sources, language, content) & may_hold(sinks, language, content))


def line_facts(lines: DataFrame, languages: tuple[str, ...] = DEFAULT_LANGUAGES, extra_sinks: tuple = ()) -> DataFrame:
    """Per line: assigned name, names mentioned, source flag, joining operator, sinks hit.

    ``extra_sinks`` are further rows of the sink table (language, rule, severity, expression, message).
    """
    language, line = F.col("language"), F.col("line")
    sinks = matching_entries(
        [(lang, pattern, f"{rule}|{sev}|{message}") for lang, rule, sev, pattern, message in
         [*WINDOW_SINKS, *extra_sinks] if lang in languages], language, line)
    is_source = F.size(matching_entries(
        [(lang, pattern, lang) for lang, pattern in WINDOW_SOURCES.items()], language, line)) > 0
    fact = F.struct(
        assigned_name(language, line).alias("lhs"),
        F.array_distinct(F.regexp_extract_all(line, F.lit(NAME), F.lit(0))).alias("names"),
        is_source.alias("is_source"), line.rlike(r"[.+&]|concat|\|\|").alias("joins"), sinks.alias("sinks"))
    return (
        # The one-element array keeps the filter above the expressions, which run once.
        lines.where(language.isin(*languages))
        .select("file", "language", "line_no", "line", F.explode(F.array(fact)).alias("f"))
        .where(F.col("f.lhs").isNotNull() | (F.size("f.sinks") > 0))
        .select("file", "language", "line_no", "line", "f.*")
    )


def tainted_names(facts: DataFrame, rounds: int = 3) -> DataFrame:
    """(file, name, line_no) of tainted assignments.

    A name becomes tainted when a line assigns it from a mention of a tainted name; three
    rounds, each an equi-join on (file, name).  Files without any source never take part.
    """
    keys = ["file", "name"]
    tainted = facts.where(F.col("is_source") & F.col("lhs").isNotNull()).select("file", F.col("lhs").alias("name"), "line_no")
    # Assignments in files that have a source, one row per mentioned name.
    steps = (
        facts.where(F.col("lhs").isNotNull() & F.col("joins"))
        .join(tainted.select("file").distinct(), "file", "left_semi")
        .select("file", "lhs", "line_no", F.explode_outer("names").alias("name")).where(F.col("name").isNotNull())
    )
    spark = facts.sparkSession
    table = work_folder(spark, "tainted")
    schema = tainted.schema
    fresh = tainted.distinct()
    for i in range(rounds + 1):
        if write_counted(fresh, f"{table}/round={i}") == 0:
            break
        known = spark.read.schema(schema).parquet(table).select(*keys).distinct()
        # Mentions of older names were followed in their own round.
        newest = spark.read.schema(schema).parquet(f"{table}/round={i}").select(*keys).distinct()
        fresh = (
            steps.join(newest, keys, "left_semi")
            .select("file", F.col("lhs").alias("name"), "line_no").distinct()
            .join(known, keys, "left_anti")
        )
    return spark.read.schema(schema).parquet(table).select(*schema.names)


def nearest_sources(tainted: DataFrame, uses: DataFrame, window: int = 25) -> DataFrame:
    """Uses with the nearest tainted assignment 1..window lines above.

    An as-of join by one running maximum over the union of both sides: linear in the
    rows, no pairs of sources and uses.
    """
    size = max(BLOCK, 4 * window)
    block = F.floor(F.col("line_no") / size)
    sources = tainted.withColumn(
        "_block", F.explode(F.array_distinct(F.array(block, F.floor((F.col("line_no") + window) / size)))))
    events = (
        sources.select("file", "name", "_block", "line_no", F.col("line_no").alias("_src"))
        .unionByName(uses.withColumn("_block", block), allowMissingColumns=True)
    )
    above = Window.partitionBy("file", "name", "_block").orderBy("line_no").rangeBetween(Window.unboundedPreceding, -1)
    return (
        events.withColumn("source_line", F.max("_src").over(above))
        .where(F.col("_src").isNull() & (F.col("line_no") - F.col("source_line") <= window)).drop("_src", "_block")
    )


def taint_window(lines: DataFrame, window: int = 25, languages: tuple[str, ...] = DEFAULT_LANGUAGES,
                 extra_sinks: tuple = (), rounds: int = 3) -> DataFrame:
    """Findings of (file, language, line_no, line) rows; one per (line, rule).

    A value is followed through ``rounds`` assignments beyond its source.
    """
    facts = cut_lineage(line_facts(lines, languages, extra_sinks))  # read once per round
    tainted = tainted_names(facts, rounds)
    uses = (
        facts.where(F.size("sinks") > 0)
        .join(tainted.select("file").distinct(), "file", "left_semi")
        .select("file", "language", "line_no", "line", "sinks", F.explode_outer("names").alias("name"))
    )
    hits = nearest_sources(tainted, uses, window).select(
        "file", "language", "line_no", "line", "source_line", F.explode("sinks").alias("_sink"))
    part = lambda i: F.split_part("_sink", F.lit("|"), F.lit(i))
    per_rule = (
        hits.groupBy("file", "language", "line_no", "_sink")
        .agg(F.max("source_line").alias("source_line"), F.first("line").alias("line"))
        .withColumn("rule_id", part(1))
    )
    cwe, owasp = F.lit(""), F.lit("")
    for rule in sorted({s[1] for s in WINDOW_SINKS}):
        cwe = F.when(F.col("rule_id") == rule, cwe_of(rule)).otherwise(cwe)
        owasp = F.when(F.col("rule_id") == rule, owasp_of(rule)).otherwise(owasp)
    return per_rule.select(
        "file", F.col("line_no").alias("line"), part(2).alias("severity"), "rule_id", "language",
        F.concat(part(3), F.lit(" - tainted by user input on line "), F.col("source_line").cast("string")).alias("message"),
        tx.snippet(F.col("line")).alias("code_snippet"), F.lit("MEDIUM").alias("confidence"),
        cwe.alias("cwe"), owasp.alias("owasp"), F.lit("").alias("ai_explanation"), F.lit(8).alias("engine_ord"),
        F.lit(0).alias("ord"))
