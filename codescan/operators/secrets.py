"""High-entropy literals, secrets in commit history, assert statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codescan.functions import text as tx
from codescan.functions.entropy import contains_secret_prefix, secret_likeness, shannon_entropy, string_literals
from codescan.operators import lines as ln
from codescan.operators.match import rule_hits
from codescan.rules.metadata import title_of

ENTROPY_MESSAGE = f"{title_of('CWE-798')}: literal with entropy=%.2f bits per character"
ASSERT_MESSAGE = title_of("CWE-617")


def secret_literals(lines: DataFrame, text: str = "line") -> DataFrame:
    """Secret-like literals: the input columns plus pos, value, entropy."""
    return (
        lines.where(F.col(text).rlike(r"""["'][^\\]{12}"""))
        .select("*", F.posexplode_outer(string_literals(F.col(text))).alias("pos", "value"))
        .where(F.col("value").isNotNull())
        .withColumn("entropy", shannon_entropy(F.col("value")))
        .where(secret_likeness(F.col("value"), F.col("entropy")))
    )


def scan_entropy(lines: DataFrame) -> DataFrame:
    """SEC001E findings of (file, language, line_no, line) rows."""
    code = ln.drop_nosec(ln.drop_comment_lines(lines))
    return secret_literals(code).select(
        "file", F.col("line_no").alias("line"), F.lit("HIGH").alias("severity"), F.lit("SEC001E").alias("rule_id"),
        "language",
        F.format_string(ENTROPY_MESSAGE, F.col("entropy")).alias("message"),
        tx.snippet(F.col("line")).alias("code_snippet"), F.lit("MEDIUM").alias("confidence"),
        F.lit("CWE-798").alias("cwe"), F.lit("A07:2021").alias("owasp"), F.lit("").alias("ai_explanation"),
        F.lit(2).alias("engine_ord"), F.col("pos").alias("ord"))


def scan_text(files: DataFrame, rules: list | None = None) -> DataFrame:
    """Line rules, secret literals and assert statements in one pass over the corpus.

    Equals the union of ``scan_lines``, ``scan_entropy`` and ``scan_assert``, but reads and
    splits each text once: the raw and the blanked lines travel side by side.
    """
    language, line = F.col("language"), F.col("line")
    lines = (
        # Line ends are replaced once, for both kinds of lines.
        files.select("file", "language", tx.unix_breaks(F.col("content")).alias("content"))
        .select("file", "language", F.posexplode(F.arrays_zip(
            F.split("content", "\n").alias("line"),
            F.split(ln.blanked(F.col("content"), language), "\n").alias("code"))).alias("line_no", "z"))
        .select("file", "language", (F.col("line_no") + 1).alias("line_no"), "z.line", "z.code")
        .where(tx.strip(line) != "")
    )
    kept = ~(ln.is_comment(language, line) | ln.is_nosec(language, line))
    kind = ("array<struct<severity:string,rule_id:string,message:string,confidence:string,cwe:string,owasp:string,"
            "engine_ord:int,ord:int>>")

    def found(severity, rule_id, message, confidence, cwe, owasp, engine_ord, ord_):
        cell = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(*[cell(v) for v in (severity, rule_id, message, confidence, cwe, owasp, engine_ord, ord_)])

    hits = F.transform(rule_hits(F.col("code"), language, rules), lambda r: found(
        r["severity"], r["rule_id"], r["message"], "LOW", r["cwe"], r["owasp"], 1, r["ord"]))
    literals = F.transform(
        F.filter(F.transform(string_literals(line), lambda v, i: F.struct(v.alias("v"), i.alias("i"), shannon_entropy(v).alias("e"))),
                 lambda x: secret_likeness(x["v"], x["e"])),
        lambda x: found("HIGH", "SEC001E", F.format_string(ENTROPY_MESSAGE, x["e"]), "MEDIUM", "CWE-798", "A07:2021", 2, x["i"]))
    asserts = F.array(found("LOW", "SEC003", ASSERT_MESSAGE, "LOW", "CWE-617", "A05:2021", 4, 0))
    none = F.array().cast(kind)
    every = F.concat(
        F.when(kept & (tx.strip(F.col("code")) != ""), hits.cast(kind)).otherwise(none),
        F.when(kept & line.rlike(r"""["'][^\\]{12}"""), literals.cast(kind)).otherwise(none),
        F.when((language == "python") & line.rlike(r"^\s*assert\b"), asserts.cast(kind)).otherwise(none))
    return (
        lines.select("file", "language", "line_no", "line", F.explode_outer(every).alias("f")).where(F.col("f").isNotNull())
        .select("file", F.col("line_no").alias("line"), "f.severity", "f.rule_id", "language", "f.message",
                tx.snippet(line).alias("code_snippet"), "f.confidence", "f.cwe", "f.owasp", F.lit("").alias("ai_explanation"),
                "f.engine_ord", "f.ord")
    )


def scan_history(added: DataFrame) -> DataFrame:
    """SEC001H findings of (sha, file, line, text) rows, one per added line.

    All tests stay inside the row, so nothing is shuffled but the final de-duplication.
    """
    stripped = tx.strip(F.col("text"))
    likely = F.filter(string_literals(F.col("text")), lambda v: secret_likeness(v, shannon_entropy(v)))
    hits = (
        added.where((stripped != "") & ~stripped.rlike("^(#|//)"))
        .withColumn("_secret", F.element_at(F.concat(likely, F.array(F.lit(""))), 1))
        .where((F.col("_secret") != "") | contains_secret_prefix(F.col("text")))
    )
    short = F.substring("sha", 1, 8)
    literal = F.col("_secret") != ""
    return hits.select(
        "sha", "file", "line", F.lit("HIGH").alias("severity"), F.lit("SEC001H").alias("rule_id"),
        F.lit("secret").alias("language"),
        F.when(literal, F.concat(F.lit("High-entropy string in git history (commit "), short,
                                 F.lit(") - possible leaked credential")))
        .otherwise(F.concat(F.lit("Possible hardcoded secret in git history (commit "), short, F.lit(")")))
        .alias("message"),
        F.substring(F.when(literal, F.col("_secret")).otherwise(stripped), 1, 100).alias("code_snippet"),
        F.lit("MEDIUM").alias("confidence"), F.lit("CWE-798").alias("cwe"), F.lit("A07:2021").alias("owasp"),
        F.lit("").alias("ai_explanation"),
    ).dropDuplicates(["sha", "file", "line"])


def scan_assert(lines: DataFrame) -> DataFrame:
    """SEC003 for Python assert statements."""
    return lines.where((F.col("language") == "python") & F.col("line").rlike(r"^\s*assert\b")).select(
        "file", F.col("line_no").alias("line"), F.lit("LOW").alias("severity"), F.lit("SEC003").alias("rule_id"),
        "language", F.lit(ASSERT_MESSAGE).alias("message"),
        tx.snippet(F.col("line")).alias("code_snippet"), F.lit("LOW").alias("confidence"),
        F.lit("CWE-617").alias("cwe"), F.lit("A05:2021").alias("owasp"), F.lit("").alias("ai_explanation"),
        F.lit(4).alias("engine_ord"), F.lit(0).alias("ord"))
