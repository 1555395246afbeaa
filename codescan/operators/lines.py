"""Files to lines, and the line filters that precede rule matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codescan.functions import text as tx
from codescan.rules import languages as lang

BRACKETS = r"[\[\](){}]"


def explode_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per non-blank line: the other columns of ``files`` plus line_no, line."""
    keep = [c for c in files.columns if c != content]
    return (
        files.select(*keep, F.posexplode(tx.line_array(F.col(content))).alias("line_no", "line"))
        .withColumn("line_no", F.col("line_no") + 1)
        .where(tx.strip(F.col("line")) != "")
    )


def all_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """Every physical line, blank ones included; a line break at the end starts no line."""
    keep = [c for c in files.columns if c != content]
    text = F.regexp_replace(tx.unix_breaks(F.col(content)), r"\n\z", "")
    return (files.where(F.col(content) != "").select(*keep, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
            .withColumn("line_no", F.col("line_no") + 1))


def is_comment(language: Column, line: Column) -> Column:
    s = tx.strip(line)
    return ((language.isin(*lang.HASH_COMMENT) & s.startswith("#"))
            | (language.isin(*lang.SLASH_COMMENT) & s.startswith("//")))


def is_nosec(language: Column, line: Column) -> Column:
    low = F.lower(line)
    return ((language.isin(*lang.NOSEC_HASH) & low.contains("# nosec"))
            | (language.isin(*lang.NOSEC_SLASH) & low.contains("// nosec")))


def drop_comment_lines(lines: DataFrame) -> DataFrame:
    return lines.where(~is_comment(F.col("language"), F.col("line")))


def drop_nosec(lines: DataFrame) -> DataFrame:
    return lines.where(~is_nosec(F.col("language"), F.col("line")))


def code_text(content: Column, language: Column) -> Column:
    """A file's text with block comments and docstrings blanked; line numbers stay."""
    return blanked(tx.unix_breaks(content), language)


def blanked(content: Column, language: Column) -> Column:
    """``code_text`` of a text whose lines all end with ``\\n``."""
    return (
        F.when(language.isin(*lang.BLOCK_COMMENT) & content.contains("/*"), tx.blank_block_comments(content))
        .when(language == "python", tx.blank_docstrings(content)).otherwise(content)
    )


def drop_block_comments(files: DataFrame) -> DataFrame:
    """Blank the lines of block comments inside each file's text (no shuffle)."""
    content = tx.unix_breaks(F.col("content"))
    has = F.col("language").isin(*lang.BLOCK_COMMENT) & F.col("content").contains("/*")
    return files.withColumn("content", F.when(has, tx.blank_block_comments(content)).otherwise(F.col("content")))


def block_comment_ranges(lines: DataFrame, key: tuple[str, ...], block: int) -> DataFrame:
    """(key, block, ranges) of the blocks of line numbers in which a block comment hides lines.

    A mark opens or closes the comment behind its line.  One row a block leaves the scan of the lines: its marks in
    order.  What a block inherits is the last mark of the blocks above it.
    """
    opens, closes = F.col("line").contains("/*"), F.col("line").contains("*/")
    mark = F.when(closes | opens, F.struct("line_no", (~closes).alias("open")))
    above = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        lines.groupBy(*key, F.floor(F.col("line_no") / block).alias("_block")).agg(F.sort_array(F.collect_list(mark)).alias("_marks"))
        .withColumn("_carried", F.last(F.try_element_at("_marks", F.lit(-1)), ignorenulls=True).over(above))
    )
    marks = F.when(F.col("_carried.open"), F.concat(F.array("_carried"), F.col("_marks"))).otherwise(F.col("_marks"))
    ranges = F.filter(F.transform(marks, lambda m, i: F.struct(
        m["open"].alias("open"), m["line_no"].alias("after"), F.get(marks, i + 1)["line_no"].alias("upto"))), lambda r: r["open"])
    return blocks.select(*key, "_block", ranges.alias("_ranges")).where(F.size("_ranges") > 0)


def drop_block_comment_lines(lines: DataFrame, key: tuple[str, ...] = ("file",), block: int = 1000) -> DataFrame:
    """The same filter for a table that holds lines rather than files.

    Lines are not put in order: each meets the hidden ranges of its block of ``block`` line numbers, a table that
    grows with the comments and is broadcast by Spark where it is small.  Lines of other languages pass by.
    """
    language = F.coalesce(F.col("language"), F.lit(""))
    blocky, rest = lines.where(language.isin(*lang.BLOCK_COMMENT)), lines.where(~language.isin(*lang.BLOCK_COMMENT))
    number = F.col("line_no")
    hidden = F.exists("_ranges", lambda r: (number > r["after"]) & (r["upto"].isNull() | (number <= r["upto"])))
    outside = (
        blocky.where(~F.coalesce(F.col("line").contains("/*"), F.lit(False)))
        .withColumn("_block", F.floor(number / block))
        .join(block_comment_ranges(blocky, key, block), [*key, "_block"], "left")
        .where(~F.coalesce(hidden, F.lit(False)))
    )
    return rest.unionByName(outside.select(*lines.columns))


def clamped_bracket_fold(line: Column) -> Column:
    """Bracket depth at the end of a line that starts at depth 0, never below 0."""
    return F.aggregate(
        F.regexp_extract_all(line, F.lit(BRACKETS), F.lit(0)), F.lit(0),
        lambda d, ch: F.when(ch.isin("(", "[", "{"), d + 1).otherwise(F.greatest(d - 1, F.lit(0))))


def logical_lines(lines: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Join continuation lines: brackets left open, or a trailing backslash.

    Depth after line i is max(depth before + net, fold from 0), i.e. an affine step in
    (max, +).  Composed over a file this is running_sum(net) + running_max(fold - sum):
    two window aggregates over one sort instead of a per-file loop.  Python lines pass
    through.  Expects every physical line, blank ones included.
    """
    key = key or ["file"]
    running = Window.partitionBy(*key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy(*key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    text = F.rtrim(F.btrim(F.concat(F.lit("."), F.col("line")), F.lit(tx.BLANKS)))
    opened = F.size(F.regexp_extract_all("line", F.lit(r"[\[({]"), F.lit(0)))
    closed = F.size(F.regexp_extract_all("line", F.lit(r"[\])}]"), F.lit(0)))
    staged = (
        lines.withColumn("_text", F.substring(text, F.lit(2), F.length(text)))
        .withColumn("_net", F.when(F.col("language") == "python", 0).otherwise(opened - closed))
        .withColumn("_fold", F.when(F.col("language") == "python", 0).otherwise(clamped_bracket_fold(F.col("line"))))
        .withColumn("_sum", F.sum("_net").over(running))
        .withColumn("_peak", F.max(F.col("_fold") - F.col("_sum")).over(running))
        .withColumn("_depth", F.col("_sum") + F.greatest(F.col("_peak"), F.lit(0)))
        .withColumn("_open", (F.col("language") != "python")
                    & ((F.col("_depth") > 0) | F.col("_text").endswith("\\")))
        .withColumn("_group", F.coalesce(F.sum(F.when(F.col("_open"), 0).otherwise(1)).over(above), F.lit(0)))
    )
    # A leading blank line leaves the buffer empty, so the logical line starts after it.
    parts = F.sort_array(F.collect_list(F.struct("line_no", "_text")))
    grouped = staged.groupBy(*key, "language", "_group").agg(parts.alias("_parts"))
    first = F.element_at(F.filter("_parts", lambda p: p["_text"] != ""), 1)
    return (
        grouped.where(F.exists("_parts", lambda p: p["_text"] != ""))
        .withColumn("_kept", F.filter("_parts", lambda p: p["line_no"] >= first["line_no"]))
        .select(
            *key, "language", first["line_no"].alias("line_no"),
            F.concat(
                first["_text"],
                F.array_join(F.transform(
                    F.slice("_kept", F.lit(2), F.size("_kept")),
                    lambda p: F.concat(F.lit(" "), F.btrim(p["_text"], F.lit(tx.BLANKS)))), "")).alias("line"))
    )
