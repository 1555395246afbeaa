"""Column expressions on source text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codescan.rules.languages import CONFIDENCE_ORDER, SEVERITY_ORDER

# Line ends recognised by Python's str.splitlines.
LINE_BREAK = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
# Characters removed by Python's str.strip.
BLANKS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + \
    "    　"

# A complete quoted literal on one line.
QUOTED = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|' r"'[^'\\]*+(?:\\.[^'\\]*+)*+'"


def unix_breaks(content: Column) -> Column:
    """All line ends as ``\\n``; texts that have no other kind are passed through."""
    other = r"[\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"
    return F.when(content.rlike(other), F.regexp_replace(content, LINE_BREAK, "\n")).otherwise(content)


def line_array(content: Column) -> Column:
    return F.split(unix_breaks(content), "\n")


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(BLANKS))


def snippet(col: Column, size: int = 120) -> Column:
    return F.substring(strip(col), 1, size)


def blank_block_comments(content: Column) -> Column:
    """Empty every line that a ``/* ... */`` comment touches, keeping line numbers.

    A line with ``/*`` is dropped as a whole, then all lines up to the one with ``*/``.
    The chain of matches (``\\G``) goes on only after a line that did not close the
    comment, so the running state needs no window and no shuffle.
    """
    return F.regexp_replace(
        content, r"(?m)(?:^(?=[^\n]*/\*)|\G(?<=\n))(?:(?![^\n]*\*/)[^\n]*(\n)|[^\n]*)", "$1")


def blank_docstrings(content: Column) -> Column:
    """Empty triple-quoted strings, keeping line numbers.

    Within a string the match goes on at the line start (``\\G``), which is tried before
    the quotes, so that the next quotes close the string.
    """
    for q in ('"""', "'''"):
        blanked = F.regexp_replace(
            content, rf"(?:\G(?<=\n)|{q})(?:(?!{q})[^\n])*+(?:(\n)|{q}|\z)", "$1")
        content = F.when(content.contains(q), blanked).otherwise(content)
    return content


def inside_literal(line: Column, position: Column) -> Column:
    """Whether the 1-based position lies in a quoted literal or a ``#`` comment of the line."""
    before = F.substring(line, F.lit(1), position - 1)
    at = F.substring(line, position, F.lit(1))
    return F.regexp_replace(before, QUOTED, "").rlike("[\"'#]") | at.isin('"', "'")


def _rank(value: Column, order: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, rank in order.items():
        out = F.when(value == name, rank).otherwise(out)
    return out


def severity_rank(severity: Column) -> Column:
    """HIGH 0, MEDIUM 1, LOW 2, anything else 9."""
    return _rank(severity, SEVERITY_ORDER, 9)


def confidence_rank(confidence: Column) -> Column:
    """LOW 0, MEDIUM 1, HIGH 2, unknown 0."""
    return _rank(confidence, CONFIDENCE_ORDER, 0)


def cvss_severity(score_text: Column, compat: bool = False) -> Column:
    """Severity of an advisory score text, NULL when it holds no number.

    A bare vector ("CVSS:3.1/AV:N/...") carries no base score and yields NULL;
    ``compat=True`` reads the version number 3.1 as the score instead.
    """
    explicit = F.regexp_extract(score_text, r"CVSS:[\d.]+/.*?/S(?:core)?:(\d+\.?\d*)", 1)
    plain = F.regexp_extract(score_text, r"(\d+\.\d+)", 1)
    if not compat:
        plain = F.when(score_text.startswith("CVSS:"), F.lit("")).otherwise(plain)
    score = F.when(explicit != "", explicit).when(plain != "", plain).cast("double")
    return F.when(score >= 7.0, "HIGH").when(score >= 4.0, "MEDIUM").when(score.isNotNull(), "LOW")


def age_text(then: Column, now: Column) -> Column:
    """Age as ``12s ago`` / ``3m ago`` / ``4h ago`` / ``5d ago``; '' when unknown."""
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    part = lambda seconds, unit: F.concat(F.floor(s / seconds).cast("string"), F.lit(unit + " ago"))
    return (F.when(s.isNull(), "").when(s < 60, part(1, "s")).when(s < 3600, part(60, "m"))
            .when(s < 86400, part(3600, "h")).otherwise(part(86400, "d")))


def relative_path(path: Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 30)).otherwise(path)


def duration_text(ms: Column) -> Column:
    s = F.round(ms / 1000).cast("long")
    m, rest = F.floor(s / 60), s % 60
    return (F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
            .when(s < 60, F.concat(s.cast("string"), F.lit("s")))
            .when(rest == 0, F.concat(m.cast("string"), F.lit("m")))
            .otherwise(F.concat(m.cast("string"), F.lit("m "), rest.cast("string"), F.lit("s"))))
