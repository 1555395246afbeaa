"""Rules against lines.

The rule pack travels inside the plan as one constant: a map from language to an array
of rule structs.  A line filters the array of its own language, so there is no join, no
shuffle and no (line, rule) candidate row; rules may be added at run time.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codescan.functions import text as tx
from codescan.functions.anchors import required_groups
from codescan.operators import lines as ln
from codescan.rules.regex_packs import SKIP_LINES, Rule, line_rules, multiline_rules

# For these ids the text of a literal is the finding, so matches inside literals count.
LITERAL_RULES = ("SEC027", "SEC027B", "SEC038", "SEC039", "SEC037", "SEC042")

_RULE = ("struct<ord:int,rule_id:string,severity:string,message:string,cwe:string,owasp:string,pattern:string,"
         "erase:string,skip:string,in_literals:boolean,signs:array<array<string>>,needs:array<array<string>>>")
_ENTRY = "struct<pattern:string,value:string,needs:array<array<string>>>"


def _sign(text: str) -> str | None:
    """A character of a required text that few lines of prose hold."""
    return next((c for c in text if c.isascii() and not (c.isalnum() or c.isspace()) and c not in ".,'-"), None)


def _entry(r: Rule) -> dict:
    needs = required_groups(r.pattern)
    signs = [sorted({_sign(t) for t in group}) for group in needs if all(map(_sign, group))]
    return {
        "ord": r.ord, "rule_id": r.rule_id, "severity": r.severity, "message": r.message, "cwe": r.cwe,
        "owasp": r.owasp, "pattern": "(?i)" + r.pattern, "erase": "(?i)" + r.erase if r.erase else "",
        "skip": SKIP_LINES.get((r.language, r.rule_id), ""),
        "in_literals": r.language != "python" or r.rule_id in LITERAL_RULES,
        # A group that asks for no more than its signs is tested by them.
        "signs": [list(g) for g in dict.fromkeys(map(tuple, signs))], "needs": [g for g in needs if not all(t == _sign(t) for t in g)],
    }


def rule_pack(rules: list[Rule], language: Column) -> Column:
    """The rules of a row's language as a constant array; NULL for other languages."""
    pack: dict[str, list[dict]] = {}
    for r in rules:
        pack.setdefault(r.language, []).append(_entry(r))
    return F.element_at(F.from_json(F.lit(json.dumps(pack)), f"map<string,array<{_RULE}>>"), language)


def _possible(needs: Column, low: Column) -> Column:
    """Whether the substrings a pattern requires all occur."""
    return F.forall(needs, lambda group: F.exists(group, lambda part: low.contains(part)))


def _signs_of(low: Column, rules: list[Rule]) -> Column:
    """The signs that a text holds, joined: one search, so that most rules need none of their own."""
    known = sorted({c for r in rules for group in _entry(r)["signs"] for c in group})
    if not known:
        return F.lit("")
    # Single characters, not ranges: those are one look-up in the search.
    one = "[" + "".join("\\" + c for c in known) + "]"
    return F.array_join(F.array_distinct(F.regexp_extract_all(low, F.lit(one), F.lit(0))), "")


def _hits(rules: Column, line: Column, low: Column, signs: Column, language: Column) -> Column:
    def hit(r):
        subject = F.when(r["erase"] == "", line).otherwise(F.regexp_replace(line, r["erase"], F.lit(" ")))
        # Python: a match that starts inside a literal or comment is no code; where the
        # literal is the finding, only lines that are nothing but a literal are skipped.
        stray = F.when(r["rule_id"].isin(*LITERAL_RULES), tx.strip(line).rlike("^[\"']")).otherwise(
            tx.inside_literal(line, F.regexp_instr(line, r["pattern"])))
        return (
            _possible(r["signs"], signs)
            & _possible(r["needs"], low)
            & F.regexp_like(subject, r["pattern"])
            & ((r["skip"] == "") | ~F.regexp_like(line, r["skip"]))
            & ((language != "python") | ~stray)
        )
    return F.filter(rules, hit)


def rule_hits(line: Column, language: Column, rules: list[Rule] | None = None) -> Column:
    """The rules that hit a line, as an array of rule structs."""
    rules = line_rules() if rules is None else rules
    pack, low = rule_pack(rules, language), F.lower(line)
    return F.flatten(F.transform(
        F.array(F.struct(low.alias("low"), _signs_of(low, rules).alias("signs"))),
        lambda x: _hits(pack, line, x["low"], x["signs"], language)))


def _entry_pack(entries: list[tuple[str, str, str]], language: Column) -> Column:
    pack: dict[str, list[dict]] = {}
    for name, pattern, value in entries:
        pack.setdefault(name, []).append({"pattern": "(?i)" + pattern, "value": value, "needs": required_groups(pattern)})
    return F.coalesce(
        F.element_at(F.from_json(F.lit(json.dumps(pack)), f"map<string,array<{_ENTRY}>>"), language),
        F.array().cast(f"array<{_ENTRY}>"))


def matching_entries(entries: list[tuple[str, str, str]], language: Column, line: Column) -> Column:
    """Values of the (language, pattern, value) entries that hit a line, in order."""
    own = _entry_pack(entries, language)
    hits = F.flatten(F.transform(F.array(F.lower(line)), lambda low: F.filter(
        own, lambda e: _possible(e["needs"], low) & F.regexp_like(line, e["pattern"]))))
    return F.transform(hits, lambda e: e["value"])


def match_rules(lines: DataFrame, rules: list[Rule] | None = None, confidence: str = "LOW",
                engine_ord: int = 1) -> DataFrame:
    """Findings of (file, language, line_no, line) rows; one per line and rule entry."""
    line = F.col("line")
    found = rule_hits(line, F.col("language"), rules)
    return (
        # explode_outer: for explode Catalyst infers a filter that evaluates the hits twice.
        lines.select("file", "language", "line_no", "line", F.explode_outer(found).alias("hit"))
        .where(F.col("hit").isNotNull())
        .select(
            "file", F.col("line_no").alias("line"), "hit.severity", "hit.rule_id", "language", "hit.message",
            tx.snippet(line).alias("code_snippet"), F.lit(confidence).alias("confidence"),
            "hit.cwe", "hit.owasp", F.lit("").alias("ai_explanation"),
            F.lit(engine_ord).alias("engine_ord"), F.col("hit.ord").alias("ord"))
    )


def drop_clean_files(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """Keep files whose text holds everything some rule of their language requires."""
    pack = rule_pack(rules, F.col("language"))
    return files.where(F.exists(F.array(F.lower("content")), lambda low: F.exists(
        pack, lambda r: _possible(r["signs"], low) & _possible(r["needs"], low))))


def may_hold(entries: list[tuple[str, str, str]], language: Column, content: Column) -> Column:
    """Whether a text holds the substrings some entry of its language requires."""
    own = _entry_pack(entries, language)
    return F.exists(F.array(F.lower(content)), lambda low: F.exists(own, lambda e: _possible(e["needs"], low)))


def scan_lines(files: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The line-rule pass over whole files: hygiene, explode, match.  No shuffle at all."""
    clean = files.withColumn("content", ln.code_text(F.col("content"), F.col("language")))
    return match_rules(ln.drop_nosec(ln.drop_comment_lines(ln.explode_lines(clean))), rules)


def scan_multiline(files: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Multi-line rules on logical lines; one finding per (line, id)."""
    rules = multiline_rules() if rules is None else rules
    found = match_rules(
        ln.logical_lines(ln.all_lines(drop_clean_files(files, rules))), rules, confidence="MEDIUM", engine_ord=3)
    rest = [c for c in found.columns if c not in ("file", "line", "rule_id")]
    return (
        found.groupBy("file", "line", "rule_id").agg(F.min_by(F.struct(*rest), "ord").alias("f"))
        .select("file", "line", "rule_id", "f.*").select(*found.columns)
    )
