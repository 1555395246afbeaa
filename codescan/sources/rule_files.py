"""User rule packs (YAML)."""

from __future__ import annotations

import re
from dataclasses import replace

from codescan.rules.regex_packs import Rule
from codescan.rules.structural_packs import StructRule, compile_rule


def load_rules(text: str, first_ord: int = 10_000) -> tuple[list[Rule], list[StructRule], list[str]]:
    """Line rules, call-shape rules and the problems found in a rule file.

    A rule needs id, language and a pattern; severity defaults to MEDIUM and message to
    "Custom rule".  ``kind: structural`` marks a call pattern with ``$`` placeholders.  A
    pattern that does not compile is reported and left out.  Of two rules with one id the
    first decides cwe and owasp.
    """
    import yaml

    data = yaml.safe_load(text) or {}
    lines: list[Rule] = []
    calls: list[StructRule] = []
    problems: list[str] = []
    tags: dict[str, tuple[str, str]] = {}
    for i, raw in enumerate(data.get("rules") or []):
        field = lambda k, default="", raw=raw: str(raw.get(k, default) or default).strip()
        rule_id, language, pattern = field("id"), field("language").lower(), field("pattern")
        if not (rule_id and language and pattern):
            problems.append(f"rule {i}: id, language and pattern are required")
            continue
        severity, message = field("severity", "MEDIUM").upper(), field("message", "Custom rule")
        cwe, owasp = tags.setdefault(rule_id, (field("cwe"), field("owasp")))
        try:
            if field("kind") == "structural":
                either = raw.get("pattern_either") or [pattern]
                calls += [
                    compile_rule(rule_id, language, severity, cwe, p, message, raw.get("options"), first_ord + i, owasp)
                    for p in either]
            else:
                re.compile(pattern)
                lines.append(Rule(rule_id, language, severity, pattern, message, None, cwe, owasp, first_ord + i))
        except (re.error, ValueError, KeyError) as exc:
            problems.append(f"rule {rule_id}: {exc}")
    return lines, calls, problems


def with_rules(base: list[Rule], extra: list[Rule]) -> list[Rule]:
    """Built-in and custom rules; custom ones rank after the built-in ones."""
    start = max((r.ord for r in base), default=-1) + 1
    return base + [replace(r, ord=start + i) for i, r in enumerate(extra)]
