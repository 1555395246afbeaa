"""Explicit schemas of inputs and outputs."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _B, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


FILES = _struct(file=_S, content=_S)

FINDING = _struct(
    file=_S, line=_I, severity=_S, rule_id=_S, language=_S, message=_S, code_snippet=_S, confidence=_S,
    cwe=_S, owasp=_S, ai_explanation=_S,
)
FINDING_COLUMNS = FINDING.fieldNames()

SCAN_REPORT = _struct(
    total=_I, critical=_I, high=_I, medium=_I, low=_I, suppressed=_I,
    by_language=T.MapType(_S, _I), findings=T.ArrayType(FINDING),
)

BASELINE = _struct(version=_I, count=_L, fingerprints=T.ArrayType(_S))

ADVISORY = _struct(
    ecosystem=_S, name=_S, version=_S, seq=_I, id=_S, summary=_S,
    severity=T.ArrayType(_struct(type=_S, score=_S)),
)

PATCHES = _struct(sha=_S, commit_ts=_TS, patch=_S)

GROUND_TRUTH = _struct(
    tests=T.ArrayType(_struct(id=_S, file=_S, language=_S, category=_S, vulnerable=_B)))

BANDIT = _struct(results=T.ArrayType(_struct(issue_severity=_S, filename=_S, line_number=_I)))
SEMGREP = _struct(results=T.ArrayType(_struct(path=_S, start=_struct(line=_I), extra=_struct(severity=_S))))

BUILD_REPORT = _struct(
    buildId=_S, branch=_S, commit=_struct(sha=_S, message=_S, author=_S), status=_S, timestamp=_S,
    duration=_L, pipeline=_struct(name=_S, url=_S),
    testResults=_struct(passed=_I, failed=_I, skipped=_I), artifacts=_S, metadata=_S,
)

OWNER = _struct(
    id=_L, username=_S, email=_S, role=_S, webhook_secret=_S, created_at=_TS, last_active=_TS)

REPORT = _struct(
    id=_L, name=_S, source=_S, uploaded_at=_TS, total=_L, critical=_L, high=_L, medium=_L, low=_L,
    by_language=_S, parent_id=_L,
)
