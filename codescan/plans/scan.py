"""The whole scan: every pass over a corpus, merged, filtered, suppressed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codescan.operators import findings as fd
from codescan.operators import lines as ln
from codescan.operators import secrets, structural, taint, taint_window
from codescan.operators.dependencies import scan_dependencies
from codescan.operators.match import scan_multiline
from codescan.schemas import FINDING_COLUMNS
from codescan.session import cut_lineage
from codescan.sources.corpus import scannable
from codescan.sources.manifests import read_dependencies


def scan_files(files: DataFrame, rules=None, struct_rules=None, window: int = 25, flow_rules: taint.FlowRules | None = None) -> DataFrame:
    """Findings of (file, language, content) rows, first per (file, line, rule) in engine order."""
    facts = taint.extract(files, flow_rules)
    windows = ln.explode_lines(taint_window.candidate_files(files))
    found = fd.union_engines(
        secrets.scan_text(files, rules), scan_multiline(files), taint.scan_flow(facts),
        taint_window.taint_window(windows, window), structural.scan_structural(facts, struct_rules))
    # Kept once: the filter reads the findings three times, and the passes behind them run only here.
    return fd.drop_unconfirmed(cut_lineage(fd.dedupe_findings(found)))


def scan(corpus: DataFrame, advisories: DataFrame | None = None, added: DataFrame | None = None,
         baseline: DataFrame | None = None, least: str = "LOW", exclude=None, ranges: DataFrame | None = None,
         **options) -> tuple[DataFrame, DataFrame]:
    """(findings, suppressed count) of a (file, content) corpus.

    Optional: an advisory table (dependency scan) and version ranges of advisories, added lines (history
    scan), a baseline of known fingerprints and a least confidence.
    """
    files = scannable(corpus, exclude) if exclude is not None else scannable(corpus)
    found = scan_files(files, **options).select(*FINDING_COLUMNS)
    if advisories is not None:
        manifests = read_dependencies(corpus) if exclude is None else read_dependencies(corpus, exclude)
        deps = scan_dependencies(manifests, advisories, ranges=ranges)
        found = found.unionByName(deps.select(*FINDING_COLUMNS))
    if added is not None:
        found = found.unionByName(secrets.scan_history(added).select(*FINDING_COLUMNS))
    # Kept once: what follows reads findings, not the corpus.
    found = cut_lineage(fd.min_confidence(found, least))
    if baseline is None:
        return found, found.sparkSession.range(1).select(F.lit(0).cast("long").alias("suppressed"))
    return fd.suppress_baseline(found, baseline), fd.count_suppressed(found, baseline)
