"""The whole scan as one lazy plan: detect, merge, threshold, enrich, order."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from vulnsieve.catalog.rules import RULES, Rule
from vulnsieve.operators import detect, file_scan as fs, findings as fnd
from vulnsieve.sources.dimensions import vuln_classes

MODULES = ("rules", "flow", "reverse")


def checks_of(rules: Sequence[Rule] = RULES, modules: Collection[str] = MODULES) -> list[detect.Check]:
    checks = []
    if "rules" in modules:
        checks += detect.rule_checks(rules)
    if "flow" in modules:
        checks += detect.flow_checks()
    if "reverse" in modules:
        checks += detect.reverse_checks()
    return checks


def detect_all(
    files: DataFrame,
    rules: Sequence[Rule] = RULES,
    modules: Collection[str] = MODULES,
    model_scores: DataFrame | None = None,
    extra: Sequence[DataFrame] = (),
) -> DataFrame:
    """Unmerged findings of the chosen modules.

    All text checks share one pass over the corpus; reverse-engineering checks are
    always on unless left out of ``modules``.  ``extra`` are finding tables of one's
    own scans with the same schema.
    """
    checks = checks_of(rules, modules)
    scans = [detect.run_checks(files, checks)] if checks else []
    if model_scores is not None:
        scans.insert(0, fnd.model_findings(model_scores, vuln_classes(files.sparkSession)))
    return fnd.union_findings(*scans, *extra)


@dataclass
class FileScan:
    """A scan with one row per file (see ``file_scan.scan_files``); everything else follows from the rows."""

    files: DataFrame
    checks: list[detect.Check]

    def findings(self, position: bool = False) -> DataFrame:
        """The merged findings, enriched by their class."""
        rows = fs.finding_rows(self.files, self.checks, position)
        return fnd.enrich_class(rows, vuln_classes(self.files.sparkSession))

    def results(self) -> DataFrame:
        return fs.file_results(self.files, self.checks)


def scan_by_file(
    files: DataFrame, rules: Sequence[Rule] = RULES, modules: Collection[str] = MODULES, at: float = fnd.DEFAULT_THRESHOLD,
) -> FileScan:
    """The scan of every file in its row: one map-only pass, no shuffle."""
    checks = checks_of(rules, modules)
    return FileScan(fs.scan_files(files, checks, at), checks)


def scan(
    files: DataFrame,
    rules: Sequence[Rule] = RULES,
    modules: Collection[str] = MODULES,
    at: float = fnd.DEFAULT_THRESHOLD,
    model_scores: DataFrame | None = None,
    extra: Sequence[DataFrame] = (),
) -> DataFrame:
    """Merged, thresholded and enriched findings.

    The checks alone merge inside the row of their file (``scan_by_file``).  Findings of a model or
    of one's own scans come from other tables, so with them all findings are merged by one shuffle.
    """
    if model_scores is None and not extra and (checks := checks_of(rules, modules)):
        return FileScan(fs.scan_files(files, checks, at), checks).findings()
    found = detect_all(files, rules, modules, model_scores, extra)
    merged = fnd.threshold(fnd.merge_findings(found), at)
    return fnd.enrich_class(merged, vuln_classes(files.sparkSession))
