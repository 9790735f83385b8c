"""Detectors: rules, flow checks and reverse-engineering checks over source texts.

Every detector describes *what* to look for as ``Check`` rows and hands them to
``run_checks``, which evaluates any number of them in one pass over the corpus
(``match_scan``).  Nothing here shuffles; text columns end with the pass.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnsieve.catalog import patterns as P
from vulnsieve.catalog.rules import RULES, Rule, parse_anchors
from vulnsieve.functions import matching as M
from vulnsieve.functions import text as X
from vulnsieve.schemas import FINDING_COLUMNS

SEQ_STEP = 1_000_000_000  # room for the matches of one check in one file

# Ordinals follow the emission order of the modules: model, rules, dangerous calls,
# data flow, missing controls, then the reverse-engineering checks.
MODEL_BASE, RULE_BASE, CALL_BASE, FLOW_BASE, CONTROL_BASE = 0, 1000, 2000, 3000, 4000
BINARY_BASE, API_BASE, ENDPOINT_BASE, HIDDEN_BASE, DECOMPILED_BASE = 5000, 5100, 5200, 5300, 5400
IMPORT_BASE = 6000


@dataclass(frozen=True)
class Check:
    """What to look for and what to report.  ``gate`` is a SQL condition on the
    columns of ``with_features``; a check without pattern reports the whole file."""

    ordinal: int
    vuln_class: int
    severity: str
    confidence: float
    source: str
    message: str
    gate: str
    pattern: str | None = None
    rule_id: str = ""


def _flow_is(language: str) -> str:
    return M.sql_in("flow_language", [language])


# ── rules ───────────────────────────────────────────────────────────────────

def rule_checks(rules: Sequence[Rule] = RULES) -> list[Check]:
    def gate(rule: Rule) -> str:
        anchors = M.sql_anchors("_low", rule.anchors) if rule.anchors else "true"
        return anchors if rule.languages is None else f"{M.sql_in('language', rule.languages)} AND {anchors}"

    return [
        Check(RULE_BASE + r.rule_idx, r.vuln_class, r.severity, r.confidence, "static_rule", r.message,
              gate(r), M.RULE_FLAGS + r.pattern, r.rule_id)
        for r in rules
    ]


# ── flow analysis ───────────────────────────────────────────────────────────

def call_checks() -> list[Check]:
    rows = [(language, *row) for language, calls in P.DANGEROUS_CALLS.items() for row in calls]
    return [
        Check(CALL_BASE + i, vuln_class, severity, P.DANGEROUS_CALL_CONFIDENCE, "code_analysis", message,
              f"{_flow_is(language)} AND {M.sql_contains('content', name)}",
              M.EXACT_FLAGS + r"\b" + re.escape(name) + r"\s*\(")
        for i, (language, name, vuln_class, severity, message) in enumerate(rows)
    ]


def _has_source() -> str:
    branches = []
    for language, rows in P.FLOW_SOURCES.items():
        found = M.sql_any(
            M.sql_all([M.sql_contains("content", anchor), M.sql_rlike("content", M.EXACT_FLAGS + pattern)])
            for pattern, anchor in rows)
        branches.append(f"WHEN {_flow_is(language)} THEN {found}")
    return f"CASE {' '.join(branches)} ELSE false END"


def sink_checks() -> list[Check]:
    rows = [(language, *row) for language, sinks in P.FLOW_SINKS.items() for row in sinks]
    return [
        Check(FLOW_BASE + i, vuln_class, "medium", P.FLOW_CONFIDENCE, "data_flow", message,
              f"{_flow_is(language)} AND has_source AND {M.sql_contains('content', anchor)}",
              M.EXACT_FLAGS + pattern)
        for i, (language, pattern, vuln_class, message, anchor) in enumerate(rows)
    ]


CONTROL_FRAMEWORKS = ("django", "flask", "express")


def control_checks() -> list[Check]:
    def gate(scope: str, low_absent, exact_absent, low_present) -> str:
        kind, _, language = scope.partition(":")
        conditions = [_flow_is(language) if kind == "language" else f"uses_{scope}"]
        conditions += [f"NOT {M.sql_contains('_low', w)}" for w in low_absent]
        conditions += [f"NOT {M.sql_contains('content', w)}" for w in exact_absent]
        if low_present:
            conditions.append(M.sql_contains("_low", low_present))
        return M.sql_all(conditions)

    return [
        Check(CONTROL_BASE + i, P.MISSING_CONTROL_CLASS, severity, P.MISSING_CONTROL_CONFIDENCE,
              "missing_control", message, gate(scope, low_absent, exact_absent, low_present))
        for i, (scope, low_absent, exact_absent, low_present, severity, message) in enumerate(P.MISSING_CONTROLS)
    ]


def import_checks() -> list[Check]:
    rows = [(language, *row) for language, imports in P.IMPORTS.items() for row in imports]
    return [
        Check(IMPORT_BASE + i, -1, "", 0.0, "import", message,
              f"{_flow_is(language)} AND {M.sql_contains('content', anchor)}", M.EXACT_FLAGS + pattern)
        for i, (language, pattern, message, anchor) in enumerate(rows)
    ]


# ── reverse-engineering checks ──────────────────────────────────────────────

def sql_binary(path: str, head: str) -> str:
    """SQL: a NUL among the first bytes, or a suffix of compiled code."""
    suffixes = [f"endswith({path}, {M.sql_text(s)})" for s in P.BINARY_SUFFIXES]
    return M.sql_any([f"contains(CAST({head} AS STRING), char(0))", *suffixes])


_TEXT_HEAD = (f"substring(encode(substring(content, 1, {P.BINARY_HEAD_BYTES}), 'UTF-8'), "
              f"1, {P.BINARY_HEAD_BYTES})")


def binary_checks(is_binary: str = sql_binary("path", _TEXT_HEAD)) -> list[Check]:
    gate = f"{is_binary} AND {M.sql_contains_any('_low', P.BINARY_MARKERS)}"
    return [Check(BINARY_BASE, 4, "high", P.REVERSE_CONFIDENCE, "binary_inspection", P.BINARY_MESSAGE,
                  gate, P.BINARY_STRING)]


def api_checks() -> list[Check]:
    gate = M.sql_all([
        M.sql_in("language", P.API_LANGUAGES),
        M.sql_contains_any("_low", P.API_ROUTE_WORDS),
        "NOT " + M.sql_contains_any("_low", P.API_AUTH_WORDS),
    ])
    return [Check(API_BASE, 9, "medium", P.REVERSE_CONFIDENCE, "api_inference", P.API_MESSAGE, gate)]


def endpoint_checks() -> list[Check]:
    return [
        Check(ENDPOINT_BASE + i, 9, "medium", P.REVERSE_CONFIDENCE, "endpoint_discovery", P.ENDPOINT_MESSAGE,
              M.sql_contains("content", anchor), M.EXACT_FLAGS + pattern)
        for i, (pattern, anchor) in enumerate(P.ENDPOINTS)
    ]


def hidden_checks() -> list[Check]:
    return [
        Check(HIDDEN_BASE + i, 9, "high", P.REVERSE_CONFIDENCE, "hidden_route_detection", P.HIDDEN_MESSAGE + message,
              M.sql_anchors("_low", parse_anchors(anchor)), M.NOCASE_DOTALL_FLAGS + pattern)
        for i, (pattern, message, anchor) in enumerate(P.HIDDEN_ROUTES)
    ]


def decompiled_checks() -> list[Check]:
    return [
        Check(DECOMPILED_BASE + i, 6, "low", P.REVERSE_CONFIDENCE, "decompiled_logic_analysis",
              P.DECOMPILED_MESSAGE + message, M.sql_contains("content", anchor), M.EXACT_FLAGS + pattern)
        for i, (pattern, message, anchor) in enumerate(P.DECOMPILED)
    ]


def flow_checks() -> list[Check]:
    return call_checks() + sink_checks() + control_checks()


def reverse_checks() -> list[Check]:
    return binary_checks() + api_checks() + endpoint_checks() + hidden_checks() + decompiled_checks()


# ── evaluation ──────────────────────────────────────────────────────────────

def with_features(files: DataFrame, flow: bool, controls: bool, sources: bool, gates: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Adds the per-text columns the gates look at, each computed once per row; the gates on them.

    All plain substring tests are answered by one pass over the text (``M.WordTests``).
    """
    tests = M.WordTests()
    gates = [tests.in_bits(g) for g in gates]
    has_source = tests.in_bits(_has_source()) if sources else None
    frameworks = {name: tests.in_bits(X.sql_framework("_normal", name, raw="content")) for name in CONTROL_FRAMEWORKS} if controls else {}
    unknown = "language = 'unknown'"
    needs_normal = [unknown]
    if controls:
        anchors = [a for f in CONTROL_FRAMEWORKS for a in P.FRAMEWORKS[f][1]]
        needs_normal.append(tests.in_bits(M.sql_contains_any("content", anchors)))
    df = files.select(
        "file_id", "path",
        M.reserve_marks(F.col("content")).alias("content"),
        X.language_from_path(F.col("path")).alias("language"),
    ).withColumns({"_low": F.lower("content"), "_words": tests.column(F.col("content"))})
    if not flow:
        return df, gates
    # Language and frameworks are read off the normalised text, which is only
    # built where a decision depends on it.
    df = df.withColumn("_normal", F.when(F.expr(M.sql_any(needs_normal)), X.normalize(F.col("content"))))
    columns = {
        "flow_language": F.when(F.expr(unknown), X.language_from_content("_normal")).otherwise(F.col("language"))}
    for name, used in frameworks.items():
        columns[f"uses_{name}"] = F.expr(f"coalesce({used}, false)")
    df = df.withColumns(columns)
    return (df.withColumn("has_source", F.expr(has_source)) if sources else df), gates


def featured(files: DataFrame, checks: Sequence[Check]) -> tuple[DataFrame, list[str]]:
    """``with_features`` for what the gates of these checks look at, and these gates."""
    ordinals = [c.ordinal for c in checks]

    def within(low: int, high: int) -> bool:
        return any(low <= o < high for o in ordinals)

    return with_features(
        files,
        flow=within(CALL_BASE, BINARY_BASE) or within(IMPORT_BASE, IMPORT_BASE + 1000),
        controls=within(CONTROL_BASE, BINARY_BASE),
        sources=within(FLOW_BASE, CONTROL_BASE),
        gates=[c.gate for c in checks],
    )


def matches(files: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Raw matches: ``file_id, path, ordinal, match_idx, line, matched_text``."""
    rows, gates = featured(files, checks)
    probes = [M.Probe(c.ordinal, gate, c.pattern) for c, gate in zip(checks, gates)]
    return M.match_scan(rows, probes, text="content", keep=["file_id", "path"])


def _check_table(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """The checks as rows, one per check (a fixed number, hence the broadcast)."""
    return F.broadcast(df.sparkSession.createDataFrame(
        [(c.ordinal, c.vuln_class, c.severity, c.confidence, c.source, c.rule_id, c.message) for c in checks],
        "ordinal int, vuln_class int, severity string, confidence double, source string, rule_id string, message string",
    ))


def endpoint_path(ordinal: Column, matched: Column) -> Column:
    path = None
    for i, (pattern, _) in enumerate(P.ENDPOINTS):
        hit, value = ordinal == ENDPOINT_BASE + i, F.regexp_extract(matched, M.EXACT_FLAGS + pattern, 1)
        path = F.when(hit, value) if path is None else path.when(hit, value)
    return path


def run_checks(files: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Findings (``schemas.FINDINGS``) of all checks, in one pass over ``files``.

    ``files``: ``file_id long, path string, content string``.
    """
    df = matches(files, checks).join(_check_table(files, checks), "ordinal")
    ordinals = {c.ordinal for c in checks}
    matched, message = F.col("matched_text"), F.col("message")
    if BINARY_BASE in ordinals:
        is_binary = F.col("ordinal") == BINARY_BASE
        df = df.filter(~is_binary | F.expr(M.sql_contains_any("lower(matched_text)", P.BINARY_MARKERS)))
        before, after = P.BINARY_MESSAGE.split("{}")
        message = F.when(is_binary, F.concat(F.lit(before), F.substring(matched, 1, 50), F.lit(after))).otherwise(message)
    if ENDPOINT_BASE in ordinals:
        is_endpoint = F.col("ordinal").between(ENDPOINT_BASE, ENDPOINT_BASE + len(P.ENDPOINTS) - 1)
        df = df.withColumn("endpoint", F.when(is_endpoint, endpoint_path(F.col("ordinal"), matched)))
        df = df.filter(~is_endpoint | F.expr(M.sql_contains_any("lower(endpoint)", P.ENDPOINT_SENSITIVE)))
        message = F.when(is_endpoint, F.concat(F.lit(P.ENDPOINT_MESSAGE), F.col("endpoint"))).otherwise(message)
    is_rule = F.col("source") == "static_rule"
    is_line_less = F.col("ordinal") == BINARY_BASE
    return df.select(
        "file_id", "path", "vuln_class",
        F.when(is_line_less, F.lit(0)).otherwise(F.col("line")).cast("int").alias("line"),
        message.alias("message"), "severity", "confidence", "source", "rule_id",
        F.when(is_rule, F.substring(matched, 1, 200)).otherwise(F.lit("")).alias("matched_text"),
        (F.col("ordinal").cast("long") * SEQ_STEP + F.col("match_idx")).alias("seq"),
    ).select(*FINDING_COLUMNS)


def rule_scan(files: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Every match of every rule that applies to the file's language."""
    return run_checks(files, rule_checks(rules))


def secret_scan(files: DataFrame) -> DataFrame:
    """Only the credential rules (class 4)."""
    return rule_scan(files, [r for r in RULES if r.vuln_class == 4])


def dangerous_calls(files: DataFrame) -> DataFrame:
    return run_checks(files, call_checks())


def data_flow(files: DataFrame) -> DataFrame:
    return run_checks(files, sink_checks())


def missing_controls(files: DataFrame) -> DataFrame:
    return run_checks(files, control_checks())


def flow_scan(files: DataFrame) -> DataFrame:
    return run_checks(files, flow_checks())


def import_scan(files: DataFrame) -> DataFrame:
    """Security-relevant imports: ``file_id, path, line, import_text, message``."""
    checks = import_checks()
    return matches(files, checks).join(_check_table(files, checks), "ordinal").select(
        "file_id", "path", "line", F.col("matched_text").alias("import_text"), "message")


def api_inference(files: DataFrame) -> DataFrame:
    return run_checks(files, api_checks())


def endpoint_table(files: DataFrame) -> DataFrame:
    """Every route found, sensitive or not: ``file_id, path, line, endpoint, sensitive``."""
    found = matches(files, endpoint_checks()).withColumn(
        "endpoint", endpoint_path(F.col("ordinal"), F.col("matched_text")))
    return found.select(
        "file_id", "path", "line", "endpoint",
        F.expr(M.sql_contains_any("lower(endpoint)", P.ENDPOINT_SENSITIVE)).alias("sensitive"))


def endpoints(files: DataFrame) -> DataFrame:
    return run_checks(files, endpoint_checks())


def hidden_routes(files: DataFrame) -> DataFrame:
    return run_checks(files, hidden_checks())


def decompiled_artifacts(files: DataFrame) -> DataFrame:
    return run_checks(files, decompiled_checks())


def reverse_scan(files: DataFrame) -> DataFrame:
    return run_checks(files, reverse_checks())


def binary_strings(files: DataFrame) -> DataFrame:
    """Embedded secrets of binaries.  ``files``: ``file_id, path, content binary``.

    Bytes are read as Latin-1, one character per byte; the whole file is scanned.
    """
    is_binary = sql_binary("path", f"substring(content, 1, {P.BINARY_HEAD_BYTES})")
    latin1 = F.decode("content", "ISO-8859-1")
    texts = files.filter(is_binary).select("file_id", "path", latin1.alias("content"))
    return run_checks(texts, binary_checks("true"))
