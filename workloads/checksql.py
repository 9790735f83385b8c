"""SQL of the check engine for text functions, detectors and merging.

It states the same results without anchors or marks: patterns are joined with texts,
and the line of a match is counted from the gaps and matches before it.
"""

from __future__ import annotations

import re

from vulnsieve.catalog import patterns as P
from vulnsieve.functions import matching as M
from vulnsieve.operators import detect as D

from workloads.base import lit

NEWLINE = "chr(10)"


def count_newlines(text: str) -> str:
    return f"(length({text}) - length(replace({text}, {NEWLINE}, '')))"


def matches(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {lit(pattern)})"


LOOKAROUND = re.compile(r"\(\?<?![^()]*\)")
_PREFIX = "lower(before || earlier)"


def _rest(pattern: str) -> str:
    return f"regexp_matches(rest, {lit('(?i)^(?:' + pattern + ')')})"


def _shorter(pattern: str) -> tuple[str, str]:
    """A look-ahead after blanks: where it fails, one blank less is matched, if there is one."""
    fails = _rest(pattern)
    return (f"(NOT {fails} OR regexp_matches(matched, '\\s$'))",
            f"CASE WHEN {fails} THEN substr(matched, 1, length(matched) - 1) ELSE matched END")


def _line_above(pattern: str) -> tuple[str, str]:
    """A look-ahead over the rest of the line: where it fails, the match ends before the last line end in its blanks."""
    fails = _rest(pattern)
    return (f"(NOT {fails} OR regexp_matches(matched, '\\n\\s*$'))",
            f"CASE WHEN {fails} THEN regexp_replace(matched, '\\n[^\\S\\n]*$', '') ELSE matched END")


def _tail(head: str, pattern: str) -> tuple[str, str]:
    """A look-ahead inside the match, right after ``head``."""
    tail = f"substr(matched || rest, 1 + length(regexp_extract(matched, {lit('(?i)^' + head)})))"
    return f"NOT regexp_matches({tail}, {lit('(?i)^(?:' + pattern + ')')})", "matched"


# rule -> which matches of the pattern without its look-around stay, and what text they keep
LOOKAROUND_SQL = {
    "XSS001": _shorter("['\"]<"), "XSS007": _shorter("escape"), "SSR002": _shorter("['\"]https?://"),
    "SSR005": _shorter("['\"]\\s*https?://"), "SSR006": _shorter("['\"]https?://"),
    "XSS011": (f"NOT {_rest('[\'\"]<')}", "matched"),
    "XSS012": _line_above(".*escape|.*sanitize|.*encode"),
    "DES002": _line_above(r".*Loader\s*=\s*yaml\.SafeLoader|.*safe_load"),
    "DES005": _line_above(".*ValidatingObjectInputStream"),
    "BOF001": (f"NOT ends_with({_PREFIX}, 'strn')", "matched"), "BOF002": (f"NOT ends_with({_PREFIX}, 'strn')", "matched"),
    "BOF004": (f"NOT {_rest('.*snprintf')}", "matched"),
    "RNG001": (f"NOT (ends_with({_PREFIX}, 'secrets.') OR ends_with({_PREFIX}, 'secure'))", "matched"),
    "PTH004": _tail(r"send_file\s*\(\s*", ".*realpath|.*abspath|.*resolve"),
    "PTH005": _tail(r"res\.sendFile\s*\(\s*", ".*resolve|.*normalize"),
}


def portable(pattern: str) -> str:
    """The pattern with the flags of the check engine (its lines end at \\n only), without look-around."""
    pattern = LOOKAROUND.sub("", pattern)
    for ours, theirs in ((M.RULE_FLAGS, "(?im)"), (M.NOCASE_DOTALL_FLAGS, "(?is)"),
                         (M.DOTALL_FLAGS, "(?s)"), (M.EXACT_FLAGS, "")):
        if pattern.startswith(ours):
            return theirs + pattern[len(ours):]
    return pattern


EXTENSION_SQL = r"lower(regexp_extract(path, '[^/](\.[^./]+)$', 1))"
PATH_LANGUAGE_SQL = "CASE " + EXTENSION_SQL + " " + " ".join(
    f"WHEN {lit(e)} THEN {lit(language)}" for e, language in P.EXTENSION_LANGUAGE.items()) + " END"

_BLANKS = (r"[ \t\x0B\f\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def normalize(text: str) -> str:
    for pattern, by in ((r"\r\n?", NEWLINE), ("(?m)" + _BLANKS + "+$", "''"),
                        (r"\n{4,}", f"repeat({NEWLINE}, 3)"), (r"^\n{3,}", f"repeat({NEWLINE}, 2)"),
                        (r"\n{3,}$", f"repeat({NEWLINE}, 2)"), (r"^\n{2,}$", NEWLINE)):
        text = f"regexp_replace({text}, {lit(pattern)}, {by}, 'g')"
    return f"regexp_replace({text}, {lit(r'([^\n])$|^$')}, '\\1' || {NEWLINE})"


def content_language(text: str) -> str:
    scores = [
        (language, " + ".join(f"{matches(text, p)}::INT" for p, _ in rows))
        for language, rows in P.CONTENT_LANGUAGE.items()
    ]
    top = "greatest(" + ", ".join(s for _, s in scores) + ")"
    branches = " ".join(f"WHEN ({s}) = {top} THEN {lit(language)}" for language, s in scores)
    return f"CASE WHEN {top} = 0 THEN 'unknown' {branches} END"


def framework(text: str, name: str) -> str:
    return matches(text, "|".join(f"(?:{p})" for p in P.FRAMEWORKS[name][0]))


def frameworks(text: str) -> str:
    """Names joined by commas, in catalogue order."""
    names = ", ".join(f"CASE WHEN {framework(text, f)} THEN {lit(f)} END" for f in P.FRAMEWORKS)
    return f"concat_ws(',', {names})"


def features(flow: bool) -> str:
    """CTEs ``feat``: language, and for flow checks language and frameworks by content."""
    path_language = f"coalesce({PATH_LANGUAGE_SQL}, 'unknown')"
    if not flow:
        return f"feat AS (SELECT *, {path_language} AS language, 'none' AS flow_language, lower(content) AS low FROM code)"
    sources = " ".join(
        f"WHEN {lit(language)} THEN " + "(" + " OR ".join(matches("content", p) for p, _ in rows) + ")"
        for language, rows in P.FLOW_SOURCES.items())
    uses = ", ".join(f"{framework('normal', f)} AS uses_{f}" for f in D.CONTROL_FRAMEWORKS)
    return f"""normalized AS (
  SELECT *, {path_language} AS language, {normalize('content')} AS normal, lower(content) AS low FROM code),
spoken AS (
  SELECT *, CASE WHEN language <> 'unknown' THEN language ELSE {content_language('normal')} END AS flow_language,
    {uses} FROM normalized),
feat AS (SELECT *, CASE flow_language {sources} ELSE false END AS has_source FROM spoken)"""


def _whole_file_gate(check: D.Check) -> str:
    """Gate of a check without a pattern, in plain SQL."""
    if check.ordinal == D.API_BASE:
        has = lambda words: "(" + " OR ".join(f"contains(low, {lit(w)})" for w in words) + ")"
        languages = ", ".join(lit(x) for x in P.API_LANGUAGES)
        return f"language IN ({languages}) AND {has(P.API_ROUTE_WORDS)} AND NOT {has(P.API_AUTH_WORDS)}"
    scope, low_absent, exact_absent, low_present, _, _ = P.MISSING_CONTROLS[check.ordinal - D.CONTROL_BASE]
    kind, _, language = scope.partition(":")
    parts = [f"flow_language = {lit(language)}" if kind == "language" else f"uses_{scope}"]
    parts += [f"NOT contains(low, {lit(w)})" for w in low_absent]
    parts += [f"NOT contains(content, {lit(w)})" for w in exact_absent]
    if low_present:
        parts.append(f"contains(low, {lit(low_present)})")
    return " AND ".join(parts)


def _pattern_gate(check: D.Check) -> str:
    """Which language a pattern check is bound to, as a SQL condition of ``feat``."""
    o = check.ordinal
    if D.RULE_BASE <= o < D.CALL_BASE:
        languages = D.RULES[o - D.RULE_BASE].languages
        return "true" if languages is None else "language IN (" + ", ".join(lit(x) for x in languages) + ")"
    if o == D.BINARY_BASE:
        suffixes = " OR ".join(f"ends_with(path, {lit(x)})" for x in P.BINARY_SUFFIXES)
        return f"({suffixes} OR contains(substr(content, 1, {P.BINARY_HEAD_BYTES}), chr(0)))"
    for base, catalogue in ((D.CALL_BASE, P.DANGEROUS_CALLS), (D.FLOW_BASE, P.FLOW_SINKS), (D.IMPORT_BASE, P.IMPORTS)):
        spread = [language for language, rows in catalogue.items() for _ in rows]
        if base <= o < base + len(spread):
            source = " AND has_source" if base == D.FLOW_BASE else ""
            return f"flow_language = {lit(spread[o - base])}{source}"
    return "true"


def found(checks: list[D.Check]) -> str:
    """CTE ``found``: all findings of the checks, plus ``matched`` and ``rest`` of the text."""
    flow = any(D.CALL_BASE <= c.ordinal < D.BINARY_BASE or c.ordinal >= D.IMPORT_BASE for c in checks)
    parts = []
    with_pattern = [c for c in checks if c.pattern]
    if with_pattern:
        # one probe table per language condition keeps the join selective
        rows = ",\n".join(
            f"({c.ordinal}, {c.vuln_class}, {lit(c.severity)}, {lit(float(c.confidence))}, {lit(c.source)}, "
            f"{lit(c.rule_id)}, {lit(c.message)}, {lit(portable(c.pattern))}, {lit(_pattern_gate(c))})"
            for c in with_pattern)
        special = [c.rule_id for c in with_pattern if c.rule_id in LOOKAROUND_SQL]
        kept = " ".join(f"WHEN {lit(r)} THEN {LOOKAROUND_SQL[r][0]}" for r in special)
        kept = f"CASE rule_id {kept} ELSE true END" if special else "true"
        kept_text = " ".join(f"WHEN {lit(r)} THEN {LOOKAROUND_SQL[r][1]}" for r in special)
        kept_text = f"CASE rule_id {kept_text} ELSE matched END" if special else "matched"
        gates = sorted({_pattern_gate(c) for c in with_pattern})
        gate = " OR ".join(f"(gate = {lit(g)} AND {g})" for g in gates)
        parts.append(f"""probes(ordinal, vuln_class, severity, confidence, source, rule_id, message, pattern, gate) AS (
  VALUES {rows}),
hits AS (
  SELECT file_id, path, content, p.*, regexp_extract_all(content, pattern) AS ms, string_split_regex(content, pattern) AS gs
  FROM feat JOIN probes p ON ({gate}) WHERE regexp_matches(content, pattern)),
each AS (SELECT *, unnest(range(0, len(ms))) AS i FROM hits),
placed AS (
  SELECT *, array_to_string(gs[1:i+1], '') AS before, array_to_string(ms[1:i], '') AS earlier, ms[i+1] AS matched FROM each),
looked AS (
  SELECT *, substr(content, 1 + length(before) + length(earlier) + length(matched)) AS rest FROM placed),
around AS (SELECT * REPLACE ({kept_text} AS matched) FROM looked WHERE {kept}),
by_pattern AS (
  SELECT file_id, path, vuln_class, 1 + {count_newlines('before')} + {count_newlines('earlier')} AS line, message,
    severity, confidence, source, rule_id, matched, ordinal, i, rest
  FROM around)""")
    unions = ["SELECT * FROM by_pattern"] if with_pattern else []
    unions += [
        f"SELECT file_id, path, {c.vuln_class}, 0, {lit(c.message)}, {lit(c.severity)}, {lit(float(c.confidence))}, "
        f"{lit(c.source)}, '', '', {c.ordinal}, 0, '' FROM feat WHERE {_whole_file_gate(c)}"
        for c in checks if not c.pattern]
    columns = ("file_id, path, vuln_class, line, message, severity, confidence, source, rule_id, matched, ordinal, i, rest")
    endpoint = "CASE ordinal " + " ".join(
        f"WHEN {D.ENDPOINT_BASE + n} THEN regexp_extract(matched, {lit(p)}, 1)" for n, (p, _) in enumerate(P.ENDPOINTS)
    ) + " END"
    sensitive = " OR ".join(f"contains(lower(endpoint), {lit(w)})" for w in P.ENDPOINT_SENSITIVE)
    markers = " OR ".join(f"contains(lower(matched), {lit(m)})" for m in P.BINARY_MARKERS)
    return ",\n".join([features(flow), *parts]) + f""",
every({columns}) AS ({' UNION ALL '.join(unions)}),
routed AS (SELECT *, {endpoint} AS endpoint FROM every),
found AS (
  SELECT file_id, path, vuln_class, CASE WHEN ordinal = {D.BINARY_BASE} THEN 0 ELSE line END AS line,
    CASE WHEN endpoint IS NOT NULL THEN message || endpoint ELSE message END AS message,
    severity, confidence, source, rule_id,
    CASE WHEN source = 'static_rule' THEN substr(matched, 1, 200) ELSE '' END AS matched_text,
    ordinal::BIGINT * {D.SEQ_STEP} + i AS seq, endpoint, matched, rest, ordinal
  FROM routed
  WHERE (endpoint IS NULL OR {sensitive})
    AND (ordinal <> {D.BINARY_BASE} OR ({markers})))"""


FINDING_SELECT = ("SELECT file_id, path, vuln_class, line, message, severity, round(confidence, 6) AS confidence, source, "
                  "rule_id, matched_text, seq")

MERGED = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY file_id, vuln_class, line ORDER BY confidence DESC, seq) AS place FROM found),
agreed AS (
  SELECT file_id, vuln_class, line, count(DISTINCT source) AS n, string_agg(DISTINCT source, ' + ' ORDER BY source) AS names
  FROM found GROUP BY ALL),
merged AS (
  SELECT file_id, path, vuln_class, line, message, severity,
    CASE WHEN n > 1 THEN least(0.99::DOUBLE, confidence * 1.3::DOUBLE) ELSE confidence END AS confidence,
    CASE WHEN n > 1 THEN names ELSE source END AS source, rule_id, matched_text, seq
  FROM ranked JOIN agreed USING (file_id, vuln_class, line) WHERE place = 1)"""


def with_ctes(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select
