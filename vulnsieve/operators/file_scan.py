"""The whole scan of a file inside its row: matches, merging, threshold and order without a shuffle.

A file is one row of the corpus, so all that merges with a finding lies in the same row.  ``scan_files``
keeps it there: the gates of ``match_scan`` become an array, every open gate turns into an array of matches
by a lambda, and merging is a sort of that array and a cut where class and line change.  What consumers
need of it (counts, clean files, ordered lists) follows from the row; nothing is regrouped by file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnsieve.catalog import patterns as P
from vulnsieve.catalog.classes import SEVERITY_ORDER
from vulnsieve.functions import matching as M
from vulnsieve.operators import detect as D
from vulnsieve.operators.findings import BOOST, CEILING
from vulnsieve.schemas import FINDING_COLUMNS

MATCH_BITS, ORDER_BITS = 40, 54  # a rank: confidence rank, number of the check, number of the match


def _literals(values: Sequence, at: str, kind: str) -> str:
    """SQL for one of several fixed values by its number; folded to a literal array."""
    return f"element_at(array({', '.join(f'cast({v} as {kind})' for v in values)}), {at} + 1)"


def _matches_sql(checks: Sequence[D.Check]) -> str:
    """SQL: ``array<struct<key long, rank long, detail string, holds boolean>>`` of the row's open gates.

    ``key`` is class and line, ``rank`` orders findings of one key, the winner first.  ``detail`` is the part
    of a match that the report shows: the text for rules, the route for endpoints.
    """
    confidences = sorted({c.confidence for c in checks}, reverse=True)
    if len(checks) >= 1 << (ORDER_BITS - MATCH_BITS) or len(confidences) >= 1 << (63 - ORDER_BITS):
        raise ValueError("more checks or confidence levels than a rank has room for")
    mark, end = M.sql_text(M.MARK), M.sql_text(M.END)
    marked = "\n".join(
        f"WHEN {i} THEN " + (M.sql_mark("content", c.pattern) if c.pattern else M.sql_text(M.MARK + M.END))
        for i, c in enumerate(checks))
    lines = (f"flatten(transform(split(m, '\\n', -1), (l, k) -> CASE WHEN contains(l, {mark}) THEN "
             f"array_repeat(k + 1, length(l) - length(replace(l, {mark}, ''))) ELSE cast(array() as array<int>) END))")
    texts = f"transform(slice(split(m, {mark}, -1), 2, {1 << 30}), part -> substring_index(part, {end}, 1))"
    rules = [i for i, c in enumerate(checks) if c.source == "static_rule"]
    whole = [i for i, c in enumerate(checks) if c.pattern is None or c.ordinal == D.BINARY_BASE]
    detail, holds = [], []
    if rules:
        detail.append(f"WHEN g BETWEEN {rules[0]} AND {rules[-1]} THEN substring(x.`1`, 1, 200)")
    for i, c in enumerate(checks):
        if c.ordinal == D.BINARY_BASE:
            detail.append(f"WHEN g = {i} THEN substring(x.`1`, 1, 50)")
            holds.append(f"WHEN g = {i} THEN {M.sql_contains_any('lower(x.`1`)', P.BINARY_MARKERS)}")
        elif D.ENDPOINT_BASE <= c.ordinal < D.ENDPOINT_BASE + len(P.ENDPOINTS):
            route = f"regexp_extract(x.`1`, {M.sql_text(c.pattern)}, 1)"
            detail.append(f"WHEN g = {i} THEN {route}")
            holds.append(f"WHEN g = {i} THEN {M.sql_contains_any(f'lower({route})', P.ENDPOINT_SENSITIVE)}")
    line = f"CASE WHEN g IN ({', '.join(map(str, whole))}) THEN 0 ELSE x.`0` END" if whole else "x.`0`"
    one = f"""named_struct(
        'key', {_literals([c.vuln_class for c in checks], 'g', 'bigint')} * {1 << 32}L + {line},
        'rank', {_literals([confidences.index(c.confidence) for c in checks], 'g', 'bigint')} * {1 << ORDER_BITS}L
            + g * {1 << MATCH_BITS}L + i,
        'detail', {'CASE ' + ' '.join(detail) + " ELSE '' END" if detail else "''"},
        'holds', {'CASE ' + ' '.join(holds) + ' ELSE true END' if holds else 'true'})"""
    # the marked text of one gate at a time: the inner array holds nothing else, or no text if nothing matched
    return f"""filter(flatten(flatten(transform(_open, g -> transform(filter(array(CASE g {marked} END), t -> contains(t, {mark})),
        m -> transform(arrays_zip({lines}, {texts}), (x, i) -> {one}))))), f -> f.holds)"""


def _evaluated_here(column: Column) -> Column:
    """The column, not to be moved: a filter on it would else be pushed below the projections it is made in,
    with all their expressions written out again in its place.  A partition has a number, so it is unchanged."""
    return F.when(F.spark_partition_id() >= 0, column)


def _check_number(rank: str) -> str:
    return f"cast(shiftright({rank}, {MATCH_BITS}) & {(1 << (ORDER_BITS - MATCH_BITS)) - 1} as int)"


def scan_files(files: DataFrame, checks: Sequence[D.Check], at: float | None = None) -> DataFrame:
    """``file_id, path, findings``: every file with its merged findings in report order, an empty list if none.

    ``findings`` is an array of ``severity_rank, less (minus the confidence), place, check, line, confidence,
    sources (a bit mask), detail``; ``finding_rows`` turns it into a table of findings.  Of the findings of
    one class and line the most confident stays, the earliest of equals; agreeing sources boost it as in
    ``merge_findings``.  Findings below ``at`` are left out.
    """
    checks = sorted(checks, key=lambda c: c.ordinal)
    names = sorted({c.source for c in checks})
    rows, conditions = D.featured(files, checks)
    gates = ", ".join(f"CASE WHEN {gate} THEN {i} END" for i, gate in enumerate(conditions))
    rows = rows.select("file_id", "path", "content", F.expr(f"array_compact(array({gates}))").alias("_open"))
    found = rows.select("file_id", "path", F.expr(f"sort_array({_matches_sql(checks)})").alias("_found"))
    begins = found.withColumn("_begins", F.expr(
        "array_compact(transform(_found, (f, i) -> CASE WHEN i = 0 OR get(_found, i - 1).key <> f.key THEN i END))"))
    bits = _literals([1 << names.index(c.source) for c in checks], _check_number("f.rank"), "int")
    merged = begins.select("file_id", "path", F.expr(f"""transform(_begins, (b, j) -> named_struct(
        'rank', get(_found, b).rank, 'line', cast(get(_found, b).key & {(1 << 32) - 1}L as int), 'detail', get(_found, b).detail,
        'sources', aggregate(slice(_found, b + 1, coalesce(get(_begins, j + 1), size(_found)) - b), 0, (all, f) -> all | {bits})))
        """).alias("_merged"))
    number = _check_number("f.rank")
    confidence = _literals([repr(float(c.confidence)) for c in checks], number, "double")
    rated = merged.select("file_id", "path", F.expr(f"""transform(_merged, f -> named_struct(
        'check', {number}, 'place', f.rank & {(1 << ORDER_BITS) - 1}L, 'line', f.line, 'sources', f.sources, 'detail', f.detail,
        'confidence', CASE WHEN bit_count(f.sources) > 1 THEN least({CEILING}D, {confidence} * {BOOST}D) ELSE {confidence} END))
        """).alias("_rated"))
    severity = _literals([SEVERITY_ORDER.index(c.severity) if c.severity in SEVERITY_ORDER else len(SEVERITY_ORDER) for c in checks],
                         "f.check", "int")
    kept = "_rated" if at is None else f"filter(_rated, f -> f.confidence >= {float(at)!r}D)"
    ordered = F.expr(f"""sort_array(transform({kept}, f -> named_struct(
        'severity_rank', {severity}, 'less', -f.confidence, 'place', f.place, 'check', f.check, 'line', f.line,
        'confidence', f.confidence, 'sources', f.sources, 'detail', f.detail)))""")
    return rated.select("file_id", "path", _evaluated_here(ordered).alias("findings"))


def _finding_sql(checks: Sequence[D.Check], columns: Sequence[str]) -> str:
    """SQL: finding ``f`` of ``scan_files``, the ``i``-th of its file, as a struct of columns of ``schemas.FINDINGS``.

    What a check always reports stands in literal arrays, one entry per check.
    """
    names = sorted({c.source for c in checks})

    def text(values) -> str:
        return _literals([M.sql_text(v) for v in values], "f.check", "string")

    before, after = (M.sql_text(part) for part in P.BINARY_MESSAGE.split("{}"))
    own = [f"WHEN {i} THEN concat({before}, f.detail, {after})" if c.ordinal == D.BINARY_BASE
           else f"WHEN {i} THEN concat({M.sql_text(P.ENDPOINT_MESSAGE)}, f.detail)" for i, c in enumerate(checks)
           if c.ordinal == D.BINARY_BASE or D.ENDPOINT_BASE <= c.ordinal < D.ENDPOINT_BASE + len(P.ENDPOINTS)]
    message = text(c.message for c in checks)
    rules = [str(i) for i, c in enumerate(checks) if c.source == "static_rule"]
    agreeing = ", ".join(f"CASE WHEN f.sources & {1 << i} <> 0 THEN {M.sql_text(n)} END" for i, n in enumerate(names))
    values = {
        "vuln_class": _literals([c.vuln_class for c in checks], "f.check", "int"), "line": "f.line",
        "message": f"CASE f.check {' '.join(own)} ELSE {message} END" if own else message,
        "severity": text(c.severity for c in checks), "confidence": "f.confidence",
        "source": f"CASE WHEN bit_count(f.sources) > 1 THEN concat_ws(' + ', {agreeing}) ELSE {text(c.source for c in checks)} END",
        "rule_id": text(c.rule_id for c in checks),
        "matched_text": f"CASE WHEN f.check IN ({', '.join(rules)}) THEN f.detail ELSE '' END" if rules else "''",
        "seq": f"{_literals([c.ordinal for c in checks], 'f.check', 'bigint')} * {D.SEQ_STEP}L + (f.place & {(1 << MATCH_BITS) - 1}L)",
        "position": "i + 1"}
    return f"named_struct({', '.join(f'{M.sql_text(c)}, {values[c]}' for c in columns)})"


def finding_rows(scanned: DataFrame, checks: Sequence[D.Check], position: bool = False) -> DataFrame:
    """The findings of ``scan_files`` as a table (``schemas.FINDINGS``), with their place in the file if asked for."""
    columns = [*FINDING_COLUMNS[2:], *(["position"] if position else [])]
    checks = sorted(checks, key=lambda c: c.ordinal)
    found = F.expr(f"inline(transform(findings, (f, i) -> {_finding_sql(checks, columns)}))")
    return scanned.select("file_id", "path", found)


def file_results(scanned: DataFrame, checks: Sequence[D.Check], columns: Sequence[str] = FINDING_COLUMNS[2:]) -> DataFrame:
    """Every file with ``count`` and its ordered list of findings."""
    checks = sorted(checks, key=lambda c: c.ordinal)
    listed = F.expr(f"transform(findings, (f, i) -> {_finding_sql(checks, columns)})")
    return scanned.select("file_id", "path", F.size("findings").alias("count"), listed.alias("findings"))


def with_severity(findings: str | Column, severity: str) -> Column:
    """How many of a file's findings have that severity."""
    return F.size(F.filter(findings, lambda f: f.severity_rank == SEVERITY_ORDER.index(severity)))


def file_counts(scanned: DataFrame) -> DataFrame:
    """Every file with its number of findings, zero where there is none."""
    return scanned.select("file_id", "path", F.size("findings").cast("long").alias("n"))


def clean_files(scanned: DataFrame) -> DataFrame:
    return scanned.filter(F.size("findings") == 0).select("file_id", "path")


def scan_totals(files_total: Column, total: Column, per_severity: dict[str, Column], rules_total: int, ml: bool, rules: bool,
                flow: bool) -> list[Column]:
    """The columns of a scan summary.  A Spark job scans every file or fails, so no file is left with an error."""
    return [
        files_total.alias("files_total"), files_total.alias("files_scanned"), F.lit(0).cast("long").alias("errors"),
        total.alias("total_findings"), *[n.alias(s) for s, n in per_severity.items()],
        F.lit(ml).alias("ml_enabled"), F.lit(rules).alias("rules_enabled"), F.lit(flow).alias("flow_enabled"),
        F.lit(rules_total).cast("int").alias("total_rules"),
        F.when(per_severity["critical"] > 0, 2).when(total > 0, 1).otherwise(0).alias("exit_code")]


def totals_of(findings: str = "findings") -> dict[str, Column]:
    """Aggregates over scanned files: their number, their findings and those of every severity."""
    zero = F.lit(0).cast("long")
    return {"files_total": F.count(F.lit(1)), "total_findings": F.coalesce(F.sum(F.size(findings)), zero),
            **{s: F.coalesce(F.sum(with_severity(findings, s)), zero) for s in SEVERITY_ORDER}}


def scan_summary(scanned: DataFrame, rules_total: int, ml: bool, rules: bool, flow: bool) -> DataFrame:
    """One row: file and finding totals, engine switches and the exit code, in one pass over the corpus."""
    row = scanned.agg(*[c.alias(f"_{name}") for name, c in totals_of().items()])
    return row.select(*scan_totals(F.col("_files_total"), F.col("_total_findings"),
                                   {s: F.col(f"_{s}") for s in SEVERITY_ORDER}, rules_total, ml, rules, flow))
