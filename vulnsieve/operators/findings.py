"""Findings: merging, thresholds, order, dimension join and counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vulnsieve.catalog.classes import SEVERITY_ORDER
from vulnsieve.operators.detect import MODEL_BASE, SEQ_STEP
from vulnsieve.schemas import FINDING_COLUMNS

BOOST, CEILING = 1.3, 0.99  # fixed values: agreement boost and its upper limit
DEFAULT_THRESHOLD = 0.5  # fixed value


def union_findings(*scans: DataFrame) -> DataFrame:
    """Bag union of finding tables; ``seq`` already carries the module order."""
    return reduce(lambda a, b: a.unionByName(b), (s.select(*FINDING_COLUMNS) for s in scans))


def merge_findings(findings: DataFrame) -> DataFrame:
    """One finding per (file, class, line).

    The most confident one stays (the earliest of equals).  Where at least two
    different sources agree, its confidence is boosted and all sources are named.
    Winner and source set are partial aggregates, so a crowded line is reduced
    before the shuffle; the source set has at most one entry per check module.
    """
    rest = [c for c in FINDING_COLUMNS if c not in ("file_id", "path", "vuln_class", "line")]
    best = F.max_by(F.struct(*rest), F.struct(F.col("confidence"), (-F.col("seq")).alias("o")))
    merged = findings.groupBy("file_id", "path", "vuln_class", "line").agg(
        best.alias("best"), F.array_sort(F.collect_set("source")).alias("sources"))
    agree = F.size("sources") > 1
    confidence = F.col("best.confidence")
    return merged.select(
        "file_id", "path", "vuln_class", "line", "best.message", "best.severity",
        F.when(agree, F.least(F.lit(CEILING), confidence * BOOST)).otherwise(confidence).alias("confidence"),
        F.when(agree, F.concat_ws(" + ", "sources")).otherwise(F.col("best.source")).alias("source"),
        "best.rule_id", "best.matched_text", "best.seq",
    )


def threshold(findings: DataFrame, at: float = DEFAULT_THRESHOLD) -> DataFrame:
    return findings.filter(F.col("confidence") >= at)


def finding_output(findings: DataFrame) -> DataFrame:
    """Output form: confidence to three places, matched text cut to 200 characters."""
    return findings.withColumns({
        "confidence": F.round("confidence", 3),
        "matched_text": F.substring("matched_text", 1, 200),
    })


def enrich_class(findings: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds name, CWE, OWASP category and remediation of the class."""
    dim = F.broadcast(classes.select(
        "vuln_class", F.col("name").alias("vulnerability_name"), "cwe_id", "owasp", "remediation"))
    unknown = F.concat(F.lit("Unknown ("), F.col("vuln_class"), F.lit(")"))
    return findings.join(dim, "vuln_class", "left").withColumns({
        "vulnerability_name": F.coalesce("vulnerability_name", unknown),
        "cwe_id": F.coalesce("cwe_id", F.lit("Unknown")),
        "owasp": F.coalesce("owasp", F.lit("Unknown")),
        "remediation": F.coalesce("remediation", F.array().cast("array<string>")),
    })


def severity_rank(severity: Column) -> Column:
    rank = F.when(severity == SEVERITY_ORDER[0], 0)
    for i, level in enumerate(SEVERITY_ORDER[1:], 1):
        rank = rank.when(severity == level, i)
    return rank.otherwise(len(SEVERITY_ORDER))


def first_seen_order() -> Column:
    """Position of a finding before sorting: module, rule and match order."""
    return F.col("seq")


def rank_findings(findings: DataFrame) -> DataFrame:
    """Adds ``position`` of each finding in its file: severity, then confidence, then order.

    A file is one row of the corpus, so the findings of one file are bounded by its text.
    """
    order = Window.partitionBy("file_id").orderBy(
        severity_rank(F.col("severity")), F.col("confidence").desc(), first_seen_order())
    return findings.withColumn("position", F.row_number().over(order))


def order_findings(findings: DataFrame) -> DataFrame:
    """All findings in report order: by path, then as in ``rank_findings`` (range sort)."""
    return findings.orderBy(
        "path", severity_rank(F.col("severity")), F.col("confidence").desc(), first_seen_order())


def severity_counts(findings: DataFrame) -> DataFrame:
    """Four levels, zero-filled: ``severity, n``."""
    wide = findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_ORDER])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(s).alias("severity"), F.col(s).alias("n")) for s in SEVERITY_ORDER])))


def vulnerability_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("vulnerability_name").agg(F.count("*").alias("n"))


def order_counts(counts: DataFrame, name: str, count: str = "n") -> DataFrame:
    """By count, descending; equal counts by name."""
    return counts.orderBy(F.col(count).desc(), name)


def breakdown(findings: DataFrame) -> DataFrame:
    """Counts by vulnerability name with the share of the largest count in percent.

    The window runs over at most one row per class, after the aggregation.
    """
    counts = vulnerability_counts(findings)
    top = F.max("n").over(Window.partitionBy())
    return order_counts(counts.withColumn("width", F.round(F.col("n") * 100.0 / top, 6)), "vulnerability_name")


def file_counts(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Every file with its number of findings, zero where there is none."""
    per_file = findings.groupBy("file_id").agg(F.count("*").alias("n"))
    return files.select("file_id", "path").join(per_file, "file_id", "left").withColumn(
        "n", F.coalesce("n", F.lit(0).cast("long")))


def file_results(files: DataFrame, findings: DataFrame, columns: Sequence[str] = FINDING_COLUMNS[2:]) -> DataFrame:
    """Every file with ``count`` and its ordered list of findings (bounded by one text)."""
    row = F.struct(
        severity_rank(F.col("severity")).alias("_rank"), (-F.col("confidence")).alias("_less"),
        first_seen_order().alias("_seq"), F.struct(*columns).alias("finding"))
    per_file = findings.groupBy("file_id").agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    return files.select("file_id", "path").join(per_file, "file_id", "left").select(
        "file_id", "path",
        F.coalesce(F.size("_rows"), F.lit(0)).alias("count"),
        F.coalesce(F.transform("_rows", lambda r: r.getField("finding")), F.array()).alias("findings"),
    )


def clean_files(files: DataFrame, findings: DataFrame) -> DataFrame:
    return files.select("file_id", "path").join(findings.select("file_id"), "file_id", "left_anti")


def scan_summary(files: DataFrame, findings: DataFrame, rules_total: int, ml: bool, rules: bool, flow: bool) -> DataFrame:
    """One row: file and finding totals, engine switches and the exit code.

    Both inputs are reduced to one row before they meet; of ``files`` only the rows are
    counted.  A Spark job scans every file or fails, so no file is left with an error.
    """
    files_row = files.agg(F.count("*").alias("files_total"))
    findings_row = findings.agg(
        F.count("*").alias("total_findings"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_ORDER])
    return files_row.crossJoin(F.broadcast(findings_row)).select(
        "files_total", F.col("files_total").alias("files_scanned"), F.lit(0).cast("long").alias("errors"),
        "total_findings", *SEVERITY_ORDER,
        F.lit(ml).alias("ml_enabled"), F.lit(rules).alias("rules_enabled"), F.lit(flow).alias("flow_enabled"),
        F.lit(rules_total).cast("int").alias("total_rules"),
        F.when(F.col("critical") > 0, 2).when(F.col("total_findings") > 0, 1).otherwise(0).alias("exit_code"),
    )


def rules_summary(rules: DataFrame, classes: DataFrame) -> DataFrame:
    """Rules per class, zero-filled."""
    counts = rules.groupBy("vuln_class").agg(F.count("*").alias("n"))
    return classes.select("vuln_class", "name").join(counts, "vuln_class", "left").select(
        "vuln_class", F.col("name").alias("vulnerability_name"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def model_findings(scores: DataFrame, classes: DataFrame, at: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Whole-file findings from class scores.

    ``scores``: ``file_id, path, class_id int, prob double, confidence double``.
    """
    dim = F.broadcast(classes.select(
        F.col("vuln_class").alias("class_id"), "severity", F.col("name").alias("_name")))
    return scores.filter(F.col("prob") >= at).join(dim, "class_id", "left").select(
        "file_id", "path", F.col("class_id").cast("int").alias("vuln_class"), F.lit(0).alias("line"),
        F.concat(F.lit("ML model detected potential "), F.coalesce("_name", F.lit("vulnerability"))).alias("message"),
        F.coalesce("severity", F.lit("medium")).alias("severity"),
        (F.col("prob") * F.col("confidence")).alias("confidence"),
        F.lit("ml_model").alias("source"), F.lit("").alias("rule_id"), F.lit("").alias("matched_text"),
        ((F.col("class_id") + MODEL_BASE).cast("long") * SEQ_STEP).alias("seq"),
    )


