"""Small fixed tables: the rule catalogue and the vulnerability classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnsieve import schemas
from vulnsieve.catalog.classes import CLASS_ROWS
from vulnsieve.catalog.patterns import ECOSYSTEMS
from vulnsieve.catalog.rules import RULES, Rule


def rule_catalog(spark: SparkSession, rules: Sequence[Rule] = RULES) -> DataFrame:
    return spark.createDataFrame(
        [
            (r.rule_idx, r.rule_id, r.vuln_class, r.pattern, r.message, r.severity,
             list(r.languages) if r.languages else None, r.confidence, [list(g) for g in r.anchors])
            for r in rules
        ],
        schemas.RULES,
    )


def rules_by_class(rules: DataFrame, vuln_class: int) -> DataFrame:
    return rules.filter(F.col("vuln_class") == vuln_class)


def vuln_classes(spark: SparkSession) -> DataFrame:
    """The class dimension: 11 rows whatever the data, so it is always safe to broadcast."""
    return spark.createDataFrame(CLASS_ROWS, schemas.VULN_CLASSES)


def class_lookup(df: DataFrame, classes: DataFrame, key: str = "vuln_class") -> DataFrame:
    """Looks a class id up: info fields, with the defaults for unknown ids."""
    dim = F.broadcast(classes.withColumnRenamed("severity", "class_severity"))
    return df.join(dim.withColumnRenamed("vuln_class", key), key, "left").withColumns({
        "cwe_id": F.coalesce("cwe_id", F.lit("Unknown")),
        "owasp": F.coalesce("owasp", F.lit("Unknown")),
        "class_severity": F.coalesce("class_severity", F.lit("medium")),
        "remediation": F.coalesce("remediation", F.array().cast("array<string>")),
    })


def ecosystem_of(language):
    """Package ecosystem of a language, null when it has none."""
    table = F.create_map(*[F.lit(x) for pair in ECOSYSTEMS.items() for x in pair])
    return F.try_element_at(table, language)
