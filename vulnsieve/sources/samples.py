"""Labelled sample corpus from template pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnsieve.catalog.classes import CLASS_NAMES, NUM_CLASSES
from vulnsieve.catalog.patterns import NAME_SETS
from vulnsieve.catalog.snippets import TEMPLATES, template_rows


def _draw(key: Column, purpose: str, seed: int, bound: Column) -> Column:
    """A reproducible number below ``bound``: leading 32 bits of an MD5."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f"-{purpose}-{seed}")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), bound)


def template_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        template_rows(),
        "template_id int, class_id int, pick int, language string, vulnerable string, safe string, "
        "vuln_description string, safe_description string")


def labelled_pairs(ids: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Two samples per id, one vulnerable and one safe; classes go round-robin over the ids.

    ``sample_id, code, labels, language, is_vulnerable, vulnerability_name, description``.
    """
    spark = ids.sparkSession
    pair = F.col(key)
    counts = F.array(*[F.lit(len(TEMPLATES[c])) for c in range(NUM_CLASSES)])
    names = F.array(*[F.lit(CLASS_NAMES[c]) for c in range(NUM_CLASSES)])
    drawn = ids.select(pair.alias("pair_id"), F.pmod(pair, F.lit(NUM_CLASSES)).cast("int").alias("class_id"))
    drawn = drawn.withColumn(
        "pick", _draw(F.col("pair_id"), "template", seed, F.element_at(counts, F.col("class_id") + 1)).cast("int"))
    both = drawn.join(F.broadcast(template_table(spark)), ["class_id", "pick"]).select(  # 41 fixed rows
        "pair_id", "class_id", "language",
        F.inline(F.array(
            F.struct(F.lit(True).alias("is_vulnerable"), F.col("vulnerable").alias("code"),
                     F.col("vuln_description").alias("description")),
            F.struct(F.lit(False).alias("is_vulnerable"), F.col("safe").alias("code"),
                     F.col("safe_description").alias("description")))))
    sample_id = F.col("pair_id") * 2 + F.when(F.col("is_vulnerable"), 0).otherwise(1)
    both = both.withColumn("sample_id", sample_id).withColumn(
        "_set", _draw(F.col("sample_id"), "names", seed, F.lit(len(NAME_SETS))).cast("int"))

    def name_of(key: str) -> Column:
        return F.element_at(F.array(*[F.lit(s[key]) for s in NAME_SETS]), F.col("_set") + 1)

    code = reduce(
        lambda text, key: F.replace(text, F.lit("{" + key + "}"), name_of(key)), NAME_SETS[0], F.col("code"))
    vulnerable = F.col("is_vulnerable")
    return both.select(
        "sample_id", code.alias("code"),
        F.when(vulnerable, F.array("class_id")).otherwise(F.array().cast("array<int>")).alias("labels"),
        "language", "is_vulnerable",
        F.when(vulnerable, F.element_at(names, F.col("class_id") + 1)).otherwise(F.lit("Safe")).alias("vulnerability_name"),
        "description",
    )


def labelled_corpus(spark: SparkSession, n: int = 5000, seed: int = 42) -> DataFrame:
    """n // 22 pairs per class, generated where they are used."""
    return labelled_pairs(spark.range(n // (2 * NUM_CLASSES) * NUM_CLASSES), "id", seed)
