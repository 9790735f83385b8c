"""Evaluation of multi-label scores and weights of labelled samples.

Scores are long: ``sample_id, class_id, prob, label`` (one row per sample and class).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnsieve.catalog.classes import NUM_CLASSES
from vulnsieve.operators.prefix import running_sums


def _class_ids(spark: SparkSession, num_classes: int) -> DataFrame:
    return spark.range(num_classes).select(F.col("id").cast("int").alias("class_id"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _precision_recall_f1(df: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    df = df.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return df.withColumn("f1", _ratio(2 * p * r, p + r))


def per_class_metrics(scores: DataFrame, threshold: float = 0.5, num_classes: int = NUM_CLASSES) -> DataFrame:
    """Unrounded precision, recall and F1 per class with the confusion counts and support."""
    hit, label = F.col("prob") >= threshold, F.col("label") == 1
    counts = scores.groupBy("class_id").agg(
        F.count_if(hit & label).alias("tp"), F.count_if(hit & ~label).alias("fp"),
        F.count_if(~hit & label).alias("fn"), F.count_if(~hit & ~label).alias("tn"))
    full = _class_ids(scores.sparkSession, num_classes).join(counts, "class_id", "left").na.fill(
        0, ["tp", "fp", "fn", "tn"])
    return _precision_recall_f1(full).withColumn("support", F.col("tp") + F.col("fn"))


def macro_metrics(per_class: DataFrame) -> DataFrame:
    """Plain mean of the unrounded class values."""
    return per_class.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def micro_metrics(per_class: DataFrame) -> DataFrame:
    return _precision_recall_f1(per_class.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])).select(
        "precision", "recall", "f1")


def metrics_table(per_class: DataFrame, classes: DataFrame, auc: DataFrame | None = None) -> DataFrame:
    """Per-class rows, then the macro and the micro row; values to four places."""
    rows = per_class.join(
        F.broadcast(classes.select(F.col("vuln_class").alias("class_id"), F.col("name").alias("class_name"))),
        "class_id", "left")
    if auc is not None:
        rows = rows.join(F.broadcast(auc.select("class_id", "auc")), "class_id", "left")  # one row per class
    else:
        rows = rows.withColumn("auc", F.lit(None).cast("double"))
    parts = [rows.select(
        F.coalesce("class_name", F.concat(F.lit("Class_"), "class_id")).alias("class_name"),
        "precision", "recall", "f1", "auc", "support")]
    for name, df in (("Macro Average", macro_metrics(per_class)), ("Micro Average", micro_metrics(per_class))):
        parts.append(df.select(
            F.lit(name).alias("class_name"), "precision", "recall", "f1",
            F.lit(None).cast("double").alias("auc"), F.lit(None).cast("long").alias("support")))
    table = reduce(DataFrame.unionByName, parts)
    return table.withColumns({c: F.round(c, 4) for c in ("precision", "recall", "f1", "auc")})


def roc_points(scores: DataFrame) -> DataFrame:
    """Cumulative counts down the score order: ``class_id, prob, pos, neg, tp, fp``.

    Equal scores are one point, counted before the shuffle, so a score that very many
    samples share is no hot spot; ``running_sums`` cuts classes with many distinct scores.
    """
    points = scores.groupBy("class_id", "prob").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"))
    return running_sums(points, ["class_id"], [F.col("prob").desc()], {"tp": "pos", "fp": "neg"})


def roc_auc(scores: DataFrame, num_classes: int = NUM_CLASSES) -> DataFrame:
    """Area under the ROC curve per class by trapezoids; 0.5 where one label is missing.

    Equal scores form one segment, so the area does not depend on their order.
    """
    pos, neg, tp = F.col("pos").cast("double"), F.col("neg").cast("double"), F.col("tp").cast("double")
    area = roc_points(scores).groupBy("class_id").agg(
        F.sum(neg * (2 * tp - pos)).alias("area2"), F.sum(pos).alias("p"), F.sum(neg).alias("n"))
    value = F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("area2") / (2 * F.col("p") * F.col("n"))).otherwise(0.5)
    return _class_ids(scores.sparkSession, num_classes).join(area, "class_id", "left").select(
        "class_id", F.coalesce(value, F.lit(0.5)).alias("auc"))


# ── labelled samples ────────────────────────────────────────────────────────

def class_distribution(samples: DataFrame, classes: DataFrame) -> DataFrame:
    """Samples per class and safe ones, zero-filled: ``vulnerability_name, n``."""
    label = F.when(F.col("is_vulnerable"), F.col("vulnerability_name")).otherwise(F.lit("Safe"))
    counts = samples.groupBy(label.alias("vulnerability_name")).agg(F.count("*").alias("n"))
    safe = classes.sparkSession.createDataFrame([("Safe",)], "vulnerability_name string")
    names = classes.select(F.col("name").alias("vulnerability_name")).unionByName(safe)
    return names.join(counts, "vulnerability_name", "left").select(
        "vulnerability_name", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def class_weights(samples: DataFrame, num_classes: int = NUM_CLASSES) -> DataFrame:
    """Inverse frequency weights: samples / (classes x max(count, 1)); foreign labels are ignored."""
    counts = samples.select(F.explode("labels").alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n"))
    total = F.broadcast(samples.agg(F.count("*").alias("total")))  # one row
    weight = F.col("total") / (F.lit(num_classes) * F.greatest(F.coalesce("n", F.lit(0).cast("long")), F.lit(1).cast("long")))
    return _class_ids(samples.sparkSession, num_classes).join(counts, "class_id", "left").crossJoin(total).select(
        "class_id", weight.alias("weight"))
