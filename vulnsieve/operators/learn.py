"""Multi-label classification of code with Spark ML: one binary model per class."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnsieve.catalog.classes import NUM_CLASSES
from vulnsieve.operators import metrics
from vulnsieve.operators.split import split_dataset
from vulnsieve.operators.tokens import token_array
from vulnsieve.scratch import written

FEATURES = 1 << 14
SHORT = 8  # blocks of four bytes of a token that is hashed together with others
TOGETHER = 500_000  # tokens, about, that are counted at a time


@dataclass
class ClassifierSet:
    """The chosen models, the regularisation they share and the validation loss of each candidate."""

    models: list[LogisticRegressionModel | None]
    reg: float
    losses: dict[float, float] = field(default_factory=dict)
    features: int = FEATURES


def _mixed(k):
    """The first steps of Murmur3 on a block, or a column of blocks, of four bytes."""
    k = k * 0xCC9E2D51 & 0xFFFFFFFF
    return (k << 15 | k >> 17) * 0x1B873593 & 0xFFFFFFFF


def _carried(h):
    h = (h << 13 | h >> 19) & 0xFFFFFFFF
    return h * 5 + 0xE6546B64 & 0xFFFFFFFF


def _hashes(tokens: list[bytes]) -> np.ndarray:
    """The signed 32-bit hashes of ``HashingTF``.  Short tokens are hashed side by side, block by block."""
    lengths = np.fromiter(map(len, tokens), np.uint64, len(tokens))
    blocks = np.array(tokens, f"S{4 * SHORT}").view("<u4").reshape(len(tokens), SHORT)
    h = np.full(len(tokens), 42, np.uint64)
    for j in range(SHORT):
        at = np.flatnonzero(lengths > 4 * j)
        mixed = h[at] ^ _mixed(blocks[at, j].astype(np.uint64))
        h[at] = np.where(lengths[at] >= 4 * j + 4, _carried(mixed), mixed)
    for at in np.flatnonzero(lengths > 4 * SHORT):
        token, one = tokens[at], 42
        whole = len(token) & ~3
        for (k,) in struct.iter_unpack("<I", token[:whole]):
            one = _carried(one ^ _mixed(k))
        h[at] = one ^ _mixed(int.from_bytes(token[whole:], "little"))
    h ^= lengths
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return (h ^ h >> 16).astype(np.uint32).view(np.int32)


def _vectors(lists: pa.Array, features: int) -> pa.Array:
    """Sparse vectors of the token counts, as the fields of ``VectorUDT``; a null list has none."""
    n, lengths = len(lists), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    tokens = lists.flatten().dictionary_encode()
    places = _hashes(tokens.dictionary.cast(pa.binary()).to_pylist()) % features
    keys = np.repeat(np.arange(n) * features, lengths) + places[tokens.indices.to_numpy()]
    keys, times = np.unique(keys, return_counts=True)
    ends = np.searchsorted(keys, np.arange(n + 1) * features).astype(np.int32)
    fields = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, features, np.int32)),
              pa.ListArray.from_arrays(ends, (keys % features).astype(np.int32)),
              pa.ListArray.from_arrays(ends, times.astype(np.float64))]
    return pa.StructArray.from_arrays(fields, ["type", "size", "indices", "values"], mask=lists.is_null())


def _token_counts(tokens: Column, features: int) -> Column:
    """What ``HashingTF`` makes of arrays of tokens, of which a token is hashed once for many rows."""
    def counted(lists: pa.Array) -> pa.Array:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        cuts = [0, *np.flatnonzero(np.diff(ends // TOGETHER)) + 1, len(lists)]
        return pa.concat_arrays([_vectors(lists.slice(a, b - a), features) for a, b in zip(cuts, cuts[1:])])

    counted.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    return F.arrow_udf(counted, VectorUDT())(tokens)


def featurize(df: DataFrame, content: str, features: int = FEATURES) -> DataFrame:
    """Adds ``features``: hashed token counts (no vocabulary pass, so no extra job).  A ``content`` that is such counts
    already, of as many features, is taken as it is."""
    if isinstance(df.schema[content].dataType, VectorUDT):
        return df.withColumn("features", F.col(content))
    return df.withColumn("features", _token_counts(token_array(F.col(content)), features))


def _label(class_id: int) -> Column:
    return F.array_contains("labels", class_id).cast("double")


def _fit(rows: DataFrame, weights: dict[int, float], reg: float, max_iter: int) -> list[LogisticRegressionModel | None]:
    present = rows.agg(*[F.sum(_label(c)).alias(str(c)) for c in range(NUM_CLASSES)]).first()
    models: list[LogisticRegressionModel | None] = []
    for c in range(NUM_CLASSES):
        if not present[str(c)]:
            models.append(None)  # nothing to learn from
            continue
        weighted = rows.withColumns({
            "label": _label(c), "w": F.when(_label(c) == 1.0, F.lit(weights.get(c, 1.0))).otherwise(F.lit(1.0))})
        model = LogisticRegression(
            weightCol="w", regParam=reg, maxIter=max_iter,
            probabilityCol=f"_p{c}", rawPredictionCol=f"_r{c}", predictionCol=f"_y{c}").fit(weighted)
        # its summary holds the session, which cannot be sent to tasks once something was observed in it
        model._java_obj.setSummary(rows.sparkSession._jvm.scala.Option.empty())
        models.append(model)
    return models


def _probabilities(models: list[LogisticRegressionModel | None], rows: DataFrame) -> DataFrame:
    for model in models:
        if model is not None:
            rows = model.transform(rows)
    probs = [F.lit(0.0) if m is None else vector_to_array(F.col(f"_p{c}"))[1] for c, m in enumerate(models)]
    extra = [name for c, m in enumerate(models) if m is not None for name in (f"_p{c}", f"_r{c}", f"_y{c}")]
    return rows.withColumn("probs", F.array(*probs)).drop(*extra)


def _loss(rows: DataFrame) -> float:
    """Mean binary cross-entropy over classes."""
    floor = 1e-7
    terms = []
    for c in range(NUM_CLASSES):
        p = F.greatest(F.least(F.get("probs", F.lit(c)), F.lit(1 - floor)), F.lit(floor))
        terms.append(-F.when(F.array_contains("labels", c), F.log(p)).otherwise(F.log(1 - p)))
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return rows.agg(F.avg(total / NUM_CLASSES)).first()[0] or 0.0


def train(
    samples: DataFrame, key: str = "sample_id", content: str = "code", regs: tuple[float, ...] = (0.001, 0.01),
    max_iter: int = 20, seed: int = 42, features: int = FEATURES,
) -> tuple[ClassifierSet, DataFrame]:
    """Trains on the train part, picks the regularisation by validation loss.

    Returns the models and the test part.  ``samples``: key, content (a text or its features) and ``labels``.
    """
    parts = split_dataset(samples.select(key, content, "labels"), key, seed=seed)
    used = featurize(parts.filter("part != 'test'"), content, features)
    data = used.select("labels", "part", "features").persist()
    try:
        data.count()  # tokenises every text once, before jobs side by side could do it on several executors
        fit_rows, val_rows = data.filter("part = 'train'"), data.filter("part = 'val'")
        weights = {r.class_id: r.weight for r in metrics.class_weights(fit_rows).collect()}  # one row per class
        losses, candidates = {}, {}
        for reg in regs:
            candidates[reg] = _fit(fit_rows, weights, reg, max_iter)
            losses[reg] = _loss(_probabilities(candidates[reg], val_rows)) if len(regs) > 1 else 0.0
        best = min(losses, key=lambda r: (losses[r], r))
    finally:
        data.unpersist()
    return ClassifierSet(candidates[best], best, losses, features), parts.filter("part = 'test'").drop("part")


def score(classifier: ClassifierSet, df: DataFrame, content: str = "content", keep: tuple[str, ...] = ("file_id", "path")) -> DataFrame:
    """Long scores: ``keep…, class_id, prob, confidence``, eleven rows per text."""
    scored = _probabilities(classifier.models, featurize(df.select(*keep, content), content, classifier.features))
    # the array is never empty; a plain posexplode has Spark test that on every text read, tokenising it twice more
    return scored.select(*keep, F.posexplode_outer("probs").alias("class_id", "prob")).withColumn(
        "confidence", F.greatest(F.col("prob"), 1 - F.col("prob")))


def labelled_scores(classifier: ClassifierSet, samples: DataFrame, key: str = "sample_id", content: str = "code") -> DataFrame:
    """``sample_id, class_id, prob, confidence, label`` of labelled samples."""
    long = score(classifier, samples.withColumn("_labels", F.to_json("labels")), content, (key, "_labels"))
    labels = F.from_json("_labels", "array<int>")
    return long.select(
        F.col(key).alias("sample_id"), "class_id", "prob", "confidence",
        F.array_contains(labels, F.col("class_id")).cast("int").alias("label"))


def evaluate(scores: DataFrame, classes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The metrics table with AUC.  The scores are computed once, however many metrics read them."""
    scores = written(scores.select("class_id", "prob", "label"), "scores")
    return metrics.metrics_table(metrics.per_class_metrics(scores, threshold), classes, metrics.roc_auc(scores))
