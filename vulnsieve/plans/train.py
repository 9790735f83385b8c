"""Train and evaluate: samples, models, test scores, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame

from vulnsieve.operators import learn
from vulnsieve.sources.dimensions import vuln_classes


def train_and_evaluate(samples: DataFrame, threshold: float = 0.5, **options) -> tuple[learn.ClassifierSet, DataFrame]:
    classifier, test = learn.train(samples, **options)
    scores = learn.labelled_scores(classifier, test)
    return classifier, learn.evaluate(scores, vuln_classes(samples.sparkSession), threshold)
