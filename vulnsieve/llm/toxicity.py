"""Toxic passages by maximum-scoring segments over token log-odds.

Token log-odds come from labelled texts, with a Dirichlet prior that backs a word off to its
shorter prefixes, so inflected and unseen forms of a word are known by their stem.  A linear
scan finds every maximal segment of a text; extreme-value statistics of clean texts say which
are significant, and a logistic curve turns their total into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnsieve.llm.common import whole_text, written

LETTERS = re.compile(r"[^\W\d_]+")
ADDRESS = re.compile(r"[@0-9]")
STEM_LENGTHS = range(4, 8)
EULER = 0.5772156649
CACHED = 300_000


def stems(word: str) -> list[str]:
    """Prefixes of a word, short to long, and the whole word, closed by a blank."""
    return [*(word[:n] for n in STEM_LENGTHS if n < len(word)), word + " "]


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)``, end exclusive, in linear time.

    A segment is maximal when no part of it and nothing that contains it scores more; each one
    begins and ends with a positive score.  Totals before (``low``) and after (``high``) each
    candidate decide whether it stands alone or joins an earlier one.
    """
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    start, end, low, high, link = [], [], [], [], []
    for i, a, b in zip(at.tolist(), total[at].tolist(), total[at + 1].tolist()):
        s, e = i, i + 1
        while True:
            j = len(start) - 1
            while j >= 0 and low[j] >= a:
                j = link[j]
            if j < 0 or high[j] >= b:
                start.append(s), end.append(e), low.append(a), high.append(b), link.append(j)
                break
            s, a = start[j], low[j]  # joins segment j and all after it
            del start[j:], end[j:], low[j:], high[j:], link[j:]
    return [(s, e, b - a) for s, e, a, b in zip(start, end, low, high)]


class _Scores(dict):
    """Scores of raw tokens, looked up word by word once."""

    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> float:
        value = self.model.token_score(token)
        if len(self) >= CACHED:
            self.clear()
        if len(token) <= 64:
            self[token] = value
        return value


@dataclass
class ToxicityModel:
    odds: dict[str, float]
    drift: float
    decay: float = 1.0  # lambda of the extreme-value law
    log_k: float = 0.0
    intercept: float = -4.0
    slope: float = 1.0
    _cache: _Scores | None = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "_cache": None}

    def token_score(self, token: str) -> float:
        """Log-odds of the longest known prefix of the token's most toxic run of letters, less
        the drift that makes ordinary text score below zero.  Addresses and numbers are no words."""
        if ADDRESS.search(token):
            return -self.drift
        best = None
        for word in LETTERS.findall(token.lower()):
            value = next((self.odds[s] for s in reversed(stems(word)) if s in self.odds), 0.0)
            best = value if best is None else max(best, value)
        return (best or 0.0) - self.drift

    def token_scores(self, text: str) -> tuple[list[str], np.ndarray]:
        """The tokens of a text and the score of each occurrence."""
        if self._cache is None:
            self._cache = _Scores(self)
        tokens = text.split()
        return tokens, np.fromiter(map(self._cache.__getitem__, tokens), np.float64, len(tokens))

    def _once(self, tokens: list[str], scores: np.ndarray) -> np.ndarray:
        """The scores with every token that comes again worth no more than ordinary text."""
        out, seen = scores, set()
        for i in np.flatnonzero(scores > 0).tolist():
            if tokens[i] in seen:
                out = scores.copy() if out is scores else out
                out[i] = -self.drift
            seen.add(tokens[i])
        return out

    def _significant(self, scores: np.ndarray, most_expected: float) -> list[tuple[int, int, float]]:
        chance = self.log_k + math.log(len(scores))
        found = ((s, e, self.decay * x - chance) for s, e, x in maximal_segments(scores))
        return [x for x in found if x[2] > -math.log(most_expected)]

    def read(self, text: str, most_expected: float = 0.05) -> tuple[float, list[tuple[int, int, float]]]:
        """The evidence of a text, and all its significant segments ``(start, end, evidence)`` in tokens.

        The evidence of a segment is the log of how rarely clean text of that length holds such a
        segment; a segment is significant when fewer than ``most_expected`` are expected by chance.
        Every occurrence of a token counts when segments are searched, so a passage that comes again
        is found again; a token that comes again within one segment adds nothing to it.  The evidence of
        the text takes every token once, so saying a thing twice makes no text more toxic.
        """
        tokens, scores = self.token_scores(text)
        if not len(scores):
            return 0.0, []
        once = self._once(tokens, scores)
        segments = self._significant(once, most_expected)
        total = sum(x for *_, x in segments)
        if once is scores:
            return total, segments
        chance, out = self.log_k + math.log(len(scores)), []
        for s, e, _ in self._significant(scores, most_expected):
            own = self.decay * float(self._once(tokens[s:e], scores[s:e]).sum()) - chance
            if own > -math.log(most_expected):
                out.append((s, e, own))
        return total, out

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.intercept + self.slope * math.log1p(evidence)))))


def _decay(values: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of ``sum p exp(lambda s) = 1`` for token scores of clean text."""
    p = counts / counts.sum()
    if not (values > 0).any() or (p * values).sum() >= 0:
        return 1.0
    low, high = 1e-3, 4.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * values)).sum() < 1 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Intercept and slope by Newton steps; classes weigh the same, the ridge keeps them finite."""
    w = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum())) * len(y)
    a = np.stack([np.ones_like(x), x])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(beta @ a, -30, 30)))
        slope = a @ (w * (y - p)) - ridge * len(y) * beta * [0.0, 1.0]
        curve = (a * (w * p * (1 - p))) @ a.T + ridge * len(y) * np.diag([1e-3, 1.0])
        step = np.linalg.solve(curve, slope)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def _word_odds(nodes: list[tuple[str, int, int]], n_toxic: int, n_clean: int, prior: float, least_z: float) -> dict[str, float]:
    """Log-odds of every prefix; parents come first.

    Counts are numbers of texts.  The prior of a prefix is ``prior`` texts, split between the
    classes as its parent is.  Of the difference to the parent's log-odds only what exceeds
    ``least_z`` standard errors is believed, so words of a few texts weigh little.
    """
    every: dict[str, float] = {}
    total = n_toxic + n_clean
    for name, toxic, clean in sorted(nodes, key=lambda x: (len(x[0]), x[0])):
        bare = name.rstrip(" ")
        longer = [s for s in (bare[:n] for n in reversed(STEM_LENGTHS) if n < len(bare)) if s in every]
        parent = every[longer[0]] if longer else 0.0
        q = 1 / (1 + math.exp(-parent))
        a = toxic + 0.5 + prior * q * 2 * n_toxic / total
        b = clean + 0.5 + prior * (1 - q) * 2 * n_clean / total
        change = math.log(a / n_toxic) - math.log(b / n_clean) - parent
        sure = max(0.0, abs(change) - least_z * math.sqrt(1 / a + 1 / b))
        every[name] = parent + math.copysign(sure, change)
    return {name: max(-1.0, value) for name, value in every.items()}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        fit_rows: int = 20_000, most_nodes: int = 200_000, least_texts: int = 4, prior: float = 2.0, least_z: float = 2.0,
        drift: float = 0.3) -> ToxicityModel:
    """Learns from ``labels`` (``id_col, label_col``) and the texts of ``docs``.

    At most ``fit_rows`` labelled rows are used, up to half of each class, picked by a hash of
    the id: the fit reads a bounded sample whatever the size of the table, so its labels and its
    model (at most ``most_nodes`` prefixes, the most frequent) can be broadcast.  Equal texts
    count once.  Two thirds of the texts give the log-odds, the rest calibrates them.  A null
    label is none; of several labels for an id the largest holds.  Without both classes the model
    knows no word and scores every text low.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        F.max(F.col(label_col).cast("int") > 0).alias("_toxic"))
    order = [F.xxhash64("_id"), "_id"]
    half = fit_rows // 2
    sample = known.filter("_toxic").orderBy(*order).limit(half).unionByName(known.filter("NOT _toxic").orderBy(*order).limit(half))
    sample = written(sample, "labels")
    texts = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text")).join(F.broadcast(sample), "_id")
    digest = F.sha2(F.col("_text").cast("binary"), 256)
    rows = written(texts.groupBy(digest.alias("digest")).agg(F.max("_toxic").alias("toxic"), F.first("_text").alias("text")).withColumn(
        "calibrates", F.pmod(F.xxhash64("digest"), F.lit(3)) == 0), "sample")
    learn = rows.filter("NOT calibrates")
    sizes = {bool(r["toxic"]): r["count"] for r in learn.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_clean:
        return ToxicityModel({}, drift)

    def count(batches):
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for is_toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {s for word in set(LETTERS.findall(text.lower())) for s in stems(word)}
                (toxic if is_toxic else clean).update(own)
                if len(toxic) + len(clean) > 1_000_000:
                    yield table(toxic, clean)
                    toxic, clean = Counter(), Counter()
        yield table(toxic, clean)

    def table(toxic, clean):
        names = list(toxic.keys() | clean.keys())
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([toxic[x] for x in names], pa.int64()),
             pa.array([clean[x] for x in names], pa.int64())], ["stem", "toxic", "clean"])

    counted = learn.select("toxic", "text").mapInArrow(count, "stem string, toxic long, clean long").groupBy("stem").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    often = counted.filter(F.col("toxic") + F.col("clean") >= least_texts).orderBy(
        F.desc(F.col("toxic") + F.col("clean")), "stem").limit(most_nodes).toArrow()
    nodes = list(zip(*(often.column(c).to_pylist() for c in ("stem", "toxic", "clean"))))
    model = ToxicityModel(_word_odds(nodes, n_toxic, n_clean, prior, least_z), drift)
    shared = spark.sparkContext.broadcast(model)

    def measure(batches):
        own = shared.value
        for batch in batches:
            out = []
            for is_toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                scores = own._once(*own.token_scores(text))
                best = max((x for _, _, x in maximal_segments(scores)), default=0.0)
                seen, n = (None, None) if is_toxic else np.unique(np.round(scores, 2), return_counts=True)
                out.append((is_toxic, len(scores), best, [] if is_toxic else seen.tolist(), [] if is_toxic else n.tolist()))
            cols = list(zip(*out)) or [[]] * 5
            kinds = [pa.bool_(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["toxic", "n", "best", "value", "times"])

    measured = written(rows.filter("calibrates").select("toxic", "text").mapInArrow(
        measure, "toxic boolean, n long, best double, value array<double>, times array<long>"), "measured")
    spread = measured.filter("NOT toxic").select(F.explode(F.arrays_zip("value", "times")).alias("z")).groupBy("z.value").agg(
        F.sum("z.times").alias("times")).toArrow()
    if spread.num_rows:
        # one token in a million at the top score: clean text is never quite without it
        top = max(model.odds.values(), default=1.0) - drift
        values = np.append(spread.column("value").to_numpy(), top)
        times = np.append(spread.column("times").to_numpy().astype(float), 1e-6 * spread.column("times").to_numpy().sum())
        model.decay = _decay(values, times)
    clean = measured.filter("NOT toxic AND n > 0").select("n", "best").toArrow()
    if clean.num_rows:
        n, best = clean.column("n").to_numpy(), clean.column("best").to_numpy()
        model.log_k = float((model.decay * best - np.log(n)).mean() - EULER)

    tuned = spark.sparkContext.broadcast(model)

    def weigh(batches):
        for batch in batches:
            found = [tuned.value.read(t)[0] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["toxic", "evidence"])

    points = rows.filter("calibrates").select("toxic", "text").mapInArrow(weigh, "toxic boolean, evidence double").toArrow()
    y = points.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
    if y.any() and not y.all():
        model.intercept, model.slope = _logistic(np.log1p(points.column("evidence").to_numpy()), y)
    return model


def toxic_passages(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score, evidence, passages`` for every row of ``docs``.

    ``passages`` lists each significant segment as ``start, end`` (tokens, end exclusive) and its
    evidence; ``evidence``, that of the text with every token taken once, gives ``score``, 0 to 1.
    A null text counts as empty; an empty text has no passage and the score of no evidence.  Repeated
    rows give repeated results.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("evidence", pa.float64())]))

    def run(batches):
        own = shared.value
        for batch in batches:
            read = [own.read(text) for text in batch.column(1).to_pylist()]
            total, found = [t for t, _ in read], [f for _, f in read]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([own.score(t) for t in total], pa.float64()), pa.array(total, pa.float64()),
                 pa.array([[{"start": s, "end": e, "evidence": x} for s, e, x in f] for f in found], spans)],
                [id_col, "score", "evidence", "passages"])

    return docs.select(F.col(id_col), whole_text(text_col).alias("_text")).mapInArrow(
        run, f"`{id_col}` {kind}, score double, evidence double, passages array<struct<start:int,end:int,evidence:double>>")


def is_toxic(score: Column) -> Column:
    return F.when(score >= 0.5, 1).otherwise(0)
