"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnsieve.llm.common import named, row_of, whole_text

UNKNOWN = "und"
PIECE = 1 << 18  # characters worked on at once
_MIX = [np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F)]
_BLANK = np.uint32(32)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _pieces(texts: list[str], orders: int):
    """Groups of ``(row, piece, own)`` of about ``PIECE`` characters: texts longer than that are
    cut, each piece followed by the characters its last n-grams reach into."""
    group, size = [], 0
    for row, text in enumerate(texts):
        text = text.lower()
        for start in range(0, len(text), PIECE):
            own = min(PIECE, len(text) - start)
            if size and size + own > PIECE:
                yield group
                group, size = [], 0
            group.append((row, text[start:start + own + orders - 1], own))
            size += own
    if group:
        yield group


def _grams(group, orders: int, buckets: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Rows, one array of buckets per order, and rows of letters: the non-zero cells of the
    sparse row-by-bucket matrix, one entry per n-gram.

    N-grams are taken over lower-cased letters with everything else as blank; those that start
    with two blanks say nothing and are left out.  Texts are set apart by blanks, so no n-gram
    holds letters of two texts.
    """
    gap = " " * (orders - 1)
    codes = np.frombuffer("".join(p + gap for _, p, _ in group).encode("utf-32-le", "surrogatepass"), "<u4")
    own = np.array([o for _, _, o in group])
    length = np.array([len(p) + len(gap) for _, p, _ in group])
    offset = np.repeat((np.cumsum(length) - length) - (np.cumsum(own) - own), own)
    at = offset + np.arange(len(offset))
    rows = np.repeat(np.array([r for r, _, _ in group]), own)
    letter = _letters()[codes]
    folded = np.where(letter, codes, _BLANK).astype(np.uint32)
    first = letter[at]
    keep = first | letter[np.minimum(at + 1, len(codes) - 1)]
    with_letter = rows[first]
    at, rows = at[keep], rows[keep]
    shift = np.uint32(32 - buckets.bit_length() + 1)
    mixed = np.full(len(at), np.uint32(0x165667B1))
    out = []
    for order in range(orders):
        mixed = (mixed ^ folded[at + order]) * _MIX[order % len(_MIX)]
        mixed ^= mixed >> np.uint32(15)
        out.append(((mixed * _MIX[0]) >> shift).astype(np.int64))
    return rows, out, with_letter


@dataclass
class LanguagePart:
    """``log_prob[i, b]``: log probability of bucket ``b`` in language ``i`` of some of the languages."""

    langs: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray
    orders: int
    buckets: int

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Joint log probability of every text (row) and language, and which texts hold a letter."""
        sums = np.zeros((len(texts), len(self.langs)))
        letters = np.zeros(len(texts), bool)
        for group in _pieces(texts, self.orders):
            rows, grams, with_letter = _grams(group, self.orders, self.buckets)
            letters[with_letter] = True
            for i in range(len(self.langs)):
                weight = sum(self.log_prob[i][g] for g in grams)
                sums[:, i] += np.bincount(rows, weights=weight, minlength=len(texts))
        return sums + self.log_prior, letters


@dataclass
class LanguageModel:
    """The learned languages in parts of bounded size, in the order of their names."""

    parts: list[LanguagePart]

    @property
    def langs(self) -> list[str]:
        return [lang for part in self.parts for lang in part.langs]


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", orders: int = 3, buckets: int = 1 << 15,
          part_langs: int = 128, smoothing: float = 0.5) -> LanguageModel:
    """Counts over all rows of ``docs`` with a language; nothing is sampled and no language left out.

    Every task counts n-grams in one array per language and hands on its non-zero cells, which
    Spark adds up.  A matrix of ``part_langs`` languages times ``buckets`` cells bounds what a task
    holds and what is collected and broadcast at once; more languages are counted in further passes.
    Null texts count as empty and repeated rows as often as they stand; without labelled rows the
    model knows no language.
    """
    rows = docs.filter(named(lang_col).isNotNull()).select(
        named(lang_col).cast("string").alias("_lang"), whole_text(text_col).alias("_text"))
    rows_of = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count("*").alias("n")).collect()}
    everything = sum(rows_of.values())
    names = sorted(rows_of)

    def part(langs: list[str]) -> LanguagePart:
        place = {lang: i for i, lang in enumerate(langs)}

        def count(batches):
            total = np.zeros(len(langs) * buckets, np.int64)
            for batch in batches:
                lang = np.array([place[x] for x in batch.column(0).to_pylist()], dtype=np.int64)
                for group in _pieces(batch.column(1).to_pylist(), orders):
                    row, grams, _ = _grams(group, orders, buckets)
                    base = lang[row] * buckets
                    for g in grams:
                        total += np.bincount(base + g, minlength=len(total))
            cells = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])

        own = rows if len(langs) == len(names) else rows.filter(F.col("_lang").isin(langs))
        counts = np.zeros(len(langs) * buckets)
        cells = own.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        counts[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
        counts = counts.reshape(len(langs), buckets) + smoothing
        prior = np.array([rows_of[lang] for lang in langs], float)
        return LanguagePart(langs, np.log(prior / everything), np.log(counts / counts.sum(axis=1, keepdims=True)),
                            orders, buckets)

    return LanguageModel([part(names[i:i + part_langs]) for i in range(0, len(names), part_langs)])


def predicted(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> Column:
    """A column ``struct<lang, score>``: the likeliest language and its posterior probability.

    ``und`` with score 0 where the text is null or holds no letter, or nothing was learned; of
    languages that are equally likely the first by name.  Every part of the log-probability matrix
    travels as a broadcast variable of its own; a text's best language and total of each part are
    put together in the row.
    """
    def of(part: LanguagePart) -> Column:
        shared = docs.sparkSession.sparkContext.broadcast(part)

        @F.pandas_udf("lang string, best double, total double")
        def score(texts: pd.Series) -> pd.DataFrame:
            sums, letters = shared.value.score([t or "" for t in texts])
            at = sums.argmax(axis=1)
            best = sums[np.arange(len(sums)), at]
            total = np.exp(sums - best[:, None]).sum(axis=1)  # in units of the best of this part
            return pd.DataFrame({"lang": [shared.value.langs[b] if ok else None for b, ok in zip(at, letters)],
                                 "best": best, "total": total})

        return score(named(text_col))

    unknown = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    if not model.parts:
        return unknown
    found = [of(part) for part in model.parts]
    best = found[0]["best"] if len(found) == 1 else F.greatest(*[f["best"] for f in found])
    lang = found[0]["lang"] if len(found) == 1 else F.coalesce(*[F.when(f["best"] == best, f["lang"]) for f in found])
    total = sum((f["total"] * F.exp(f["best"] - best) for f in found[1:]), found[0]["total"] * F.exp(found[0]["best"] - best))
    return F.when(lang.isNull(), unknown).otherwise(F.struct(lang.alias("lang"), (1 / total).alias("score")))


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Rows whose language is known with a probability of ``least`` or more, all columns kept.

    Null and empty texts and those without a letter go.  A model that has learned no language rejects
    no other text.  Rows are judged one by one, repeated ones alike; columns of any name and type are
    handed through; an empty table gives an empty one.
    """
    if not model.parts:
        return docs.filter(named(text_col).cast("string").rlike(r"\p{L}"))
    found = predicted(docs, model, text_col)
    marked = docs.select(row_of(docs).alias("row"), found.alias("found"))
    return marked.filter((F.col("found.lang") != UNKNOWN) & (F.col("found.score") >= least)).select("row.*")
