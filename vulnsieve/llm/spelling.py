"""Spelling variants: words one edit apart meet under the rotations of their terminator-marked forms."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vulnsieve.llm.common import slices, whole_text, written

#: Maximal runs of ASCII letters and U+00C0 to U+00FF, as UTF-8.
RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
END = "$"


def misspelt(run: bytes, id_crc: int, every: int) -> bytes:
    """``run`` without one code point if ``every`` divides the checksum of id and run."""
    h = zlib.crc32(run, id_crc)
    if h % every:
        return run
    word = run.decode()
    at = h % len(word)
    return (word[:at] + word[at + 1:]).encode()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int | None = 97) -> DataFrame:
    """``word, n``: how often every word stands in the texts, once some runs have lost a code point.

    Words are maximal runs of letters (``RUN``); only A to Z are lower-cased.  If ``every`` divides the crc32
    of ``<id>:<word>`` in UTF-8, the code point at that number modulo the length goes (``None``: never).  A
    null text has no words, a null id counts as the empty text.  Words left empty are not counted.
    """
    def run(batches):
        held: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays(
                [pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for start, end in slices(batch, "_text"):
                for key, text in zip(*(c.slice(start, end - start).to_pylist() for c in batch.columns)):
                    found = Counter(RUN.findall(text.lower()))
                    if every:
                        id_crc = zlib.crc32(key.encode() + b":")
                        for word, n in found.items():
                            held[misspelt(word, id_crc, every)] += n
                    else:
                        held.update(found)
                if len(held) > 400_000:  # memory of the worker stays bounded; Spark adds what is handed on
                    yield rows()
                    held.clear()
        held.pop(b"", None)
        yield rows()

    parts = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("_key"),
        whole_text(text_col).cast("binary").alias("_text")).mapInArrow(run, "word string, n long")
    return parts.filter("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def rotations(words: DataFrame) -> DataFrame:
    """``key, word, n, skips, first`` for every rotation of ``word$``, as whole and without its last character.

    A rotation that ends in a character of the word stands under the prefix before it: the word ``skips`` that
    character.  Every rotation also stands under itself, as the word an insertion would start from.  Of equal
    neighbouring characters only the skipped one that comes ``first`` counts as a deletion, since all give the
    same word.
    """
    marked = words.withColumn("size", F.length("word"))
    at = F.explode(F.sequence(F.lit(0), F.col("size"))).alias("at")
    turned = marked.select("word", "n", "size", at)

    def cut(start, length):
        return F.substring(F.col("word"), start, length)

    head, here = cut(F.lit(1), F.col("at")), cut(F.col("at") + 1, F.lit(1))
    after = cut(F.col("at") + 2, F.col("size"))
    skip = F.struct(F.concat(after, F.lit(END), head).alias("key"), F.lit(True).alias("skips"),
                    ((F.col("at") == 0) | (here != cut(F.col("at"), F.lit(1)))).alias("first"))
    full = F.struct(F.concat(here, after, F.lit(END), head).alias("key"), F.lit(False).alias("skips"), F.lit(False).alias("first"))
    both = F.when(F.col("at") < F.col("size"), F.array(skip, full)).otherwise(F.array(full))
    return turned.select("word", "n", F.explode(both).alias("r")).select("r.key", "word", "n", "r.skips", "r.first")


def neighbours(words: DataFrame) -> DataFrame:
    """``word, n_near, best``: for words with a near one, how many there are and the one of largest ``n``.

    ``best`` is a struct ``n, word``; of equal ``n`` the smallest word in code-point order.  Two words are near
    if they differ by exactly one inserted, deleted or replaced character.  ``words`` has distinct ``word`` and
    ``n``; words must not hold the terminator.

    Rotations are sorted by key.  All words under one key but one are equal up to the skipped character, so a
    key holds one word more than the alphabet has characters at most, and a scan of its range, in order of
    ``n``, tells every word its number of neighbours and the best other word, without making pairs.
    """
    span = Window.partitionBy("key").orderBy(F.desc("n"), "word")
    whole = span.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    count = lambda mark: F.sum(F.when(mark, 1).otherwise(0)).over(whole)
    other = F.struct(F.col("n"), F.col("word"))
    scanned = rotations(words).select(
        "word", "skips", "first", F.row_number().over(span).alias("no"), count(F.col("skips")).alias("skipping"),
        count(F.col("first")).alias("deleting"), count(~F.col("skips")).alias("wholes"),
        F.first(other).over(whole).alias("top"), F.nth_value(other, 2).over(whole).alias("second"))
    best = F.when(F.col("no") == 1, F.col("second")).otherwise(F.col("top"))
    near = F.when(F.col("skips"), F.col("skipping") - 1 + F.when(F.col("first"), F.col("wholes")).otherwise(0)).otherwise(
        F.col("deleting"))
    # min by (-n, word) is the largest n and of those the smallest word
    found = scanned.select("word", near.alias("near"), F.struct((-best["n"]).alias("less"), best["word"].alias("word")).alias("best"),
                           best.isNotNull().alias("any")).filter("any")
    out = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    return out.select("word", "n_near", F.struct((-F.col("best.less")).alias("n"), F.col("best.word").alias("word")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for the words of ``forms`` (``word, form``, no nulls, no cycles): the last form reached.

    Pointer doubling: after k rounds a word points 2**k forms on.  Words that have arrived at a word without a
    form leave the joins, so a root that many words lead to is no hot key.  Every round is written to the
    shared folder.
    """
    has = forms.select(F.col("word").alias("at"))
    now = written(forms.join(has, forms["form"] == has["at"], "left").select(
        "word", F.col("form").alias("root"), F.col("at").isNull().alias("done")), "chains")
    while not now.filter("NOT done").isEmpty():
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("next"), F.col("done").alias("ended"))
        under_way = now.filter("NOT done")
        moved = under_way.join(ahead, under_way["root"] == ahead["at"]).select(
            "word", F.col("next").alias("root"), F.col("ended").alias("done"))
        now = written(now.filter("done").unionByName(moved), "chains")
    return now.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_count: int = 3,
             factor: int = 2, every: int | None = 97) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the texts.

    Words are those of ``word_counts`` with at least ``least_length`` code points and ``least_count``
    occurrences in all texts.  A word's ``form`` is its near word (see ``neighbours``) with the largest ``n``,
    if that is at least ``factor`` times its own (more than 1, so that forms cannot run in a circle); else
    null.  ``root`` is the last form reached from the word, itself if it has none.  ``n_near`` counts its near
    words, 0 if none.  Null and empty texts have no words; repeated rows count as often as they stand; an
    empty table gives no row.
    """
    if factor <= 1:
        raise ValueError("factor must be more than 1")
    words = written(word_counts(docs, id_col, text_col, every).filter(
        (F.length("word") >= least_length) & (F.col("n") >= least_count)), "words")
    best = F.when(F.col("best.n") >= F.col("n") * factor, F.col("best"))
    found = written(words.join(neighbours(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), best.alias("best")).select(
        "word", "n", "n_near", F.col("best.word").alias("form"), F.col("best.n").alias("form_n")), "variants")
    ends = roots(found.filter("form IS NOT NULL").select("word", "form"))
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
