"""Source divergence: joint tables of count levels by one-hot products, priced by what terms weigh in each source."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vulnsieve.llm.common import slices, whole_text, written

SCALE = 1_000_000_000
PRIOR = 5
#: Letters of a term by byte value: A to Z become lower-case, other ASCII a blank; UTF-8 beyond ASCII stays.
_FOLDED = bytes(b if b >= 0x80 or chr(b).isalpha() else 32 for b in range(256)).lower()


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and code points beyond ASCII; only A to Z are lower-cased."""
    return text.translate(_FOLDED).split()


def term_counts(docs: DataFrame, text_col: str, group_cols: tuple[str, str]) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of every term in every group."""
    def run(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def rows():
            for (lang, source), (n, docs) in held.items():
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), pa.array(list(n), pa.binary()),
                    pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())],
                    ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for start, end in slices(batch, "_text"):
                for lang, source, text in zip(*(c.slice(start, end - start).to_pylist() for c in batch.columns)):
                    n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                    found = Counter(terms(text))
                    size -= len(n)
                    n.update(found)
                    docs.update(found.keys())
                    size += len(n)
                if size > 400_000:  # memory of the worker stays bounded; Spark adds what is handed on
                    yield from rows()
                    held, size = {}, 0
        yield from rows()

    lang, source = (_named(c).alias(n) for c, n in zip(group_cols, ("lang", "source")))
    parts = docs.select(lang, source, whole_text(text_col).cast("binary").alias("_text")).mapInArrow(
        run, "lang string, source string, term binary, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _named(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def weight(n, size, kept, prior: int = PRIOR, scale: int = SCALE):
    """Smoothed share of a term, in whole parts of ``scale``; numbers of any size, exactly."""
    return 1 + scale * (n + prior) // (size + prior * kept) if kept else 0


def _weight(n: str, size: str, kept: str, prior: int, scale: int) -> Column:
    """``weight`` of columns; decimals hold every product exactly."""
    return F.expr(f"1 + (cast({scale} as decimal(10,0)) * (cast({n} as decimal(19,0)) + {prior}))"
                  f" div (cast({size} as decimal(19,0)) + {prior} * cast({kept} as decimal(18,0)))")


def joint_tables(levels: np.ndarray, columns: int = 512):
    """``first, second, n``: joint tables of the groups' levels, a block of terms at a time.

    ``levels`` has a row for each term and a column for each group and holds counts.  Of every block of terms
    the indicator columns (group, level) are written out and multiplied by their transpose; an entry of the
    product is the number of terms with one level in one group and the other in another.  Blocks end where
    their indicators pass ``columns``: terms in order of their size share levels, so blocks of rare terms are
    long.  Entries count terms of one block and stay far below 2**24, so single precision is exact.
    """
    terms_no, groups = levels.shape
    start = 0
    while start < terms_no:
        end = min(terms_no, start + max(1, columns // groups))
        while end < terms_no:
            wider = min(terms_no, end + (end - start))
            if sum(len(np.unique(levels[start:wider, g])) for g in range(groups)) > columns:
                break
            end = wider
        block = levels[start:end]
        owners, values, marks = [], [], []
        for g in range(groups):
            own, place = np.unique(block[:, g], return_inverse=True)
            owners += [g] * len(own)
            values += own.tolist()
            hot = np.zeros((len(own), end - start), np.float32)
            hot[place, np.arange(end - start)] = 1
            marks.append(hot)
        one_hot = np.concatenate(marks)
        yield owners, values, (one_hot @ one_hot.T).astype(np.int64)
        start = end


def price(levels: np.ndarray, sizes: list[int], kept: int, prior: int = PRIOR, scale: int = SCALE) -> np.ndarray:
    """Sum over the terms of what two groups' weights differ by, less the difference of their zero levels.

    The zero levels are added once for all kept terms, so terms that occur in neither group need no row.
    """
    groups = len(sizes)
    total = np.zeros((groups, groups), np.int64)
    zero = np.array([weight(0, s, kept, prior, scale) for s in sizes], np.int64)
    base = np.abs(zero[:, None] - zero[None, :])
    for owners, values, joint in joint_tables(levels):
        weights = np.array([weight(n, sizes[g], kept, prior, scale) for g, n in zip(owners, values)], np.int64)
        owners = np.array(owners)
        cost = joint * (np.abs(weights[:, None] - weights[None, :]) - base[owners[:, None], owners[None, :]])
        cuts = np.flatnonzero(np.diff(owners, prepend=-1))
        total += np.add.reduceat(np.add.reduceat(cost, cuts, 0), cuts, 1)
    return total


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
               least_docs: int = 30, top: int = 50, prior: int = PRIOR, scale: int = SCALE,
               block: int = 32, slice_terms: int = 4096) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far the sources of a language lie apart, and by which terms.

    Terms are runs of letters (``terms``); a language keeps those in at least ``least_docs`` of its documents.
    A term weighs ``weight`` in a group (lang, source) and in the whole language.  Part ``pair``: for every
    other source of the language the summed differences of the weights, all ranks.  Part ``term``: terms that
    occur in the group and weigh more there than in the language, by that excess, the first ``top`` ranks.
    Ranks go by value descending, then item in UTF-8 order.

    Null text, language and source count as empty; every row is a document, also one that repeats another.  A
    group without terms takes part in ``pair``; a language that keeps no term gives zeros.  An empty table
    gives no row.  The output holds every pair of sources of a language, as asked for.

    Terms are counted in the tasks that read them and summed by Spark.  Pairs are priced in cells: a share of
    ``slice_terms`` terms of a language (by hash) for two blocks of ``block`` sources, so a cell's memory is
    bounded however large a language or a source is.  A cell turns counts into joint tables of count levels by
    products of one-hot matrices and prices them; Spark adds the cells.
    """
    counts = written(term_counts(docs, text_col, (lang_col, source_col)), "term-counts")
    groups = docs.select(_named(lang_col).alias("lang"), _named(source_col).alias("source")).distinct()
    whole = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).filter(
        F.col("docs") >= least_docs).select("lang", "term", "total")
    whole = written(whole, "kept-terms")
    kept = written(counts.join(whole, ["lang", "term"]).select("lang", "source", "term", "n", "total"), "kept-counts")
    langs = groups.select("lang").distinct().join(
        whole.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_size")), "lang", "left").select(
        "lang", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("lang_size", F.lit(0)).alias("lang_size"))
    order = Window.partitionBy("lang").orderBy("source")
    groups = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("size")), ["lang", "source"], "left").join(
        langs, "lang").select("lang", "source", F.coalesce("size", F.lit(0)).alias("size"), "kept", "lang_size",
                              (F.row_number().over(order) - 1).alias("no"), F.count("*").over(
                                  Window.partitionBy("lang")).alias("sources"))
    groups = written(groups, "groups")
    rows = kept.join(groups, ["lang", "source"])

    excess = rows.select(
        "lang", "source", F.decode("term", "UTF-8").alias("item"),
        (_weight("n", "size", "kept", prior, scale) - _weight("total", "lang_size", "kept", prior, scale)).alias("value")
    ).filter("value > 0")
    ranking = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_term = excess.withColumn("rank", F.row_number().over(ranking)).filter(F.col("rank") <= top)

    # cells: (lang, share of the terms, block of sources, block of sources not before it)
    blocks, own = F.ceil(F.col("sources") / block).cast("int"), F.floor(F.col("no") / block).cast("int")
    shares = F.greatest(F.lit(1), F.ceil(F.col("kept") / slice_terms)).cast("int")
    cell = ["lang", "share", "a", "b"]
    meets = F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: F.named_struct(
        F.lit("a"), F.least(own, other), F.lit("b"), F.greatest(own, other)))).alias("ab")
    priced_rows = rows.select(
        "lang", F.pmod(F.xxhash64("term"), shares).cast("int").alias("share"), meets, "term", "no", "n", "total").select(
        "lang", "share", "ab.a", "ab.b", "term", "no", "n", "total")
    heads = groups.select(
        "lang", meets, F.col("no").alias("number"), F.col("size").alias("breadth"), F.col("kept").alias("terms"),
        F.explode(F.sequence(F.lit(0), shares - 1)).alias("share")).select(
        "lang", "share", "ab.a", "ab.b", "number", "breadth", "terms")

    def priced(key, found: pa.Table, head: pa.Table) -> pa.Table:
        lang, share, low, high = (k.as_py() for k in key)
        numbers, sizes = (head.column(c).to_numpy() for c in ("number", "breadth"))
        in_order = np.argsort(numbers)
        numbers, sizes = numbers[in_order], [int(s) for s in sizes[in_order]]
        terms_no = int(head.column("terms")[0].as_py())
        zero = np.array([weight(0, s, terms_no, prior, scale) for s in sizes], np.int64)
        value = np.zeros((len(numbers), len(numbers)), np.int64)
        if share == 0:  # once for each pair: what all kept terms differ by where neither source has one
            value += terms_no * np.abs(zero[:, None] - zero[None, :])
        if found.num_rows:
            code = found.column("term").combine_chunks().dictionary_encode()
            place = code.indices.to_numpy(zero_copy_only=False)
            levels = np.zeros((len(code.dictionary), len(numbers)), np.int64)
            levels[place, np.searchsorted(numbers, found.column("no").to_numpy())] = found.column("n").to_numpy()
            totals = np.zeros(len(code.dictionary), np.int64)
            totals[place] = found.column("total").to_numpy()
            value += price(levels[np.argsort(totals, kind="stable")], sizes, terms_no, prior, scale)
        # pairs of one block are priced in the cell of that block with itself alone
        of = numbers // block
        x, y = np.nonzero((of[:, None] == low) & (of[None, :] == high) & (numbers[:, None] < numbers[None, :]))
        return pa.table({"lang": pa.array([lang] * len(x), pa.string()), "i": pa.array(numbers[x], pa.int32()),
                         "j": pa.array(numbers[y], pa.int32()), "value": pa.array(value[x, y], pa.int64())})

    cells = priced_rows.groupBy(*cell).cogroup(heads.groupBy(*cell)).applyInArrow(
        priced, "lang string, i int, j int, value long")
    sums = cells.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    both = sums.select("lang", "value", F.explode(F.array(
        F.named_struct(F.lit("own"), "i", F.lit("other"), "j"), F.named_struct(F.lit("own"), "j", F.lit("other"), "i"))).alias("p"))

    def named(no: str, name: str) -> DataFrame:
        return groups.select("lang", F.col("no").cast("int").alias(no), F.col("source").alias(name))

    pairs = both.select("lang", "value", "p.own", "p.other").join(named("own", "source"), ["lang", "own"]).join(
        named("other", "item"), ["lang", "other"])
    by_pair = pairs.select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(ranking))

    def part(name: str, df: DataFrame) -> DataFrame:
        return df.select("lang", "source", F.lit(name).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")

    return part("pair", by_pair).unionByName(part("term", by_term))
