"""Every match of many patterns, with line numbers, as one map-only plan.

``match_scan`` works in three steps that never shuffle:

1. per row, the *gates* (language tests and plain substring tests) decide which
   patterns can match at all; ``explode`` keeps one row per open gate, so texts
   without an open gate never meet a regular expression;
2. one ``CASE`` over the pattern number runs the one literal pattern of that row
   (literal patterns are compiled once per task) and puts a mark before and after
   every match;
3. the marked text is cut at line ends and at marks, which yields the line and the
   text of every match in time linear in the text.

The marks are two Unicode noncharacters.  A text that already holds one of them has
it swapped for a third noncharacter first, so marks are never confused with text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK, END, SPARE = "\ufdd0", "\ufdd1", "\ufdd2"

# i: ignore case, m: ^ and $ at every line, d: only \n ends a line, s: dot takes \n
RULE_FLAGS = "(?imd)"
EXACT_FLAGS = "(?d)"
DOTALL_FLAGS = "(?sd)"
NOCASE_DOTALL_FLAGS = "(?isd)"


@dataclass(frozen=True)
class Probe:
    """One thing to look for.

    ``gate`` is a SQL condition on the row (see the helpers below); ``pattern`` None
    reports the row once, at line 0.  Gates and patterns are SQL text because a scan
    holds hundreds of them and one parsed expression plans far faster than as many
    column calls.
    """

    ordinal: int
    gate: str
    pattern: str | None = None


def reserve_marks(text: Column) -> Column:
    """The text with the two marks, should it hold them, swapped for a third one."""
    return F.when(
        F.contains(text, F.lit(MARK)) | F.contains(text, F.lit(END)),
        F.translate(text, MARK + END, SPARE + SPARE),
    ).otherwise(text)


def sql_text(value: str) -> str:
    """A string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_any(conditions: Iterable[str]) -> str:
    return "(" + " OR ".join(conditions) + ")"


def sql_all(conditions: Iterable[str]) -> str:
    return "(" + " AND ".join(conditions) + ")"


def sql_contains(column: str, word: str) -> str:
    return f"contains({column}, {sql_text(word)})"


def sql_contains_any(column: str, words: Iterable[str]) -> str:
    return sql_any(sql_contains(column, w) for w in words)


def sql_rlike(column: str, pattern: str) -> str:
    return f"rlike({column}, {sql_text(pattern)})"


def sql_in(column: str, values: Iterable[str]) -> str:
    return f"{column} IN ({', '.join(sql_text(v) for v in values)})"


def sql_anchors(column: str, groups: Sequence[Sequence[str]]) -> str:
    """Every group has at least one alternative inside the column."""
    return sql_all(sql_contains_any(column, group) for group in groups)


_WORD_TEST = re.compile(r"contains\((_low|content), '((?:[^'\\]|\\.)*)'\)")
WORD_BITS = 62  # tests a long holds


class WordTests:
    """Plain substring tests of many conditions, answered by one pass over a text.

    ``in_bits`` writes the tests on ``content`` and on its lower case ``_low`` as tests of a bit of
    the column ``_words``; ``column`` sets the bits.  Null stays null.  Tests that bytes cannot
    answer (an empty word, a lower-case word beyond ASCII) stay as they are.
    """

    def __init__(self):
        self._numbers: dict[tuple[str, str], int] = {}

    def in_bits(self, condition: str) -> str:
        def bit(test: re.Match) -> str:
            word = re.sub(r"\\(.)", r"\1", test[2])
            if not word or test[1] == "_low" and not word.isascii():
                return test[0]
            n = self._numbers.setdefault((test[1], word), len(self._numbers))
            return f"((get(_words, {n // WORD_BITS}) & {1 << n % WORD_BITS}L) <> 0L)"
        return _WORD_TEST.sub(bit, condition)

    def column(self, text: Column) -> Column:
        exact, low = (
            {word.encode().decode("latin-1"): n for (name, word), n in self._numbers.items() if name == column}
            for column in ("content", "_low"))
        longs = -(-len(self._numbers) // WORD_BITS)

        def found(texts: pa.Array) -> pa.Array:
            searches = [_automaton(exact), _automaton(low)]
            return pa.array((None if raw is None else _bits(raw, searches, longs) for raw in texts.to_pylist()), pa.list_(pa.int64()))

        found.__annotations__ = {"texts": pa.Array, "return": pa.Array}
        return F.arrow_udf(found, "array<bigint>")(text.cast("binary"))


def _automaton(words: dict[str, int]):
    automaton = ahocorasick.Automaton()
    for word, n in words.items():
        automaton.add_word(word, n)
    automaton.make_automaton()
    return automaton if words else None


def _bits(raw: bytes, searches: Sequence, longs: int) -> list[int]:
    """The bits of the words in a text; bytes are looked at as Latin-1, one character each."""
    exact, low = searches
    found = set()
    if exact:
        found.update(n for _, n in exact.iter(raw.decode("latin-1")))
    if low:
        # beyond A-Z two characters have ASCII in their lower case
        folded = raw.lower().replace("\u212a".encode(), b"k").replace("\u0130".encode(), "i\u0307".encode())
        found.update(n for _, n in low.iter(folded.decode("latin-1")))
    bits = [0] * longs
    for n in found:
        bits[n // WORD_BITS] |= 1 << n % WORD_BITS
    return bits


def newline_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _mark_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(MARK), F.lit("")))


def marked_lines(marked: Column) -> Column:
    """The 1-based line of every mark, in text order."""
    return F.flatten(
        F.transform(
            F.split(marked, "\n", -1),
            lambda line, i: F.when(
                F.contains(line, F.lit(MARK)),
                F.array_repeat((i + 1).cast("int"), _mark_count(line)),
            ).otherwise(F.array().cast("array<int>")),
        )
    )


def marked_texts(marked: Column) -> Column:
    """The text of every marked match, in text order."""
    parts = F.split(marked, MARK, -1)
    return F.transform(
        F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))),
        lambda part: F.substring_index(part, END, 1),
    )


def marked_matches(marked: Column) -> Column:
    """``array<struct<match_idx int, line int, matched_text string>>`` of a marked text."""
    zipped = F.arrays_zip(marked_lines(marked).alias("line"), marked_texts(marked).alias("text"))
    return F.when(
        F.contains(marked, F.lit(MARK)),
        F.transform(
            zipped,
            lambda m, i: F.struct(
                i.cast("int").alias("match_idx"),
                m.getField("line").alias("line"),
                m.getField("text").alias("matched_text"),
            ),
        ),
    )


def sql_mark(column: str, pattern: str) -> str:
    """The column with a mark before and after every match."""
    return f"regexp_replace({column}, {sql_text(pattern)}, {sql_text(MARK + '$0' + END)})"


def match_scan(rows: DataFrame, probes: Sequence[Probe], text: str, keep: Sequence[str]) -> DataFrame:
    """One row per match of every probe whose gate is open.

    Returns ``keep`` columns plus ``ordinal int, match_idx int, line int,
    matched_text string`` (the whole match, not cut).
    """
    gates = ", ".join(f"CASE WHEN {p.gate} THEN {p.ordinal} END" for p in probes)
    open_gates = rows.withColumn("_gates", F.expr(f"array({gates})"))
    # The generator input is an expression on purpose: for a bare column Spark infers
    # a size filter, pushes it below the projection and tests every gate twice.
    hits = open_gates.select(
        *keep, F.col(text).alias("_text"),
        F.expr("explode(array_except(_gates, array(CAST(NULL AS INT))))").alias("ordinal"),
    )
    whole_file = [p.ordinal for p in probes if p.pattern is None]
    branches = [f"WHEN ordinal = {p.ordinal} THEN {sql_mark('_text', p.pattern)}" for p in probes if p.pattern]
    if whole_file:
        branches.append(f"WHEN ordinal IN ({', '.join(map(str, whole_file))}) THEN {sql_text(MARK + END)}")
    found = (
        hits.withColumn("_marked", F.expr(f"CASE {' '.join(branches)} END"))
        .select(*keep, "ordinal", F.inline(marked_matches(F.col("_marked"))))
    )
    if whole_file:
        found = found.withColumn(
            "line", F.when(F.col("ordinal").isin(whole_file), F.lit(0)).otherwise(F.col("line")))
    return found
