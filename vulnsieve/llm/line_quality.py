"""Quality rules, line first: lines are judged, failing ones removed, documents losing too much rejected."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnsieve.llm.common import slices, whole_text

WINDOW = 5
#: ASCII white space, symbol characters and the first bytes of code points, by byte value.
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
FIRST = (np.arange(256) & 0xC0) != 0x80


@dataclass(frozen=True)
class LineRules:
    """What a line must not be.  Patterns are RE2, so SQL engines with RE2 read them alike.

    * navigation: at least ``least_separators`` separators, one in ``words_a_separator`` words or more;
    * boilerplate: a phrase of ``boilerplate`` in a line of ``phrase_words`` words or fewer;
    * punctuation: no sentence mark at all in a line of ``heading_words`` words or fewer, or a doubled mark
      for every ``words_a_shout`` words;
    * symbols: one symbol in ``chars_a_symbol`` characters or more.
    """

    separators: str = "[|»›•·]"
    least_separators: int = 2
    words_a_separator: int = 6
    boilerplate: str = (
        r"(?i)\b(all rights reserved|(cookie|privacy) policy|terms (of (use|service)|and conditions)"
        r"|(enable|requires) javascript|skip to (main )?content|sign (in|up)|log ?in|my account|add to cart"
        r"|click here|read more|back to top|subscribe (now|to our)|share (this|on)|powered by|lorem ipsum)\b|©|\(c\) ?(19|20)[0-9]{2}")
    phrase_words: int = 30
    sentence_mark: str = "[.!?:;。！？।…]"
    heading_words: int = 10
    shout: str = "[!?]{2,}"
    words_a_shout: int = 3
    symbols: str = r"[#*$%&<>{}\[\]=_~^\\|]"
    chars_a_symbol: int = 5


REASONS = ("navigation", "boilerplate", "punctuation", "symbols")


def failing(lines: pa.Array, words: np.ndarray, chars: np.ndarray, rules: LineRules) -> np.ndarray:
    """For every line the number of the first of ``REASONS`` it fails by, counted from 1; 0 if none."""
    def count(pattern: str) -> np.ndarray:
        return pc.count_substring_regex(lines, pattern).to_numpy(zero_copy_only=False)

    def found(pattern: str) -> np.ndarray:
        return pc.match_substring_regex(lines, pattern).to_numpy(zero_copy_only=False)

    separators, shouts = count(rules.separators), count(rules.shout)
    return np.select([
        (separators >= rules.least_separators) & (separators * rules.words_a_separator >= words),
        (words <= rules.phrase_words) & found(rules.boilerplate),
        ((words <= rules.heading_words) & ~found(rules.sentence_mark)) | ((shouts > 0) & (shouts * rules.words_a_shout >= words)),
        count(rules.symbols) * rules.chars_a_symbol >= chars,
    ], [1, 2, 3, 4], 0)


def _pieces(data: np.ndarray, kept: np.ndarray, lengths: np.ndarray) -> pa.DictionaryArray:
    """The pieces of ``data`` whose bytes are marked in ``kept``, one after the other, as a dictionary array."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    array = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data[kept])])
    return array.dictionary_encode()


def _codes(found: pa.DictionaryArray) -> np.ndarray:
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _ranked(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs, exactly."""
    if not len(left):
        return left
    return np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1].astype(np.int64)


def repeated_words(codes: np.ndarray, owner: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Marks the words that lie in a window of ``window`` words found twice or more in their own document.

    ``codes`` are equal for equal words, ``owner`` numbers the documents in order.
    """
    n = len(codes) - window + 1
    covered = np.zeros(len(codes) + 1, np.int64)
    if n <= 0:
        return covered[:-1] > 0
    grams = codes
    for i in range(1, window):
        grams = _ranked(grams[:-1], codes[i:])
    inside = np.flatnonzero(owner[:n] == owner[window - 1:])
    if len(inside):
        keys = owner[inside] * (int(grams.max()) + 1) + grams[inside]
        _, back, times = np.unique(keys, return_inverse=True, return_counts=True)
        starts = inside[times[back] > 1]
        np.add.at(covered, starts, 1)
        np.add.at(covered, starts + window, -1)
    return np.cumsum(covered)[:-1] > 0


def measure(texts: list[bytes], rules: LineRules, with_text: bool = False) -> dict[str, np.ndarray | list[str]]:
    """Counts of every text, over all texts at once."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    bounds = np.concatenate([[0], ends])

    def per(marks: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(marks)])
        return total[cuts[1:]] - total[cuts[:-1]]

    solid = ~SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]])))
    starts, stops = edges[::2], edges[1::2]
    first = solid & FIRST[data]
    opens = np.zeros(len(data), bool)
    opens[starts] = True
    codes = _codes(_pieces(data, solid, stops - starts))
    n_words = per(opens, bounds)
    owner = np.repeat(np.arange(len(texts)), n_words)
    repeats = np.bincount(owner[repeated_words(codes, owner)], minlength=len(texts))

    # every text ends in a line end here, so lines are what lies between line ends
    newline = data == 10
    cuts = np.concatenate([[0], np.flatnonzero(newline) + 1])
    line_words, line_chars = per(opens, cuts), per(first, cuts)
    lines = _pieces(data, ~newline, np.diff(cuts) - 1)
    line_code, line_owner = _codes(lines), np.searchsorted(bounds, cuts[:-1], "right") - 1
    worded = np.flatnonzero(line_words > 0)
    keys = line_owner[worded] * (len(lines.dictionary) + 1) + line_code[worded]
    earlier = np.ones(len(worded), bool)
    earlier[np.unique(keys, return_index=True)[1]] = False
    # equal lines fail alike: each distinct one is judged once
    sample = np.zeros(len(lines.dictionary), np.int64)
    sample[line_code] = np.arange(len(line_code))
    distinct_lines = lines.dictionary.cast(pa.large_string(), safe=False)
    reason = failing(distinct_lines, line_words[sample], line_chars[sample], rules)[line_code]
    failed = (reason > 0) & (line_words > 0)
    count = lambda marks: np.bincount(line_owner[marks], minlength=len(texts))
    out = {
        "n_words": n_words, "word_chars": per(first, bounds), "n_symbols": per(SYMBOL[data], bounds),
        "n_dup_lines": np.bincount(line_owner[worded[earlier]], minlength=len(texts)), "n_repeat_words": repeats,
        "n_lines": np.bincount(line_owner[worded], minlength=len(texts)), "n_failed_lines": count(failed),
        "lost_chars": np.bincount(line_owner[failed], line_chars[failed], len(texts)).astype(np.int64),
        **{f"{name}_lines": count(failed & (reason == i)) for i, name in enumerate(REASONS, 1)},
    }
    if with_text:
        stays = np.repeat(~failed, np.diff(cuts))
        clean, places = data[stays].tobytes(), np.concatenate([[0], np.cumsum(per(stays, bounds))])
        out["clean_text"] = [clean[a:max(a, b - 1)].decode("utf-8", "replace") for a, b in zip(places, places[1:])]
    return out


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_failed_lines", "lost_chars",
          *(f"{name}_lines" for name in REASONS))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules(),
          least_words: int = 10, repeat_percent: int = 20, lost_percent: int = 50, with_text: bool = False) -> DataFrame:
    """``id_col``, the counts of ``COUNTS``, ``base_failed, kept`` and, if asked for, ``clean_text`` for every row.

    Words end at ASCII white space; lines end at ``\\n``.  ``n_repeat_words`` counts words in windows of five
    found twice or more in the text, ``n_dup_lines`` lines with a word that equal an earlier one.
    ``base_failed`` holds for texts of fewer than ``least_words`` words or with more than ``repeat_percent``
    percent of repeated words.  Every line with a word is held against ``rules``; ``clean_text`` lacks the
    failing ones.  A document is ``kept`` when it did not fail at the base and its failing lines hold no more
    than ``lost_percent`` percent of its word characters.

    A null text counts as empty: no word, so not kept.  Rows are judged one by one, so null, repeated and tied
    ids come back as they are; an empty table gives no row.  Map only: one pass, no shuffle, and texts are
    worked on some 2 MB at a time, a longer one alone.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    fields = [*COUNTS, *(["clean_text"] if with_text else [])]
    types = [pa.int64()] * len(COUNTS) + ([pa.string()] if with_text else [])

    def run(batches):
        for batch in batches:
            for start, end in slices(batch, "_text"):
                part = batch.slice(start, end - start)
                found = measure(part.column(1).to_pylist(), rules, with_text)
                arrays = [pa.array(found[name], t) for name, t in zip(fields, types)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], ["_id", *fields])

    out = docs.select(F.col(f"`{id_col}`").alias("_id"), whole_text(text_col).cast("binary").alias("_text")).mapInArrow(
        run, ", ".join([f"_id {kind}", *(f"{c} long" for c in COUNTS), *(["clean_text string"] if with_text else [])]))
    base = (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * repeat_percent)
    lost = F.col("lost_chars") * 100 > F.col("word_chars") * lost_percent
    return out.select(F.col("_id").alias(id_col), *fields, base.alias("base_failed"), (~base & ~lost).alias("kept"))


def keep_clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``id_col, text_col`` of the documents that are kept, without their failing lines."""
    out = judge(docs, id_col, text_col, with_text=True, **options).filter("kept")
    return out.select(f"`{id_col}`", F.col("clean_text").alias(text_col))
