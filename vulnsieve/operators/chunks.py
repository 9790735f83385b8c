"""Chunks, functions and the full preprocessing of source texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnsieve.catalog import patterns as P
from vulnsieve.functions import matching as M
from vulnsieve.functions import text as X
from vulnsieve.functions.matching import sql_rlike


#: White space that may stand before a definition, beyond what ``\\s`` covers.
_BLANKS = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def _spans(lines: str, size: int, overlap_lines: int) -> str:
    """SQL: half-open line ranges of the chunks of a text, a fold over the lengths of its lines.

    A chunk is closed once it holds ``size`` characters: before the last line that opens a
    definition among the lines looked back at, else before its last line.  The next chunk
    starts a few lines earlier.  The state is the start of the running chunk, its characters
    and the ranges so far; only lengths and flags are carried, no text.
    """
    opens = "|".join(re.escape(word) for word in P.CHUNK_BOUNDARIES)
    opening = sql_rlike("line", f"(?d)^{_BLANKS}*(?:{opens})")
    ahead = f"greatest(acc.first, e.at - {P.CHUNK_LOOKBACK})"
    # e.at numbers the line just added, from 0
    cut = (f"CASE WHEN {ahead} < e.at THEN coalesce(array_max(filter(sequence({ahead} + 1, e.at), i -> get(_marks, i).opens)), e.at) "
           "ELSE e.at END")
    start = "named_struct('first', 0, 'chars', 0L, 'out', cast(array() as array<struct<a:int,b:int>>))"
    grown = "named_struct('first', acc.first, 'chars', acc.chars + e.chars, 'out', acc.out)"
    begin = f"greatest(acc.first, c - {overlap_lines})"
    closed = (f"transform(array({cut}), c -> named_struct('first', {begin}, 'chars', "
              f"aggregate(slice(_marks, {begin} + 1, e.at + 1 - {begin}), 0L, (n, m) -> n + m.chars), "
              "'out', concat(acc.out, array(named_struct('a', acc.first, 'b', c)))))[0]")
    fold = f"aggregate(_marks, {start}, (acc, e) -> CASE WHEN acc.chars + e.chars < {size} THEN {grown} ELSE {closed} END)"
    marks = (f"transform({lines}, (line, i) -> named_struct('at', i, 'chars', cast(length(line) + 1 as bigint), 'opens', {opening}))")
    # the marks are bound once: they stand in the fold more than once
    return (f"transform(array({marks}), _marks -> transform(array({fold}), f -> CASE WHEN f.first < size(_marks) "
            "THEN concat(f.out, array(named_struct('a', f.first, 'b', size(_marks)))) ELSE f.out END)[0])[0]")


def chunk_array(content: str = "content", max_chunk_size: int = P.CHUNK_SIZE, overlap: int = P.CHUNK_OVERLAP) -> Column:
    """Chunks of a text column with their line ranges; chunks without any line are dropped."""
    whole = "array(named_struct('a', 0, 'b', size(_lines)))"
    spans = _spans("_lines", max_chunk_size, overlap // P.CHUNK_CHARS_PER_LINE)
    return F.expr(f"""CASE WHEN {content} IS NOT NULL THEN transform(array(split({content}, '\n', -1)), _lines -> transform(
        filter(CASE WHEN length({content}) <= {max_chunk_size} THEN {whole} ELSE {spans} END, s -> s.b > s.a),
        s -> named_struct('code', array_join(slice(_lines, s.a + 1, s.b - s.a), '\n'), 'start_line', s.a + 1, 'end_line', s.b)))[0] END""")


def chunk(files: DataFrame, max_chunk_size: int = P.CHUNK_SIZE, overlap: int = P.CHUNK_OVERLAP) -> DataFrame:
    """``file_id, chunk_no, code, start_line, end_line``."""
    chunks = files.select("file_id", chunk_array("content", max_chunk_size, overlap).alias("_chunks"))
    return chunks.select("file_id", F.posexplode("_chunks").alias("chunk_no", "c")).select("file_id", "chunk_no", "c.*")


def extract_functions(files: DataFrame) -> DataFrame:
    """``file_id, name, code, start_line, end_line`` of every function.

    ``files`` needs ``language``; languages without a pattern of their own use the
    Python one.  For Python the name is the function's name and the first line the
    one of its ``def``.
    """
    languages = list(P.FUNCTIONS)
    default = languages.index(P.FUNCTION_DEFAULT_LANGUAGE)
    named = [name for name in languages if name != P.FUNCTION_DEFAULT_LANGUAGE]
    probes = []
    for i, language in enumerate(languages):
        pattern, _, anchors = P.FUNCTIONS[language]
        own = M.sql_in("language", [language]) if i != default else f"NOT {M.sql_in('language', named)}"
        probes.append(M.Probe(i, f"{own} AND {M.sql_contains_any('content', anchors.split('|'))}",
                              M.DOTALL_FLAGS + pattern))
    rows = files.select("file_id", "language", M.reserve_marks(F.col("content")).alias("content"))
    found = M.match_scan(rows, probes, text="content", keep=["file_id"])
    code = F.col("matched_text")
    name = None
    for i, language in enumerate(languages):
        pattern, groups, _ = P.FUNCTIONS[language]
        # The match is searched again for its groups; \z then ends the match itself.
        options = [F.nullif(F.regexp_extract(code, M.DOTALL_FLAGS + pattern, g), F.lit("")) for g in groups]
        hit, value = F.col("ordinal") == i, F.coalesce(*options, F.lit("unknown"))
        name = F.when(hit, value) if name is None else name.when(hit, value)
    skipped = F.when((F.col("ordinal") == default) & F.startswith(code, F.lit("\n")), 1).otherwise(0)
    body = F.when(skipped == 1, F.substring(code, 2, F.length(code))).otherwise(code)
    start = F.col("line") + skipped
    return found.select(
        "file_id", "match_idx", name.alias("name"), body.alias("code"),
        start.cast("int").alias("start_line"),
        (start + M.newline_count(body)).cast("int").alias("end_line"),
    )


def preprocess(files: DataFrame, max_chunk_size: int = P.CHUNK_SIZE, overlap: int = P.CHUNK_OVERLAP) -> DataFrame:
    """Normalised text, language, frameworks, chunks and counts, one row per file.

    Functions are a table of their own (``extract_functions``) so that no row has to
    be gathered again after its functions were found.
    """
    normal = files.select("file_id", "path", X.normalize(F.col("content")).alias("content"))
    known = normal.withColumns({
        "language": X.detect_language(F.col("path"), "content"),
        "frameworks": X.detect_frameworks("content"),
    })
    return X.with_counts(known.withColumn("chunks", chunk_array("content", max_chunk_size, overlap)))


def preprocessed_functions(files: DataFrame) -> DataFrame:
    """``extract_functions`` on the normalised texts."""
    normal = files.select("file_id", "path", X.normalize(F.col("content")).alias("content"))
    return extract_functions(normal.withColumn("language", X.detect_language(F.col("path"), "content")))
