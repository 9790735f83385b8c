"""Column functions over source text and paths: language, frameworks, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnsieve.catalog import patterns as P
from vulnsieve.functions.matching import (
    EXACT_FLAGS, sql_all, sql_contains, sql_contains_any, sql_rlike, sql_text,
)

# Blanks that a right-strip removes inside a line (the line end excepted).
LINE_BLANKS = r"[ \t\x0B\f\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def path_extension(path: Column) -> Column:
    """Lower-cased suffix of the last path part, '' when there is none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)\z", 1))


def _extension_language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in P.EXTENSION_LANGUAGE.items() for x in pair])
    return F.try_element_at(table, path_extension(path))


def language_from_path(path: Column) -> Column:
    return F.coalesce(_extension_language(path), F.lit("unknown"))


def _content_ranking(column: str) -> str:
    """SQL: per language a struct of its patterns present, its rank in ties and its name."""
    ranked = []
    for i, (language, rows) in enumerate(P.CONTENT_LANGUAGE.items()):
        score = " + ".join(
            f"CASE WHEN {sql_contains(column, anchor)} AND {sql_rlike(column, EXACT_FLAGS + pattern)} THEN 1 ELSE 0 END"
            for pattern, anchor in rows)
        ranked.append(f"named_struct('score', {score}, 'rank', {-i}, 'language', {sql_text(language)})")
    return f"array_max(array({', '.join(ranked)}))"


def language_from_content(column: str) -> Column:
    """The language with most patterns present in a text column; ties go to the earlier one."""
    return F.expr(f"CASE WHEN {_content_ranking(column)}.score > 0 "
                  f"THEN {_content_ranking(column)}.language ELSE 'unknown' END")


def detect_language(path: Column, content: str) -> Column:
    """By extension where it is known, else by the (normalised) content column."""
    return F.coalesce(_extension_language(path), language_from_content(content))


def sql_framework(column: str, framework: str, raw: str | None = None) -> str:
    """SQL: any pattern of the framework occurs in the normalised text column.

    ``raw`` (default: the column itself) is where plain anchors are looked up first.
    """
    found, anchors = P.FRAMEWORKS[framework]
    one_pass = EXACT_FLAGS + "|".join(f"(?:{p})" for p in found)
    return sql_all([sql_contains_any(raw or column, anchors), sql_rlike(column, one_pass)])


def detect_frameworks(column: str) -> Column:
    """Names of the frameworks used, in catalogue order."""
    names = ", ".join(f"CASE WHEN {sql_framework(column, f)} THEN {sql_text(f)} END" for f in P.FRAMEWORKS)
    return F.expr(f"array_compact(array({names}))")


def fold_line_ends(content: Column) -> Column:
    return F.when(
        F.contains(content, F.lit("\r")), F.regexp_replace(content, F.lit("\r\n?"), F.lit("\n"))
    ).otherwise(content)


def normalize(content: Column) -> Column:
    """LF line ends, no trailing blanks, at most two blank lines in a row, final LF."""
    step = fold_line_ends(content)
    step = F.regexp_replace(step, F.lit(LINE_BLANKS + r"++(?=\n|\z)"), F.lit(""))
    step = F.regexp_replace(step, F.lit(r"\n{4,}"), F.lit("\n\n\n"))
    step = F.regexp_replace(step, F.lit(r"\A\n{3,}"), F.lit("\n\n"))
    step = F.regexp_replace(step, F.lit(r"\n{3,}\z"), F.lit("\n\n"))
    step = F.regexp_replace(step, F.lit(r"\A\n{2,}\z"), F.lit("\n"))
    return F.regexp_replace(step, F.lit(r"(?<!\n)\z"), F.lit("\n"))


def with_counts(df: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``line_count`` (line ends) and ``char_count``."""
    c = F.col(content)
    return df.withColumns({
        "line_count": (F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))).cast("int"),
        "char_count": F.length(c).cast("int"),
    })


def line_context(content: Column, line: Column, n: int = 3) -> Column:
    """``struct<snippet, start_line, end_line, target_line>`` around a 1-based line."""
    lines = F.split(content, "\n", -1)
    start = F.greatest(F.lit(0), line - F.lit(n + 1))
    end = F.least(F.size(lines), line + F.lit(n))
    body = F.transform(
        F.slice(lines, start + 1, F.greatest(end - start, F.lit(0))),
        lambda text, i: F.format_string(
            "%s%4d | %s",
            F.when(start + i + 1 == line, F.lit(">>> ")).otherwise(F.lit("    ")),
            start + i + 1, text),
    )
    return F.struct(
        F.concat_ws("\n", body).alias("snippet"),
        (start + 1).cast("int").alias("start_line"),
        end.cast("int").alias("end_line"),
        line.cast("int").alias("target_line"),
    )


def format_size(size: Column) -> Column:
    """Bytes as text with one decimal: ``1536`` -> ``1.5 KB``."""
    value, out = size.cast("double"), None
    for unit in ("B", "KB", "MB", "GB"):
        text = F.format_string(f"%.1f {unit}", F.bround(value, 1))
        small = value < 1024
        out = F.when(small, text) if out is None else out.when(small, text)
        value = value / 1024
    return out.otherwise(F.format_string("%.1f TB", F.bround(value, 1)))

