"""Dependency manifests: eight formats parsed in one map-only pass.

Every format is a column expression from the text of one manifest to an array of
``struct<line_no, name, version, dep_type>``.  Section state (Pipfile, pyproject,
go.mod, Cargo) needs no window: the text is cut where a line changes the state, and
the first line of each piece tells the state of the whole piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vulnsieve.catalog.patterns import MANIFEST_FILES

BLANKS = " \t\r\x0b\f"  # a line never holds \n
INDENT = r"[ \t\r\x0B\f]*"
PIECE = 1 << 32  # places a later section after every line of an earlier one

# Line patterns of the formats.
REQUIREMENT = r"^([a-zA-Z0-9_.-]+)\s*(?:[=<>!~]+\s*([0-9][0-9a-zA-Z.*-]*))?"
QUOTED_REQUIREMENT = r'^"([a-zA-Z0-9_.-]+)(?:[=<>!~]+([0-9][0-9a-zA-Z.*-]*))?'
GEM = r"""^gem\s+['"]([^'"]+)['"](?:\s*,\s*['"]([^'"]+)['"])?"""
TABLE_VERSION = r'version\s*=\s*"([^"]+)"'
CARGO_SECTIONS = ["[dependencies]", "[dev-dependencies]", "[build-dependencies]"]


def _trim(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def _empty_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def _dep(line_no: Column, name: Column, version: Column, dep_type: Column | None = None) -> Column:
    return F.struct(
        line_no.cast("long").alias("line_no"), name.alias("name"), version.alias("version"),
        (F.lit(None).cast("string") if dep_type is None else dep_type).alias("dep_type"))


def _lines(text: Column) -> Column:
    """``array<struct<n, s>>``: numbered, trimmed lines of a text."""
    return F.transform(F.split(text, "\n", -1), lambda s, i: F.struct(i.cast("long").alias("n"), _trim(s).alias("s")))


def _pieces(content: Column, boundary: str, is_open: Callable[[Column], Column],
            closed: Callable[[Column], Column] = lambda ls: F.slice(ls, 1, 0)) -> Column:
    """Lines that count: all but the first of open pieces, ``closed(lines)`` of the others.

    A piece starts at every line that matches ``boundary``; its first line tells
    whether it is open.
    """
    cut = F.split(content, rf"\n(?={boundary})", -1)

    def wanted(ls: Column, piece: Column) -> Column:
        opened = is_open(F.get(ls, F.lit(0)).getField("s"))
        kept = F.when(opened, F.slice(ls, 2, F.greatest(F.size(ls), F.lit(1)))).otherwise(closed(ls))
        return F.transform(kept, lambda l: F.struct((piece * PIECE + l.getField("n")).alias("n"), l.getField("s").alias("s")))

    return F.flatten(F.transform(F.transform(cut, _lines), lambda ls, i: wanted(ls, i.cast("long"))))


def requirements(content: Column) -> Column:
    wanted = F.filter(_lines(content), lambda l: F.rlike(l.getField("s"), F.lit(REQUIREMENT))
                      & ~F.startswith(l.getField("s"), F.lit("-")))
    return F.transform(wanted, lambda l: _dep(
        l.getField("n"), F.regexp_extract(l.getField("s"), REQUIREMENT, 1),
        _empty_to_null(F.regexp_extract(l.getField("s"), REQUIREMENT, 2))))


def _key_value(line: Column) -> tuple[Column, Column]:
    parts = F.split(line, "=", 2)
    return _trim(F.get(parts, F.lit(0))), _trim(F.get(parts, F.lit(1)))


def pipfile(content: Column) -> Column:
    inside = _pieces(content, INDENT + r"\[", lambda first: first == "[packages]")

    def parse(l: Column) -> Column:
        name, value = _key_value(l.getField("s"))
        version = F.ltrim(F.btrim(value, F.lit('"')), F.lit("*>=<~!"))
        return _dep(l.getField("n"), F.btrim(name, F.lit('"')), _empty_to_null(version))

    return F.transform(F.filter(inside, lambda l: F.contains(l.getField("s"), F.lit("="))), parse)


def pyproject(content: Column) -> Column:
    opens = r"(?=[^\n]*dependencies)(?=[^\n]*=)(?=[^\n]*\[)"
    closes = rf"(?![^\n]*dependencies){INDENT}\["
    inside = _pieces(content, f"(?:{opens}|{closes})", lambda first: (
        F.contains(first, F.lit("dependencies")) & F.contains(first, F.lit("=")) & F.contains(first, F.lit("["))))
    wanted = F.filter(inside, lambda l: F.rlike(l.getField("s"), F.lit(QUOTED_REQUIREMENT)))
    return F.transform(wanted, lambda l: _dep(
        l.getField("n"), F.regexp_extract(l.getField("s"), QUOTED_REQUIREMENT, 1),
        _empty_to_null(F.regexp_extract(l.getField("s"), QUOTED_REQUIREMENT, 2))))


def _json_sections(content: Column, sections: list[str]) -> Column:
    """Entries of JSON objects as dependencies; a text that is no JSON has none."""
    schema = ", ".join(f"`{s}` map<string,string>" for s in sections)

    def entries_of(parsed: Column, i: int, section: str) -> Column:
        entries = F.coalesce(F.map_entries(parsed.getField(section)),
                             F.array().cast("array<struct<key:string,value:string>>"))
        versions = F.transform(entries, lambda e: F.struct(
            e.getField("key").alias("key"), F.regexp_replace(e.getField("value"), F.lit("[^0-9.]"), F.lit("")).alias("value")))
        return F.transform(versions, lambda e, j: _dep(
            F.lit(i * PIECE) + j, e.getField("key"), _empty_to_null(e.getField("value")), F.lit(section)))

    # bound to a variable: a text is parsed once for all sections
    return F.flatten(F.transform(F.array(F.from_json(content, schema)), lambda parsed: F.concat(
        *[entries_of(parsed, i, section) for i, section in enumerate(sections)])))


def package_json(content: Column) -> Column:
    return _json_sections(content, ["dependencies", "devDependencies"])


def composer_json(content: Column) -> Column:
    found = F.filter(
        _json_sections(content, ["require", "require-dev"]),
        lambda d: (d.getField("name") != "php") & ~F.startswith(d.getField("name"), F.lit("ext-")))
    return F.transform(found, lambda d: _dep(d.getField("line_no"), d.getField("name"), d.getField("version")))


def go_mod(content: Column) -> Column:
    boundary = rf"{INDENT}(?:require \(|\){INDENT}(?:\n|\z))"
    inside = _pieces(
        content, boundary, lambda first: F.startswith(first, F.lit("require (")),
        closed=lambda ls: F.filter(ls, lambda l: F.startswith(l.getField("s"), F.lit("require "))))

    def parse(l: Column) -> Column:
        words = F.split(_trim(F.replace(l.getField("s"), F.lit("require "), F.lit(""))), r"\s+", -1)
        return _dep(l.getField("n"), F.get(words, F.lit(0)),
                    F.ltrim(F.get(words, F.lit(1)), F.lit("v")))

    return F.filter(F.transform(inside, parse), lambda d: d.getField("version").isNotNull())


def cargo(content: Column) -> Column:
    boundary = rf"{INDENT}(?:\[(?:dev-|build-)?dependencies\]{INDENT}(?:\n|\z)|\[(?![^\n]*dependencies))"
    inside = _pieces(content, boundary, lambda first: first.isin(CARGO_SECTIONS))

    def parse(l: Column) -> Column:
        name, value = _key_value(l.getField("s"))
        bare = F.btrim(value, F.lit('"'))
        table = F.regexp_extract(bare, TABLE_VERSION, 1)
        return _dep(l.getField("n"), name, _empty_to_null(F.when(table != "", table).otherwise(bare)))

    return F.transform(F.filter(inside, lambda l: F.contains(l.getField("s"), F.lit("="))), parse)


def gemfile(content: Column) -> Column:
    wanted = F.filter(_lines(content), lambda l: F.rlike(l.getField("s"), F.lit(GEM)))

    def parse(l: Column) -> Column:
        version = F.regexp_extract(l.getField("s"), GEM, 2)
        return _dep(l.getField("n"), F.regexp_extract(l.getField("s"), GEM, 1),
                    F.when(version != "", F.ltrim(version, F.lit("~>=<! "))))

    return F.transform(wanted, parse)


PARSERS: dict[str, Callable[[Column], Column]] = {
    "requirements.txt": requirements,
    "Pipfile": pipfile,
    "pyproject.toml": pyproject,
    "package.json": package_json,
    "go.mod": go_mod,
    "Cargo.toml": cargo,
    "Gemfile": gemfile,
    "composer.json": composer_json,
}


def parse_manifests(manifests: DataFrame, formats: list[str] | None = None) -> DataFrame:
    """Dependencies of all manifests, in one pass over ``project, path, file_name, content``.

    Besides the dependency columns, ``format_no, path, line_no`` tell the order.
    """
    chosen = [(i, name, eco) for i, (name, eco) in enumerate(MANIFEST_FILES) if formats is None or name in formats]
    file_name, parsed, number, ecosystem = F.col("file_name"), None, None, None
    for i, name, eco in chosen:
        hit = file_name == name
        deps = PARSERS[name](F.col("content"))
        parsed = F.when(hit, deps) if parsed is None else parsed.when(hit, deps)
        number = F.when(hit, i) if number is None else number.when(hit, i)
        ecosystem = F.when(hit, F.lit(eco)) if ecosystem is None else ecosystem.when(hit, F.lit(eco))
    return manifests.filter(file_name.isin([name for _, name, _ in chosen])).select(
        "project", "path", file_name.alias("source"), ecosystem.alias("ecosystem"), number.alias("format_no"),
        F.inline(parsed),
    ).select("project", "name", "version", "ecosystem", "source", "dep_type", "format_no", "path", "line_no")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key.  A partial aggregate, so a crowded key is reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return df.groupBy(*keys).agg(
        F.min(F.struct(*order, *rest)).alias("_first")).select(*keys, "_first.*").select(*df.columns)


def distinct_deps(deps: DataFrame) -> DataFrame:
    """One dependency per project, name and ecosystem: format order, root before subfolders, path, line."""
    depth = F.size(F.split("path", "/", -1))
    ordered = deps.withColumn("depth", depth)
    return first_per_key(ordered, ["project", "name", "ecosystem"], ["format_no", "depth", "path", "line_no"]).drop("depth")


def section_of_line(lines: DataFrame, header: str, keys: list[str], line_no: str = "line_no") -> DataFrame:
    """Adds ``section``: the last header at or above each line of a table of lines."""
    above = Window.partitionBy(*keys).orderBy(line_no).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("section", F.last(header, ignorenulls=True).over(above))
