"""Raw JSON feeds (CVE, OSV, KEV, repositories, advisories) flattened with given schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnsieve import schemas
from vulnsieve.functions.urls import version_key

DATE_CHARS = 10  # fixed value


_RANGES = "array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>"
INTERVALS = "array<struct<introduced:string,fixed:string,last_affected:string>>"


def _intervals(events: Column) -> Column:
    """The events of one range, in version order, as intervals.

    Each ``introduced`` is closed by the next ``fixed`` (exclusive) or ``last_affected``
    (inclusive); what is never closed stays open.  A leading end without a start begins below
    all versions.
    """
    ordered = F.array_sort(F.flatten(F.transform(events, lambda e: F.filter(F.array(*[
        F.struct(F.when(e.getField(kind) == "0", F.lit("")).otherwise(version_key(e.getField(kind))).alias("key"),
                 F.lit(place).alias("place"), e.getField(kind).alias("version"))
        for place, kind in enumerate(("fixed", "introduced", "last_affected"))]), lambda x: x.version.isNotNull()))))

    def interval(low, fixed, last):
        return F.array(F.struct(low.alias("introduced"), fixed.alias("fixed"), last.alias("last_affected")))

    none = F.lit(None).cast("string")
    start = F.struct(F.lit(True).alias("leading"), F.lit(False).alias("open"), none.alias("low"), F.array().cast(INTERVALS).alias("out"))

    def step(acc, e):
        starts = e.place == 1
        closes = ~starts & (acc.open | acc.leading)
        fixed, last = F.when(e.place == 0, e.version), F.when(e.place == 2, e.version)
        return F.struct(
            F.lit(False).alias("leading"), starts.alias("open"),
            F.when(starts & acc.open, acc.low).when(starts, e.version).alias("low"),
            F.when(closes, F.concat(acc.out, interval(acc.low, fixed, last))).otherwise(acc.out).alias("out"))

    return F.aggregate(ordered, start, step, lambda acc: F.when(
        acc.open, F.concat(acc.out, interval(acc.low, none, none))).otherwise(acc.out))


def _text(column: str | Column, default: str = "") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(default))


def _or_empty(column: str | Column, kind: str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, F.array().cast(kind))


def flatten_cve(raw: DataFrame, json: str = "json") -> DataFrame:
    """One row per CVE of the feed documents."""
    cve = raw.select(F.explode(F.from_json(json, schemas.CVE_FEED).vulnerabilities.cve).alias("c")).select("c.*")
    english = F.filter("descriptions", lambda d: d.lang == "en")
    metric = F.get(F.col("metrics.cvssMetricV31"), F.lit(0)).cvssData
    weaknesses = F.flatten(F.transform("weaknesses", lambda w: F.transform(w.description, lambda d: d.value)))
    references = F.transform(
        "references",
        lambda r: F.struct(
            _text(r.url).alias("url"), _text(r.source).alias("source"),
            _or_empty(r.tags, "array<string>").alias("tags")))
    return cve.select(
        _text("id", "Unknown").alias("cve_id"),
        _text(F.get(english, F.lit(0)).value).alias("description"),
        metric.baseScore.alias("cvss_score"),
        metric.baseSeverity.alias("cvss_severity"),
        metric.vectorString.alias("cvss_vector"),
        _or_empty(F.filter(weaknesses, lambda v: F.startswith(v, F.lit("CWE-"))), "array<string>").alias("cwe_ids"),
        _or_empty(references, "array<struct<url:string,source:string,tags:array<string>>>").alias("references"),
        F.substring(_text("published"), 1, DATE_CHARS).alias("published"),
    )


def flatten_osv(raw: DataFrame, json: str = "json") -> DataFrame:
    """One row per OSV record and affected package.

    A record without affected packages keeps one row with null package; ranges are those of
    the row's package.  ``affected_ranges`` is what a report shows; ``intervals`` and
    ``versions`` say what is affected: commit ranges are left out, and a package with neither
    ranges nor versions is affected as a whole (one open interval).
    """
    record = raw.select(F.explode(F.from_json(json, schemas.OSV_FEED).vulns).alias("v")).select("v.*")
    vectors = F.transform(F.filter("severity", lambda s: s.type == "CVSS_V3"), lambda s: _text(s.score))
    stated = F.upper(F.to_json("severity"))
    level = F.when(F.contains(stated, F.lit("CRITICAL")), "CRITICAL")
    for name in ("HIGH", "MEDIUM", "LOW"):
        level = level.when(F.contains(stated, F.lit(name)), name)

    def last_of(events: Column, field: str) -> Column:
        return F.aggregate(events, F.lit(None).cast("string"), lambda acc, e: F.coalesce(e.getField(field), acc))

    rows = record.select(
        _text("id").alias("vuln_id"),
        F.filter(_or_empty("aliases", "array<string>"), lambda a: F.startswith(a, F.lit("CVE-"))).alias("cve_ids"),
        _text("summary").alias("summary"),
        _text("details").alias("details"),
        level.otherwise(F.lit("UNKNOWN")).alias("severity"),
        F.get(vectors, F.size(vectors) - 1).alias("cvss_vector"),
        _or_empty(F.transform(
            "references",
            lambda r: F.struct(_text(r.type).alias("type"), _text(r.url).alias("url"))),
            "array<struct<type:string,url:string>>").alias("references"),
        _text("published").alias("published"), _text("modified").alias("modified"),
        "affected",
        F.explode_outer(F.array_distinct(F.transform("affected", lambda a: a.package))).alias("p"),
    )
    own = F.filter("affected", lambda a: a.package.eqNullSafe(F.col("p")))
    ranges = F.filter(
        F.transform(F.flatten(F.transform(own, lambda a: _or_empty(a.ranges, _RANGES))), lambda r: F.struct(
            last_of(r.events, "introduced").alias("introduced"), last_of(r.events, "fixed").alias("fixed"))),
        lambda r: r.introduced.isNotNull() | r.fixed.isNotNull())
    all_ranges = F.flatten(F.transform(own, lambda a: _or_empty(a.ranges, _RANGES)))
    versions = F.array_distinct(F.flatten(F.transform(own, lambda a: _or_empty(a.versions, "array<string>"))))
    stated = F.flatten(F.transform(F.filter(all_ranges, lambda r: F.coalesce(r.type, F.lit("")) != "GIT"),
                                   lambda r: _intervals(_or_empty(r.events, "array<struct<introduced:string,fixed:string,last_affected:string>>"))))
    empty = (F.size(all_ranges) == 0) & (F.size(versions) == 0)
    null = F.lit(None).cast("string")
    whole = F.array(F.struct(null.alias("introduced"), null.alias("fixed"), null.alias("last_affected")))
    return rows.select(
        "vuln_id", F.col("p.name").alias("package"), F.col("p.ecosystem").alias("ecosystem"),
        "cve_ids", "summary", "details", "severity", "cvss_vector",
        _or_empty(ranges, "array<struct<introduced:string,fixed:string>>").alias("affected_ranges"),
        F.when(empty, whole).otherwise(_or_empty(stated, INTERVALS)).alias("intervals"), _or_empty(versions, "array<string>").alias("versions"),
        "references", "published", "modified",
    )


def flatten_kev(raw: DataFrame, json: str = "json") -> DataFrame:
    """One row per entry of the known-exploited catalogue."""
    entry = raw.select(F.explode(F.from_json(json, schemas.KEV_FEED).vulnerabilities).alias("v")).select("v.*")
    return entry.select(
        _text("cveID").alias("cve_id"), _text("vendorProject").alias("vendor"), _text("product").alias("product"),
        _text("vulnerabilityName").alias("name"), _text("shortDescription").alias("description"),
        _text("dateAdded").alias("date_added"), _text("dueDate").alias("due_date"),
        _text("requiredAction").alias("required_action"),
        _text("knownRansomwareCampaignUse", "Unknown").alias("known_ransomware"), _text("notes").alias("notes"),
    )


def flatten_repos(raw: DataFrame, json: str = "json") -> DataFrame:
    """One row per repository metadata document."""
    zero = F.lit(0).cast("long")
    return raw.select(F.from_json(json, schemas.REPO_RECORD).alias("r")).select("r.*").select(
        _text("full_name").alias("full_name"), _text("description").alias("description"),
        _text("language").alias("language"), _text("default_branch", "main").alias("default_branch"),
        F.coalesce("stargazers_count", zero).alias("stars"), F.coalesce("forks_count", zero).alias("forks"),
        F.coalesce("open_issues_count", zero).alias("open_issues"),
        _text("created_at").alias("created_at"), _text("updated_at").alias("updated_at"),
        _text(F.col("license.spdx_id"), "Unknown").alias("license"),
        _or_empty("topics", "array<string>").alias("topics"),
        _text("visibility", "public").alias("visibility"),
        F.coalesce("archived", F.lit(False)).alias("archived"),
        _text("clone_url").alias("clone_url"), _text("html_url").alias("html_url"),
    )


def flatten_advisories(raw: DataFrame, json: str = "json", repo: str = "repo") -> DataFrame:
    """One row per advisory; ``vulnerabilities`` stays an array of packages."""
    packages = F.transform("a.vulnerabilities", lambda v: F.struct(
        _text(v.package.getField("name")).alias("package"), _text(v.package.ecosystem).alias("ecosystem"),
        _text(v.vulnerable_version_range).alias("vulnerable_range"), _text(v.patched_versions).alias("patched_version")))
    kind = "array<struct<package:string,ecosystem:string,vulnerable_range:string,patched_version:string>>"
    return raw.select(repo, F.explode(F.from_json(json, schemas.ADVISORY_FEED)).alias("a")).select(
        repo, _text("a.ghsa_id").alias("ghsa_id"), _text("a.cve_id").alias("cve_id"),
        _text("a.summary").alias("summary"), _text("a.severity").alias("severity"), _text("a.state").alias("state"),
        _text("a.published_at").alias("published_at"), _or_empty(packages, kind).alias("vulnerabilities"),
    )
