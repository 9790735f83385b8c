"""Vulnerability intelligence: look-ups, joins with findings and dependencies, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vulnsieve.functions.urls import version_key
from vulnsieve.operators.prefix import alike, first_intervals, first_rows, interval_join, running_sums
from vulnsieve.scratch import written
from vulnsieve.sources.store import has_id


def top_n(df: DataFrame, n: int, order: list[Column], per: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows in an order, overall or per key (``first_rows``)."""
    return df.orderBy(*order).limit(n) if per is None else first_rows(df, per, order, n)


def _newest() -> list[Column]:
    return [F.col("published").desc(), F.col("cve_id")]


# ── CVE look-ups ────────────────────────────────────────────────────────────

def search_cve_keyword(cve: DataFrame, keyword: str, severity: str | None = None, n: int = 10) -> DataFrame:
    """CVEs whose description or id holds every word of the keyword."""
    text = F.lower(F.concat_ws(" ", "cve_id", "description"))
    for word in keyword.lower().split():
        cve = cve.filter(F.contains(text, F.lit(word)))
    if severity:
        cve = cve.filter(F.col("cvss_severity") == severity.upper())
    return top_n(cve, n, _newest())


def search_cve_cwe(cve: DataFrame, cwe: str, n: int = 10) -> DataFrame:
    cwe = "CWE-" + cwe.replace("CWE-", "")
    return top_n(cve.filter(F.array_contains("cwe_ids", cwe)), n, _newest())


def get_cve(cve: DataFrame, *cve_ids: str) -> DataFrame:
    """The newest record of each of the named CVEs; from a stored feed only row groups that can hold one."""
    return top_n(cve.filter(has_id("cve_id", cve_ids)), 1, _newest(), per=["cve_id"])


def recent_cve(cve: DataFrame, days: int, as_of: str, severity: str | None = None, n: int = 20) -> DataFrame:
    """CVEs published in the last ``days`` days before and on ``as_of`` (an ISO date)."""
    day = F.lit(as_of).cast("date")
    found = cve.filter(F.col("published").between(F.date_sub(day, days).cast("string"), day.cast("string")))
    if severity:
        found = found.filter(F.col("cvss_severity") == severity.upper())
    return top_n(found, n, _newest())


def cve_search(cve: DataFrame, query: str, by_cwe: bool = False, n: int = 10) -> DataFrame:
    """By CWE when asked to, by id for ``CVE-`` queries, else by keyword."""
    if by_cwe:
        return search_cve_cwe(cve, query, n)
    if query.upper().startswith("CVE-"):
        return get_cve(cve, query.upper())
    return search_cve_keyword(cve, query, n=n)


# ── KEV look-ups ────────────────────────────────────────────────────────────

def search_kev(kev: DataFrame, keyword: str) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "vendor", "product", "name", "description", "cve_id"))
    return kev.filter(F.contains(text, F.lit(keyword.lower())))


def _added_since(days: int, as_of: str) -> Column:
    return F.col("date_added") >= F.date_sub(F.lit(as_of).cast("date"), days).cast("string")


def recent_kev(kev: DataFrame, days: int, as_of: str) -> DataFrame:
    return kev.filter(_added_since(days, as_of))


def kev_lookup(kev: DataFrame, *cve_ids: str) -> DataFrame:
    """The first catalogue entry of each of the named CVEs, whatever their case.

    A catalogue prepared by ``with_kev_id`` and stored is read where its row groups can hold one.
    """
    keyed = kev if KEV_ID in kev.columns else with_kev_id(kev)
    found = keyed.filter(has_id(KEV_ID, [c.upper() for c in cve_ids]))
    return top_n(found, 1, [F.col("date_added"), F.col("cve_id")], per=[KEV_ID]).drop(KEV_ID)


KEV_ID = "kev_id"


def with_kev_id(kev: DataFrame) -> DataFrame:
    """The catalogue with its ids in upper case as a column of their own, to be stored by."""
    return kev.withColumn(KEV_ID, F.upper("cve_id"))


def kev_stats(kev: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return kev.agg(
        F.count("*").alias("total_known_exploited"),
        F.count_if(_added_since(days, as_of)).alias("added_recently"),
        F.count_if(F.lower("known_ransomware") == "known").alias("ransomware_associated"),
    )


def threat_report(kev: DataFrame, as_of: str, days: int = 30, n: int = 5) -> DataFrame:
    """The newest entries with the catalogue totals beside each; the totals alone if none is new."""
    rows = top_n(recent_kev(kev, days, as_of), n, [F.col("date_added").desc(), F.col("cve_id")]).select(
        "cve_id", F.concat_ws("/", "vendor", "product").alias("vendor_product"),
        F.substring("description", 1, 70).alias("summary"), "date_added")
    # one row of totals beside the few newest ones
    return kev_stats(kev, as_of, days).join(F.broadcast(rows), F.lit(True), "left").select(
        *rows.columns, "total_known_exploited", "added_recently", "ransomware_associated")


# ── other look-ups ──────────────────────────────────────────────────────────

def ecosystem_vulns(osv: DataFrame, ecosystem: str, n: int = 20) -> DataFrame:
    found = osv.filter(F.col("ecosystem") == ecosystem).select(
        "vuln_id", "summary", F.concat_ws(",", "cve_ids").alias("aliases"), "published", "modified", "ecosystem")
    return top_n(found.distinct(), n, [F.col("modified").desc(), F.col("vuln_id")])


def search_repos(repos: DataFrame, query: str, language: str | None = None, sort: str = "stars", n: int = 10) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "full_name", "description"))
    for word in query.lower().split():
        repos = repos.filter(F.contains(text, F.lit(word)))
    if language:
        repos = repos.filter(F.lower("language") == language.lower())
    key = {"stars": "stars", "forks": "forks", "updated": "updated_at"}[sort]
    return top_n(repos, n, [F.col(key).desc(), F.col("full_name")]).select(
        "full_name", F.substring("description", 1, 200).alias("description"), "language", "stars",
        F.col("html_url").alias("url"))


# ── findings with CVEs and KEV ──────────────────────────────────────────────

def cve_context(cve: DataFrame, classes: DataFrame, k: int = 3) -> DataFrame:
    """Per CWE of a vulnerability class its ``k`` newest CVEs: at most one row per class."""
    cwes = classes.select("cwe_id").filter(F.startswith("cwe_id", F.lit("CWE-"))).distinct()
    per_cwe = cve.select("cve_id", "description", "cvss_score", "published",
                         F.explode(F.array_distinct("cwe_ids")).alias("cwe_id"))
    newest = Window.partitionBy("cwe_id").orderBy(*_newest())
    ranked = per_cwe.join(F.broadcast(cwes), "cwe_id", "left_semi").withColumn(
        "rank", F.row_number().over(newest)).filter(F.col("rank") <= k)
    rows = F.sort_array(F.collect_list(F.struct("rank", "cve_id", "description", "cvss_score", "published")))
    return ranked.groupBy("cwe_id").agg(rows.alias("_rows")).select(
        "cwe_id",
        F.transform("_rows", lambda r: F.struct(r.cve_id, r.description, r.cvss_score, r.published)).alias("related_cves"),
        F.size("_rows").alias("total_known_cves"))


def enrich_cve(
    findings: DataFrame, cve: DataFrame, classes: DataFrame, k: int = 3, as_of: str = "", context: DataFrame | None = None,
) -> DataFrame:
    """Adds ``related_cves``, ``total_known_cves``, ``data_source`` and ``lookup_time``."""
    context = cve_context(cve, classes, k) if context is None else context
    context = F.broadcast(context.select("cwe_id", "related_cves", "total_known_cves"))  # at most one row per class
    kind = "array<struct<cve_id:string,description:string,cvss_score:double,published:string>>"
    return findings.join(context, "cwe_id", "left").withColumns({
        "related_cves": F.coalesce("related_cves", F.array().cast(kind)),
        "total_known_cves": F.coalesce("total_known_cves", F.lit(0)),
        "data_source": F.lit("NIST NVD"),
        "lookup_time": F.lit(as_of),
    })


def _kev_hits(lists: DataFrame, kev: DataFrame) -> DataFrame:
    """``_ids, _hit``: per comma-joined list of CVE ids the first one in the catalogue."""
    wanted = lists.select("_ids", F.posexplode(F.split("_ids", ",")).alias("pos", "kev_id"))
    known = kev.filter(F.col("cve_id") != "").select(
        F.upper("cve_id").alias("kev_id"), F.struct("vendor", "product", "date_added", "known_ransomware").alias("kev_match"))
    return wanted.join(known, "kev_id").groupBy("_ids").agg(
        F.min_by(F.struct("kev_id", "kev_match"), F.struct("pos", "kev_match")).alias("_hit"))


def _related_ids() -> Column:
    return F.concat_ws(",", F.transform("related_cves", lambda c: F.upper(c.cve_id)))


def enrich_kev(findings: DataFrame, kev: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """Findings with a related CVE in the known-exploited catalogue become critical.

    The look-up runs per list of related CVEs, not per finding.  ``context`` (see
    ``cve_context``) holds those lists already, at most one per class: with it the
    findings are neither read twice nor shuffled.  Without it the lists are the
    distinct ones of the findings, and the joins carry no hint, so that measured
    sizes decide.
    """
    keyed = findings.withColumn("_ids", _related_ids())
    if context is None:
        first = _kev_hits(keyed.select("_ids").filter(F.col("_ids") != "").distinct(), kev)
    else:
        first = F.broadcast(_kev_hits(context.select(_related_ids().alias("_ids")).distinct(), kev))
    hit = F.col("_hit").isNotNull()
    warning = F.concat(
        F.lit("[ACTIVELY EXPLOITED] "), F.col("message"), F.lit(" — This vulnerability pattern matches "),
        F.col("_hit.kev_id"), F.lit(", which is in the CISA Known Exploited Vulnerabilities catalog."))
    return keyed.join(first, "_ids", "left").withColumns({
        "severity": F.when(hit, F.lit("critical")).otherwise(F.col("severity")),
        "message": F.when(hit, warning).otherwise(F.col("message")),
        "kev_id": F.col("_hit.kev_id"),
        "kev_match": F.col("_hit.kev_match"),
    }).drop("_ids", "_hit")


def enrich_findings(findings: DataFrame, cve: DataFrame, kev: DataFrame, classes: DataFrame, k: int = 3, as_of: str = "") -> DataFrame:
    """CVE and KEV context in one pass over the findings: two broadcast joins of at most one row per class."""
    context = cve_context(cve, classes, k)
    return enrich_kev(enrich_cve(findings, cve, classes, k, as_of, context), kev, context)


# ── dependencies with OSV ───────────────────────────────────────────────────

BELOW_ALL, ABOVE_ALL = "", "~"  # bounds of version keys


def interval_keys(osv: DataFrame) -> Column:
    """``array<struct<low, high>>`` of version keys, low inclusive, high exclusive.

    From ``intervals`` (see ``flatten_osv``); a table without them states its intervals as
    ``affected_ranges``, none meaning every version.
    """
    if "intervals" not in osv.columns:
        ranges = F.transform("affected_ranges", lambda r: F.struct(
            F.coalesce(version_key(r.introduced), F.lit(BELOW_ALL)).alias("low"),
            F.coalesce(version_key(r.fixed), F.lit(ABOVE_ALL)).alias("high")))
        return F.when(F.size("affected_ranges") > 0, ranges).otherwise(
            F.array(F.struct(F.lit(BELOW_ALL).alias("low"), F.lit(ABOVE_ALL).alias("high"))))
    return F.transform("intervals", lambda r: F.struct(
        F.when(r.introduced == "0", F.lit(BELOW_ALL)).otherwise(F.coalesce(version_key(r.introduced), F.lit(BELOW_ALL))).alias("low"),
        # the least text above a key: includes the key itself
        F.coalesce(version_key(r.fixed), F.concat(version_key(r.last_affected), F.lit("\0")), F.lit(ABOVE_ALL)).alias("high")))


def listed_keys(osv: DataFrame) -> Column:
    """Keys of the versions a record lists one by one."""
    if "versions" not in osv.columns:
        return F.array().cast("array<string>")
    return F.transform("versions", version_key)


NO_VERSION = "\0"  # stands for a missing version in join keys
PACKAGE, EXACT = ["ecosystem", "name"], ["ecosystem", "name", "_version"]
VULNERABILITY = ["vuln_id", "summary", "severity", "cve_ids", "affected_ranges"]


def _exact(deps: DataFrame) -> DataFrame:
    return deps.withColumn("_version", F.coalesce("version", F.lit(NO_VERSION)))


def _affected_intervals(osv: DataFrame) -> Column:
    """Disjoint intervals of version keys a record affects; a listed version is an interval of its own."""
    point = F.transform(listed_keys(osv), lambda k: F.struct(k.alias("low"), F.concat(k, F.lit("\0")).alias("high")))
    return _disjoint(F.concat(interval_keys(osv), point))


def _records(osv: DataFrame) -> DataFrame:
    """Records of a package, written, with the version keys they affect and a number of their own."""
    return written(osv.filter(F.col("package").isNotNull()).select(
        "ecosystem", F.col("package").alias("name"), *VULNERABILITY, _affected_intervals(osv).alias("_keys"),
        F.monotonically_increasing_id().alias("_record")), "records")


def affected_classes(deps: DataFrame, records: DataFrame, first: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``ecosystem, name, _version, _class`` of each distinct version, and ``ecosystem, name, _class, _record``.

    A class is the versions of a package that the same records affect (``alike``), so records are matched once
    for all of them.  With ``first`` a class has only the first so many records by their id.

    Popular packages occur in very many projects, so versions are made distinct first (a
    partial aggregate).  Versions and bounds become comparable keys, which ``interval_join``
    sweeps: only versions inside an interval are paired with its record.  The intervals of a
    record are disjoint, so a pair is found once.  A dependency without a version is affected
    by every record of its package.  With ``first`` no other pairs are built (``first_intervals``).
    """
    versions = written(_exact(deps).select(*EXACT).distinct().withColumn(
        "_key", F.when(F.col("_version") != NO_VERSION, version_key(F.col("_version")))), "versions")
    bounds = records.select(*PACKAGE, "_record", "vuln_id", F.explode("_keys").alias("r")).select(
        *PACKAGE, "_record", "vuln_id", F.col("r.low").alias("_low"), F.col("r.high").alias("_high"))
    like = written(alike(versions, bounds, PACKAGE, "_key", "_low", "_high"), "alike")
    known, unknown = versions.join(like, [*PACKAGE, "_key"]), versions.filter("_key IS NULL")
    places, every, order = like.select(*PACKAGE, "_like").distinct(), records.select(*PACKAGE, "_record", "vuln_id"), [F.col("vuln_id"), F.col("_record")]
    if first is None:
        swept = interval_join(places, bounds, PACKAGE, "_like", "_low", "_high")
    else:
        swept, every = first_intervals(places, bounds, PACKAGE, "_like", "_low", "_high", order, first), top_n(every, first, order, per=PACKAGE)
    whole = every.join(unknown.select(*PACKAGE).distinct(), PACKAGE)
    named, found = F.col("_like").alias("_class"), [*PACKAGE, "_class", "_record"]
    nothing = F.lit(NO_VERSION).alias("_class")
    return (written(known.select(*EXACT, named).unionByName(unknown.select(*EXACT, nothing)), "classes"),
            written(swept.select(*PACKAGE, named, "_record").select(*found).unionByName(whole.select(*PACKAGE, nothing, "_record")), "affected"))


#: So many packages are told to every task.
FEW_PACKAGES = 10_000


def _few_packages(df: DataFrame) -> DataFrame | None:
    """The packages of a table for a broadcast, if they are few; elsewhere a join by package costs more than it saves."""
    packages = written(df.select(*PACKAGE).distinct(), "packages")
    return F.broadcast(packages) if packages.count() <= FEW_PACKAGES else None


def match_osv(deps: DataFrame, osv: DataFrame, first: int | None = None) -> DataFrame:
    """One row per dependency and vulnerability that affects its version.

    With ``first`` only the first so many vulnerabilities of a version by their id: all that a list of the
    first so many of a project can hold (see ``first_vulns``).

    Where versions have few records each, the pairs of version and record are joined back to the dependencies:
    every pair met is a row of the result, and adaptive execution cuts versions with very many dependents.
    Where they have many, pairs are far more than either side, and no pair is shuffled (``_tiled``).
    """
    records = _records(osv)
    if (packages := _few_packages(records)) is not None:
        deps = deps.join(packages, PACKAGE, "left_semi")
    rows = _exact(deps.select("project", *PACKAGE, "version"))
    versions, affected = affected_classes(deps, records, first)
    sizes = written(affected.groupBy(*CLASS).agg(F.count("*").alias("_records")), "sizes")
    of_version = versions.join(sizes, CLASS).agg(F.sum("_records").alias("pairs")).first()["pairs"] or 0
    if of_version <= FEW_RECORDS * versions.count():
        pairs = versions.join(affected, CLASS).join(records.select("_record", *VULNERABILITY), "_record")
        matched = pairs.join(rows, EXACT)
    else:
        held = written(rows.join(versions, EXACT).drop("_version"), "held")
        matched = _tiled(held, affected.join(records.select("_record", *VULNERABILITY), "_record"), sizes)
    return matched.select(
        "project", "name", F.coalesce("version", F.lit("unknown")).alias("package_version"), "ecosystem", *VULNERABILITY)


CLASS = ["ecosystem", "name", "_class"]
#: So many records of a version on average are few.
FEW_RECORDS = 4
#: Dependencies, and records, of a class that meet in one tile; pairs that one task makes.
TILE, PAIRS_A_TASK = 500, 1_000_000


def _tiled(held: DataFrame, found: DataFrame, sizes: DataFrame) -> DataFrame:
    """Dependencies of each class with all its records, in tiles of ``TILE`` by ``TILE`` pairs or so.

    Every dependency goes to one row of tiles and every record to one column, so a side is repeated once for
    ``TILE`` of the other and pairs are made where they are used, however crowded a class is.  Tiles are
    dealt to tasks by the number of pairs; a dependency's records come in order of their id.
    """
    counted = written(held.groupBy(*CLASS).agg(F.count("*").alias("_deps")).join(sizes, CLASS).select(
        *CLASS, (F.col("_deps") * F.col("_records")).alias("_pairs"), F.ceil(F.col("_deps") / TILE).alias("_rows"),
        F.ceil(F.col("_records") / TILE).alias("_columns")), "tiles")
    pairs = counted.agg(F.sum("_pairs").alias("pairs")).first()["pairs"] or 0
    tasks = max(2 * held.sparkSession.sparkContext.defaultParallelism, -(-pairs // PAIRS_A_TASK))
    tile = [*CLASS, "_row", "_column"]
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    deps = held.join(counted, CLASS).withColumns({
        "_row": F.pmod(F.xxhash64("project", "version"), F.col("_rows")), "_column": every("_columns")})
    vulns = found.join(counted, CLASS).withColumns({"_row": every("_rows"), "_column": F.pmod(F.xxhash64("_record"), F.col("_columns"))})
    left = deps.select(*tile, "project", "version").repartition(tasks, *tile)
    right = vulns.select(*tile, *VULNERABILITY).repartition(tasks, *tile).sortWithinPartitions(*tile, "vuln_id")
    return left.join(right.hint("merge"), tile)


def _disjoint(keys: Column) -> Column:
    """Intervals of one record, overlapping and touching ones merged: a version lies in one at most."""
    kind = "array<struct<low:string,high:string>>"

    def step(out, r):
        last = F.get(out, F.size(out) - 1)
        joined = F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))),
                          F.array(F.struct(last.low.alias("low"), F.greatest(last.high, r.high).alias("high"))))
        return F.when((F.size(out) > 0) & (r.low <= last.high), joined).otherwise(F.concat(out, F.array(r)))

    return F.aggregate(F.array_sort(F.filter(keys, lambda r: r.low < r.high)), F.array().cast(kind), step)


def version_counts(deps: DataFrame, osv: DataFrame) -> DataFrame:
    """``ecosystem, name, _version, _count``: records that affect each distinct version, if any.

    No pair of version and record is built.  Every record gives +1 and -1 at the bounds of its
    intervals, summed per bound; a running sum in key order (``running_sums``) gives the count
    at each version.  A dependency without a version is affected by every record of its package.
    Most dependencies are of packages without any record: those are left out before versions are
    told apart.
    """
    vulns = osv.filter(F.col("package").isNotNull()).select(
        "ecosystem", F.col("package").alias("name"), _affected_intervals(osv).alias("r"))
    every = written(vulns.groupBy(*PACKAGE).agg(F.count("*").alias("_count")), "packages")
    ends = F.flatten(F.transform("r", lambda r: F.array(
        F.struct(r.low.alias("_key"), F.lit(1).alias("delta")), F.struct(r.high.alias("_key"), F.lit(-1).alias("delta")))))
    deltas = vulns.select(*PACKAGE, F.explode(ends).alias("e")).select(*PACKAGE, "e.*").filter(
        F.col("_key") != ABOVE_ALL).groupBy(*PACKAGE, "_key").agg(F.sum("delta").alias("delta"))
    # written, as the packages are, so that their sizes are known where they are joined
    versions = written(_exact(deps).select(*EXACT).join(every.select(*PACKAGE), PACKAGE, "left_semi").distinct(), "versions")
    none = F.col("_version") == NO_VERSION
    line = deltas.select(*PACKAGE, "_key", "delta", F.lit(None).cast("string").alias("_version")).unionByName(
        versions.filter(~none).select(*PACKAGE, version_key(F.col("_version")).alias("_key"),
                                      F.lit(0).cast("long").alias("delta"), "_version"))
    # the bounds at a version's key come before it
    swept = running_sums(line, PACKAGE, [F.col("_key"), F.col("_version").asc_nulls_first()], {"_count": "delta"})
    counted = swept.filter(F.col("_version").isNotNull()).select(*EXACT, "_count")
    return counted.unionByName(versions.filter(none).join(every, PACKAGE).select(*EXACT, "_count")).filter("_count > 0")


def annotate_deps(deps: DataFrame, osv: DataFrame) -> DataFrame:
    """Every dependency with its number of vulnerabilities, counted once per distinct version."""
    counts = written(version_counts(deps, osv), "counts")  # few beside the dependencies: joined by their true size
    marked = _exact(deps).join(counts, EXACT, "left")
    if (packages := _few_packages(counts)) is not None:  # dependencies of other packages meet no count
        met = _exact(deps.join(packages, PACKAGE, "left_semi")).join(counts, EXACT, "left")
        marked = met.unionByName(_exact(deps.join(packages, PACKAGE, "left_anti")).withColumn("_count", F.lit(None).cast("long")))
    return marked.select(
        *deps.columns, F.coalesce("_count", F.lit(0).cast("long")).alias("n_vulnerabilities"),
    ).withColumn("is_vulnerable", F.col("n_vulnerabilities") > 0)


def dep_summary(manifests: DataFrame, annotated: DataFrame) -> DataFrame:
    """Per project: manifests found, distinct dependencies, vulnerable ones."""
    files = manifests.groupBy("project").agg(F.count("*").alias("files_found"))
    deps = annotated.groupBy("project").agg(
        F.count("*").alias("total_dependencies"), F.count_if(F.col("is_vulnerable")).alias("vulnerable_dependencies"))
    zero = F.lit(0).cast("long")
    return files.join(deps, "project", "left").select(
        "project", "files_found", F.coalesce("total_dependencies", zero).alias("total_dependencies"),
        F.coalesce("vulnerable_dependencies", zero).alias("vulnerable_dependencies"))


def dep_report(vulns: DataFrame) -> DataFrame:
    """Report rows: severity, package@version, summary, CVEs, the fix of the first range."""
    first = F.get("affected_ranges", F.lit(0))
    fix = F.when(F.size("affected_ranges") > 0, F.coalesce(first.fixed, F.lit("No fix available")))
    return vulns.select(
        "project", "severity", F.concat("name", F.lit("@"), "package_version").alias("package"), "ecosystem",
        "vuln_id", F.substring("summary", 1, 80).alias("summary"),
        F.concat_ws(", ", "cve_ids").alias("cves"), fix.alias("fix"))


# ── repositories ────────────────────────────────────────────────────────────

def first_vulns(vulns: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` dependency vulnerabilities of every project (a report's cut)."""
    return top_n(vulns, n, [F.col("name"), F.col("vuln_id")], per=["project"])


def _listed(rows: DataFrame, key: str, order: list[str], columns: dict[str, str], name: str) -> DataFrame:
    """One row per key with its rows as an ordered array of structs."""
    row = F.struct(F.struct(*order).alias("_order"), F.struct(*[F.col(c).alias(n) for n, c in columns.items()]).alias("_row"))
    return rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["_row"]).alias(name))


def combine_repo(
    repos: DataFrame, file_counts: DataFrame, dep_totals: DataFrame, advisories: DataFrame, vulns: DataFrame | None = None, n: int = 20,
) -> DataFrame:
    """Per repository: code findings, files, dependency totals and advisories.

    ``file_counts``: ``repo, n``; ``dep_totals``: ``project, …``; every input is reduced to one row per
    repository before the joins.  With ``vulns`` (see ``match_osv``) two lists come along: the first ``n``
    ``vulnerabilities`` by package and id, of which every task hands on ``n`` a repository at most, and
    all advisories as ``advisory_list``, by id.
    """
    code = file_counts.groupBy("repo").agg(
        F.sum("n").alias("code_findings"), F.count("*").alias("files_scanned"))
    known = advisories.groupBy("repo").agg(F.count("*").alias("advisories"))
    totals = dep_totals.select(
        F.col("project").alias("repo"), "total_dependencies",
        F.col("vulnerable_dependencies").alias("dep_vulnerabilities"))
    zero = F.lit(0).cast("long")
    parts, lists = [code, totals, known], []
    if vulns is not None:
        first = first_vulns(vulns, n).select(F.col("project").alias("repo"), "name", "package_version", "vuln_id", "severity", "summary")
        parts += [
            _listed(first, "repo", ["name", "vuln_id"], {"package": "name", "version": "package_version", "vuln_id": "vuln_id",
                                                         "severity": "severity", "summary": "summary"}, "vulnerabilities"),
            _listed(advisories, "repo", ["ghsa_id"], {c: c for c in ("ghsa_id", "cve_id", "severity", "summary")}, "advisory_list")]
        lists = [F.coalesce(c, F.array()).alias(c) for c in ("vulnerabilities", "advisory_list")]
    joined = repos.select(F.col("full_name").alias("repo"), "stars", "language")
    for part in parts:
        joined = joined.join(part, "repo", "left")
    counts = ["code_findings", "dep_vulnerabilities", "advisories", "files_scanned", "total_dependencies"]
    return joined.select("repo", "stars", "language", *[F.coalesce(c, zero).alias(c) for c in counts], *lists)


def repo_summary(combined: DataFrame) -> DataFrame:
    return combined.select("repo", "code_findings", "dep_vulnerabilities", "advisories", "files_scanned")
