"""Registered queries: manifests, feeds, look-ups, enrichment, repositories."""

from __future__ import annotations

from pyspark.sql import functions as F

from vulnsieve.catalog.patterns import MANIFEST_FILES
from vulnsieve.operators import file_scan as fs, intel, manifests as man
from vulnsieve.plans.deps import scan_dependencies
from vulnsieve.plans.repos import scan_repositories
from vulnsieve.plans.scan import scan, scan_by_file
from vulnsieve.sources import feeds
from vulnsieve.sources.dimensions import vuln_classes
from vulnsieve.sources.store import store_feed

from workloads import base as B
from workloads import checksql as S
from workloads.base import AS_OF, lit, query
from workloads.scanning import _SCANNED

# ── manifests ───────────────────────────────────────────────────────────────
# Check SQL: lines with numbers, section state by a window over the lines.

_WS = r"[ \t\r\x0B\f]"
_LINES = f"""numbered AS (
  SELECT project, path, file_name, unnest(string_split(content, chr(10))) AS raw,
    unnest(range(0, len(string_split(content, chr(10))))) AS line_no FROM manifests),
lines AS (SELECT * EXCLUDE raw, regexp_replace(raw, '^{_WS}+|{_WS}+$', '', 'g') AS line FROM numbered)"""


def _state(open_when: str, close_when: str) -> str:
    """SQL for whether a line is inside a section, by the last line that changed the state."""
    return (f"coalesce(last_value(CASE WHEN {open_when} THEN true WHEN {close_when} THEN false END IGNORE NULLS) OVER "
            "(PARTITION BY project, path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false)")


def _null(text: str) -> str:
    return f"nullif({text}, '')"


def _part(i: int) -> str:
    pos = "strpos(line, '=')"
    text = f"substr(line, 1, {pos} - 1)" if i == 1 else f"substr(line, {pos} + 1)"
    return f"regexp_replace({text}, '^{_WS}+|{_WS}+$', '', 'g')"


_REQ, _QREQ, _GEM = (lit(p) for p in (man.REQUIREMENT, man.QUOTED_REQUIREMENT, man.GEM))
_OPEN_PY = "contains(line, 'dependencies') AND contains(line, '=') AND contains(line, '[')"
_OPEN_CARGO = f"line IN ({', '.join(lit(x) for x in man.CARGO_SECTIONS)})"
_CARGO_BARE = f"trim({_part(2)}, '\"')"
_GO_LINE = f"regexp_replace(replace(line, 'require ', ''), '^{_WS}+|{_WS}+$', '', 'g')"
_GO_WORDS = f"string_split_regex({_GO_LINE}, '\\s+')"

# per format: state, condition, name, version
_FORMATS = {
    "requirements.txt": ("true", f"NOT starts_with(line, '-') AND regexp_matches(line, {_REQ})",
                         f"regexp_extract(line, {_REQ}, 1)", _null(f"regexp_extract(line, {_REQ}, 2)")),
    "Pipfile": (_state("line = '[packages]'", "starts_with(line, '[')"),
                "inside AND line <> '[packages]' AND contains(line, '=')", f"trim({_part(1)}, '\"')",
                _null(f"ltrim(trim({_part(2)}, '\"'), '*>=<~!')")),
    "pyproject.toml": (_state(_OPEN_PY, "starts_with(line, '[') AND NOT contains(line, 'dependencies')"),
                       f"inside AND NOT ({_OPEN_PY}) AND regexp_matches(line, {_QREQ})",
                       f"regexp_extract(line, {_QREQ}, 1)", _null(f"regexp_extract(line, {_QREQ}, 2)")),
    "go.mod": (_state("starts_with(line, 'require (')", "line = ')'"),
               "NOT starts_with(line, 'require (') AND (inside OR starts_with(line, 'require ')) AND "
               f"len({_GO_WORDS}) >= 2", f"({_GO_WORDS})[1]", f"ltrim(({_GO_WORDS})[2], 'v')"),
    "Cargo.toml": (_state(_OPEN_CARGO, "starts_with(line, '[') AND NOT contains(line, 'dependencies')"),
                   f"inside AND NOT ({_OPEN_CARGO}) AND contains(line, '=')", _part(1),
                   _null(f"CASE WHEN regexp_matches({_CARGO_BARE}, {lit(man.TABLE_VERSION)}) "
                         f"THEN regexp_extract({_CARGO_BARE}, {lit(man.TABLE_VERSION)}, 1) ELSE {_CARGO_BARE} END")),
    "Gemfile": ("true", f"regexp_matches(line, {_GEM})", f"regexp_extract(line, {_GEM}, 1)",
                f"CASE WHEN regexp_extract(line, {_GEM}, 2) <> '' THEN ltrim(regexp_extract(line, {_GEM}, 2), '~>=<! ') END"),
}
_JSON = {"package.json": ["dependencies", "devDependencies"], "composer.json": ["require", "require-dev"]}


def _format_sql(name: str) -> str:
    number, ecosystem = next((i, e) for i, (n, e) in enumerate(MANIFEST_FILES) if n == name)
    head = f"{lit(ecosystem)} AS ecosystem, {lit(name)} AS source"
    if name in _JSON:
        parts = []
        for i, section in enumerate(_JSON[name]):
            dep_type = lit(section) if name == "package.json" else "NULL::VARCHAR"
            keep = "true" if name == "package.json" else "name <> 'php' AND NOT starts_with(name, 'ext-')"
            parts.append(f"""SELECT project, name, nullif(regexp_replace(json_extract_string(o, '$."' || name || '"'), '[^0-9.]', '', 'g'), '') AS version,
  {head}, {dep_type} AS dep_type, path, {number} AS format_no, {i} * 1000 + k AS line_no
FROM (SELECT project, path, o, unnest(json_keys(o)) AS name, unnest(range(0, len(json_keys(o)))) AS k FROM (
  SELECT project, path, json_extract(CASE WHEN file_name = {lit(name)} AND json_valid(content) THEN content END, '$."{section}"') AS o
  FROM manifests) WHERE o IS NOT NULL) WHERE {keep}""")
        return "\nUNION ALL\n".join(parts)
    state, condition, dep_name, version = _FORMATS[name]
    return f"""SELECT project, {dep_name} AS name, {version} AS version, {head}, NULL::VARCHAR AS dep_type, path,
  {number} AS format_no, line_no FROM (SELECT *, {state} AS inside FROM lines WHERE file_name = {lit(name)}) WHERE {condition}"""


_MANIFEST_CTES = [B.MANIFESTS_SQL, _LINES]
_ALL_DEPS = "parsed AS (" + "\nUNION ALL\n".join(_format_sql(name) for name, _ in MANIFEST_FILES) + ")"
_DEP_COLUMNS = "project, name, version, ecosystem, source, dep_type, path"
_DISTINCT = """distinct_deps AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, name, ecosystem
  ORDER BY format_no, len(string_split(path, '/')), path, line_no) AS place FROM parsed) WHERE place = 1)"""

for _name, _ in MANIFEST_FILES:
    query("manifest_" + _name.replace(".", "_").lower(), S.with_ctes(
        *_MANIFEST_CTES, select=f"SELECT {_DEP_COLUMNS} FROM ({_format_sql(_name)})"),
    )(lambda spark, d, _name=_name: man.parse_manifests(B.manifests(spark, d), [_name]).drop("format_no", "line_no"))


@query("parse_manifests", S.with_ctes(*_MANIFEST_CTES, _ALL_DEPS, select=f"SELECT {_DEP_COLUMNS}, format_no FROM parsed"))
def parse_manifests(spark, d):
    return man.parse_manifests(B.manifests(spark, d)).drop("line_no")


@query("distinct_deps", S.with_ctes(*_MANIFEST_CTES, _ALL_DEPS, _DISTINCT, select=f"SELECT {_DEP_COLUMNS} FROM distinct_deps"))
def distinct_deps(spark, d):
    return man.distinct_deps(man.parse_manifests(B.manifests(spark, d))).drop("format_no", "line_no")


@query("first_per_key", """SELECT user_id, event_type, event_id, round(value, 6) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1""")
def first_per_key(spark, d):
    events = B.table(spark, d, "events").select("user_id", "event_type", "event_id", "value", (-F.col("value")).alias("less"))
    return man.first_per_key(events, ["user_id", "event_type"], ["less", "event_id"]).drop("less").withColumn(
        "value", F.round("value", 6))


@query("section_of_line", S.with_ctes(*_MANIFEST_CTES, select="""SELECT project, path, line_no, line, last_value(
  CASE WHEN starts_with(line, '[') THEN line END IGNORE NULLS) OVER (PARTITION BY project, path ORDER BY line_no
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM lines WHERE file_name IN ('Pipfile', 'Cargo.toml')"""))
def section_of_line(spark, d):
    rows = B.manifests(spark, d).filter(F.col("file_name").isin("Pipfile", "Cargo.toml")).select(
        "project", "path", F.posexplode(F.split("content", "\n", -1)).alias("line_no", "raw"))
    lines = rows.select("project", "path", F.col("line_no").cast("long").alias("line_no"),
                        F.btrim("raw", F.lit(man.BLANKS)).alias("line"))
    headed = lines.withColumn("header", F.when(F.startswith("line", F.lit("[")), F.col("line")))
    return man.section_of_line(headed, "header", ["project", "path"]).drop("header")


# ── feeds ───────────────────────────────────────────────────────────────────

def cve(spark, d):
    return feeds.flatten_cve(B.cve_raw(spark, d))


def kev(spark, d):
    return feeds.flatten_kev(B.kev_raw(spark, d))


def osv(spark, d):
    return feeds.flatten_osv(B.osv_raw(spark, d))


def repos(spark, d):
    return feeds.flatten_repos(B.repo_raw(spark, d))


def advisories(spark, d):
    return feeds.flatten_advisories(B.advisory_raw(spark, d))


_STORED: dict = {}


def stored(spark, d, name):
    """The flattened feed as a table in order of its ids, written once a session and input folder."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _STORED:
        _STORED[key] = store_feed(cve(spark, d), "cve_id") if name == "cve" else store_feed(
            intel.with_kev_id(kev(spark, d)), intel.KEV_ID)
    return _STORED[key]


_CVE_COLUMNS = "cve_id, description, round(cvss_score, 6) AS cvss_score, cvss_severity, cvss_vector, cwe_id AS cwe_ids, published"


def _cve_out(df):
    return df.select("cve_id", "description", F.round("cvss_score", 6).alias("cvss_score"), "cvss_severity", "cvss_vector",
                     F.concat_ws(",", "cwe_ids").alias("cwe_ids"), "published")


@query("flatten_cve", f"""WITH {B.CVE_SQL} SELECT {_CVE_COLUMNS},
  (SELECT string_agg('https://ref/' || o_orderkey || '/' || i || ' vendor Patch', ';' ORDER BY i) FROM range(1, 7) t(i)) AS refs FROM cve""")
def flatten_cve(spark, d):
    refs = F.transform("references", lambda r: F.concat_ws(" ", r.url, r.source, F.concat_ws(",", r.tags)))
    found = cve(spark, d).withColumn("refs", F.concat_ws(";", refs))
    return found.select("cve_id", "description", F.round("cvss_score", 6).alias("cvss_score"), "cvss_severity", "cvss_vector",
                        F.concat_ws(",", "cwe_ids").alias("cwe_ids"), "published", "refs")


@query("flatten_osv", f"""WITH {B.OSV_SQL} SELECT vuln_id, package, ecosystem, cve_ids, summary, details, severity, cvss_vector,
  coalesce((SELECT string_agg(low || '<' || coalesce(high, '') || '<' || coalesce(last, ''), ';' ORDER BY low) FROM intervals i
    WHERE i.vuln_id = osv.vuln_id), '') AS ranges,
  'WEB https://osv/' || p_partkey || '/1;WEB https://osv/' || p_partkey || '/2;WEB https://osv/' || p_partkey || '/3;WEB https://osv/' || p_partkey || '/4' AS refs,
  published, modified FROM osv""")
def flatten_osv(spark, d):
    ranges = F.transform("intervals", lambda r: F.concat_ws("<", F.coalesce(r.introduced, F.lit("0")), F.coalesce(r.fixed, F.lit("")),
                                                            F.coalesce(r.last_affected, F.lit(""))))
    refs = F.transform("references", lambda r: F.concat_ws(" ", r.type, r.url))
    return osv(spark, d).select(
        "vuln_id", "package", "ecosystem", F.concat_ws(",", "cve_ids").alias("cve_ids"), "summary", "details", "severity",
        "cvss_vector", F.concat_ws(";", ranges).alias("ranges"), F.concat_ws(";", refs).alias("refs"), "published", "modified")


_KEV_COLUMNS = "cve_id, vendor, product, name, description, date_added, due_date, required_action, known_ransomware, notes"


@query("flatten_kev", f"WITH {B.KEV_SQL} SELECT {_KEV_COLUMNS} FROM kev")
def flatten_kev(spark, d):
    return kev(spark, d)


@query("flatten_repos", f"""WITH {B.REPOS_SQL} SELECT * EXCLUDE (s_suppkey, s_nationkey) FROM repos""")
def flatten_repos(spark, d):
    return repos(spark, d).withColumn("topics", F.concat_ws(",", "topics"))


@query("flatten_advisories", f"WITH {B.ADVISORIES_SQL} SELECT * FROM advisories")
def flatten_advisories(spark, d):
    return advisories(spark, d).select(
        "repo", "ghsa_id", "cve_id", "summary", "severity", "state", "published_at", F.inline("vulnerabilities")
    ).withColumnRenamed("ecosystem", "package_ecosystem")


# ── look-ups ────────────────────────────────────────────────────────────────

#: Ids looked up: the first orders, in whatever year they were placed.
_IDS = [f"CVE-{year}-{order}" for year in range(1992, 1999) for order in range(15)]
_NEWEST = "ORDER BY published DESC, cve_id LIMIT"


@query("search_cve_keyword", f"""WITH {B.CVE_SQL} SELECT {_CVE_COLUMNS} FROM cve
WHERE contains(lower(cve_id || ' ' || description), 'urgent') AND contains(lower(cve_id || ' ' || description), 'customer 1')
  AND cvss_severity = 'CRITICAL' {_NEWEST} 40""")
def search_cve_keyword(spark, d):
    """Words are looked up one by one; the second one here is a prefix of many numbers."""
    found = cve(spark, d).filter(F.contains(F.lower("description"), F.lit("customer 1")))
    return _cve_out(intel.search_cve_keyword(found, "Urgent", "critical", 40))


@query("search_cve_cwe", f"WITH {B.CVE_SQL} SELECT {_CVE_COLUMNS} FROM cve WHERE cwe_id = 'CWE-79' {_NEWEST} 10")
def search_cve_cwe(spark, d):
    return _cve_out(intel.search_cve_cwe(cve(spark, d), "CWE-79"))


@query("get_cve", f"WITH {B.CVE_SQL} SELECT {_CVE_COLUMNS} FROM cve WHERE cve_id IN ({', '.join(map(lit, _IDS))})")
def get_cve(spark, d):
    """From the stored feed: parsed once, then looked up by id."""
    return _cve_out(intel.get_cve(stored(spark, d, "cve"), *_IDS))


@query("recent_cve", f"""WITH {B.CVE_SQL} SELECT {_CVE_COLUMNS} FROM cve WHERE published BETWEEN '1998-11-01' AND '1998-12-01'
  AND cvss_severity = 'HIGH' {_NEWEST} 20""")
def recent_cve(spark, d):
    return _cve_out(intel.recent_cve(cve(spark, d), 30, AS_OF, "high"))


@query("cve_search", f"""WITH {B.CVE_SQL}
SELECT * FROM (SELECT 'cwe' AS kind, {_CVE_COLUMNS} FROM cve WHERE cwe_id = 'CWE-22' {_NEWEST} 10)
UNION ALL SELECT * FROM (SELECT 'keyword', {_CVE_COLUMNS} FROM cve WHERE contains(lower(description), 'low') {_NEWEST} 10)
UNION ALL SELECT * FROM (SELECT 'id', {_CVE_COLUMNS} FROM cve WHERE cve_id = 'CVE-1997-1')""")
def cve_search(spark, d):
    feed = cve(spark, d)
    tagged = lambda kind, df: _cve_out(df).withColumn("kind", F.lit(kind))
    return tagged("cwe", intel.cve_search(feed, "CWE-22", by_cwe=True)).unionByName(
        tagged("keyword", intel.cve_search(feed, "LOW"))).unionByName(tagged("id", intel.cve_search(feed, "cve-1997-1")))


@query("search_kev", f"WITH {B.KEV_SQL} SELECT {_KEV_COLUMNS} FROM kev WHERE contains(lower(concat_ws(' ', vendor, product, name, "
                     "description, cve_id)), 'vendor3')")
def search_kev(spark, d):
    return intel.search_kev(kev(spark, d), "VENDOR3")


@query("recent_kev", f"WITH {B.KEV_SQL} SELECT {_KEV_COLUMNS} FROM kev WHERE date_added >= '1998-09-02'")
def recent_kev(spark, d):
    return intel.recent_kev(kev(spark, d), 90, AS_OF)


@query("kev_lookup", f"WITH {B.KEV_SQL} SELECT {_KEV_COLUMNS} FROM kev WHERE upper(cve_id) IN ({', '.join(map(lit, _IDS))})")
def kev_lookup(spark, d):
    return intel.kev_lookup(stored(spark, d, "kev"), *_IDS)


@query("kev_stats", f"""WITH {B.KEV_SQL} SELECT count(*) AS total_known_exploited,
  count(*) FILTER (date_added >= '1998-11-01') AS added_recently,
  count(*) FILTER (lower(known_ransomware) = 'known') AS ransomware_associated FROM kev""")
def kev_stats(spark, d):
    return intel.kev_stats(kev(spark, d), AS_OF)


@query("threat_report", f"""WITH {B.KEV_SQL}, t AS (SELECT count(*) AS total_known_exploited,
  count(*) FILTER (date_added >= '1998-11-01') AS added_recently,
  count(*) FILTER (lower(known_ransomware) = 'known') AS ransomware_associated FROM kev)
SELECT r.*, t.* FROM t LEFT JOIN (SELECT cve_id, vendor || '/' || product AS vendor_product, substr(description, 1, 70) AS summary, date_added
  FROM kev WHERE date_added >= '1998-11-01' ORDER BY date_added DESC, cve_id LIMIT 5) r ON true""")
def threat_report(spark, d):
    return intel.threat_report(kev(spark, d), AS_OF)


@query("ecosystem_vulns", f"""WITH {B.OSV_SQL} SELECT vuln_id, summary, cve_ids AS aliases, published, modified, ecosystem FROM osv
WHERE ecosystem = 'npm' ORDER BY modified DESC, vuln_id LIMIT 20""")
def ecosystem_vulns(spark, d):
    return intel.ecosystem_vulns(osv(spark, d), "npm")


@query("search_repos", f"""WITH {B.REPOS_SQL} SELECT full_name, substr(description, 1, 200) AS description, language, stars,
  html_url AS url FROM repos WHERE contains(lower(full_name || ' ' || description), 'tools') AND language = 'Go'
ORDER BY stars DESC, full_name LIMIT 100""")
def search_repos(spark, d):
    return intel.search_repos(repos(spark, d), "tools", "go", n=100)


@query("top_n", """SELECT user_id, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (
  PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 3""")
def top_n(spark, d):
    events = B.table(spark, d, "events").select("user_id", "event_id", "value")
    return intel.top_n(events, 3, [F.col("value").desc(), F.col("event_id")], per=["user_id"]).withColumn("value", F.round("value", 6))


# ── enrichment ──────────────────────────────────────────────────────────────

_CONTEXT = f"""top3 AS (SELECT * FROM (SELECT cwe_id, cve_id, row_number() OVER (PARTITION BY cwe_id ORDER BY published DESC, cve_id) AS r
  FROM cve) WHERE r <= 3),
context AS (SELECT cwe_id, string_agg(cve_id, ',' ORDER BY r) AS related, count(*)::INT AS total_known_cves FROM top3 GROUP BY 1),
exploited AS (SELECT cwe_id, arg_min(cve_id, r) AS kev_id FROM top3 WHERE cve_id IN (SELECT upper(cve_id) FROM kev) GROUP BY 1)"""


@query("enrich_cve", S.with_ctes(*_SCANNED, B.CVE_SQL, B.KEV_SQL, _CONTEXT, select="""SELECT file_id, line, vuln_class,
  coalesce(related, '') AS related, coalesce(total_known_cves, 0) AS total_known_cves, 'NIST NVD' AS data_source, '"""
  + AS_OF + "' AS lookup_time FROM scanned LEFT JOIN context USING (cwe_id)"))
def enrich_cve(spark, d):
    found = scan(B.code(spark, d))
    rows = intel.enrich_cve(found, cve(spark, d), vuln_classes(spark), as_of=AS_OF)
    return rows.select("file_id", "line", "vuln_class", F.concat_ws(",", "related_cves.cve_id").alias("related"),
                       "total_known_cves", "data_source", "lookup_time")


@query("enrich_kev", S.with_ctes(*_SCANNED, B.CVE_SQL, B.KEV_SQL, _CONTEXT, select="""SELECT file_id, line, vuln_class, kev_id,
  CASE WHEN kev_id IS NULL THEN severity ELSE 'critical' END AS severity,
  CASE WHEN kev_id IS NULL THEN message ELSE '[ACTIVELY EXPLOITED] ' || message || ' — This vulnerability pattern matches '
    || kev_id || ', which is in the CISA Known Exploited Vulnerabilities catalog.' END AS message
FROM scanned LEFT JOIN exploited USING (cwe_id)"""))
def enrich_kev(spark, d):
    found = scan(B.code(spark, d))
    rows = intel.enrich_findings(found, cve(spark, d), kev(spark, d), vuln_classes(spark))
    return rows.select("file_id", "line", "vuln_class", "kev_id", "severity", "message")


# ── dependencies with OSV ───────────────────────────────────────────────────

def _parts(version: str) -> str:
    """Eight numbers and whether the version is a release: lists that compare like versions."""
    digits = f"string_split(regexp_extract({version}, '[0-9]+([.][0-9]+)*'), '.')"
    numbers = f"list_transform((list_concat({digits}, ['0','0','0','0','0','0','0','0']))[1:8], lambda x: x::BIGINT)"
    return f"list_append({numbers}, CASE WHEN contains({version}, '-') THEN 0 ELSE 1 END)"


_MATCHED = f"""pairs AS (SELECT d.project, d.name, d.version, d.ecosystem, v.*  EXCLUDE (ecosystem)
  FROM deps d JOIN osv v ON d.ecosystem = v.ecosystem AND d.name = v.package),
hits AS (
  SELECT DISTINCT d.vuln_id, d.version FROM (SELECT DISTINCT vuln_id, version FROM pairs WHERE version IS NOT NULL) d
    JOIN intervals i ON i.vuln_id = d.vuln_id
  WHERE (i.low = '0' OR {_parts('d.version')} >= {_parts('i.low')}) AND (i.high IS NULL OR {_parts('d.version')} < {_parts('i.high')})
    AND (i.last IS NULL OR {_parts('d.version')} <= {_parts('i.last')})
  UNION SELECT vuln_id, version FROM listed),
matched AS (SELECT d.project, d.name, coalesce(d.version, 'unknown') AS package_version, d.ecosystem, d.vuln_id, d.summary,
  d.severity, d.cve_ids, d.has_range, d.kind, d.p_size, d.fixed
  FROM pairs d LEFT JOIN hits h ON h.vuln_id = d.vuln_id AND h.version = d.version WHERE d.version IS NULL OR h.vuln_id IS NOT NULL)"""
#: The fix a report shows: the last one of the first range, whatever its kind.
_FIX = """CASE WHEN NOT has_range OR kind = 4 THEN NULL WHEN kind = 0 AND p_size % 5 = 0 OR kind = 2 THEN 'No fix available'
  WHEN kind = 1 THEN '5.20.0' WHEN kind IN (3, 5) THEN '9f3c1e' ELSE fixed END"""
_OSV_CTES = [B.DEPS_SQL, B.OSV_SQL, _MATCHED]


@query("match_osv", S.with_ctes(*_OSV_CTES, select="SELECT project, name, package_version, ecosystem, vuln_id, summary, severity, cve_ids FROM matched"))
def match_osv(spark, d):
    rows = intel.match_osv(B.dependencies(spark, d), osv(spark, d))
    return rows.drop("affected_ranges").withColumn("cve_ids", F.concat_ws(",", "cve_ids"))


@query("dep_report", S.with_ctes(*_OSV_CTES, select=f"""SELECT project, severity, name || '@' || package_version AS package, ecosystem, vuln_id,
  substr(summary, 1, 80) AS summary, cve_ids AS cves, {_FIX} AS fix FROM matched"""))
def dep_report(spark, d):
    return intel.dep_report(intel.match_osv(B.dependencies(spark, d), osv(spark, d)))


_OSV_FROM_MANIFESTS = f"""osv_m AS (SELECT 'OSV-' || p_partkey AS vuln_id, p_partkey, p_size,
    ['flask', 'requests', 'left-pad', 'serde', 'rails', 'a/b'][p_partkey % 6 + 1] AS package,
    ['PyPI', 'PyPI', 'npm', 'crates.io', 'RubyGems', 'Packagist'][p_partkey % 6 + 1] AS ecosystem,
    (p_size % 4) || '.' || (p_partkey % 40) AS fixed FROM part)"""


def manifest_osv(spark, d):
    """Vulnerability rows per part for the packages the manifests name."""
    p = B.table(spark, d, "part")
    key = F.col("p_partkey")
    fixed = F.concat_ws(".", F.col("p_size") % 4, key % 40)
    return p.select(
        F.concat(F.lit("OSV-"), key).alias("vuln_id"),
        B._pick(["flask", "requests", "left-pad", "serde", "rails", "a/b"], key).alias("package"),
        B._pick(["PyPI", "PyPI", "npm", "crates.io", "RubyGems", "Packagist"], key).alias("ecosystem"),
        F.array().cast("array<string>").alias("cve_ids"), F.lit("s").alias("summary"), F.lit("HIGH").alias("severity"),
        F.array(F.struct(F.lit(None).cast("string").alias("introduced"), fixed.alias("fixed"))).alias("affected_ranges"))


_PROJECT_MATCH = f"""dep_hits AS (SELECT d.project, d.name, d.ecosystem, count(v.vuln_id) AS n FROM distinct_deps d LEFT JOIN osv_m v
  ON d.ecosystem = v.ecosystem AND d.name = v.package AND (d.version IS NULL OR {_parts('d.version')} < {_parts('v.fixed')})
  GROUP BY ALL),
dep_totals AS (SELECT m.project, m.files_found, count(h.name) AS total_dependencies,
  count(*) FILTER (h.n > 0) AS vulnerable_dependencies FROM (SELECT project, count(*) AS files_found FROM manifests GROUP BY 1) m
  LEFT JOIN dep_hits h USING (project) GROUP BY ALL),
dep_vulns AS (SELECT d.project, d.name, coalesce(d.version, 'unknown') AS package_version, v.vuln_id, 'HIGH' AS severity
  FROM distinct_deps d JOIN osv_m v ON d.ecosystem = v.ecosystem AND d.name = v.package
    AND (d.version IS NULL OR {_parts('d.version')} < {_parts('v.fixed')}))"""
_PROJECT_CTES = [*_MANIFEST_CTES, _ALL_DEPS, _DISTINCT, _OSV_FROM_MANIFESTS, _PROJECT_MATCH]


@query("dep_summary", S.with_ctes(*_PROJECT_CTES, select="SELECT * FROM dep_totals"))
def dep_summary(spark, d):
    return scan_dependencies(B.manifests(spark, d), manifest_osv(spark, d)).summary


@query("annotate_deps", S.with_ctes(*_PROJECT_CTES, select="SELECT project, name, ecosystem, n AS n_vulnerabilities, n > 0 AS is_vulnerable FROM dep_hits"))
def annotate_deps(spark, d):
    return scan_dependencies(B.manifests(spark, d), manifest_osv(spark, d)).dependencies.select(
        "project", "name", "ecosystem", "n_vulnerabilities", "is_vulnerable")


@query("first_vulns", S.with_ctes(*_OSV_CTES, select="""SELECT ecosystem, name, vuln_id FROM (SELECT *, row_number() OVER (
  PARTITION BY ecosystem ORDER BY name, vuln_id) AS r FROM (SELECT DISTINCT ecosystem, name, vuln_id FROM matched)) WHERE r <= 20"""))
def first_vulns(spark, d):
    rows = intel.match_osv(B.dependencies(spark, d), osv(spark, d)).select("ecosystem", "name", "vuln_id").distinct()
    return intel.first_vulns(rows.withColumnRenamed("ecosystem", "project")).withColumnRenamed("project", "ecosystem")


# ── repositories ────────────────────────────────────────────────────────────

_REPO_OF_FILE = "'org/Supplier#' || lpad((file_id % 100)::VARCHAR, 9, '0')"


_REPO_CTES = [*_SCANNED, *_PROJECT_CTES, B.REPOS_SQL, B.ADVISORIES_SQL, f"""
found_per_file AS (SELECT c.file_id, count(s.file_id) AS n FROM code c LEFT JOIN scanned s USING (file_id) GROUP BY 1),
repo_code AS (SELECT {_REPO_OF_FILE} AS repo, sum(n)::BIGINT AS code_findings, count(*) AS files_scanned FROM found_per_file GROUP BY 1),
repo_deps AS (SELECT 'org/Supplier#' || lpad(substr(project, 2), 9, '0') AS repo, * FROM dep_totals),
repo_adv AS (SELECT repo, count(*) AS advisories FROM advisories GROUP BY 1),
combined AS (SELECT full_name AS repo, stars, language, coalesce(code_findings, 0) AS code_findings,
  coalesce(vulnerable_dependencies, 0) AS dep_vulnerabilities, coalesce(advisories, 0) AS advisories,
  coalesce(files_scanned, 0) AS files_scanned, coalesce(total_dependencies, 0) AS total_dependencies
FROM repos LEFT JOIN repo_code ON repo_code.repo = full_name LEFT JOIN repo_deps ON repo_deps.repo = full_name
LEFT JOIN repo_adv ON repo_adv.repo = full_name)"""]


_REPO_DETAIL = """repo_vulns AS (SELECT 'org/Supplier#' || lpad(substr(project, 2), 9, '0') AS repo,
    string_agg(name || '@' || package_version || ' ' || vuln_id || ' ' || severity, ',' ORDER BY name, vuln_id) AS vulnerabilities
  FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY name, vuln_id) AS r FROM dep_vulns) WHERE r <= 20 GROUP BY 1),
repo_advs AS (SELECT repo, string_agg(ghsa_id || ' ' || cve_id || ' ' || severity || ' ' || summary, ',' ORDER BY ghsa_id) AS advisory_list
  FROM advisories GROUP BY 1)"""


def _supplier(number):
    return F.concat(F.lit("org/Supplier#"), F.lpad(number, 9, "0"))


@query("combine_repo", S.with_ctes(*_REPO_CTES, _REPO_DETAIL, select="""SELECT combined.*, coalesce(vulnerabilities, '') AS vulnerabilities,
  coalesce(advisory_list, '') AS advisory_list FROM combined LEFT JOIN repo_vulns USING (repo) LEFT JOIN repo_advs USING (repo)"""))
def combine_repo(spark, d):
    """The repository report with its detail: totals, the first 20 vulnerabilities and the advisories."""
    per_file = fs.file_counts(scan_by_file(B.code(spark, d)).files).withColumn("repo", _supplier((F.col("file_id") % 100).cast("string")))
    named = B.manifests(spark, d).withColumn("project", _supplier(F.substring("project", 2, 20)))
    done = scan_dependencies(named, manifest_osv(spark, d))
    rows = intel.combine_repo(repos(spark, d), per_file, done.summary, advisories(spark, d), done.first_vulnerabilities(20))
    return rows.withColumns({
        "vulnerabilities": F.array_join(F.transform("vulnerabilities", lambda v: F.concat(
            v.package, F.lit("@"), v.version, F.lit(" "), v.vuln_id, F.lit(" "), v.severity)), ","),
        "advisory_list": F.array_join(F.transform("advisory_list", lambda a: F.concat_ws(
            " ", a.ghsa_id, a.cve_id, a.severity, a.summary)), ",")})


@query("repo_summary", S.with_ctes(*_REPO_CTES, select="SELECT repo, code_findings, dep_vulnerabilities, advisories, files_scanned FROM combined"))
def repo_summary(spark, d):
    """The repository report through the plan; a file's repository follows from the number in its path."""
    number = F.regexp_extract("path", r"src/m(\d+)", 1).cast("long") % 100
    owner = F.concat(F.lit("org/Supplier#"), F.lpad(number.cast("string"), 9, "0"))
    named = B.manifests(spark, d).withColumn(
        "project", F.concat(F.lit("org/Supplier#"), F.lpad(F.substring("project", 2, 20), 9, "0")))
    return intel.repo_summary(scan_repositories(
        repos(spark, d), B.code(spark, d), named, manifest_osv(spark, d), advisories(spark, d), owner))
