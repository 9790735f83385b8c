"""Tables of the registered queries, once for Spark and once as SQL for the check.

Code, manifests and feeds are derived from the given tables row by row, so the work
of every query grows with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnsieve.catalog.classes import CLASS_ROWS
from vulnsieve.catalog.snippets import corpus_snippets
from vulnsieve.sources.tables import code_from_table, seeded_corpus

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

AS_OF = "1998-12-01"  # every look-up of recent entries names its day


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return register


def lit(value) -> str:
    """A value as a SQL literal of the check engine."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int):
        return repr(value)
    if isinstance(value, float):
        return f"{value!r}::DOUBLE"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(lit(v) for v in value) + "]"
    return "'" + value.replace("'", "''") + "'"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    body = ",\n".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ── corpora ─────────────────────────────────────────────────────────────────

SNIPPETS = corpus_snippets()


def code(spark: SparkSession, d: str) -> DataFrame:
    snippets = spark.createDataFrame(SNIPPETS, "snippet_id int, ext string, code string")
    return seeded_corpus(table(spark, d, "documents").select("doc_id", "text"), snippets, len(SNIPPETS))


CODE_SQL = values("snippets", "snippet_id, ext, code", SNIPPETS) + f""",
code AS (
  SELECT doc_id AS file_id, 'src/m' || doc_id || ext AS path, code || chr(10) || text AS content
  FROM documents JOIN snippets ON doc_id % {len(SNIPPETS)} = snippet_id)"""


def documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return code_from_table(docs, "doc_id", F.concat(F.lit("doc/"), F.col("doc_id"), F.lit(".txt")), "text")


DOCUMENTS_SQL = "code AS (SELECT doc_id AS file_id, 'doc/' || doc_id || '.txt' AS path, text AS content FROM documents)"


def pages(spark: SparkSession, d: str) -> DataFrame:
    return code_from_table(table(spark, d, "pages"), "page_id", "url", "html")


PAGES_SQL = "code AS (SELECT page_id AS file_id, url AS path, html AS content FROM pages)"


def turns(spark: SparkSession, d: str) -> DataFrame:
    talk = table(spark, d, "conversations")
    return code_from_table(
        talk, F.col("conv_id") * 1_000_000_000 + F.col("turn"), F.concat(F.lit("chat/"), F.col("conv_id")), "text")


TURNS_SQL = ("code AS (SELECT conv_id * 1000000000 + turn AS file_id, 'chat/' || conv_id AS path, text AS content "
             "FROM conversations)")

# ── dimensions ──────────────────────────────────────────────────────────────

CLASSES_SQL = values(
    "classes", "vuln_class, name, cwe_id, owasp, severity, remediation",
    [(r[0], r[1], r[2], r[4], r[5], r[8]) for r in CLASS_ROWS])

CWE_IDS = [r[2] for r in CLASS_ROWS]
ECOSYSTEMS = ["PyPI", "npm", "Go", "crates.io"]

# ── feeds ───────────────────────────────────────────────────────────────────


def _pick(options: list[str], index) -> F.Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (index % len(options) + 1).cast("int"))


def cve_raw(spark: SparkSession, d: str) -> DataFrame:
    """One feed document per order."""
    o = table(spark, d, "orders")
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    describe = F.concat(F.col("o_orderpriority"), F.lit(" flaw reported by customer "), F.col("o_custkey"), F.lit(". "),
                        F.repeat(F.lit("Details follow. "), 40))
    entry = lambda lang, value: F.struct(F.lit(lang).alias("lang"), value.alias("value"))
    level = F.when(F.startswith("o_orderpriority", F.lit("1")), "CRITICAL").when(
        F.startswith("o_orderpriority", F.lit("2")), "HIGH").when(
        F.startswith("o_orderpriority", F.lit("3")), "MEDIUM").otherwise("LOW")
    metric = F.struct(F.struct((F.col("o_totalprice") / 1000).alias("baseScore"), level.alias("baseSeverity"),
                               F.lit("CVSS:3.1/AV:N").alias("vectorString")).alias("cvssData"))
    metrics = F.when(F.col("o_orderstatus") != "P", F.struct(F.array(metric).alias("cvssMetricV31")))
    weak = F.array(F.struct(F.array(entry("en", _pick(CWE_IDS, key)), entry("en", F.lit("NVD-CWE-noinfo"))).alias("description")))
    refs = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.struct(
        F.concat(F.lit("https://ref/"), key, F.lit("/"), i).alias("url"), F.lit("vendor").alias("source"),
        F.array(F.lit("Patch")).alias("tags")))
    cve = F.struct(
        F.concat(F.lit("CVE-"), F.substring(day, 1, 4), F.lit("-"), key).alias("id"),
        F.concat(day, F.lit("T10:00:00.000")).alias("published"),
        F.array(entry("fr", F.lit("sans objet")), entry("en", describe)).alias("descriptions"),
        metrics.alias("metrics"), weak.alias("weaknesses"), refs.alias("references"))
    return o.select(F.to_json(F.struct(F.array(F.struct(cve.alias("cve"))).alias("vulnerabilities"))).alias("json"))


CVE_SQL = f"""cve AS (
  SELECT 'CVE-' || strftime(o_orderdate, '%Y') || '-' || o_orderkey AS cve_id,
    o_orderpriority || ' flaw reported by customer ' || o_custkey || '. ' || repeat('Details follow. ', 40)
      AS description,
    CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 1000 END AS cvss_score,
    CASE WHEN o_orderstatus <> 'P' THEN CASE substr(o_orderpriority, 1, 1)
      WHEN '1' THEN 'CRITICAL' WHEN '2' THEN 'HIGH' WHEN '3' THEN 'MEDIUM' ELSE 'LOW' END END AS cvss_severity,
    CASE WHEN o_orderstatus <> 'P' THEN 'CVSS:3.1/AV:N' END AS cvss_vector,
    {lit(CWE_IDS)}[o_orderkey % {len(CWE_IDS)} + 1] AS cwe_id,
    strftime(o_orderdate, '%Y-%m-%d') AS published,
    o_orderkey, o_orderstatus, o_orderpriority, o_custkey
  FROM orders)"""


def kev_raw(spark: SparkSession, d: str) -> DataFrame:
    """One catalogue document per urgent order; ids of finished ones are lower-case."""
    o = table(spark, d, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    cve_id = F.concat(F.lit("CVE-"), F.substring(day, 1, 4), F.lit("-"), F.col("o_orderkey"))
    entry = F.struct(
        F.when(F.col("o_orderstatus") == "F", F.lower(cve_id)).otherwise(cve_id).alias("cveID"),
        F.concat(F.lit("Vendor"), F.col("o_custkey") % 50).alias("vendorProject"),
        F.concat(F.lit("Product"), F.col("o_custkey") % 7).alias("product"),
        F.concat(F.lit("Flaw "), F.col("o_orderkey")).alias("vulnerabilityName"),
        F.concat(F.lit("Exploited through order "), F.col("o_orderkey"), F.lit(", see the notice of the vendor for all of the details"))
        .alias("shortDescription"),
        day.alias("dateAdded"),
        F.when(F.col("o_orderstatus") == "F", F.lit("Known")).when(F.col("o_orderstatus") == "P", F.lit("Unknown"))
        .alias("knownRansomwareCampaignUse"))
    return o.select(F.to_json(F.struct(F.array(entry).alias("vulnerabilities"))).alias("json"))


KEV_SQL = """kev AS (
  SELECT CASE WHEN o_orderstatus = 'F' THEN lower(id) ELSE id END AS cve_id,
    'Vendor' || (o_custkey % 50) AS vendor, 'Product' || (o_custkey % 7) AS product, 'Flaw ' || o_orderkey AS name,
    'Exploited through order ' || o_orderkey || ', see the notice of the vendor for all of the details' AS description,
    strftime(o_orderdate, '%Y-%m-%d') AS date_added, '' AS due_date, '' AS required_action,
    CASE WHEN o_orderstatus = 'F' THEN 'Known' ELSE 'Unknown' END AS known_ransomware, '' AS notes
  FROM (SELECT *, 'CVE-' || strftime(o_orderdate, '%Y') || '-' || o_orderkey AS id FROM orders
        WHERE o_orderpriority = '1-URGENT'))"""


def osv_raw(spark: SparkSession, d: str) -> DataFrame:
    """One feed document per part: a package, its ranges or versions, and a severity text.

    Six kinds in turn: one pair, two pairs, an inclusive end, a commit range beside versions,
    listed versions, a commit range alone.  Some have no range at all.
    """
    p = table(spark, d, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    word = F.when(size >= 40, "critical").when(size >= 30, "High").when(size >= 20, "MEDIUM").when(size >= 10, "low").otherwise("none")
    fixed = F.concat((size / 10).cast("int"), F.lit("."), size % 10, F.lit(".0"))
    null = F.lit(None).cast("string")
    event = lambda a=null, b=null, c=null: F.struct(
        a.cast("string").alias("introduced"), b.cast("string").alias("fixed"), c.cast("string").alias("last_affected"))
    ranged = lambda kind, *events: F.struct(F.lit(kind).alias("type"), F.array(*events).alias("events"))
    kinds = "array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>"
    none = F.array().cast(kinds)
    commit = ranged("GIT", event(F.lit("0")), event(b=F.lit("9f3c1e")))
    one = F.when(size % 5 == 0, F.array(ranged("SEMVER", event(F.lit("0"))))).otherwise(
        F.array(ranged("SEMVER", event(F.lit("0.0.1")), event(b=fixed))))
    two = F.array(ranged("SEMVER", event(F.lit("0")), event(b=F.lit("2.5.0")), event(F.lit("4.0.0")), event(b=F.lit("5.20.0"))))
    last = F.array(ranged("ECOSYSTEM", event(F.lit("1.10.0")), event(c=F.lit("3.30.0"))))
    mixed = F.array(commit, ranged("ECOSYSTEM", event(F.lit("0")), event(b=fixed)))
    kind = key % 6
    ranges = F.when(size % 7 == 0, none).when(kind == 0, one).when(kind == 1, two).when(kind == 2, last).when(
        kind == 3, mixed).when(kind == 4, none).otherwise(F.array(commit))
    listed = F.when(kind == 4, F.array(F.lit("1.7.0"), F.lit("3.8.0"), F.lit("7.9.0-rc1"))).otherwise(F.array().cast("array<string>"))
    record = F.struct(
        F.concat(F.lit("OSV-"), key).alias("id"), F.concat(F.col("p_name"), F.lit(" may be abused")).alias("summary"),
        F.repeat(F.concat(F.col("p_brand"), F.lit(" ")), 100).alias("details"),
        F.array(F.concat(F.lit("CVE-2001-"), key), F.concat(F.lit("GHSA-"), key)).alias("aliases"),
        F.lit("2001-01-01").alias("published"), F.concat(F.lit("2002-01-"), F.lpad((key % 28 + 1).cast("string"), 2, "0")).alias("modified"),
        F.array(F.struct(F.lit("CVSS_V3").alias("type"), F.lit("CVSS:3.1/first").alias("score")),
                F.struct(F.lit("CVSS_V3").alias("type"), F.lit("CVSS:3.1/last").alias("score")),
                F.struct(F.lit("TEXT").alias("type"), word.alias("score"))).alias("severity"),
        F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.struct(
            F.lit("WEB").alias("type"), F.concat(F.lit("https://osv/"), key, F.lit("/"), i).alias("url"))).alias("references"),
        F.array(F.struct(
            F.struct(F.concat(F.lit("pkg"), key).alias("name"), _pick(ECOSYSTEMS, key).alias("ecosystem")).alias("package"),
            ranges.alias("ranges"), listed.alias("versions"))).alias("affected"))
    return p.select(F.to_json(F.struct(F.array(record).alias("vulns"))).alias("json"))


OSV_SQL = f"""osv AS (
  SELECT 'OSV-' || p_partkey AS vuln_id, 'pkg' || p_partkey AS package,
    {lit(ECOSYSTEMS)}[p_partkey % {len(ECOSYSTEMS)} + 1] AS ecosystem, 'CVE-2001-' || p_partkey AS cve_ids,
    p_name || ' may be abused' AS summary, repeat(p_brand || ' ', 100) AS details,
    CASE WHEN p_size >= 40 THEN 'CRITICAL' WHEN p_size >= 30 THEN 'HIGH' WHEN p_size >= 20 THEN 'MEDIUM'
      WHEN p_size >= 10 THEN 'LOW' ELSE 'UNKNOWN' END AS severity,
    'CVSS:3.1/last' AS cvss_vector,
    p_partkey % 6 AS kind, p_size % 7 <> 0 AS has_range,
    (p_size // 10) || '.' || (p_size % 10) || '.0' AS fixed,
    '2001-01-01' AS published, '2002-01-' || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0') AS modified,
    p_partkey, p_size
  FROM part),
intervals(vuln_id, low, high, last) AS (
  SELECT vuln_id, CASE WHEN p_size % 5 = 0 THEN '0' ELSE '0.0.1' END, CASE WHEN p_size % 5 <> 0 THEN fixed END, NULL
    FROM osv WHERE has_range AND kind = 0
  UNION ALL SELECT vuln_id, '0', '2.5.0', NULL FROM osv WHERE has_range AND kind = 1
  UNION ALL SELECT vuln_id, '4.0.0', '5.20.0', NULL FROM osv WHERE has_range AND kind = 1
  UNION ALL SELECT vuln_id, '1.10.0', NULL, '3.30.0' FROM osv WHERE has_range AND kind = 2
  UNION ALL SELECT vuln_id, '0', fixed, NULL FROM osv WHERE has_range AND kind = 3
  UNION ALL SELECT vuln_id, '0', NULL, NULL FROM osv WHERE NOT has_range AND kind <> 4),
listed(vuln_id, version) AS (
  SELECT vuln_id, unnest(['1.7.0', '3.8.0', '7.9.0-rc1']) FROM osv WHERE kind = 4)"""


def dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Orders as projects, parts as their packages; returned lines have no version, some a pre-release."""
    li = table(spark, d, "lineitem")
    version = F.concat(F.col("l_linenumber"), F.lit("."), F.col("l_quantity").cast("int"), F.lit(".0"),
                       F.when(F.col("l_orderkey") % 4 == 0, "-rc1").otherwise(""))
    return li.select(
        F.concat(F.lit("order-"), F.col("l_orderkey")).alias("project"),
        F.concat(F.lit("pkg"), F.col("l_partkey")).alias("name"),
        F.when(F.col("l_returnflag") != "R", version).alias("version"),
        _pick(ECOSYSTEMS, F.col("l_partkey")).alias("ecosystem"),
        F.lit("requirements.txt").alias("source"), F.lit(None).cast("string").alias("dep_type"),
        F.lit(0).alias("format_no"), F.lit("requirements.txt").alias("path"),
        F.col("l_linenumber").cast("long").alias("line_no"))


DEPS_SQL = f"""deps AS (
  SELECT 'order-' || l_orderkey AS project, 'pkg' || l_partkey AS name,
    CASE WHEN l_returnflag <> 'R' THEN l_linenumber || '.' || l_quantity::INT || '.0'
      || CASE WHEN l_orderkey % 4 = 0 THEN '-rc1' ELSE '' END END AS version,
    {lit(ECOSYSTEMS)}[l_partkey % {len(ECOSYSTEMS)} + 1] AS ecosystem, l_linenumber AS line_no
  FROM lineitem)"""


def repo_raw(spark: SparkSession, d: str) -> DataFrame:
    """One metadata document per supplier; some fields are missing on purpose."""
    s = table(spark, d, "supplier")
    key = F.col("s_suppkey")
    rich = F.col("s_acctbal") > 0
    record = F.struct(
        F.concat(F.lit("org/"), F.col("s_name")).alias("full_name"),
        F.when(rich, F.concat(F.lit("Tools of "), F.col("s_name"), F.repeat(F.lit(" and more"), 30))).alias("description"),
        F.when(rich, _pick(["Python", "Go", "Rust"], key)).alias("language"),
        (key * 37 % 1009).alias("stargazers_count"), (key * 11 % 503).alias("forks_count"),
        F.when(rich, key % 13).alias("open_issues_count"),
        F.concat(F.lit("2020-01-"), F.lpad((key % 28 + 1).cast("string"), 2, "0")).alias("updated_at"),
        F.when(rich, F.struct(F.lit("MIT").alias("spdx_id"))).alias("license"),
        F.array(F.lit("spark"), F.concat(F.lit("n"), F.col("s_nationkey"))).alias("topics"),
        F.concat(F.lit("https://github.com/org/"), F.col("s_suppkey")).alias("html_url"))
    return s.select(F.to_json(record).alias("json"))


REPOS_SQL = """repos AS (
  SELECT 'org/' || s_name AS full_name,
    CASE WHEN s_acctbal > 0 THEN 'Tools of ' || s_name || repeat(' and more', 30) ELSE '' END AS description,
    CASE WHEN s_acctbal > 0 THEN ['Python', 'Go', 'Rust'][s_suppkey % 3 + 1] ELSE '' END AS language,
    'main' AS default_branch, s_suppkey * 37 % 1009 AS stars, s_suppkey * 11 % 503 AS forks,
    CASE WHEN s_acctbal > 0 THEN s_suppkey % 13 ELSE 0 END AS open_issues,
    '' AS created_at, '2020-01-' || lpad((s_suppkey % 28 + 1)::VARCHAR, 2, '0') AS updated_at,
    CASE WHEN s_acctbal > 0 THEN 'MIT' ELSE 'Unknown' END AS license, 'spark,n' || s_nationkey AS topics,
    'public' AS visibility, false AS archived, '' AS clone_url, 'https://github.com/org/' || s_suppkey AS html_url,
    s_suppkey, s_nationkey
  FROM supplier)"""


def advisory_raw(spark: SparkSession, d: str) -> DataFrame:
    """Per supplier a document with as many advisories as its nation number modulo three."""
    s = table(spark, d, "supplier")
    key = F.col("s_suppkey")
    advisory = lambda i: F.struct(
        F.concat(F.lit("GHSA-"), key, F.lit("-"), i).alias("ghsa_id"),
        F.when(i > 1, F.concat(F.lit("CVE-2020-"), key)).alias("cve_id"),
        F.concat(F.lit("Issue "), i).alias("summary"), F.lit("high").alias("severity"), F.lit("published").alias("state"),
        F.array(F.struct(
            F.struct(F.concat(F.lit("pkg"), key).alias("name"), F.lit("pip").alias("ecosystem")).alias("package"),
            F.lit("< 2.0").alias("vulnerable_version_range"))).alias("vulnerabilities"))
    n = F.col("s_nationkey") % 3
    docs = F.slice(F.transform(F.sequence(F.lit(1), F.lit(2)), advisory), F.lit(1), n)
    return s.select(F.concat(F.lit("org/"), F.col("s_name")).alias("repo"), F.to_json(docs).alias("json"))


ADVISORIES_SQL = """advisories AS (
  SELECT 'org/' || s_name AS repo, 'GHSA-' || s_suppkey || '-' || i AS ghsa_id,
    CASE WHEN i > 1 THEN 'CVE-2020-' || s_suppkey ELSE '' END AS cve_id, 'Issue ' || i AS summary, 'high' AS severity,
    'published' AS state, '' AS published_at, 'pkg' || s_suppkey AS package, 'pip' AS package_ecosystem,
    '< 2.0' AS vulnerable_range, '' AS patched_version
  FROM (SELECT *, unnest(range(1, s_nationkey % 3 + 1)) AS i FROM supplier))"""

# ── manifests ───────────────────────────────────────────────────────────────
# @ID@ becomes the document id, @TEXT@ the document text, @EQ@ the text with = for blanks, @QUOTED@ its lines in quotes,
# @WORDS@ its words as members of a JSON object; ten kinds in turn.
MANIFEST_TEMPLATES = [
    (0, "requirements.txt", "requirements.txt", "# pinned\nflask==2.@ID@.1\nrequests >= 2.0\n-r more.txt\n\nnumpy\nFlask~=1.0\n@TEXT@\n"),
    (1, "Pipfile", "Pipfile", "[source]\nurl = \"x\"\n\n[packages]\nflask = \"==2.@ID@\"\n\"django\" = \"*\"\nplain\n@EQ@\n[dev-packages]\npytest = \"*\"\n"),
    (2, "pyproject.toml", "pyproject.toml", "[project]\nname = \"p@ID@\"\ndependencies = [\n  \"flask>=2.@ID@\",\n  \"click\",\n@QUOTED@\n]\n[tool.x]\n\"none==1\"\n[project.optional-dependencies]\ndev = [\"black\"]\n  \"ruff==0.1\"\n"),
    (3, "package.json", "package.json", "{\"name\": \"p\", \"dependencies\": {\"left-pad\": \"^1.3.@ID@\", \"any\": \"*\", @WORDS@}, \"devDependencies\": {\"jest\": \">=1.0 <2.0\", \"left-pad\": \"1.0.0\"}}"),
    (4, "go.mod", "go.mod", "module m@ID@\n\ngo 1.21\n\nrequire github.com/a/b v1.@ID@.0\n\nrequire (\n\tgithub.com/c/d v0.1.2\n@TEXT@\n\tgithub.com/e/f v2.0.0 // indirect\n)\n\nreplace x => y\n"),
    (5, "Cargo.toml", "Cargo.toml", "[package]\nversion = \"0.1.@ID@\"\n\n[dependencies]\nserde = \"1.0.@ID@\"\ntokio = { version = \"1.2\", features = [\"full\"] }\n@EQ@\n\n[dependencies.extra]\npath = \"../x\"\n[dev-dependencies]\ncriterion = \"0.5\"\n[profile]\nopt = 3\n"),
    (6, "Gemfile", "Gemfile", "source 'https://rubygems.org'\ngem 'rails', '~> 7.@ID@'\ngem \"puma\"\n  gem 'pg' , \">= 1.0\"\n# gem 'no'\n@TEXT@\n"),
    (7, "composer.json", "composer.json", "{\"require\": {\"php\": \">=8\", \"ext-json\": \"*\", \"a/b\": \"^2.@ID@\", @WORDS@}, \"require-dev\": {\"phpunit/phpunit\": \"~9.5\"}}"),
    (8, "package.json", "web/package.json", "{\"dependencies\": {\"broken@ID@\": "),
    (9, "requirements.txt", "web/requirements.txt", "Flask==0.@ID@\nflask==9.9\n@TEXT@"),
]


def manifests(spark: SparkSession, d: str) -> DataFrame:
    kinds = spark.createDataFrame(MANIFEST_TEMPLATES, "kind int, file_name string, path string, template string")
    docs = table(spark, d, "documents").select("doc_id", "text")
    n = len(MANIFEST_TEMPLATES)
    words = F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))),
                        lambda w: F.concat(F.lit('"'), w, F.lit('": "^'), F.length(w), F.lit('.0"')))
    members = F.array_join(F.concat(F.array(F.lit('"zz": "1"')), words), ", ")
    # the costly value is made only where its mark can occur; a null text stays null
    wanted = F.contains("template", F.lit("@WORDS@")) | F.contains("text", F.lit("@WORDS@"))
    filled = F.col("template")
    for mark, value in (
            ("@ID@", F.col("doc_id").cast("string")), ("@EQ@", F.replace("text", F.lit(" "), F.lit("="))),
            ("@QUOTED@", F.concat(F.lit('"'), F.replace("text", F.lit("\n"), F.lit('"\n"')), F.lit('"'))),
            ("@WORDS@", F.when(wanted, members).otherwise(F.lit(""))), ("@TEXT@", F.col("text"))):
        filled = F.replace(filled, F.lit(mark), value)
    return docs.join(F.broadcast(kinds), F.col("doc_id") % n == F.col("kind")).select(
        F.concat(F.lit("p"), F.floor(F.col("doc_id") / n)).alias("project"), "path", "file_name", filled.alias("content"))


MANIFESTS_SQL = values("kinds", "kind, file_name, path, template", MANIFEST_TEMPLATES) + f""",
manifests AS (
  SELECT 'p' || (doc_id // {len(MANIFEST_TEMPLATES)}) AS project, path, file_name,
    replace(replace(replace(replace(replace(template, '@ID@', doc_id::VARCHAR), '@EQ@', replace(text, ' ', '=')),
      '@QUOTED@', '"' || replace(text, chr(10), '"' || chr(10) || '"') || '"'),
      '@WORDS@', array_to_string(list_concat(['"zz": "1"'], list_transform(list_distinct(regexp_extract_all(text, '[a-z]+')),
        lambda w: '"' || w || '": "^' || length(w) || '.0"')), ', ')), '@TEXT@', text) AS content
  FROM documents JOIN kinds ON doc_id % {len(MANIFEST_TEMPLATES)} = kind)"""

# ── scores and labels ───────────────────────────────────────────────────────


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Eleven scores per vector, each from every eleventh value; the vector's label is its one true class.

    Values are summed as whole thousandths, so both engines give the same scores.
    """
    e = table(spark, d, "embeddings")
    value = F.transform("embedding", lambda x, i: F.struct((i % 11).alias("c"), F.floor(x.cast("double") * 1000).alias("v")))
    of_class = lambda c: F.aggregate(
        F.filter("values", lambda s: s.c == c), F.lit(0).cast("long"), lambda acc, s: acc + s.v)
    sums = F.transform(F.sequence(F.lit(0), F.lit(10)), of_class)
    prob = F.least(F.greatest((F.col("x") + 1500) / 3000, F.lit(0.0)), F.lit(1.0))
    return e.select("vec_id", "label", value.alias("values")).select(
        F.col("vec_id").alias("sample_id"), "label", F.posexplode(sums).alias("class_id", "x"),
    ).select("sample_id", "class_id", prob.alias("prob"), (F.col("label") == F.col("class_id")).cast("int").alias("label"))


SCORES_SQL = """scores AS (
  SELECT vec_id AS sample_id, c AS class_id,
    least(greatest((sum(floor(embedding[i]::DOUBLE * 1000)::BIGINT) + 1500) / 3000, 0), 1)::DOUBLE AS prob,
    (any_value(label) = c)::INT AS label
  FROM embeddings, (SELECT unnest(range(0, 11)) AS c), (SELECT unnest(range(1, 65)) AS i) WHERE (i - 1) % 11 = c
  GROUP BY vec_id, c)"""


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Documents with labels: class 0 is quality, class 1 is toxic."""
    flags = F.array(F.when(F.col("quality") == 1, 0), F.when(F.col("toxic") == 1, 1))
    return table(spark, d, "labels").select("doc_id", F.array_compact(flags).alias("labels"))


LABELLED_SQL = "labelled AS (SELECT doc_id, quality, toxic FROM labels)"
