"""Registered queries: sources, text functions, detectors and findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnsieve.catalog import patterns as P
from vulnsieve.catalog.rules import RULES
from vulnsieve.functions import text as X
from vulnsieve.functions.urls import parse_repo_url
from vulnsieve.operators import detect as D, file_scan as fs, findings as fnd, reports
from vulnsieve.plans.scan import detect_all, scan, scan_by_file
from vulnsieve.sources import files as src
from vulnsieve.sources.dimensions import class_lookup, ecosystem_of, rule_catalog, rules_by_class, vuln_classes

from workloads import base as B
from workloads import checksql as S
from workloads.base import lit, query

LOOKAROUND = [r for r in RULES if r.lookaround]


def rounded(df):
    return df.withColumn("confidence", F.round("confidence", 6))


# ── rules ───────────────────────────────────────────────────────────────────

def _register_rules(name, rules, corpus, corpus_sql):
    sql = S.with_ctes(corpus_sql, S.found(D.rule_checks(rules)), select=S.FINDING_SELECT + " FROM found")
    query(name, sql)(lambda spark, d: rounded(D.rule_scan(corpus(spark, d), rules)))


for _class in range(11):
    _own = [r for r in RULES if r.vuln_class == _class and not r.rule_id.startswith("AUT")]
    _register_rules(f"rules_class_{_class:02d}", _own, B.code, B.CODE_SQL)
_register_rules("rules_secret_formats", [r for r in RULES if r.rule_id.startswith("AUT")], B.code, B.CODE_SQL)
_register_rules("rule_scan", RULES, B.code, B.CODE_SQL)
_register_rules("rule_scan_documents", RULES, B.documents, B.DOCUMENTS_SQL)
_register_rules("rule_scan_pages", RULES, B.pages, B.PAGES_SQL)
_register_rules("rule_scan_conversations", RULES, B.turns, B.TURNS_SQL)
_SECRETS = [r for r in RULES if r.vuln_class == 4]
query("secret_scan_documents", S.with_ctes(
    B.DOCUMENTS_SQL, S.found(D.rule_checks(_SECRETS)), select=S.FINDING_SELECT + " FROM found"),
)(lambda spark, d: rounded(D.secret_scan(B.documents(spark, d))))
query("secret_scan_conversations", S.with_ctes(
    B.TURNS_SQL, S.found(D.rule_checks(_SECRETS)), select=S.FINDING_SELECT + " FROM found"),
)(lambda spark, d: rounded(D.secret_scan(B.turns(spark, d))))


# The check engine has no look-around: the SQL tests the text around each match instead.
_register_rules("rule_scan_lookaround", LOOKAROUND, B.code, B.CODE_SQL)


# ── flow and reverse ────────────────────────────────────────────────────────

def _register_checks(name, checks, scan_function, corpus=B.code, corpus_sql=B.CODE_SQL):
    sql = S.with_ctes(corpus_sql, S.found(checks), select=S.FINDING_SELECT + " FROM found")
    query(name, sql)(lambda spark, d: rounded(scan_function(corpus(spark, d))))


_register_checks("dangerous_calls", D.call_checks(), D.dangerous_calls)
_register_checks("data_flow", D.sink_checks(), D.data_flow)
_register_checks("missing_controls", D.control_checks(), D.missing_controls)
_register_checks("flow_scan", D.flow_checks(), D.flow_scan)
_register_checks("api_inference", D.api_checks(), D.api_inference)
_register_checks("endpoints", D.endpoint_checks(), D.endpoints)
_register_checks("hidden_routes", D.hidden_checks(), D.hidden_routes)
_register_checks("decompiled_artifacts", D.decompiled_checks(), D.decompiled_artifacts)
_register_checks("reverse_scan", D.reverse_checks(), D.reverse_scan)

# `import random` is no finding when a comment calls it secure: the check looks at the rest of the text
query("import_scan", S.with_ctes(
    B.CODE_SQL, S.found(D.import_checks()),
    select="SELECT file_id, path, line, matched AS import_text, message FROM found "
           r"WHERE NOT (starts_with(message, 'random module') AND regexp_matches(rest, '^\s*#.*?secure'))"),
)(lambda spark, d: D.import_scan(B.code(spark, d)))

_ENDPOINT_ROWS = S.found(D.endpoint_checks()).split("found AS (")[0].rstrip().rstrip(",")
query("endpoint_table", S.with_ctes(
    B.CODE_SQL, _ENDPOINT_ROWS,
    select="SELECT file_id, path, line, endpoint, (" + " OR ".join(
        f"contains(lower(endpoint), {lit(w)})" for w in P.ENDPOINT_SENSITIVE) + ") AS sensitive FROM routed"),
)(lambda spark, d: D.endpoint_table(B.code(spark, d)))


@query("binary_strings", S.with_ctes(
    B.CODE_SQL,
    "runs AS (SELECT file_id, unnest(regexp_extract_all(code.content || chr(10) || 'x' , '[ -~]{4,}')) AS s FROM code)",
    select="SELECT file_id, 'bin/' || file_id || '.so' AS path, 4 AS vuln_class, 0 AS line, "
           "'Potential hardcoded secret found in binary: ''' || substr(s, 1, 50) || '...''' AS message, 'high' AS severity, "
           "0.6::DOUBLE AS confidence, 'binary_inspection' AS source FROM runs WHERE "
           + " OR ".join(f"contains(lower(s), {lit(m)})" for m in P.BINARY_MARKERS)))
def binary_strings(spark, d):
    """Every text as the bytes of a compiled file."""
    files = B.code(spark, d).select(
        "file_id", F.concat(F.lit("bin/"), F.col("file_id"), F.lit(".so")).alias("path"),
        F.encode("content", "UTF-8").alias("content"))
    return D.binary_strings(files).drop("rule_id", "matched_text", "seq")


# ── text functions ──────────────────────────────────────────────────────────

@query("language_from_path", f"WITH {B.CODE_SQL} SELECT file_id, coalesce({S.PATH_LANGUAGE_SQL}, 'unknown') AS language FROM code")
def language_from_path(spark, d):
    return B.code(spark, d).select("file_id", X.language_from_path(F.col("path")).alias("language"))


@query("language_from_content", f"WITH {B.CODE_SQL} SELECT file_id, {S.content_language('content')} AS language FROM code")
def language_from_content(spark, d):
    return B.code(spark, d).select("file_id", X.language_from_content("content").alias("language"))


@query("detect_language", f"""WITH {B.CODE_SQL}
SELECT file_id, coalesce({S.PATH_LANGUAGE_SQL}, {S.content_language('content')}) AS language FROM code""")
def detect_language(spark, d):
    return B.code(spark, d).select("file_id", X.detect_language(F.col("path"), "content").alias("language"))


@query("detect_frameworks", f"WITH {B.CODE_SQL} SELECT file_id, {S.frameworks('content')} AS frameworks FROM code")
def detect_frameworks(spark, d):
    return B.code(spark, d).select("file_id", F.concat_ws(",", X.detect_frameworks("content")).alias("frameworks"))


_ROUGH = "regexp_replace(content, '[.,]', '  ' || chr(13) || repeat(chr(10), 5), 'g')"


@query("normalize", f"WITH {B.CODE_SQL} SELECT file_id, {S.normalize(_ROUGH)} AS content FROM code")
def normalize(spark, d):
    """Texts with blanks, CR and runs of line ends in place of every stop and comma."""
    rough = F.regexp_replace("content", "[.,]", "  \r\n\n\n\n\n")
    return B.code(spark, d).select("file_id", X.normalize(rough).alias("content"))


@query("line_and_char_counts", f"WITH {B.CODE_SQL} SELECT file_id, {S.count_newlines('content')} AS line_count, "
                               "length(content) AS char_count FROM code")
def line_and_char_counts(spark, d):
    return X.with_counts(B.code(spark, d)).select("file_id", "line_count", "char_count")


@query("line_context", f"""WITH {B.CODE_SQL},
n AS (SELECT file_id, string_split(content, chr(10)) AS ls FROM code),
t AS (SELECT file_id, ls, 1 + file_id % len(ls) AS line FROM n),
e AS (SELECT *, unnest(range(greatest(0, line - 4), least(len(ls), line + 3))) AS i FROM t)
SELECT file_id, line::INT AS target_line, (min(i) + 1)::INT AS start_line, (max(i) + 1)::INT AS end_line,
  string_agg((CASE WHEN i + 1 = line THEN '>>> ' ELSE '    ' END) || lpad((i + 1)::VARCHAR, 4, ' ') || ' | ' || ls[i + 1],
             chr(10) ORDER BY i) AS snippet
FROM e GROUP BY file_id, line""")
def line_context(spark, d):
    rows = B.code(spark, d).withColumn("line", (1 + F.col("file_id") % F.size(F.split("content", "\n", -1))).cast("int"))
    return rows.select("file_id", X.line_context(F.col("content"), F.col("line")).alias("c")).select("file_id", "c.*")


@query("format_size", """WITH s AS (SELECT doc_id, n_chars * n_chars * n_chars AS b FROM documents)
SELECT doc_id, CASE WHEN b < 1024 THEN printf('%.1f B', b::DOUBLE) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0::DOUBLE)
  WHEN b < 1073741824 THEN printf('%.1f MB', b / 1024.0::DOUBLE / 1024)
  WHEN b < 1099511627776 THEN printf('%.1f GB', b / 1024.0::DOUBLE / 1024 / 1024)
  ELSE printf('%.1f TB', b / 1024.0::DOUBLE / 1024 / 1024 / 1024) END AS size FROM s""")
def format_size(spark, d):
    docs = B.table(spark, d, "documents")
    return docs.select("doc_id", X.format_size(F.col("n_chars") * F.col("n_chars") * F.col("n_chars")).alias("size"))


_URL_KINDS = ("CASE doc_id % 5 WHEN 0 THEN 'https://github.com/org' || doc_id || '/repo.git' "
              "WHEN 1 THEN ' github.com/org/' || source || '/ ' WHEN 2 THEN source || '/' || lang "
              "WHEN 3 THEN 'https://example.org/' || source ELSE 'https://github.com/only' || doc_id END")


@query("parse_repo_url", f"""WITH u AS (SELECT doc_id, regexp_replace(rtrim(trim({_URL_KINDS}), '/'), '\\.git$', '') AS u FROM documents),
p AS (SELECT doc_id, u, string_split(u, 'github.com/') AS h, string_split(u, '/') AS s FROM u),
t AS (SELECT *, CASE WHEN contains(u, 'github.com') AND len(h) = 2 THEN string_split(h[2], '/') END AS t FROM p)
SELECT doc_id, CASE WHEN len(t) >= 2 THEN t[1] WHEN NOT contains(u, '://') AND len(s) = 2 THEN s[1] END AS owner,
  CASE WHEN len(t) >= 2 THEN t[2] WHEN NOT contains(u, '://') AND len(s) = 2 THEN s[2] END AS repo FROM t""")
def parse_urls(spark, d):
    docs = B.table(spark, d, "documents").withColumn("url", F.expr(_URL_KINDS))
    return docs.select("doc_id", parse_repo_url(F.col("url")).alias("p")).select("doc_id", "p.*")


@query("decode_content", """SELECT doc_id, lang, md5(text) AS digest, length(text) AS chars, contains(text, chr(13)) AS has_cr FROM documents""")
def decode_content(spark, d):
    """English texts as UTF-8 bytes, others as Latin-1 bytes, with CRLF line ends; both must come back whole."""
    docs = B.table(spark, d, "documents").select("doc_id", "lang", "text")
    latin = (F.col("lang") != "en") & (F.decode(F.encode("text", "ISO-8859-1"), "ISO-8859-1") == F.col("text"))
    crlf = F.replace("text", F.lit("\n"), F.lit("\r\n"))
    raw = docs.select("doc_id", "lang", F.when(latin, F.encode(crlf, "ISO-8859-1")).otherwise(F.encode(crlf, "UTF-8")).alias("content"))
    return src.decode_content(raw).select(
        "doc_id", "lang", F.md5("content").alias("digest"), F.length("content").cast("long").alias("chars"),
        F.contains("content", F.lit("\r")).alias("has_cr"))


@query("code_from_table", f"WITH {B.PAGES_SQL} SELECT * FROM code")
def code_from_table(spark, d):
    return B.pages(spark, d)


@query("order_files", f"WITH {B.CODE_SQL} SELECT path FROM code ORDER BY path")
def order_files(spark, d):
    return src.order_files(B.code(spark, d).select("path"))


@query("ecosystem_of", f"WITH {B.CODE_SQL} SELECT file_id, CASE coalesce({S.PATH_LANGUAGE_SQL}, 'unknown') "
       + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in P.ECOSYSTEMS.items()) + " END AS ecosystem FROM code")
def ecosystems(spark, d):
    return B.code(spark, d).select("file_id", ecosystem_of(X.language_from_path(F.col("path"))).alias("ecosystem"))


# ── findings ────────────────────────────────────────────────────────────────

_ALL_CHECKS = D.rule_checks(RULES) + D.flow_checks() + D.reverse_checks()
_FOUND = [B.CODE_SQL, S.found(_ALL_CHECKS)]
_SCANNED = [*_FOUND, S.MERGED, B.CLASSES_SQL, """scanned AS (
  SELECT m.*, name AS vulnerability_name, cwe_id, owasp, remediation FROM merged m JOIN classes c USING (vuln_class)
  WHERE confidence >= 0.5)"""]
_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"


def scanned(spark, d):
    return scan(B.code(spark, d), RULES)


def _sql(select, ctes=_SCANNED):
    return S.with_ctes(*ctes, select=select)


@query("union_findings", _sql(S.FINDING_SELECT + " FROM found", _FOUND))
def union_findings(spark, d):
    files = B.code(spark, d)
    return rounded(fnd.union_findings(D.rule_scan(files, RULES), D.flow_scan(files), D.reverse_scan(files)))


@query("merge_findings", _sql(S.FINDING_SELECT + " FROM merged", [*_FOUND, S.MERGED]))
def merge_findings(spark, d):
    return rounded(fnd.merge_findings(detect_all(B.code(spark, d), RULES)))


@query("threshold", _sql(S.FINDING_SELECT + " FROM merged WHERE confidence >= 0.7", [*_FOUND, S.MERGED]))
def threshold(spark, d):
    return rounded(fnd.threshold(fnd.merge_findings(detect_all(B.code(spark, d), RULES)), 0.7))


@query("module_switches", S.with_ctes(
    B.CODE_SQL, S.found(D.flow_checks()), S.MERGED, select=S.FINDING_SELECT + " FROM merged WHERE confidence >= 0.5"))
def module_switches(spark, d):
    return rounded(scan(B.code(spark, d), modules=["flow"]).select(*fnd.FINDING_COLUMNS))


@query("scan", _sql(S.FINDING_SELECT + ", vulnerability_name, cwe_id, owasp, array_to_string(remediation, ' / ') AS remediation "
                    "FROM scanned"))
def full_scan(spark, d):
    return rounded(scanned(spark, d)).withColumn("remediation", F.concat_ws(" / ", "remediation"))


@query("finding_output", _sql("SELECT file_id, line, vuln_class, round(confidence, 3) AS confidence, "
                              "substr(matched_text, 1, 200) AS matched_text FROM scanned"))
def finding_output(spark, d):
    return fnd.finding_output(scanned(spark, d)).select("file_id", "line", "vuln_class", "confidence", "matched_text")


@query("enrich_class", """SELECT event_id, user_id, """ + "CASE user_id % 13 " + " ".join(
    f"WHEN {k} THEN {lit(v)}" for k, v in {r[0]: r[1] for r in B.CLASS_ROWS}.items())
    + " ELSE 'Unknown (' || user_id % 13 || ')' END AS vulnerability_name FROM events")
def enrich_class(spark, d):
    events = B.table(spark, d, "events").select("event_id", "user_id", (F.col("user_id") % 13).cast("int").alias("vuln_class"))
    return fnd.enrich_class(events, vuln_classes(spark)).select("event_id", "user_id", "vulnerability_name")


@query("class_lookup", f"""WITH {B.CLASSES_SQL}
SELECT event_id, coalesce(cwe_id, 'Unknown') AS cwe_id, coalesce(owasp, 'Unknown') AS owasp,
  coalesce(severity, 'medium') AS class_severity, coalesce(array_to_string(remediation, ' / '), '') AS remediation
FROM events LEFT JOIN classes ON user_id % 13 = vuln_class""")
def class_lookups(spark, d):
    events = B.table(spark, d, "events").select("event_id", (F.col("user_id") % 13).cast("int").alias("vuln_class"))
    return class_lookup(events, vuln_classes(spark)).select(
        "event_id", "cwe_id", "owasp", "class_severity", F.concat_ws(" / ", "remediation").alias("remediation"))


@query("rank_findings", _sql(f"SELECT file_id, vuln_class, line, row_number() OVER (PARTITION BY file_id ORDER BY {_RANK}, "
                             "confidence DESC, seq) AS position FROM scanned"))
def rank_findings(spark, d):
    return scan_by_file(B.code(spark, d), RULES).findings(position=True).select("file_id", "vuln_class", "line", "position")


@query("order_findings", _sql(f"SELECT path, vuln_class, line, severity FROM scanned ORDER BY path, {_RANK}, confidence DESC, seq"))
def order_findings(spark, d):
    return fnd.order_findings(scanned(spark, d)).select("path", "vuln_class", "line", "severity")


@query("severity_counts", _sql("SELECT s.severity, count(m.severity) AS n FROM (VALUES ('critical'), ('high'), ('medium'), ('low')) "
                               "s(severity) LEFT JOIN scanned m ON m.severity = s.severity GROUP BY 1"))
def severity_counts(spark, d):
    return fnd.severity_counts(scanned(spark, d))


@query("severity_by_class", _sql("SELECT vulnerability_name, severity, count(*) AS n, round(avg(confidence), 6) AS confidence "
                                 "FROM scanned GROUP BY 1, 2"))
def severity_by_class(spark, d):
    return scanned(spark, d).groupBy("vulnerability_name", "severity").agg(
        F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query("vulnerability_counts", _sql("SELECT vulnerability_name, count(*) AS n FROM scanned GROUP BY 1"))
def vulnerability_counts(spark, d):
    return fnd.vulnerability_counts(scanned(spark, d))


@query("order_counts", _sql("SELECT vulnerability_name, count(*) AS n FROM scanned GROUP BY 1 ORDER BY n DESC, 1"))
def order_counts(spark, d):
    return fnd.order_counts(fnd.vulnerability_counts(scanned(spark, d)), "vulnerability_name")


@query("breakdown", _sql("SELECT vulnerability_name, n, round(n * 100.0::DOUBLE / max(n) OVER (), 6) AS width FROM "
                         "(SELECT vulnerability_name, count(*) AS n FROM scanned GROUP BY 1)"))
def breakdown(spark, d):
    return fnd.breakdown(scanned(spark, d))


@query("file_counts", _sql("SELECT c.file_id, c.path, count(s.file_id) AS n FROM code c LEFT JOIN scanned s USING (file_id) GROUP BY 1, 2"))
def file_counts(spark, d):
    return fs.file_counts(scan_by_file(B.code(spark, d), RULES).files)


@query("file_results", _sql(f"""SELECT c.file_id, c.path, count(s.file_id)::INT AS count,
  coalesce(string_agg(s.line || ':' || s.vuln_class, ',' ORDER BY {_RANK}, s.confidence DESC, s.seq), '') AS findings
FROM code c LEFT JOIN scanned s USING (file_id) GROUP BY 1, 2"""))
def file_results(spark, d):
    rows = scan_by_file(B.code(spark, d), RULES).results()
    return rows.withColumn("findings", F.concat_ws(",", F.transform(
        "findings", lambda f: F.concat_ws(":", f.line, f.vuln_class))))


@query("clean_files", _sql("SELECT file_id, path FROM code WHERE file_id NOT IN (SELECT file_id FROM scanned)"))
def clean_files(spark, d):
    return fs.clean_files(scan_by_file(B.code(spark, d), RULES).files)


@query("scan_summary", _sql("""SELECT (SELECT count(*) FROM code) AS files_total, (SELECT count(*) FROM code) AS files_scanned,
  0 AS errors, count(*) AS total_findings, count(*) FILTER (severity = 'critical') AS critical,
  count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium,
  count(*) FILTER (severity = 'low') AS low, false AS ml_enabled, true AS rules_enabled, true AS flow_enabled,
  """ + str(len(RULES)) + """ AS total_rules,
  CASE WHEN count(*) FILTER (severity = 'critical') > 0 THEN 2 WHEN count(*) > 0 THEN 1 ELSE 0 END AS exit_code
FROM scanned"""))
def scan_summary(spark, d):
    return fs.scan_summary(scan_by_file(B.code(spark, d), RULES).files, len(RULES), ml=False, rules=True, flow=True)


@query("findings_by_file", _sql("""SELECT path, line, vulnerability_name, upper(severity) AS severity,
  printf('%.1f%%', confidence * 100) AS confidence, message, cwe_id, owasp, source, rule_id, remediation[1] AS fix FROM scanned"""))
def findings_by_file(spark, d):
    return reports.findings_by_file(scanned(spark, d))


@query("rules_summary", f"""WITH {B.CLASSES_SQL}, {B.values('rules', 'vuln_class', [(r.vuln_class,) for r in RULES])},
{B.CODE_SQL}
SELECT c.vuln_class, c.name AS vulnerability_name, count(r.vuln_class) AS n, (SELECT count(*) FROM code) AS files
FROM classes c LEFT JOIN rules r USING (vuln_class) GROUP BY 1, 2""")
def rules_summary(spark, d):
    """Rules per class beside the number of files they are applied to."""
    files = B.code(spark, d).agg(F.count("*").alias("files"))
    return fnd.rules_summary(rule_catalog(spark), vuln_classes(spark)).crossJoin(F.broadcast(files))


@query("rule_hits", S.with_ctes(
    B.CODE_SQL, S.found(D.rule_checks(RULES)), B.values("rules", "rule_id, vuln_class, message", [
        (r.rule_id, r.vuln_class, r.message) for r in RULES]),
    select="SELECT r.rule_id, r.message, count(f.rule_id) AS n FROM rules r LEFT JOIN found f USING (rule_id) "
           "GROUP BY 1, 2"))
def rule_hits(spark, d):
    """Hits of the catalogue rows, class by class, zero where a rule never matched."""
    rules = rule_catalog(spark, RULES)
    classes = sorted({r.vuln_class for r in RULES})
    chosen = reduce(DataFrame.unionByName, [rules_by_class(rules, c) for c in classes]).select("rule_id", "message")
    hits = D.rule_scan(B.code(spark, d), RULES).groupBy("rule_id").agg(F.count("*").alias("n"))
    return F.broadcast(chosen).join(hits, "rule_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


@query("model_findings", f"""WITH {B.SCORES_SQL}, {B.CLASSES_SQL}
SELECT sample_id AS file_id, 'vec/' || sample_id AS path, class_id AS vuln_class, 0 AS line,
  'ML model detected potential ' || name AS message, severity, round(prob * 0.9::DOUBLE, 6) AS confidence, 'ml_model' AS source
FROM scores JOIN classes ON class_id = vuln_class WHERE prob >= 0.5""")
def model_findings(spark, d):
    rows = B.scores(spark, d).select(
        F.col("sample_id").alias("file_id"), F.concat(F.lit("vec/"), "sample_id").alias("path"), "class_id", "prob",
        F.lit(0.9).alias("confidence"))
    return rounded(fnd.model_findings(rows, vuln_classes(spark)).drop("rule_id", "matched_text", "seq"))


_MODEL = f"""{B.SCORES_SQL}, model AS (
  SELECT sample_id AS file_id, path, class_id AS vuln_class, 0 AS line, 'ML model detected potential ' || name AS message,
    severity, prob * 0.9::DOUBLE AS confidence, 'ml_model' AS source, '' AS rule_id, '' AS matched_text,
    class_id::BIGINT * {D.SEQ_STEP} AS seq
  FROM scores JOIN classes ON class_id = vuln_class JOIN code ON file_id = sample_id WHERE prob >= 0.5)"""
_BOTH = S.MERGED.replace("found", "from_both").replace("merged AS", "merged_all AS")


@query("scan_with_model", S.with_ctes(*_FOUND, B.CLASSES_SQL, _MODEL, f"""from_both AS (
  SELECT {', '.join(fnd.FINDING_COLUMNS)} FROM found UNION ALL SELECT {', '.join(fnd.FINDING_COLUMNS)} FROM model)""", _BOTH,
    select=S.FINDING_SELECT + " FROM merged_all WHERE confidence >= 0.5"))
def scan_with_model(spark, d):
    """The scan of the corpus merged with model scores: the vectors' scores stand for those of the files they share a number with."""
    files = B.code(spark, d)
    scores = B.scores(spark, d).withColumnRenamed("sample_id", "file_id").join(files.select("file_id", "path"), "file_id").select(
        "file_id", "path", "class_id", "prob", F.lit(0.9).alias("confidence"))
    return rounded(scan(files, RULES, model_scores=scores).select(*fnd.FINDING_COLUMNS))
