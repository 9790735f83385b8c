"""Explicit schemas of the tables that flow between operators."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


CODE_FILES = _struct(file_id=_L, path=_S, content=_S)

RULES = _struct(
    rule_idx=_I, rule_id=_S, vuln_class=_I, pattern=_S, message=_S, severity=_S,
    languages=T.ArrayType(_S), confidence=_D, anchors=T.ArrayType(T.ArrayType(_S)),
)

VULN_CLASSES = _struct(
    vuln_class=_I, name=_S, cwe_id=_S, cwe_name=_S, owasp=_S, severity=_S,
    description=_S, impact=_S, remediation=T.ArrayType(_S),
)

FINDINGS = _struct(
    file_id=_L, path=_S, vuln_class=_I, line=_I, message=_S, severity=_S,
    confidence=_D, source=_S, rule_id=_S, matched_text=_S, seq=_L,
)
FINDING_COLUMNS = FINDINGS.fieldNames()

DEPENDENCIES = _struct(project=_S, name=_S, version=_S, ecosystem=_S, source=_S, dep_type=_S)

SCORES = _struct(sample_id=_L, class_id=_I, prob=_D, confidence=_D, label=_I)

# ── raw JSON feeds ──────────────────────────────────────────────────────────
_LANG_VALUE = T.ArrayType(_struct(lang=_S, value=_S))

CVE_FEED = _struct(vulnerabilities=T.ArrayType(_struct(cve=_struct(
    id=_S,
    published=_S,
    descriptions=_LANG_VALUE,
    metrics=_struct(cvssMetricV31=T.ArrayType(_struct(
        cvssData=_struct(baseScore=_D, baseSeverity=_S, vectorString=_S)))),
    weaknesses=T.ArrayType(_struct(description=_LANG_VALUE)),
    references=T.ArrayType(_struct(url=_S, source=_S, tags=T.ArrayType(_S))),
))))

OSV_FEED = _struct(vulns=T.ArrayType(_struct(
    id=_S, summary=_S, details=_S, aliases=T.ArrayType(_S), published=_S, modified=_S,
    severity=T.ArrayType(_struct(type=_S, score=_S)),
    references=T.ArrayType(_struct(type=_S, url=_S)),
    affected=T.ArrayType(_struct(
        package=_struct(name=_S, ecosystem=_S),
        ranges=T.ArrayType(_struct(type=_S, events=T.ArrayType(_struct(introduced=_S, fixed=_S, last_affected=_S)))),
        versions=T.ArrayType(_S),
    )),
)))

KEV_FEED = _struct(vulnerabilities=T.ArrayType(_struct(
    cveID=_S, vendorProject=_S, product=_S, vulnerabilityName=_S, shortDescription=_S,
    dateAdded=_S, dueDate=_S, requiredAction=_S, knownRansomwareCampaignUse=_S, notes=_S,
)))

REPO_RECORD = _struct(
    full_name=_S, description=_S, language=_S, default_branch=_S,
    stargazers_count=_L, forks_count=_L, open_issues_count=_L,
    created_at=_S, updated_at=_S, license=_struct(spdx_id=_S), topics=T.ArrayType(_S),
    visibility=_S, archived=_B, clone_url=_S, html_url=_S,
)

ADVISORY_FEED = T.ArrayType(_struct(
    ghsa_id=_S, cve_id=_S, summary=_S, severity=_S, state=_S, published_at=_S,
    vulnerabilities=T.ArrayType(_struct(
        package=_struct(name=_S, ecosystem=_S),
        vulnerable_version_range=_S, patched_versions=_S,
    )),
))
