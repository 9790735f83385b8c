"""Code-security analytics as Spark jobs."""

from vulnsieve.operators.detect import flow_scan, reverse_scan, rule_scan, secret_scan
from vulnsieve.operators.findings import merge_findings
from vulnsieve.plans.deps import scan_dependencies
from vulnsieve.plans.repos import scan_repositories
from vulnsieve.plans.scan import detect_all, scan
from vulnsieve.session import build_session
from vulnsieve.sources.files import read_code_files, read_manifests
from vulnsieve.sources.tables import code_from_table

__all__ = [
    "build_session", "code_from_table", "detect_all", "flow_scan", "merge_findings", "read_code_files",
    "read_manifests", "reverse_scan", "rule_scan", "scan", "scan_dependencies", "scan_repositories", "secret_scan",
]
