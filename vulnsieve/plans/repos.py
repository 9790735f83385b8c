"""Repository reports: code scan, dependency scan and advisories per repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from vulnsieve.operators import file_scan as fs, intel
from vulnsieve.plans.deps import scan_dependencies
from vulnsieve.plans.scan import scan_by_file


def scan_repositories(
    repos: DataFrame, files: DataFrame, manifests: DataFrame, osv: DataFrame, advisories: DataFrame, repo_of_path: Column,
    detail: bool = False, n: int = 20,
) -> DataFrame:
    """One row per repository, with its first ``n`` vulnerabilities and its advisories if ``detail`` is asked for.

    ``repo_of_path`` tells the repository of a file's path.
    """
    per_file = fs.file_counts(scan_by_file(files).files).withColumn("repo", repo_of_path)
    done = scan_dependencies(manifests, osv)
    return intel.combine_repo(
        repos, per_file, done.summary, advisories, done.first_vulnerabilities(n) if detail else None, n)
