"""Times the headline queries and prints one JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default all),
``BENCH_QUERIES`` (comma-separated names, default the list below), ``BENCH_AS_GIVEN`` (set: read the
tables as they lie).

Each given table is one Parquet row group, so a stage that reads texts would run in one task.
Before the clock starts the tables are written once with ``GROUPS`` row groups each, as tables of any
size have them; the rows and their order are the same.
"""

from __future__ import annotations

import glob
import json
import os
import shutil
import sys
import tempfile
import time

import pyarrow.parquet as pq

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vulnsieve.session import build_session  # noqa: E402
from workloads import QUERIES  # noqa: E402

HEADLINE = [
    "rule_scan_documents", "rule_scan", "rule_scan_lookaround", "secret_scan_documents", "rule_scan_pages",
    "flow_scan", "reverse_scan", "scan", "severity_by_class", "rank_findings", "file_results", "clean_files",
    "detect_language", "normalize", "token_counts", "encode", "chunk", "extract_functions",
    "parse_manifests", "distinct_deps", "match_osv", "dep_summary", "flatten_cve", "enrich_kev", "combine_repo",
    "labelled_corpus", "split_dataset", "per_class_metrics", "roc_auc",
]


GROUPS = 32


def in_row_groups(sf_dir: str, target: str) -> str:
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        if os.path.isfile(path):
            table = pq.read_table(path)
            pq.write_table(table, f"{target}/{os.path.basename(path)}", row_group_size=max(1, -(-table.num_rows // GROUPS)))
        else:
            os.symlink(path, f"{target}/{os.path.basename(path)}")
    return target


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    as_given = bool(os.environ.get("BENCH_AS_GIVEN"))
    scratch = tempfile.mkdtemp(prefix="bench-")
    read_dir = sf_dir if as_given else in_row_groups(sf_dir, scratch)
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        f"local[{cpus}]", "bench", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # starts the executor threads
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, read_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    shutil.rmtree(scratch)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "input": "as given" if as_given else f"{GROUPS} row groups a table",
    }))


if __name__ == "__main__":
    main()
