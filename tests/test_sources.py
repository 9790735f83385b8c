"""Files, manifests, sinks, streams and session settings on a scratch folder."""

import json
import os

from pyspark.sql import functions as F

from vulnsieve.catalog.rules import RULES
from vulnsieve.operators import file_scan as fs, findings as fnd, reports
from vulnsieve.plans.deps import scan_dependencies
from vulnsieve.plans.scan import scan, scan_by_file
from vulnsieve.session import checkpoint_dir
from vulnsieve.sources import files as src
from vulnsieve.streaming.incremental import read_code_stream, scan_stream


def write(root, path, data):
    target = root / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(data if isinstance(data, bytes) else data.encode())


def test_read_code_files(spark, tmp_path):
    write(tmp_path, "b/z.py", "os.system(1)\r\nx\ry")
    write(tmp_path, "a.JS", "x")
    write(tmp_path, "b/sp ace+%.go", "y")
    write(tmp_path, "latin.php", "caf\xe9".encode("latin-1"))
    write(tmp_path, "notes.txt", "n")
    write(tmp_path, "node_modules/m/i.js", "n")
    write(tmp_path, "b/vendor/v.go", "n")
    write(tmp_path, "big.c", b"x" * (6 * 1024 * 1024))
    write(tmp_path, "limit.c", b"x" * (5 * 1024 * 1024))
    rows = {os.path.relpath(r.path, tmp_path): r.content for r in src.read_code_files(spark, str(tmp_path)).collect()}
    assert sorted(rows) == ["a.JS", "b/sp ace+%.go", "b/z.py", "big.c", "latin.php", "limit.c"]
    assert len(rows["big.c"]) == 6 * 1024 * 1024
    limit = 5 * 1024 * 1024
    small = src.read_code_files(spark, str(tmp_path), max_bytes=limit).select("path").collect()
    assert len(small) == 5
    assert [tuple(r)[1:] for r in src.skipped_files(spark, str(tmp_path), limit).collect()] == [
        (6 * 1024 * 1024, f"larger than {limit} bytes")]
    assert rows["b/z.py"] == "os.system(1)\nx\ny" and rows["latin.php"] == "café"
    flat = src.read_code_files(spark, str(tmp_path), recursive=False).select("path").collect()
    assert sorted(os.path.relpath(r.path, tmp_path) for r in flat) == ["a.JS", "big.c", "latin.php", "limit.c"]
    first = src.read_code_files(spark, str(tmp_path), max_files=2).select("path").collect()
    assert sorted(os.path.relpath(r.path, tmp_path) for r in first) == ["a.JS", "b/sp ace+%.go"]
    only = src.read_code_files(spark, str(tmp_path), extensions=[".php"], max_files=None).collect()
    assert len(only) == 1 and src.read_code_files(spark, str(tmp_path / "b" / "z.py")).count() == 1
    assert scan(src.read_code_files(spark, str(tmp_path))).filter("rule_id = 'CMD001'").count() == 1
    assert [r.path for r in src.order_files(src.read_code_files(spark, str(tmp_path))).select("path").collect()] == sorted(
        str(tmp_path / p) for p in rows)


def test_many_files_are_all_read(spark, tmp_path):
    for i in range(10_001):
        (tmp_path / f"f{i}.py").write_text("x")
    assert src.read_code_files(spark, str(tmp_path), decode=False).select("path").count() == 10_001


def test_skipped_names_above_the_root_do_not_count(spark, tmp_path):
    write(tmp_path, "build/project/a.py", "x")
    assert src.read_code_files(spark, str(tmp_path / "build" / "project")).count() == 1


def test_pruned_before_reading(spark, tmp_path):
    write(tmp_path, "a.py", "x")
    write(tmp_path, "venv/b.py", "x")
    plan = src.read_code_files(spark, str(tmp_path), max_bytes=10)._jdf.queryExecution().executedPlan().toString()
    scan_line = next(line for line in plan.split("\n") if "FileScan binaryFile" in line)
    assert "file_size" in scan_line and "arrays_overlap" in scan_line


def test_read_manifests(spark, tmp_path):
    for path in ("requirements.txt", "web/package.json", "venv/requirements.txt", "a/b/go.mod", "web/other.json"):
        write(tmp_path, path, "x")
    rows = src.read_manifests(spark, str(tmp_path)).collect()
    assert sorted((r.path, r.file_name) for r in rows) == [("requirements.txt", "requirements.txt"), ("web/package.json", "package.json")]


def test_reports(spark, tmp_path, files_of):
    files = files_of(("a.py", "os.system(x)\nimport random"), ("b.txt", "clean"))
    scanned = scan_by_file(files)
    found = scan(files)
    totals = reports.write_json_report(scanned, str(tmp_path / "report"), len(RULES))
    assert totals["files_total"] == 2 and totals["total_findings"] == found.count()
    assert spark.read.json(str(tmp_path / "report" / "findings")).count() == found.count()
    document = json.loads(spark.read.text(str(tmp_path / "report" / "summary")).first().value)
    assert document["scan_summary"] == fnd.scan_summary(files, found, len(RULES), False, True, True).first().asDict()
    assert document["scan_summary"] == fs.scan_summary(scanned.files, len(RULES), False, True, True).first().asDict()
    assert document["report_metadata"]["format"] == "json"
    rows = reports.findings_by_file(found).collect()
    assert rows[0].severity == "CRITICAL" and rows[0].confidence.endswith("%") and rows[0].fix
    empty = reports.write_json_report(scan_by_file(files.limit(0)), str(tmp_path / "none"), len(RULES))
    assert empty["files_total"] == empty["total_findings"] == 0
    assert json.loads(spark.read.text(str(tmp_path / "none" / "summary")).first().value)["scan_summary"]["exit_code"] == 0


def test_report_reads_the_corpus_once(spark, tmp_path, files_of):
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    files = files_of(*[(f"f{i}.py", "eval(x)\n" * i) for i in range(9)])
    counted = files.mapInArrow(seen, files.schema)
    reports.write_json_report(scan_by_file(counted), str(tmp_path / "once"), len(RULES))
    assert reads.value == 9


def test_dependency_report(spark, tmp_path):
    manifests = spark.createDataFrame([("p", "requirements.txt", "requirements.txt", "a==1\nb"), ("q", "Gemfile", "Gemfile", "")],
                                      "project string, path string, file_name string, content string")
    osv = spark.createDataFrame([("1", "a", "PyPI", [], "s", "H", [(None, "2")])],
                                "vuln_id string, package string, ecosystem string, cve_ids array<string>, summary string, severity string, "
                                "affected_ranges array<struct<introduced:string,fixed:string>>")
    reports.write_dep_json(scan_dependencies(manifests, osv), str(tmp_path / "deps"))
    read = {n: spark.read.json(str(tmp_path / "deps" / n)).collect() for n in ("dependencies", "summary", "vulnerabilities")}
    assert sorted((r.name, r.n_vulnerabilities) for r in read["dependencies"]) == [("a", 1), ("b", 0)]
    assert [(r.project, r.vuln_id) for r in read["vulnerabilities"]] == [("p", "1")]
    assert sorted((r.project, r.total_dependencies) for r in read["summary"]) == [("p", 2), ("q", 0)]


def test_stream_equals_batch(spark, tmp_path, files_of):
    a = files_of(("a.py", "os.system(x)"), ("b.py", "eval(input())"))
    b = files_of(("c.c", "strcpy(a, b);")).withColumn("file_id", F.lit(9).cast("long"))
    inbox, sink, seen = str(tmp_path / "in"), str(tmp_path / "out"), {}
    options = dict(checkpoint=str(tmp_path / "cp"), on_batch=lambda i, m: seen.__setitem__(i, m["findings"]))
    for part in (a, b):
        part.coalesce(1).write.mode("append").parquet(inbox)
        scan_stream(read_code_stream(spark, inbox), sink, **options).awaitTermination(120)
    streamed = spark.read.parquet(sink).drop("batch_id")
    batch = scan(a.unionByName(b)).select(*streamed.columns)
    assert sorted(map(str, streamed.collect())) == sorted(map(str, batch.collect()))
    assert len(seen) == 2 and sum(seen.values()) == streamed.count()


def test_stream_of_code_files(spark, tmp_path):
    """Files that arrive in two batches, a restart between them: the findings of one batch scan, none lost or doubled."""
    tree, sink, point = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "cp")
    tree.mkdir()
    write(tree, "a.py", "os.system(x)\r\neval(input())")
    write(tree, "sub/b.c", "strcpy(a, b);")
    write(tree, "node_modules/skipped.js", "eval(x)")
    write(tree, "notes.txt", "eval(x)")

    def run():
        scan_stream(src.read_code_file_stream(spark, str(tree)), sink, point).awaitTermination(120)
        return spark.read.parquet(sink).select("path", "line", "vuln_class", "message").collect()

    first = run()
    assert {os.path.basename(r.path) for r in first} == {"a.py", "b.c"}
    assert sorted(run()) == sorted(first)  # a restart without new files
    write(tree, "sub/c.py", "import pickle\npickle.loads(input())")
    streamed = run()
    batch = scan(src.read_code_files(spark, str(tree))).select("path", "line", "vuln_class", "message").collect()
    assert sorted(streamed) == sorted(batch) and len(batch) > len(first)


def test_checkpoint_folder_is_the_named_one(spark):
    assert checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert spark.sparkContext.getCheckpointDir().removeprefix("file:").startswith(checkpoint_dir(spark))
