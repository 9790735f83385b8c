"""Flow checks, reverse checks, merging, order and counts."""

from vulnsieve import schemas
from vulnsieve.catalog.rules import RULES
from vulnsieve.operators import detect, file_scan as fs, findings as fnd
from vulnsieve.plans.scan import detect_all, scan, scan_by_file
from vulnsieve.sources.dimensions import class_lookup, rule_catalog, vuln_classes
from workloads import base as B


def finding(file_id=1, vuln_class=2, line=3, message="m", severity="low", confidence=0.6, source="a", seq=0):
    return (file_id, f"f{file_id}", vuln_class, line, message, severity, confidence, source, "", "", seq)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.FINDINGS)


def test_merge_boost_ties_and_sources(spark):
    merged = {r.vuln_class: r for r in fnd.merge_findings(table(
        spark,
        finding(vuln_class=0, confidence=0.6, source="b", seq=1), finding(vuln_class=0, confidence=0.6, source="a", message="late", seq=2),
        finding(vuln_class=1, confidence=0.8, seq=5, message="late"), finding(vuln_class=1, confidence=0.8, seq=4, message="early"),
        finding(vuln_class=2, confidence=0.9, source="x"), finding(vuln_class=2, confidence=0.7, source="y", seq=9),
        finding(vuln_class=3, confidence=0.4),
    )).collect()}
    assert round(merged[0].confidence, 9) == 0.78 and merged[0].source == "a + b" and merged[0].message == "m"
    assert merged[1].message == "early" and merged[1].confidence == 0.8 and merged[1].source == "a"
    assert merged[2].confidence == 0.99
    assert merged[3].confidence == 0.4


def test_threshold_is_inclusive_and_after_the_boost(spark):
    rows = table(spark, finding(confidence=0.5), finding(vuln_class=4, confidence=0.4, source="a"),
                 finding(vuln_class=4, confidence=0.4, source="b", seq=1), finding(vuln_class=5, confidence=0.49))
    kept = fnd.threshold(fnd.merge_findings(rows)).collect()
    assert sorted(r.vuln_class for r in kept) == [2, 4]


def test_flow_checks(files_of):
    code = 'import os\nos.system("rm " + input())\neval(user_input)'
    rows = detect.flow_scan(files_of(("t.py", code))).collect()
    sources = {(r.source, r.line) for r in rows}
    assert ("code_analysis", 2) in sources and ("data_flow", 2) in sources and ("missing_control", 0) in sources
    merged = scan(files_of(("t.py", code)), modules=["flow"]).filter("line = 2").collect()
    assert [round(r.confidence, 6) for r in merged] == [0.91]


def test_sinks_need_a_source(files_of):
    assert detect.data_flow(files_of(("t.py", "eval(x)"), ("t.rb", "eval(input())"))).count() == 0


def test_language_of_flow_is_by_content(files_of):
    rows = detect.flow_scan(files_of(("noext", "def f(a):\n    import x\n    eval(a)"))).collect()
    assert any(r.source == "code_analysis" for r in rows)


def test_missing_controls(files_of):
    rows = detect.missing_controls(files_of(
        ("a.py", "from django import x\n# settings\nlogging"), ("b.py", "from flask import Flask\ncsrf logger"),
        ("c.js", "const e = require('express'); // Helmet"), ("d.js", "app.get(1)\ncors helmet rate"))).collect()
    by_file = {}
    for r in rows:
        by_file.setdefault(r.file_id, set()).add(r.message.split(":")[0] + str(r.message.count("CORS")))
    assert len([r for r in rows if r.file_id == 0]) == 2
    assert not [r for r in rows if r.file_id == 1]
    assert len([r for r in rows if r.file_id == 2]) == 2
    assert not [r for r in rows if r.file_id == 3]


def test_reverse_checks(files_of):
    rows = detect.reverse_scan(files_of(
        ("a.py", "@app.route('/admin/x')\n@app.route('/open')\n"),
        ("b.py", "if DEBUG:\n  x: the\n  route"), ("c.c", "x = 0xFF; goto end;"), ("d.bin", "\0\0password=hunter2 tail\0"),
        ("e.py", "a route with a token"))).collect()
    found = {(r.file_id, r.source) for r in rows}
    assert {(0, "endpoint_discovery"), (1, "hidden_route_detection"), (2, "decompiled_logic_analysis"),
            (3, "binary_inspection"), (0, "api_inference"), (1, "api_inference")} <= found
    assert (4, "api_inference") not in found
    assert [r.message for r in rows if r.source == "endpoint_discovery"] == ["Potentially sensitive endpoint discovered: /admin/x"]
    binary = [r for r in rows if r.source == "binary_inspection"]
    assert binary[0].line == 0 and binary[0].message.endswith("'password=hunter2 tail...'")


def test_binary_strings(spark):
    data = spark.createDataFrame(
        [(1, "a.dat", bytearray(b"\x00\xff" + b"Bearer abcdef\x01secret=1")), (2, "b.txt", bytearray(b"secret=1")),
         (3, "c.class", bytearray("é secret=2".encode("latin-1"))), (4, "d.dat", bytearray(b"x" * 1024 + b"\0secret=1"))],
        "file_id long, path string, content binary")
    assert sorted((r.file_id, r.message) for r in detect.binary_strings(data).collect()) == [
        (1, "Potential hardcoded secret found in binary: 'Bearer abcdef...'"),
        (1, "Potential hardcoded secret found in binary: 'secret=1...'"),
        (3, "Potential hardcoded secret found in binary: ' secret=2...'")]


def test_own_scans_union_in(spark, files_of):
    own = table(spark, finding(file_id=0, vuln_class=77, confidence=0.9, severity="high", source="mine"))
    rows = scan(files_of(("a.txt", "nothing")), extra=[own]).collect()
    assert [r.vulnerability_name for r in rows] == ["Unknown (77)"] and rows[0].remediation == []


def test_order_and_counts(spark, files_of):
    rows = table(spark, finding(line=1, severity="low", confidence=0.9), finding(line=2, severity="critical", confidence=0.5, seq=1),
                 finding(line=3, severity="critical", confidence=0.8, seq=2), finding(line=4, severity="odd", seq=3))
    assert {r.line: r.position for r in fnd.rank_findings(rows).collect()} == {3: 1, 2: 2, 1: 3, 4: 4}
    assert [r.line for r in fnd.order_findings(rows).collect()] == [3, 2, 1, 4]
    assert {r.severity: r.n for r in fnd.severity_counts(rows).collect()} == {"critical": 2, "high": 0, "medium": 0, "low": 1}
    files = files_of(("f0", "x"), ("f1", "y"))
    assert {r.file_id: r["count"] for r in fnd.file_results(files, rows).collect()} == {0: 0, 1: 4}
    assert [r.path for r in fnd.clean_files(files, rows).collect()] == ["f0"]
    summary = fnd.scan_summary(files, rows, len(RULES), False, True, True).first()
    assert (summary.files_total, summary.total_findings, summary.exit_code) == (2, 4, 2)
    assert fnd.scan_summary(files, rows.limit(0), 110, False, True, True).first().exit_code == 0


def test_model_findings(spark):
    scores = spark.createDataFrame([(1, "p", 0, 0.5, 0.5), (1, "p", 10, 0.49, 1.0)],
                                   "file_id long, path string, class_id int, prob double, confidence double")
    rows = fnd.model_findings(scores, vuln_classes(spark)).collect()
    assert [(r.vuln_class, r.line, r.severity, r.confidence, r.seq) for r in rows] == [(0, 0, "critical", 0.25, 0)]


def test_dimensions(spark):
    assert rule_catalog(spark).count() == 110
    assert {r.n for r in fnd.rules_summary(rule_catalog(spark), vuln_classes(spark)).filter("vuln_class = 4").collect()} == {18}
    rows = class_lookup(spark.createDataFrame([(3,), (99,)], "vuln_class int"), vuln_classes(spark)).collect()
    assert {r.vuln_class: r.class_severity for r in rows} == {3: "high", 99: "medium"}


def test_no_shuffle_in_a_scan(files_of):
    plan = scan(files_of(("a.py", "x")))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Sort" not in plan


def test_scan_by_file_equals_the_shuffled_merge(spark, files_of):
    snippets = [(f"s{i}{ext}", code) for i, ext, code in B.SNIPPETS]
    lines = "\n".join(code for *_, code in B.SNIPPETS)
    files = files_of(*snippets, ("all.py", lines), ("all.js", lines), ("twice.py", "\n".join([lines] * 3)), ("a.py", ""), ("b.py", None),
                     ("marks.py", "eval(x) \ufdd0 \ufdd1 eval(y)\n\ufdd2"), ("x.so", "password = hidden\0secret_key_1234"),
                     ("routes.py", "@app.route('/admin/keys')\n@app.route('/open')"), ("one.c", "strcpy(a, b); strcpy(c, d);"))
    merged = fnd.merge_findings(detect_all(files))
    scanned = scan_by_file(files, at=0.0)
    rows = scanned.findings().select(*fnd.FINDING_COLUMNS)
    assert sorted(map(repr, map(tuple, rows.collect()))) == sorted(map(repr, map(tuple, merged.select(*rows.columns).collect())))
    assert rows.filter("source like '% + %'").count() > 0 and rows.filter("line = 0").count() > 0
    found = scan(files)
    ranked = {(r.file_id, r.vuln_class, r.line): r.position for r in fnd.rank_findings(found).collect()}
    by_file = scan_by_file(files)
    assert {(r.file_id, r.vuln_class, r.line): r.position for r in by_file.findings(position=True).collect()} == ranked
    old = {r.file_id: (r["count"], [(f.line, f.vuln_class, f.message) for f in r.findings]) for r in fnd.file_results(files, found).collect()}
    new = {r.file_id: (r["count"], [(f.line, f.vuln_class, f.message) for f in r.findings]) for r in by_file.results().collect()}
    assert old == new
    assert sorted(r.path for r in fs.clean_files(by_file.files).collect()) == sorted(r.path for r in fnd.clean_files(files, found).collect())
    assert sorted(map(tuple, fs.file_counts(by_file.files).collect())) == sorted(map(tuple, fnd.file_counts(files, found).collect()))
    assert fs.scan_summary(by_file.files, 7, True, True, False).first() == fnd.scan_summary(files, found, 7, True, True, False).first()
    assert scan_by_file(files.limit(0)).findings().count() == 0


def test_scan_merges_model_scores(spark, files_of):
    files = files_of(("a.py", "eval(x)"), ("b.py", "fine"))
    scores = spark.createDataFrame([(0, "a.py", 5, 0.9, 1.0), (1, "b.py", 0, 0.8, 0.9), (1, "b.py", 1, 0.3, 1.0)],
                                   "file_id long, path string, class_id int, prob double, confidence double")
    found = scan(files, model_scores=scores).collect()
    model = sorted((r.path, r.vuln_class, r.line) for r in found if r.source == "ml_model")
    assert model == [("a.py", 5, 0), ("b.py", 0, 0)]
    assert any(r.source != "ml_model" for r in found)


def test_unmerged_scan_equals_the_modules_apart(files_of):
    files = files_of(("a.py", "import pickle\npickle.loads(input())\n0xF"), ("b.txt", "eval(request)"))
    together = sorted(map(tuple, detect_all(files).collect()))
    apart = sorted(map(tuple, fnd.union_findings(detect.rule_scan(files), detect.flow_scan(files), detect.reverse_scan(files)).collect()))
    assert together == apart
