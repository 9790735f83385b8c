"""Lists of first matches, files of their own and reports that were rewritten to scale."""

import hashlib
import os
import random

from pyspark.sql import Observation
from pyspark.sql import functions as F

from vulnsieve.operators import intel, learn, reports
from vulnsieve.operators.prefix import alike, first_intervals
from vulnsieve.sources import files as src
from workloads import QUERIES, sinks

OSV = ("vuln_id string, package string, ecosystem string, cve_ids array<string>, summary string, severity string, "
       "affected_ranges array<struct<introduced:string,fixed:string>>")


def test_first_intervals_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    points = [(rng.choice(["hot", "hot", "x", "y", None]), rng.choice([None, *range(40)])) for _ in range(200)]
    spans = [(rng.choice(["hot", "hot", "x", "z", None]), rng.choice([None, *range(40)]), rng.choice([None, *range(45)]), i) for i in range(300)]
    left = spark.createDataFrame(points, "k string, at int")
    right = spark.createDataFrame(spans, "k string, low int, high int, s long")
    for n in (1, 4, 500):
        got = sorted((r.k, r["at"], r.s) for r in first_intervals(left, right, ["k"], "at", "low", "high", [F.col("s").desc()], n).collect())
        plain = []
        for k, at in {(k, at) for k, at in points if None not in (k, at)}:
            hits = sorted((s for key, low, high, s in spans if key == k and None not in (low, high) and low <= at < high), reverse=True)
            plain += [(k, at, s) for s in hits[:n]]
        assert got == sorted(plain) and len(plain) >= 50
    assert first_intervals(left.limit(0), right, ["k"], "at", "low", "high", [F.col("s")], 2).count() == 0
    assert first_intervals(left, right.limit(0), ["k"], "at", "low", "high", [F.col("s")], 2).count() == 0


def test_positions_without_a_bound_between_them_are_alike(spark):
    points = spark.createDataFrame([("k", i) for i in (0, 1, 2, 2, 3, 5, 6, 9)] + [("other", 4), (None, 1), ("k", None)], "k string, at int")
    spans = spark.createDataFrame([("k", 2, 6), ("k", 2, 7), ("k", 5, None), (None, 1, 2)], "k string, low int, high int")
    got = {(r.k, r["at"]): r["_like"] for r in alike(points, spans, ["k"], "at", "low", "high").collect()}
    assert got == {("k", 0): 0, ("k", 1): 0, ("k", 2): 2, ("k", 3): 2, ("k", 5): 5, ("k", 6): 6, ("k", 9): 9, ("other", 4): 4}


def test_first_matches_do_not_build_all_pairs(spark, monkeypatch):
    """400 versions and 300 records that affect them all: 120,000 pairs, of which lists of three hold 1,200."""
    deps = spark.createDataFrame([(f"p{i}", "hot", f"{i}.0" if i else None, "E") for i in range(400)],
                                 "project string, name string, version string, ecosystem string")
    osv = spark.createDataFrame([(f"V{i:03d}", "hot", "E", [], "s", "HIGH", [(None, "900")]) for i in range(300)], OSV)

    def refused(*_):
        raise AssertionError("all pairs are built")

    monkeypatch.setattr(intel, "interval_join", refused)
    rows = intel.match_osv(deps, osv, 3)
    assert sorted((r.project, r.vuln_id) for r in rows.collect()) == sorted((f"p{i}", f"V00{j}") for i in range(400) for j in range(3))


def test_dependencies_are_counted_alike_with_few_and_many_packages(spark, monkeypatch):
    deps = spark.createDataFrame(
        [("p", "a", "1.0", "E"), ("q", "a", None, "E"), ("q", "b", "1.0", "E"), ("q", "c", "1.0", "E"), ("q", None, "1.0", "E"), ("q", "a", "1.0", None)],
        "project string, name string, version string, ecosystem string")
    osv = spark.createDataFrame([("V1", "a", "E", [], "s", "H", [(None, "2")]), ("V2", "b", "E", [], "s", "H", [(None, "1")])], OSV)
    counts, matches = [], []
    for few in (10, 0):
        monkeypatch.setattr(intel, "FEW_PACKAGES", few)
        marked = intel.annotate_deps(deps, osv)
        assert marked.columns == [*deps.columns, "n_vulnerabilities", "is_vulnerable"]
        counts.append(sorted(map(str, marked.collect())))
        matches.append(sorted((r.project, r.vuln_id) for r in intel.match_osv(deps, osv).collect()))
    assert counts[0] == counts[1] and len(counts[0]) == 6 and matches[0] == matches[1] == [("p", "V1"), ("q", "V1")]


def test_crowded_classes_meet_in_tiles(spark, tmp_path, monkeypatch):
    """600 versions of few classes by 40 records: no pair is shuffled, each is there once, in the packed report too."""
    monkeypatch.setattr(intel, "TILE", 7)
    deps = spark.createDataFrame(
        [(f"p{i}", "hot", f"{i % 5}.{i}" if i % 50 else None, "E") for i in range(600)] + [("p1", "hot", "1.1", "E"), ("p1", None, "1", "E")],
        "project string, name string, version string, ecosystem string")
    osv = spark.createDataFrame([(f"V{j % 39:03d}", "hot", "E", [], "s", "HIGH", [(None, f"{j % 7}.0")]) for j in range(40)], OSV)
    rows = intel.match_osv(deps, osv)
    plain = sorted((r.project, f"V{j % 39:03d}") for r in deps.filter("name = 'hot'").collect() for j in range(40)
                   if r.version is None or int(r.version.split(".")[0]) < j % 7)
    assert sorted((r.project, r.vuln_id) for r in rows.collect()) == plain and len(plain) > 10_000
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "_row" in plan and "_column" in plan
    done = type("Done", (), {"dependencies": deps, "vulnerabilities": rows, "summary": deps.select("project").distinct()})
    reports.write_dep_json(done, str(tmp_path / "deps"), "gzip")
    assert all(f.endswith((".json.gz", "_SUCCESS", ".crc")) for f in _files(tmp_path / "deps"))
    read = spark.read.json(str(tmp_path / "deps" / "vulnerabilities"))
    assert sorted((r.project, r.vuln_id) for r in read.collect()) == plain


def _files(folder):
    return {os.path.relpath(os.path.join(at, name), folder) for at, _, names in os.walk(folder) for name in names}


def test_a_document_is_one_file_and_nothing_else(spark, tmp_path, monkeypatch):
    rows = [(7, "a"), (-3, "é\n"), (7, "a"), (None, "d\r\ne"), (9, ""), (10, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(sinks, "_scratch", lambda spark, name: f"file:{tmp_path}/{name}")
    found = QUERIES["read_code_files"](spark, str(tmp_path)).collect()
    texts = [(i, (t or "").replace("\r\n", "\n") + "\n") for i, t in rows]
    assert sorted(map(str, ((r.doc_id, r.digest, r.chars) for r in found))) == sorted(
        map(str, ((i, hashlib.md5(t.encode()).hexdigest(), len(t)) for i, t in texts)))
    assert len(_files(tmp_path / "files")) == len(rows)  # no checksum and no marker beside a file


def test_files_are_written_alike_where_arrow_knows_no_file_system(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("0", "1-0.txt", "x"), ("0", "2-1.txt", None), ("1", "-7.txt", "a\nb")], "folder string, name string, content string")
    src.write_files(rows, str(tmp_path / "own"))
    assert _files(tmp_path / "own") == {"0/1-0.txt", "0/2-1.txt", "1/-7.txt"}
    monkeypatch.setattr(src.fs, "FileSystem", type("None", (), {"from_uri": staticmethod(lambda uri: int(uri))}))
    src.write_files(rows, str(tmp_path / "spark"))
    read = [sorted(r.content for r in src.read_code_files(spark, str(tmp_path / at), extensions=[".txt"]).collect()) for at in ("own", "spark")]
    assert read[0] == read[1] == ["\n", "a\nb\n", "x\n"]


def test_small_files_are_read_many_to_a_task(spark, tmp_path):
    rows = spark.range(9000).select((F.col("id") % 4).cast("string").alias("folder"), F.concat("id", F.lit(".txt")).alias("name"),
                                    F.col("id").cast("string").alias("content"))
    src.write_files(rows, str(tmp_path / "t"))
    files = src.read_code_files(spark, str(tmp_path / "t"), extensions=[".txt"])
    assert files.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert files.select(F.sum(F.btrim("content", F.lit("\n")).cast("long"))).first()[0] == 9000 * 8999 // 2


def test_models_score_after_something_was_observed(spark):
    seen = Observation("before")
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 3}
    rows = spark.createDataFrame([(i, "eval x" if i % 2 else "print y", [0] if i % 2 else []) for i in range(40)], "sample_id long, code string, labels array<int>")
    classifier, _ = learn.train(rows, regs=(0.01,), max_iter=3, features=64)
    assert learn.score(classifier, rows, "code", ("sample_id",)).filter("prob > 0").count() == 40
