"""Whole jobs over tables of other shapes, and the steps that were rewritten to scale."""

import hashlib

from pyspark.sql import functions as F

from vulnsieve.catalog import lexicon as L
from vulnsieve.functions import matching as M
from vulnsieve.operators import intel, tokens as T
from vulnsieve.operators.prefix import interval_join
from workloads import QUERIES


def _documents(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_incremental_scan_reads_a_folder_of_files(spark, tmp_path):
    d = _documents(spark, tmp_path, [(i, f"text {i}") for i in range(80)])
    columns = ["file_id", "line", "vuln_class", "message"]
    rows = [sorted(map(tuple, QUERIES[n](spark, d).select(columns).collect())) for n in ("incremental_scan", "scan")]
    assert rows[0] and rows[0] == rows[1]


def test_read_code_files_has_a_file_for_every_row(spark, tmp_path):
    rows = [(7, "a"), (107, "b"), (7, "c"), (8, "d\ne"), (9, "")]
    d = _documents(spark, tmp_path, rows)
    found = QUERIES["read_code_files"](spark, d).collect()
    assert sorted((r.doc_id, r.digest, r.chars) for r in found) == sorted(
        (i, hashlib.md5(f"{t}\n".encode()).hexdigest(), len(t) + 1) for i, t in rows)


def test_word_bits_say_what_contains_says(spark):
    words = ["eval(", "eval", "it's", "a\\b", "k", "i̇", "é", "x" * 3, "", "select"] + [f"w{i}" for i in range(150)]
    tests = M.WordTests()
    plain = [M.sql_contains(c, w) for c in ("content", "_low") for w in words]
    bits = [tests.in_bits(p) for p in plain]
    assert sum(p == b for p, b in zip(plain, bits)) == 4  # the empty word twice, two lower-case words beyond ASCII
    texts = ["EVAL(1)", "it's a\\b", "K", "İ", "É é", "xx", "SELECT w149 W7", "", "\0eval", None, "w14"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "file_id int, content string").withColumns(
        {"_low": F.lower("content"), "_words": tests.column(F.col("content"))})
    for row in rows.select(F.expr(f"array({', '.join(plain)})").alias("plain"), F.expr(f"array({', '.join(bits)})").alias("bits")).collect():
        assert row.plain == row.bits


def test_first_matches_hold_all_that_a_project_list_shows(spark):
    deps = spark.createDataFrame(
        [(p, n, v, "PyPI") for p in ("p", "q") for n, v in (("a", "1.0"), ("a", None), ("b", "2.5"), ("c", "9"))],
        "project string, name string, version string, ecosystem string")
    osv = spark.createDataFrame(
        [(f"V{i:03d}", n, "PyPI", ["C"], "s", "HIGH", [(None, f"{i % 4}.0")]) for i in range(60) for n in ("a", "b")],
        "vuln_id string, package string, ecosystem string, cve_ids array<string>, summary string, severity string, "
        "affected_ranges array<struct<introduced:string,fixed:string>>")
    everything, first = intel.match_osv(deps, osv), intel.match_osv(deps, osv, 5)
    assert first.count() < everything.count()
    columns = ["project", "name", "vuln_id"]
    assert sorted(map(tuple, intel.first_vulns(first, 5).select(columns).collect())) == sorted(
        map(tuple, intel.first_vulns(everything, 5).select(columns).collect()))


def test_pairs_of_an_interval_join_are_not_broadcast(spark):
    points = spark.range(300).select(F.lit("k").alias("k"), F.col("id").alias("at"))
    spans = spark.range(200).select(F.lit("k").alias("k"), F.col("id").alias("lo"), (F.col("id") + 150).alias("hi"))
    joined = interval_join(points, spans, ["k"], "at", "lo", "hi")
    assert joined.columns == ["k", "at", "lo", "hi"]
    assert joined.count() == points.join(spans, "k").filter("lo <= at AND at < hi").count()
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=merge)" in plan


def test_encode_looks_tokens_up_outside_lambdas(spark, files_of):
    """The ids and types are those of the plain expressions; no lambda is evaluated token by token."""
    texts = ["def f(x):\n  return 'é' + x  # end", "", "  \n", "... . .5 1e3 @a $b_c _ 'q' \" != <= é世 /* c */ //d", None, "import os " * 700]
    files = files_of(*[(f"f{i}", t) for i, t in enumerate(texts)])
    encoded = T.encode(files, padding=False, max_length=64)
    assert "transform(" not in encoded._jdf.queryExecution().optimizedPlan().toString()  # texts go to one helper
    tokens = T.tokenize(files.filter("content IS NOT NULL")).collect()
    words = {w: i for i, w in enumerate(L.vocabulary_words())}
    for row in encoded.collect():
        if texts[row.file_id] is None:
            assert row.input_ids is None
            continue
        own = sorted((t for t in tokens if t.file_id == row.file_id), key=lambda t: t.pos)[:62]
        unk = words["[UNK]"]
        pieces = [([words[t.token]] if t.token in words else [words.get(c, unk) if " " <= c <= "~" else unk for c in t.token[:64]], t.type) for t in own]
        ids = [words["[CLS]"], *[i for p, _ in pieces for i in p], words["[SEP]"]][:64]
        types = [9, *[k for p, k in pieces for _ in p], 9][:64]
        assert row.input_ids == ids and row.token_type_ids == types
