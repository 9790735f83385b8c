"""Steps that must not do their work more often than once, and the plain forms they equal."""

import random

from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from vulnsieve.catalog import lexicon as L
from vulnsieve.llm import packing
from vulnsieve.operators import intel, learn, manifests as man, tokens
from vulnsieve.sources.dimensions import vuln_classes
from workloads import base as B


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _labelled(spark):
    rows = [(i, ("eval(x) " if i % 2 else "safe = y ") + "z " * (i % 7), [1] if i % 2 else [0] if i % 3 else []) for i in range(120)]
    return spark.createDataFrame(rows, "sample_id long, code string, labels array<int>")


def test_scores_and_metrics_tokenise_a_text_once(spark, tmp_path):
    samples = _labelled(spark)
    classifier, test = learn.train(samples, regs=(0.1,), max_iter=3, features=1 << 8)
    texts = samples.withColumn("labels", F.to_json("labels"))
    texts.write.parquet(f"{tmp_path}/texts")
    stored = spark.read.parquet(f"{tmp_path}/texts").withColumn("labels", F.from_json("labels", "array<int>"))
    scores = learn.labelled_scores(classifier, stored)
    assert _plan(scores).count("regexp_extract_all") == 1
    assert "regexp_extract_all" not in _plan(learn.evaluate(scores, vuln_classes(spark)))
    found = scores.groupBy("sample_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("class_id")).alias("c")).collect()
    assert len(found) == 120 and all(r.n == 11 and r.c == list(range(11)) for r in found)


def test_features_are_those_of_hashing_tf(spark, monkeypatch):
    """Token counts come from a helper that hashes a distinct token once; they equal Spark ML's own."""
    monkeypatch.setattr(learn, "TOGETHER", 40)  # several cuts a batch
    texts = ["", " \n", "x=1 // y\r\nz", "'c' \"a\\\nb\" \"\"\"d\n\"\"\" '", "é ü 𝄞x # ж\u0085y\n0x1F 1.5e-3 ??=", "\0a $b_1 \0",
             "a bc def ghij klmno " * 30, "x" * 32 + " " + "y" * 33 + " " + "z" * 71, "/* öä */ \"ab\\é\" \"x"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3)], "i int, t string").coalesce(2)
    for features in (7, 1 << 14):
        plain = HashingTF(numFeatures=features, inputCol="w", outputCol="plain").transform(rows.withColumn("w", tokens.token_array(F.col("t"))))
        both = learn.featurize(plain, "t", features)
        assert "counted(" in _plan(both)
        for row in both.collect():
            assert row.plain == row.features and len(row.plain) == len(row.features)
    assert learn.featurize(spark.createDataFrame([(None,)], "t string"), "t").first().features is None


def test_training_on_features_is_training_on_texts(spark):
    """A query may count the tokens of its texts once, for training and scores; the test part is not counted for training."""
    samples = _labelled(spark)
    counted = learn.featurize(samples, "code", 1 << 8).drop("code")
    (a, rest), (b, left) = (learn.train(s, content=c, regs=(0.1,), max_iter=3, features=1 << 8) for s, c in ((samples, "code"), (counted, "features")))
    assert sorted(r.sample_id for r in rest.collect()) == sorted(r.sample_id for r in left.collect())
    texts = {r[:2]: r.prob for r in learn.score(a, samples, "code", ("sample_id",)).collect()}
    own = learn.score(b, counted, "features", ("sample_id",))
    assert {r[:2] for r in own.collect()} == set(texts) and all(abs(texts[r[:2]] - r.prob) < 1e-9 for r in own.collect())


def test_packing_hands_its_workers_small_batches(spark, monkeypatch):
    """Whole texts lie in an executor several times a batch, so packing builds small ones; the session keeps its setting."""
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    was = spark.conf.get(name)
    monkeypatch.setattr(packing, "written", lambda df, _: seen.append(int(spark.conf.get(name))) or df)
    monkeypatch.setattr(packing, "pieces", lambda docs, *_: docs)
    monkeypatch.setattr(packing, "pack", lambda parts, *_: parts)
    rows = packing.pack_documents(spark.range(3), "no file")
    assert rows.count() == 3 and seen == [packing.ROWS_TOGETHER] and seen[0] <= 1000 and spark.conf.get(name) == was


def test_token_array_is_the_lexer_without_blanks(spark):
    random.seed(5)
    parts = ['"', "'", '"""', "'''", "\\", "//", "#", "/*", "*/", "0x1F", "0b", "0o7", "1.5e-3", ".5", "...", "?.", "->", "<<=", "\n", "\r",
             "\r\n", "\t ", "\x0b", "\f", "\x1c", "\x85", "\xa0", " ", "é", "\U0001F600", "$a", "_b9", "Z", "a" * 9, "9x", " " * 30, "&&", "(", "]", "`", "0"]
    texts = ["".join(random.choices(parts, k=random.randrange(25))) for _ in range(3000)] + [None, "", " ", " \n ", "a ", "\n" * 500]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.filter(F.regexp_extract_all("t", F.lit(L.TOKEN_PATTERN), F.lit(0)), lambda t: ~F.substring(t, 1, 1).isin(list(L.BLANKS)))
    assert rows.filter(~plain.eqNullSafe(tokens.token_array(F.col("t")))).count() == 0
    # blanks are passed over by the matching itself
    assert "filter(" not in _plan(rows.select(tokens.token_array(F.col("t"))))


def test_versions_are_counted_once_and_without_foreign_packages(spark):
    kind = "project string, name string, version string, ecosystem string"
    deps = spark.createDataFrame(
        [("p", "a", "1.0", "PyPI"), ("q", "a", "3.0", "PyPI"), ("p", "b", None, "PyPI"), ("p", "c", "1.0", "PyPI"), ("p", "a", "1.0", "npm"),
         ("q", "a", "1.0", None), ("q", None, "1.0", "PyPI"), ("q", None, None, None)], kind)
    osv = spark.createDataFrame(
        [("V1", "a", "PyPI", [(None, "2.0")]), ("V2", "a", "PyPI", [(None, "4.0")]), ("V3", "b", "PyPI", [(None, "9")]),
         ("V4", None, "PyPI", [(None, "9")]), ("V5", "a", None, [(None, "9")])],
        "vuln_id string, package string, ecosystem string, affected_ranges array<struct<introduced:string,fixed:string>>")
    marked = intel.annotate_deps(deps, osv)
    assert "Window" not in _plan(marked)  # the counts are a table, whoever reads the dependencies
    found = {(r.project, r.name, r.ecosystem): r.n_vulnerabilities for r in marked.collect()}
    assert len(found) == 8 and {k: n for k, n in found.items() if n} == {("p", "a", "PyPI"): 2, ("q", "a", "PyPI"): 1, ("p", "b", "PyPI"): 1}


def test_a_json_manifest_is_parsed_once(spark):
    texts = ['{"dependencies": {"a": "^1.2", "b": "*", "c": null}, "devDependencies": {"a": "x"}}', '{"dependencies": 5, "devDependencies": {"d": "3"}}',
             '{"devDependencies": {"e": {"f": 1}}, "dependencies": {', '{"devDependencies": {"g": "~7"}}', "[]", "", "no", None]
    rows = spark.createDataFrame([(f"p{i}", "package.json", "package.json", t) for i, t in enumerate(texts)],
                                 "project string, path string, file_name string, content string")
    parsed = man.parse_manifests(rows, ["package.json"])
    assert _plan(parsed).count("from_json") == 1
    assert sorted(map(str, (tuple(r) for r in parsed.select("project", "line_no", "name", "version", "dep_type").collect()))) == sorted(map(str, [
        ("p0", 0, "a", "1.2", "dependencies"), ("p0", 1, "b", None, "dependencies"), ("p0", 2, "c", None, "dependencies"),
        ("p0", man.PIECE, "a", None, "devDependencies"), ("p1", man.PIECE, "d", "3", "devDependencies"),
        ("p3", man.PIECE, "g", "7", "devDependencies")]))


def test_manifest_texts_hold_the_words_where_they_are_named(spark, tmp_path):
    texts = ["ab cd ab", "x @WORDS@ y", None, ""]
    rows = [(10 * t + k, text) for t, text in enumerate(texts) for k in range(10)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.project, r.path): r.content for r in B.manifests(spark, str(tmp_path)).collect()}
    assert len(found) == 40 and all((v is None) == (p == "p2") for (p, _), v in found.items())
    assert '"zz": "1", "ab": "^2.0", "cd": "^2.0"}' in found["p0", "package.json"]
    assert found["p1", "Cargo.toml"].count('x="zz": "1", "x": "^1.0", "y": "^1.0"=y') == 1 and "@WORDS@" in found["p1", "Gemfile"]
