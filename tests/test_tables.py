"""Manifests, feeds, joins, metrics, splits, samples and models on small inputs."""

import json
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from vulnsieve.operators import intel, learn, manifests as man, metrics, split
from vulnsieve.operators.prefix import interval_join, running_sums
from vulnsieve.plans.deps import scan_dependencies
from vulnsieve.plans.train import train_and_evaluate
from vulnsieve.sources import feeds
from vulnsieve.sources.store import store_feed
from vulnsieve.sources.dimensions import vuln_classes
from vulnsieve.sources.samples import labelled_corpus


def parsed(spark, name, content, path=None):
    rows = spark.createDataFrame([("p", path or name, name, content)], "project string, path string, file_name string, content string")
    return [(r.name, r.version) for r in man.parse_manifests(rows).orderBy("line_no").collect()]


@pytest.mark.parametrize("name, content, want", [
    ("requirements.txt", "a==1.0\n b >= 2.1b3 , <3\n#c\n-e d\n\ne\n!f\ng ~= x", [("a", "1.0"), ("b", "2.1b3"), ("e", None), ("g", None)]),
    ("Pipfile", "x = 1\n[packages]\na = \"*\"\n \"b\" = '==1'\nc\n[dev-packages]\nd = 1\n  [packages]\ne = \">=2\"",
     [("a", None), ("b", "'==1'"), ("e", "2")]),
    ("pyproject.toml", "dependencies = [\n \"a>=1\",\n [odd dependencies\n\"b\"\n]\n[tool]\n\"c==1\"\noptional-dependencies = [ \"no\" ]\n\"d<2.0\"",
     [("a", "1"), ("b", None), ("d", "2.0")]),
    ("package.json", '{"dependencies": {"a": ">=1.0 <2.0", "b": "latest"}, "devDependencies": {"c": "^3"}}',
     [("a", "1.02.0"), ("b", None), ("c", "3")]),
    ("package.json", '{"dependencies": {"a": ', []),
    ("go.mod", "require a v1\nrequire (\n\tb v2 // indirect\n\n\tc vv3\n)\nd v4\nrequire ( \ne v5\n)\nrequire f v6\n",
     [("a", "1"), ("b", "2"), ("c", "3"), ("e", "5"), ("f", "6")]),
    ("Cargo.toml", "[package]\nv = 1\n[dependencies]\na = \"1.0\"\nb = { path = \"x\", version = \"2\" }\n[dependencies.c]\nfeatures = []\n[other]\nd = 1\n[dev-dependencies] \ne = \"\"",
     [("a", "1.0"), ("b", "2"), ("features", "[]"), ("e", None)]),
    ("Gemfile", "gem 'a', '~> 1.0'\n gem \"b\"\ngems 'c'\ngem 'd','>= 2', '< 3'", [("a", "1.0"), ("b", None), ("d", "2")]),
    ("composer.json", '{"require": {"php": "8", "ext-x": "*", "a/b": "^1.2"}, "require-dev": {"c/d": "dev"}}', [("a/b", "1.2"), ("c/d", None)]),
])
def test_manifest_formats(spark, name, content, want):
    assert parsed(spark, name, content) == want


def test_distinct_deps_order(spark):
    rows = spark.createDataFrame([
        ("p", "sub/requirements.txt", "requirements.txt", "a==9\nb==1"), ("p", "requirements.txt", "requirements.txt", "x\na==1\na==2"),
        ("p", "Pipfile", "Pipfile", "[packages]\na = \"3\"\nc = \"4\""), ("q", "Pipfile", "Pipfile", "[packages]\na = \"5\""),
    ], "project string, path string, file_name string, content string")
    got = {(r.project, r.name): r.version for r in man.distinct_deps(man.parse_manifests(rows)).collect()}
    assert got == {("p", "x"): None, ("p", "a"): "1", ("p", "b"): "1", ("p", "c"): "4", ("q", "a"): "5"}


def json_table(spark, *docs):
    return spark.createDataFrame([(x,) for x in docs], "json string")


def test_feeds_defaults_and_broken_json(spark):
    kev = feeds.flatten_kev(json_table(spark, '{"vulnerabilities":[{"cveID":"CVE-1"},{}]}', "{broken", "{}")).collect()
    assert sorted((r.cve_id, r.known_ransomware) for r in kev) == [("", "Unknown"), ("CVE-1", "Unknown")]
    cve = feeds.flatten_cve(json_table(spark, '{"vulnerabilities":[{"cve":{}},{"cve":{"id":"C","descriptions":[{"lang":"en","value":"'
                                       + "x" * 600 + '"}],"weaknesses":[{"description":[{"value":"CWE-1"},{"value":"Other"}]}]}}]}')).collect()
    by_id = {r.cve_id: r for r in cve}
    assert by_id["Unknown"].cwe_ids == [] and by_id["Unknown"].published == "" and len(by_id["C"].description) == 600
    assert by_id["C"].cwe_ids == ["CWE-1"]
    osv = feeds.flatten_osv(json_table(spark, '{"vulns":[{"id":"O","severity":[{"type":"CVSS_V3","score":"low/high"}],"affected":['
                                       '{"package":{"name":"a","ecosystem":"E"},"ranges":[{"events":[{"introduced":"1"},{"fixed":"2"},{"introduced":"3"}]},{"events":[]}]},'
                                       '{"package":{"name":"a","ecosystem":"E"},"ranges":[{"events":[{"fixed":"5"}]}]}]},{"id":"N"}]}')).collect()
    rows = {r.vuln_id: r for r in osv}
    assert rows["O"].severity == "HIGH" and [tuple(x) for x in rows["O"].affected_ranges] == [("3", "2"), (None, "5")]
    assert rows["N"].package is None and rows["N"].severity == "UNKNOWN"
    repo = feeds.flatten_repos(json_table(spark, "{}")).first()
    assert (repo.default_branch, repo.stars, repo.license, repo.visibility) == ("main", 0, "Unknown", "public")


def osv_record(number, **affected):
    package = {"package": {"name": "a", "ecosystem": "E"}, **affected}
    return json.dumps({"vulns": [{"id": number, "affected": [package]}]})


def test_osv_intervals(spark):
    pairs = [{"introduced": "0"}, {"fixed": "1.2"}, {"introduced": "2.0"}, {"fixed": "2.3"}]
    git = {"type": "GIT", "events": [{"introduced": "0"}, {"fixed": "9f3c1"}]}
    own = {"type": "ECOSYSTEM", "events": [{"introduced": "0"}, {"fixed": "0.5"}]}
    osv = feeds.flatten_osv(json_table(
        spark, osv_record("pairs", ranges=[{"type": "SEMVER", "events": pairs}]),
        osv_record("swapped", ranges=[{"type": "SEMVER", "events": pairs[2:] + pairs[:2]}]),
        osv_record("git", ranges=[git, own]), osv_record("only_git", ranges=[git]),
        osv_record("last", ranges=[{"type": "SEMVER", "events": [{"introduced": "0"}, {"last_affected": "0.9"}]}]),
        osv_record("listed", versions=["7.7"]), osv_record("all"),
        osv_record("pre", ranges=[{"type": "SEMVER", "events": [{"introduced": "0"}, {"fixed": "1.0.0"}]}])))
    versions = ["1.0", "1.2", "2.1", "2.3", "0.4", "0.9", "2.1", "7.7", "1.0.0-rc1", "1.0.0+build5", None]
    deps = spark.createDataFrame([(f"p{i}", "a", v, "E") for i, v in enumerate(versions)], "project string, name string, version string, ecosystem string")
    got = {}
    for r in intel.match_osv(deps, osv).collect():
        got.setdefault(r.vuln_id, set()).add(r.package_version)
    every = {v or "unknown" for v in versions}
    pre = {"1.0.0-rc1"}
    assert got["pairs"] == got["swapped"] == {"1.0", "2.1", "0.4", "0.9", "1.0.0+build5", "unknown"} | pre
    assert got["git"] == {"0.4", "unknown"} and got["last"] == {"0.4", "0.9", "unknown"}
    assert got["listed"] == {"7.7", "unknown"} and got["all"] == every and got["only_git"] == {"unknown"}
    assert got["pre"] == {"0.4", "0.9", "unknown"} | pre
    counts = {r.project: r.n_vulnerabilities for r in intel.annotate_deps(deps, osv).collect()}
    assert counts == {f"p{i}": sum((v or "unknown") in s for s in got.values()) for i, v in enumerate(versions)}


OSV = ("vuln_id string, package string, ecosystem string, cve_ids array<string>, summary string, severity string, "
       "affected_ranges array<struct<introduced:string,fixed:string>>")


def osv_table(spark, *rows):
    return spark.createDataFrame([(i, p, "E", ["CVE-" + i], "s", "HIGH", r) for i, p, r in rows], OSV)


def dep_table(spark, *rows):
    return spark.createDataFrame([(p, n, v, "E") for p, n, v in rows], "project string, name string, version string, ecosystem string")


def test_osv_ranges(spark):
    osv = osv_table(spark, ("1", "a", [("1.0", "2.0")]), ("2", "a", []), ("3", "a", [("5", None)]), ("4", "a", [(None, "1"), ("3", "4")]))
    deps = dep_table(spark, ("p", "a", "1.5"), ("q", "a", "2.0"), ("r", "a", None), ("s", "a", "10"), ("t", "b", "1"), ("u", "a", "3.1"))
    got = {}
    for r in intel.match_osv(deps, osv).collect():
        got.setdefault(r.project, set()).add(r.vuln_id)
    assert got == {"p": {"1", "2"}, "q": {"2"}, "r": {"1", "2", "3", "4"}, "s": {"2", "3"}, "u": {"2", "4"}}
    assert {r.package_version for r in intel.match_osv(deps, osv).filter("project = 'r'").collect()} == {"unknown"}
    report = intel.dep_report(intel.match_osv(deps, osv)).collect()
    assert {r.fix for r in report if r.vuln_id in "23"} == {None, "No fix available"}


def test_crowded_packages_are_whole(spark):
    random.seed(1)
    osv = osv_table(spark, *[(str(i), "hot" if i % 3 else f"p{i}", [(None, f"{i % 5}.0")]) for i in range(60)])
    versions = [(f"j{i}", "hot" if i % 3 else f"p{random.randrange(60)}", random.choice([f"{i % 4}.1", "3.1", None])) for i in range(300)]
    got = sorted((r.project, r.vuln_id) for r in intel.match_osv(dep_table(spark, *versions), osv).collect())
    package = {str(i): "hot" if i % 3 else f"p{i}" for i in range(60)}
    plain = sorted((p, v) for p, n, version in versions for v in package
                   if package[v] == n and (version is None or float(version) < int(v) % 5))
    assert got == plain and len(plain) > 1000
    counts = {r.project: r.n_vulnerabilities for r in intel.annotate_deps(dep_table(spark, *versions), osv).collect()}
    assert counts == {p: sum(x == p for x, _ in plain) for p, *_ in versions}


@pytest.fixture(params=[True, False])
def slicing(spark, request):
    """Range partitions merged by adaptive execution, and kept as they are dealt."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    if not request.param:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    for key, value in old.items():
        spark.conf.set(key, value)


def test_running_sums(spark, slicing):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", None, "a", f"k{rng.randrange(30)}"]), i, rng.choice([None, 1, 2, -3]), 1) for i in range(700)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "k string, at int, v long, one int")
    got = {r["at"]: (r.s, r.n) for r in running_sums(df, ["k"], [F.col("at").desc()], {"s": "v", "n": "one"}).collect()}
    plain, sums = {}, {}
    for k, at, v, one in sorted(rows, key=lambda r: -r[1]):
        s, n = sums.get(k, (0, 0))
        sums[k] = plain[at] = (s + (v or 0), n + one)
    assert got == plain
    alone = running_sums(df, [], [F.col("at")], {"n": "one"}).collect()
    assert {r["at"]: r.n for r in alone} == {i: i + 1 for i in range(700)}
    assert running_sums(df.limit(0), ["k"], [F.col("at")], {"n": "one"}).count() == 0


def test_interval_join(spark, slicing):
    rng = random.Random(5)
    points = [(rng.choice(["hot", "hot", "x", "y", None]), rng.choice([None, *range(12)]), i) for i in range(150)] + [("hot", 5, 900)] * 3
    spans = [(rng.choice(["hot", "hot", "x", "z", None]), rng.choice([None, *range(12)]), rng.choice([None, *range(15)]), i) for i in range(120)]
    left = spark.createDataFrame(points, "k string, at int, p long")
    right = spark.createDataFrame(spans, "k string, low int, high int, s long")
    joined = interval_join(left, right, ["k"], "at", "low", "high")
    got = sorted((r.k, r["at"], r.low, r.high, r.p, r.s) for r in joined.collect())
    plain = sorted((k, at, low, high, p, s) for k, at, p in points for key, low, high, s in spans
                   if k == key and None not in (k, at, low, high) and low <= at < high)
    assert got == plain and len(plain) > 1000
    assert interval_join(left.limit(0), right, ["k"], "at", "low", "high").count() == 0
    assert interval_join(left, right.limit(0), ["k"], "at", "low", "high").count() == 0


def test_matching_pairs_only_what_matches(spark):
    """One package, very many versions and records of one version each: the pairs are those of the result."""
    n = 400
    osv = osv_table(spark, *[(str(i), "hot", [(f"{i}.0", f"{i}.5")]) for i in range(n)])
    deps = dep_table(spark, *[(f"j{i}", "hot", f"{i}.1") for i in range(n)])
    plan = intel.match_osv(deps, osv)
    assert plan.count() == n
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def scanned_rows(df):
    """Rows the scans of an executed plan gave."""
    df.collect()
    plan, rows = df._jdf.queryExecution().executedPlan(), 0
    nodes = [plan.executedPlan() if plan.nodeName().startswith("Adaptive") else plan]
    while nodes:
        node = nodes.pop()
        if node.nodeName().startswith("Scan parquet"):
            rows += node.metrics().apply("numOutputRows").value()
        children = [node.plan()] if "QueryStage" in node.getClass().getSimpleName() else [
            node.children().apply(i) for i in range(node.children().size())]
        nodes += children
    return rows


def test_look_ups_read_the_row_groups_that_matter(spark, tmp_path):
    n = 60_000
    feed = spark.range(n).select(
        F.concat(F.lit("CVE-2001-"), F.col("id")).alias("cve_id"), F.sha2(F.col("id").cast("string"), 512).alias("description"),
        F.lit("2001-01-01").alias("published"))
    table = store_feed(feed, "cve_id", str(tmp_path / "cve"), group_bytes=200_000)
    ids = [f"CVE-2001-{i}" for i in range(0, n, n // 12)] + ["CVE-1999-1"]
    found = intel.get_cve(table, *ids)
    assert "In(cve_id" in found._jdf.queryExecution().executedPlan().toString()
    groups = sum(pq.ParquetFile(f).metadata.num_row_groups for f in (tmp_path / "cve").glob("*.parquet"))
    assert groups > 20
    assert sorted(r.cve_id for r in found.collect()) == sorted(ids[:-1])
    one = intel.get_cve(table, "CVE-2001-777")
    assert 0 < scanned_rows(one) < n / 5 and one.count() == 1
    absent = intel.get_cve(table, "CVE-2001-77x")
    assert scanned_rows(absent) == 0 and absent.count() == 0
    assert intel.get_cve(table).count() == 0
    kev = spark.createDataFrame([("cve-1", "2001"), ("CVE-1", "2000"), (None, "1999"), ("CVE-2", "2002")], "cve_id string, date_added string")
    table = store_feed(intel.with_kev_id(kev), intel.KEV_ID, str(tmp_path / "kev"))
    for catalogue in (kev, table):
        assert [(r.cve_id, r.date_added) for r in intel.kev_lookup(catalogue, "Cve-1", "cve-9").collect()] == [("CVE-1", "2000")]


def test_kev_enrichment(spark):
    found = spark.createDataFrame([(1, "low", "m", "CWE-89"), (2, "low", "m", "CWE-79"), (3, "low", "m", "Unknown")],
                                  "file_id long, severity string, message string, cwe_id string")
    cve = spark.createDataFrame([("CVE-A", "d", 1.0, "2020-01-01", ["CWE-89"]), ("CVE-B", "d", 1.0, "2021-01-01", ["CWE-89"]),
                                 ("CVE-C", "d", 1.0, "2022-01-01", ["CWE-79", "CWE-79"])],
                                "cve_id string, description string, cvss_score double, published string, cwe_ids array<string>")
    kev = spark.createDataFrame([("cve-a", "v", "p", "2020", "Known"), ("CVE-b", "v", "p", "2020", "Known"), ("", "v", "p", "2020", "x")],
                                "cve_id string, vendor string, product string, date_added string, known_ransomware string")
    rows = {r.file_id: r for r in intel.enrich_kev(intel.enrich_cve(found, cve, vuln_classes(spark)), kev).collect()}
    assert rows == {r.file_id: r for r in intel.enrich_findings(found, cve, kev, vuln_classes(spark)).collect()}
    assert [c.cve_id for c in rows[1].related_cves] == ["CVE-B", "CVE-A"] and rows[1].total_known_cves == 2
    assert rows[1].severity == "critical" and rows[1].kev_id == "CVE-B" and rows[1].message.startswith("[ACTIVELY EXPLOITED] m — ")
    assert rows[2].severity == "low" and rows[2].kev_id is None and rows[2].total_known_cves == 1 and rows[3].related_cves == []


def test_dependency_totals(spark):
    manifests = spark.createDataFrame([("p", "requirements.txt", "requirements.txt", "a==1\nb"), ("q", "Gemfile", "Gemfile", "")],
                                      "project string, path string, file_name string, content string")
    osv = spark.createDataFrame([("1", "a", "PyPI", [], "s", "H", [(None, "2")])], OSV)
    rows = {r.project: tuple(r)[1:] for r in scan_dependencies(manifests, osv).summary.collect()}
    assert rows == {"p": (1, 2, 1), "q": (1, 0, 0)}


def test_auc_of_hot_and_distinct_scores(spark, slicing):
    """A class with one score for all, one with all scores distinct."""
    scores = spark.range(40_000).select(
        F.col("id").alias("sample_id"), (F.col("id") % 2).cast("int").alias("class_id"),
        F.when(F.col("id") % 2 == 0, 0.5).otherwise(F.col("id") / 40_000).alias("prob"),
        F.when(F.col("id") % 2 == 0, F.col("id") % 3 == 0).otherwise(F.col("id") > 10_000).cast("int").alias("label"))
    got = {r.class_id: r.auc for r in metrics.roc_auc(scores, 2).collect()}
    assert got == {0: 0.5, 1: 1.0}
    points = metrics.roc_points(scores).groupBy("class_id").agg(F.count("*").alias("n"), F.max("tp").alias("tp"), F.max("fp").alias("fp"))
    assert {r.class_id: (r.n, r.tp, r.fp) for r in points.collect()} == {0: (1, 6667, 13333), 1: (20_000, 15_000, 5_000)}


def test_auc_with_ties(spark, slicing):
    random.seed(3)
    rows = [(i, c, random.choice([0.0, 0.25, 0.25, 0.5, random.random()]), int(random.random() < (0 if c == 2 else 0.4)))
            for i in range(200) for c in range(3)]
    scores = spark.createDataFrame(rows, "sample_id long, class_id int, prob double, label int")

    def plain(c):
        pos = [p for _, k, p, y in rows if k == c and y]
        neg = [p for _, k, p, y in rows if k == c and not y]
        if not pos or not neg:
            return 0.5
        return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))

    got = {r.class_id: r.auc for r in metrics.roc_auc(scores, 4).collect()}
    assert all(abs(got[c] - plain(c)) < 1e-9 for c in range(3)) and got[3] == 0.5 and got[2] == 0.5


def test_metrics_without_positives(spark):
    scores = spark.createDataFrame([(1, 0, 0.4, 0), (2, 0, 0.6, 0), (3, 0, 0.5, 1)], "sample_id long, class_id int, prob double, label int")
    rows = {r.class_id: r for r in metrics.per_class_metrics(scores, num_classes=2).collect()}
    assert (rows[0].tp, rows[0].fp, rows[0].fn, rows[0].tn, rows[0].support) == (1, 1, 0, 1, 1)
    assert (rows[1].precision, rows[1].recall, rows[1].f1) == (0, 0, 0)


@pytest.mark.parametrize("n, digits", [(1, 1), (7, 1), (10, 2), (999, 1), (999, 3)])
def test_split_is_exact(spark, n, digits):
    parts = split.split_dataset(spark.range(n), "id", digits=digits).groupBy("part").count().collect()
    sizes = {r.part: r["count"] for r in parts}
    assert sizes.get("train", 0) == int(n * 0.8) and sizes.get("val", 0) == int(n * 0.1) and sum(sizes.values()) == n


def test_split_does_not_depend_on_buckets(spark):
    a, b = (sorted(map(tuple, split.split_dataset(spark.range(500), "id", digits=k).collect())) for k in (1, 4))
    assert a == b
    with pytest.raises(ValueError):
        split.split_dataset(spark.range(5), "id", ratios=(0.5, 0.1, 0.1))


def test_labelled_corpus(spark):
    rows = labelled_corpus(spark, 230).collect()
    assert len(rows) == 230 // 22 * 22 and sum(r.is_vulnerable for r in rows) == len(rows) // 2
    assert all(r.labels == [] and r.vulnerability_name == "Safe" for r in rows if not r.is_vulnerable)
    assert not [r for r in rows if "{func}" in r.code or "{param}" in r.code or "{var}" in r.code]
    assert sorted(map(str, rows)) == sorted(map(str, labelled_corpus(spark, 230).collect()))
    distribution = {r.vulnerability_name: r.n for r in metrics.class_distribution(labelled_corpus(spark, 230), vuln_classes(spark)).collect()}
    assert distribution["Safe"] == 110 and distribution["Buffer Overflow"] == 10 and len(distribution) == 12


def test_class_weights(spark):
    rows = spark.createDataFrame([([0, 1],), ([0],), ([],), ([99],)], "labels array<int>")
    weights = {r.class_id: r.weight for r in metrics.class_weights(rows).collect()}
    assert abs(weights[0] - 4 / 22) < 1e-12 and abs(weights[1] - 4 / 11) < 1e-12 and abs(weights[5] - 4 / 11) < 1e-12


def test_train_evaluate_and_score(spark, files_of):
    classifier, table = train_and_evaluate(labelled_corpus(spark, 660), regs=(0.01, 1.0), max_iter=10, features=1 << 12)
    rows = {r.class_name: r for r in table.collect()}
    assert len(rows) == 13 and len(classifier.losses) == 2 and rows["Micro Average"].f1 > 0.5
    scores = learn.score(classifier, files_of(("a.py", "import pickle\n\ndef f(x):\n    return pickle.loads(x)"))).collect()
    assert len(scores) == 11 and max(scores, key=lambda r: r.prob).class_id == 5
