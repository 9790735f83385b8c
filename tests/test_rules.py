"""The rule scan against plain Python on every rule, and its anchor tests."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from vulnsieve.catalog.rules import RULES
from vulnsieve.catalog.snippets import LANGUAGE_EXTENSION, PROBES, corpus_snippets
from vulnsieve.functions.matching import END, MARK
from vulnsieve.operators import detect
from vulnsieve.plans.scan import scan

LANGUAGE_OF = {e: x for x, e in LANGUAGE_EXTENSION.items()}


def python_matches(rule, text):
    pattern = re.compile(rule.pattern, re.IGNORECASE | re.MULTILINE | re.ASCII)
    return [(text.count("\n", 0, m.start()) + 1, m.group(0)[:200]) for m in pattern.finditer(text)]


def expected(rules, files):
    out = []
    for file_id, path, text in files:
        language = LANGUAGE_OF.get(path[path.rfind("."):].lower() if "." in path else "", "unknown")
        for rule in rules:
            if rule.languages is None or language in rule.languages:
                out += [(file_id, rule.rule_id, line, matched) for line, matched in python_matches(rule, text)]
    return sorted(out)


def scanned(files, rules=RULES):
    rows = detect.rule_scan(files, rules).select("file_id", "rule_id", "line", "matched_text").collect()
    return sorted(tuple(r) for r in rows)


def test_catalogue():
    assert len(RULES) == 110 and len({r.rule_id for r in RULES}) == 110
    assert sum(r.languages is None for r in RULES) == 48


def test_every_rule_reports_its_probe(files_of):
    pairs = []
    for rule in RULES:
        language = (rule.languages or ("python",))[0]
        pairs.append((f"p/{rule.rule_id}{LANGUAGE_EXTENSION[language]}", PROBES[rule.rule_id]))
    found = {(r[0], r[1]) for r in scanned(files_of(*pairs))}
    assert [r.rule_id for i, r in enumerate(RULES) if (i, r.rule_id) not in found] == []


def test_all_rules_equal_plain_python(spark):
    filler = "Plain prose; des. and ../x\n\n\tif x = 'y' + z:\n"
    rows = [(i, f"s/{i}{ext}", filler + code + "\n" + filler + code) for i, ext, code in corpus_snippets()]
    files = spark.createDataFrame(rows, "file_id long, path string, content string")
    assert scanned(files) == expected(RULES, rows)


TRICKY = [
    ("a.js", "el.innerHTML   =   '<p>'\nel.innerHTML='<b>'\nel.innerHTML\n=\n\n'<'"),
    ("b.py", "yaml.load( \n  f, Loader=yaml.SafeLoader)\nyaml.load(f, Loader=yaml.SafeLoader)\nyaml.load(x)"),
    ("c.c", "strnstrcpy(a); strcpy (b)\nsprintf(a); snprintf(b)\nsnprintf(x)\nsprintf(y)"),
    ("d.py", "secrets.random.choice(x) securerandom.random( random.random()random.randint("),
    ("e.go", "http.Get(\"https://x\") http.Get( \"https://y\") http.Post(\n\"http://z\")"),
    ("f.txt", "<%= escape(x) %> <%=\n escape\n %> {!! y !!}"),
    ("g.py", ""), ("h.py", "\n\n\n"), ("i.py", f"os.system(1){MARK} {END}\nos.system(2){MARK}"),
    ("j.py", "password = '" + "x" * 400 + "'"),
    ("k.js", "jquery.html( '<a') ; jquery.append(x)\nres.sendFile( a.resolve, req.x)\nres.sendFile(\nresolve\nreq.y"),
    ("l.py", "send_file( realpath(request.x))\nsend_file(a, request.y)\nMarkup( escape(x))Markup(escape"),
]


def test_tricky_texts_equal_plain_python(files_of):
    pairs = [(p, t) for p, t in TRICKY]
    rows = [(i, p, t) for i, (p, t) in enumerate(pairs)]
    marks = str.maketrans({MARK: "\ufdd2", END: "\ufdd2"})
    assert scanned(files_of(*pairs)) == expected(RULES, [(i, p, t.translate(marks)) for i, p, t in rows])


def test_language_filter_and_safe_code(files_of):
    safe = "def add(a, b):\n    return a + b\n\nresult = add(1, 2)\nprint(result)"
    found = scanned(files_of(("x.py", "strcpy(buffer, input);"), ("y.py", safe), ("z.unknown", "os.system('x')")))
    assert not [f for f in found if f[1].startswith("BOF")]
    assert len([f for f in found if f[0] == 1]) <= 2
    assert not [f for f in found if f[0] == 2 and f[1] == "CMD001"]


def test_one_crowded_text_is_linear(files_of):
    text = "0xFF goto x;\n" * 60_000
    rows = detect.decompiled_artifacts(files_of(("big.c", text))).groupBy("message").count().collect()
    assert sorted(r["count"] for r in rows) == [60_000, 60_000]


@pytest.mark.parametrize("rule", RULES, ids=lambda r: r.rule_id)
def test_anchors_hold_in_every_match(rule):
    plain = re.sub(r"\(\?[=!<][^()]*(?:\([^()]*\)[^()]*)*\)", "", rule.pattern)

    @settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(re.compile(plain, re.IGNORECASE | re.ASCII), fullmatch=True))
    def check(text):
        if text.isascii() and re.search(rule.pattern, text, re.I | re.M | re.A):
            low = text.lower()
            assert all(any(word in low for word in group) for group in rule.anchors), text

    check()


def test_scan_reports_cwe_and_severity(files_of):
    rows = scan(files_of(("v.py", "import os\nos.system('ls ' + input())\n"))).collect()
    assert rows and all(r.cwe_id.startswith("CWE-") for r in rows)
    assert {"critical", "high"} & {r.severity for r in rows}
