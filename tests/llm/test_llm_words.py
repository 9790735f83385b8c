"""Line quality, source divergence and spelling variants against plain Python."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vulnsieve.llm import level_products, line_quality, spelling

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ── line quality ────────────────────────────────────────────────────────────

def plain_quality(text, rules=line_quality.LineRules()):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times = collections.Counter(windows)
    covered = {i + o for i, w in enumerate(windows) if times[w] > 1 for o in range(5)}
    lost, failed, clean = 0, 0, []
    for line in text.split("\n"):
        own = WORD.findall(line)
        count = lambda pattern: len(re.findall(pattern, line))
        separators, shouts, chars = count(rules.separators), count(rules.shout), sum(map(len, own))
        bad = own and (
            (separators >= rules.least_separators and separators * rules.words_a_separator >= len(own))
            or (len(own) <= rules.phrase_words and re.search(rules.boilerplate, line, re.ASCII))
            or (len(own) <= rules.heading_words and not re.search(rules.sentence_mark, line))
            or (shouts and shouts * rules.words_a_shout >= len(own)) or count(rules.symbols) * rules.chars_a_symbol >= chars)
        if bad:
            lost, failed = lost + chars, failed + 1
        else:
            clean.append(line)
    chars = sum(map(len, words))
    base = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return {"n_words": len(words), "word_chars": chars, "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
            "n_failed_lines": failed, "lost_chars": lost, "base_failed": base, "kept": not base and lost * 2 <= chars,
            "clean_text": "\n".join(clean)}


TEXTS = [
    None, "", " ", "\n\n", "a", "a b c d e a b c d e f", "x\nx\n\nx \nx", "a a a a a a", "é ü b ß c\x0bd\x1ce",
    "Home | Shop | Cart » Help\nThis is a sentence, and it is long enough to stay here.\nAll rights reserved.\nRead more",
    "BUY!! NOW!! THIS!! IS!! CHEAP!! AND!! GOOD!! FOR!! ALL!! OF!! YOU!!", "one two three four five six seven eight nine ten eleven",
    "a& b& c# d$ e% f* g< h> i& j& k& l& m.", "Line. " * 3 + "\r\nLine. " * 4, "the end.\n" * 30, "日本語 は 。 " * 12,
    " ".join(f"w{i}" for i in range(4000)) + ".", "z" * 100_000 + ". " + "y " * 12,
]


def test_line_quality(spark, docs_of):
    rng = random.Random(3)
    pool = ["ab", "cd.", "|", "é!", "!!", "#", "read", "more", "x", "©"]
    texts = TEXTS + ["".join(rng.choice(pool) + rng.choice([" ", " ", "\n", "\t"]) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    docs = docs_of(*texts, extra=True)
    rows = line_quality.judge(docs, with_text=True).collect()
    assert len(rows) == len(texts)
    for r in rows:
        plain = plain_quality(texts[r.doc_id])
        assert {k: r[k] for k in plain} == plain, texts[r.doc_id]
        assert r.n_failed_lines == sum(r[f"{name}_lines"] for name in line_quality.REASONS)
    kept = {r.doc_id: r.text for r in line_quality.keep_clean(docs).collect()}
    assert kept == {i: plain_quality(t)["clean_text"] for i, t in enumerate(texts) if plain_quality(t)["kept"]}
    assert line_quality.judge(docs.limit(0)).count() == 0
    again = docs_of((None, "a"), (None, "a"), (4, "a"), extra=True)
    assert [r.n_words for r in line_quality.judge(again).collect()] == [1, 1, 1]


@given(st.lists(st.text(st.sampled_from("ab \n\t.|é!"), max_size=80), min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_line_quality_any(texts):
    found = line_quality.measure([t.encode() for t in texts], line_quality.LineRules(), True)
    for i, text in enumerate(texts):
        plain = plain_quality(text)
        assert {k: found[k][i] for k in plain if k in found} == {k: v for k, v in plain.items() if k in found}


def test_line_quality_batches(spark, docs_of, monkeypatch):
    monkeypatch.setattr(line_quality, "slices", lambda batch, text: ((i, i + 1) for i in range(batch.num_rows)))
    for one in TEXTS:
        data = (one or "").encode()
        assert line_quality.measure([data], line_quality.LineRules())["n_words"][0] == plain_quality(one)["n_words"]


# ── divergence ──────────────────────────────────────────────────────────────

def plain_divergence(rows, least_docs, top=50):
    letters = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = {i: i + 32 for i in range(65, 91)}
    counts, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        found = letters.findall((text or "").translate(lower))
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = set()
    for lang in {g[0] for g in counts}:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        groups = {s: c for (l, s), c in counts.items() if l == lang}
        whole = collections.Counter()
        for c in groups.values():
            whole.update(c)

        def weights(c):
            size = sum(c[t] for t in kept)
            return {t: 1 + (1000000000 * (c[t] + 5)) // (size + 5 * len(kept)) for t in kept}

        q, p = weights(whole), {s: weights(c) for s, c in groups.items()}
        order = lambda x: (-x[1], x[0].encode())
        for s in groups:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if groups[s][t] and p[s][t] > q[t]]
            out |= {(lang, s, "pair", o, v, i) for i, (o, v) in enumerate(sorted(pairs, key=order), 1)}
            out |= {(lang, s, "term", t, v, i) for i, (t, v) in enumerate(sorted(terms, key=order)[:top], 1)}
    return out


@pytest.mark.parametrize("block, slice_terms", [(32, 4096), (2, 5)])
def test_divergence(spark, block, slice_terms):
    rng = random.Random(block)
    pool = ["the", "The", "THE", "é", "É", "ß", "日本", "it's", "x1y", " ", "end."] + [f"{a}{b}" for a, b in itertools.product("abcdefg", repeat=2)]
    weights = [60 / (i + 1) for i in range(len(pool))]
    rows = []
    for _ in range(260):
        source = rng.choice(["s1", "s1", "s1", "s2", "s3", "S3", "ö", None, ""])
        rows.append((" ".join(rng.choices(pool, weights, k=rng.randint(0, 25))), rng.choice(["en", "en", "de", None]), source))
    rows += [(None, "en", "empty"), ("", "de", "s9"), ("rare words only", "fr", "s1"), ("others", "fr", "s2"), ("lone", "it", "s1")]
    rows += [rows[0]] * 5 + [(" ".join(["the"] * 3000), "en", "s2")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, source string, term string, n int")
    got = level_products.divergence(df, least_docs=6, top=7, block=block, slice_terms=slice_terms).collect()
    plain = plain_divergence(rows, 6, 7)
    assert {tuple(r) for r in got} == plain and len(got) == len(plain)
    assert any(r.part == "pair" and r.lang == "fr" and r.value == 0 for r in got)
    assert level_products.divergence(df.limit(0)).count() == 0


def test_joint_tables_are_whole():
    rng = np.random.default_rng(1)
    levels = np.minimum(rng.zipf(1.3, (300, 5)) - 1, 10**7)
    levels[rng.random((300, 5)) < 0.6] = 0
    for columns in (1, 7, 40, 5000):
        joint = collections.Counter()
        for owners, values, table in level_products.joint_tables(levels, columns):
            for x, y in itertools.product(range(len(owners)), repeat=2):
                joint[owners[x], values[x], owners[y], values[y]] += int(table[x, y])
        plain = collections.Counter((g, int(row[g]), h, int(row[h])) for row in levels for g in range(5) for h in range(5))
        assert +joint == plain
    sizes = levels.sum(axis=0).tolist()
    kept = 300
    value = level_products.price(levels, sizes, kept)
    p = [[level_products.weight(int(n), sizes[g], kept) for n in levels[:, g]] for g in range(5)]
    zero = [level_products.weight(0, s, kept) for s in sizes]
    for g, h in itertools.product(range(5), repeat=2):
        assert value[g, h] + kept * abs(zero[g] - zero[h]) == sum(abs(a - b) for a, b in zip(p[g], p[h]))


# ── spelling ────────────────────────────────────────────────────────────────

def plain_words(docs, every=97):
    lower = {i: i + 32 for i in range(65, 91)}
    counts = collections.Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if every and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return counts


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(counts, length=5, least=3):
    words = {w: n for w, n in counts.items() if len(w) >= length and n >= least}
    form, out = {}, {}
    near = {w: [u for u in words if one_edit(w, u)] for w in words}
    for w in words:
        best = min(near[w], key=lambda u: (-words[u], u), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


@pytest.mark.parametrize("every", [97, 3, None])
def test_variants(spark, docs_of, every):
    rng = random.Random(7)
    bases = ["".join(rng.choices("aabcé", k=rng.randint(4, 7))) for _ in range(25)] + ["aaaaa", "aaaaaa", "ÀÿÖöü", "àÿÖöü"]
    def mutated(w):
        i = rng.randrange(len(w) + 1)
        return rng.choice([w, w, w[:i] + rng.choice("abcé") + w[i:], w[:i] + w[i + 1:], w[:i] + rng.choice("abé") + w[i + 1:], w.upper()])
    texts = [" ".join(mutated(rng.choice(bases)) + rng.choice(["", ".", "1x", "×"]) for _ in range(60)) for _ in range(60)]
    items = [*enumerate(texts), (None, texts[0]), (None, texts[0]), (3, texts[1]), (90, None), (91, ""), (92, "12 !"), (93, "q" * 50_000)]
    docs = docs_of(*items, extra=True)
    plain = plain_variants(plain_words(items, every))
    rows = spelling.variants(docs, every=every).collect()
    assert len(rows) == len(plain) > 100
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == plain
    assert sum(r.form is not None and r.root != r.form for r in rows) > 3
    assert spelling.variants(docs.limit(0)).count() == 0


def test_neighbours_of_runs_and_ties(spark):
    words = {"aaaaa": 4, "aaaaaa": 9, "aaaab": 9, "aaaba": 3, "abaaa": 7, "baaaa": 9, "zzzzz": 5}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r.word: (r.n_near, r.best.word, r.best.n) for r in spelling.neighbours(df).collect()}
    plain = {}
    for w in words:
        near = [u for u in words if one_edit(w, u)]
        if near:
            best = min(near, key=lambda u: (-words[u], u))
            plain[w] = (len(near), best, words[best])
    assert got == plain and got["aaaaa"] == (5, "aaaaaa", 9)


def test_roots_of_long_chains(spark):
    forms = [(f"w{i:03}", f"w{i + 1:03}") for i in range(70)] + [(f"x{i}", "w069") for i in range(50)] + [("y", "z")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert got == {w: "z" if w == "y" else "w070" for w, _ in forms}
