"""Operators on single texts against plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vulnsieve.llm import bpe, language_id, pii, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", " ", "   ", "\n\n x  y ", "a" * 3000, "<|endoftext|>", "x<|endoftext|> <|endoftext|>y", "don't  it's 12½ ²", "\x1c\x85\xa0 z",
       "日本語 テスト", "é" * 400, "\U0001F600 \U0001F468‍\U0001F469", "tab\tand\r\nline", "a b\nc", "x \ny", "x\n y"]


def plain_base(text):
    """The four base patterns as they are stated, with the plain engine."""
    out = []
    email = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
    out += [("email", m.start(), m.end()) for m in re.finditer(email, text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab.@-+%_ 0123456789()\né", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_base(text)


def test_spans_and_scores():
    text = "Call +1 (415) 555-0199 now, card 4111 1111 1111 1111, iban GB82 WEST 1234 5698 7654 32, host 10.0.0.1, a@b.co@c.de"
    found = {k: text[s:e] for k, s, e, _ in pii.scan(text)}
    assert found == {"phone": "+1 (415) 555-0199", "card": "4111 1111 1111 1111", "iban": "GB82 WEST 1234 5698 7654 32",
                     "ip": "10.0.0.1", "email": "a@b.co"}
    rated = {k: v for k, _, _, v in pii.scan(text)}
    assert rated["phone"] > pii.START["phone"] and rated["card"] > pii.START["card"]
    assert not pii.scan("GB82 WEST 1234 5698 7654 33, 4111 1111 1111 1112, 078-05-1120")
    assert [k for k, *_ in pii.scan("my ssn is 078-05-1120")] == ["ssn"]
    assert [k for k, *_ in pii.scan('token = "9c8b45435718dcc700c184a7e303cdc6"')] == ["secret"]


def test_long_secrets():
    for n in (256, 257, 5000):
        text = 'token = "' + ("9c8bX45435z718dcc700c184" * n)[:n] + '" end'
        assert [k for k, *_ in pii.scan(text)] == ["secret"]
        assert "9c8b" not in pii.redacted(text)
    assert pii.scan('token="' * 50_000) == []  # linear in the text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab.@-+ 0123456789\n", max_size=60))
def test_redacted_text_holds_no_base_span(text):
    once = pii.redacted(text)
    assert not [s for s in pii.base_spans(once) if s not in pii.base_spans(pii.redacted(once))]
    for kind, s, e in pii.base_spans(text):
        assert f"[{kind.upper()}]" in once or "[" in once


def test_long_digits_and_runs():
    for text in ("1" * 50_000, "1." * 20_000, "+1" + "-" * 50_000, "@" * 20_000, "a" * 50_000 + "@"):
        pii.scan(text)


@pytest.mark.parametrize("text", ODD)
def test_bpe_odd(text):
    tool = bpe.codec(PATH)
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert tool.encode(text) == tool.pack(ids)
    assert tool.decode(tool.pack(ids)) == LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aehinrst T.,'\n", max_size=80))
def test_bpe_any(text):
    tool = bpe.codec(PATH)
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert tool.encode(text) == tool.pack(ids) and tool.decode(tool.encode(text)) == text


def test_bpe_caches_do_not_matter(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 5)
    tool, rng = bpe.Codec(PATH), random.Random(3)
    for _ in range(200):
        text = " ".join("".join(rng.choices("abcdehinrst", k=rng.randint(1, 9))) for _ in range(20))
        assert tool.encode(text) == tool.pack(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_bpe_queries_rows(spark, docs_of):
    docs = docs_of((1, None), (1, None), (2, "a <|endoftext|>"), (3, "x" * 200_000), (None, "th é"), extra=True)
    rows = bpe.round_trip(docs, PATH).collect()
    assert len(rows) == 5
    for r in rows:
        text = {1: "", 2: "a <|endoftext|>", 3: "x" * 200_000, None: "th é"}[r.doc_id]
        ids = LIBRARY.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0
    back = bpe.decode(bpe.encode(docs, PATH), PATH).filter("doc_id = 2").first()
    assert back.text == "a <|endoftext|>"


def test_pii_rows(spark, docs_of):
    docs = docs_of(None, "", "mail a@b.co", "mail a@b.co", extra=True)
    rows = {r.doc_id: r.spans for r in pii.find_pii(docs).collect()}
    assert rows[0] == rows[1] == [] and rows[2] == rows[3] and rows[2][0].start == 5
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    assert {r.doc_id: r.text for r in clean.collect()} == {0: None, 1: "", 2: "mail [EMAIL]", 3: "mail [EMAIL]"}
    assert pii.find_pii(docs.limit(0)).count() == 0


def plain_segments(scores):
    """Repeatedly take the best-scoring run, then look left and right of it."""
    if not len(scores):
        return []
    total = np.concatenate([[0], np.cumsum(scores)])
    best = max(((total[j] - total[i], -(j - i), i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))
    if best[0] <= 0:
        return []
    _, _, i, j = best
    right = [(s + j, e + j, x) for s, e, x in plain_segments(scores[j:])]
    return plain_segments(scores[:i]) + [(i, j, best[0])] + right


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-9, 9), max_size=18))
def test_maximal_segments(scores):
    # uneven fractions rule out ties between runs
    values = np.array([s + 0.01 * zlib.crc32(bytes([i])) / 2**32 for i, s in enumerate(scores)])
    found = toxicity.maximal_segments(values)
    plain = plain_segments(values)
    assert [(s, e) for s, e, _ in found] == [(s, e) for s, e, _ in plain]
    assert np.allclose([x for *_, x in found], [x for *_, x in plain])


def test_every_passage_is_found():
    """A passage that comes again is listed again; the evidence of the text takes its words once."""
    model = toxicity.ToxicityModel({"vile ": 6.0, "foul ": 5.0, "grim ": 1.5}, drift=0.5, decay=1.0, log_k=0.0)
    calm, bad = "all is quiet here " * 40, "vile foul "
    one, twice = model.read(calm + bad + calm), model.read(calm + bad + calm + bad + calm)
    assert [e - s for s, e, _ in one[1]] == [2] and [e - s for s, e, _ in twice[1]] == [2, 2]
    assert [s for s, *_ in twice[1]] == [160, 322]
    assert twice[0] == pytest.approx(one[0] - math.log(484 / 322))  # only the length differs
    # repeats within one segment add nothing, so many of a weak word are no passage
    assert model.read(calm + "grim " * 30 + calm)[1] == []
    assert model.read("") == (0.0, []) and model.read(calm) == (0.0, [])
    tokens = (calm + bad + "vile " + calm + "foul vile").split()
    plain = [(s, e) for s, e, x in plain_segments(model.token_scores(" ".join(tokens))[1]) if x - math.log(len(tokens)) > -math.log(0.05)]
    assert [(s, e) for s, e, _ in model.read(" ".join(tokens))[1]] == [
        (s, e) for s, e in plain if sum(model.odds.get(w + " ", 0) - 0.5 for w in dict.fromkeys(tokens[s:e])) > math.log(len(tokens) / 0.05) + 0.5]


def test_toxicity_learns_stems(spark, docs_of):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    items, labels = [], []
    for i in range(900):
        bad = i % 3 == 0
        words = [word() for _ in range(40)]
        if bad:
            for _ in range(4):
                words[rng.randrange(40)] = "snarl" + rng.choice(["ig", "er", "ing", "ed", "y", "ous", "ish", "ly", "um"])
        items.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = docs_of(*items, (9000, None), (9001, ""), extra=True)
    known = spark.createDataFrame([x for x in labels if x[0] % 5], "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    rows = {r.doc_id: r for r in toxicity.toxic_passages(docs, model).collect()}
    held = [x for x in labels if x[0] % 5 == 0]
    assert np.mean([(rows[i].score >= 0.5) == bool(y) for i, y in held]) > 0.97
    assert rows[9000].score == rows[9001].score < 0.5 and rows[9000].passages == []
    assert toxicity.toxic_passages(docs.limit(0), model).count() == 0
    empty = toxicity.fit(docs, known.limit(0))
    assert all(r.score < 0.5 for r in toxicity.toxic_passages(docs, empty).collect())


def plain_grams(text, orders, buckets):
    """Buckets of the n-grams of a text, one character after the other."""
    folded = [ord(c) if c.isalpha() else 32 for c in text.lower()] + [32] * orders
    mix = [0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F]
    out = []
    for i in range(len(text.lower())):
        if folded[i] == folded[i + 1] == 32:
            continue
        mixed = 0x165667B1
        for o in range(orders):
            mixed = (mixed ^ folded[i + o]) * mix[o % 4] % 2**32
            mixed ^= mixed >> 15
            out.append((mixed * mix[0] % 2**32) >> (32 - buckets.bit_length() + 1))
    return out


def plain_languages(training, texts, orders=3, buckets=1 << 15, smoothing=0.5):
    counts = {}
    for text, lang in training:
        if lang is not None:
            counts.setdefault(lang, []).append(text or "")
    langs = sorted(counts)
    if not langs:
        return [("und", 0.0)] * len(texts)
    rows = sum(map(len, counts.values()))
    cells = {lang: np.bincount(np.array(sum((plain_grams(t, orders, buckets) for t in counts[lang]), []), int), minlength=buckets) + smoothing
             for lang in langs}
    out = []
    for text in texts:
        if text is None or not any(c.isalpha() for c in text):
            out.append(("und", 0.0))
            continue
        grams = plain_grams(text, orders, buckets)
        sums = [math.log(len(counts[x]) / rows) + float(np.log(cells[x][grams] / cells[x].sum()).sum()) for x in langs]
        best = max(range(len(langs)), key=lambda i: (sums[i], -i))
        out.append((langs[best], 1 / sum(math.exp(s - sums[best]) for s in sums)))
    return out


@pytest.mark.parametrize("part_langs", [1, 2, 128])
def test_languages_against_plain(spark, docs_of, part_langs):
    rng = random.Random(part_langs)
    texts = [("en", "The cat. The hat"), ("de", "Der Hut, DER Bär"), ("en", "that"), (None, "zzz"), ("de", None), ("fr", ""),
             ("xx", "one text"), ("yy", "one text"), (None, "one text"), (None, "1234 --"), (None, None), ("en", "The cat. The hat")]
    texts += [(rng.choice(["en", "de", "fr", None]), "".join(rng.choices("abcé ü.", k=rng.randint(0, 60)))) for _ in range(60)]
    docs = docs_of(*[(i, t, lang) for i, (lang, t) in enumerate(texts)], extra=True)
    model = language_id.train(docs, part_langs=part_langs)
    assert model.langs == ["de", "en", "fr", "xx", "yy"]
    plain = plain_languages([(t, lang) for lang, t in texts], [t for _, t in texts])
    rows = docs.select("doc_id", language_id.predicted(docs, model).alias("f")).selectExpr("doc_id", "f.*").collect()
    for r in rows:
        assert r.lang == plain[r.doc_id][0], texts[r.doc_id]
        assert abs(r.score - plain[r.doc_id][1]) < 1e-9
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (lang, p) in enumerate(plain) if lang != "und" and p >= 0.5}
    none = language_id.train(docs.limit(0))
    assert {r.f.lang for r in docs.select(language_id.predicted(docs, none).alias("f")).collect()} == {"und"}
    assert docs.limit(0).select(language_id.predicted(docs, model).alias("f")).count() == 0


def test_many_languages(spark, docs_of):
    docs = docs_of(*[(i, "".join(chr(0x4E00 + 50 * i + j) for j in range(30)), f"l{i:03}") for i in range(300)])
    model = language_id.train(docs)
    assert len(model.langs) == 300 and len(model.parts) == 3
    found = docs.select("lang", language_id.predicted(docs, model).alias("f")).collect()
    assert all(r.lang == r.f.lang for r in found)


def test_language_pieces_do_not_matter(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choices("abc é.1", k=rng.randint(0, 300))) for _ in range(30)]
    prob = np.log(np.random.default_rng(0).dirichlet(np.ones(1 << 15), 3))
    model = language_id.LanguagePart(["a", "b", "c"], np.log(np.ones(3) / 3), prob, 3, 1 << 15)
    whole = model.score(texts)
    monkeypatch.setattr(language_id, "PIECE", 17)
    parts = model.score(texts)
    assert np.allclose(whole[0], parts[0]) and (whole[1] == parts[1]).all()
