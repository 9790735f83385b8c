"""Operators on tables against brute force: copies, near copies, search, filters, scores, packing."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from vulnsieve.llm import bpe, exact_dedup, exact_topk, packing, pii, simhash, suffix_lm, url_filter
from vulnsieve.llm.common import fold

PATH = bpe_path = corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json")


def random_texts(seed, n, words=12):
    rng = random.Random(seed)
    pool = ["the", "of", "and"] + ["".join(rng.choices("abcdefg", k=rng.randint(2, 8))) for _ in range(200)]
    return [" ".join(rng.choices(pool, k=rng.randint(1, words))) for _ in range(n)]


# ── exact copies ────────────────────────────────────────────────────────────

@pytest.mark.parametrize("counters", [1, 3, 1024])
def test_exact_copies(spark, docs_of, counters):
    texts = random_texts(1, 60, 2) + ["hot"] * 80 + ["", None, "", "A", "a"]
    random.Random(2).shuffle(texts)
    docs = docs_of(*texts, extra=True)
    rows = exact_dedup.mark_duplicates(docs, counters=counters).collect()
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    assert len(rows) == len(texts)
    for r in rows:
        own = groups[texts[r.doc_id] or ""]
        assert (r.keep_id, r.group_size, r.kept) == (max(own), len(own), r.doc_id == max(own))
        assert bytes(r.digest) == hashlib.sha256((texts[r.doc_id] or "").encode()).digest()
    kept = exact_dedup.drop_duplicates(docs, counters=counters)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(map(max, groups.values()))


def test_frequent_digests_are_found(spark):
    rng = random.Random(5)
    values = [b"x"] * 400 + [b"y"] * 300 + [b"%d" % rng.randrange(10**6) for _ in range(1000)]
    rng.shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "digest binary").repartition(7)
    found = exact_dedup.frequent_digests(df, 6)
    assert {b"x", b"y"} <= set(found) and len(found) <= 6


def test_exact_ties_nulls_empty(spark, docs_of):
    docs = docs_of((7, "a"), (7, "a"), (7, "b"), (None, "b"), (None, "c"), (None, "c"), (8, None))
    kept = [(r.doc_id, r.text) for r in exact_dedup.drop_duplicates(docs).collect()]
    assert sorted(kept, key=str) == sorted([(7, "a"), (7, "b"), (None, "c"), (8, None)], key=str)
    assert exact_dedup.drop_duplicates(docs.limit(0)).count() == 0
    assert exact_dedup.mark_duplicates(docs.limit(0)).count() == 0


# ── near copies ─────────────────────────────────────────────────────────────

def plain_components(prints, radius=2):
    parent = {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def plain_simhash(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_copies(spark, docs_of):
    texts = random_texts(3, 40, 30)
    long = " ".join(random_texts(4, 60, 30))
    texts += [long, long + " extra", long.upper(), long.replace("the", "teh", 1), None, "", "  ", "a", "A b", "a b"]
    docs = docs_of(*texts, extra=True)
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = {i: plain_simhash(t) for i, t in enumerate(texts)}
    assert {i: r.fingerprint & (2**64 - 1) for i, r in rows.items()} == prints
    assert {i: r.component_id for i, r in rows.items()} == plain_components(prints)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == set(plain_components(prints).values())
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_near_copies_with_null_and_repeated_ids(spark, docs_of):
    base = " ".join(random_texts(8, 60, 30))
    alone, other, third = "quite another text", "nothing like the rest of it", "a third one of its own"
    docs = docs_of((3, base), (7, base.upper()), (7, alone), (None, base.title()), (None, other), (None, third), (None, third))
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([(3, base), (7, alone), (None, other), (None, third)], key=str)
    same = docs_of((5, base), (5, base.upper()), (6, other), (None, alone), (None, alone.upper()))
    kept = [(r.doc_id, r.text.lower()) for r in simhash.keep_one(same).collect()]
    assert sorted(kept, key=str) == sorted([(5, base.lower()), (6, other), (None, alone)], key=str)


def odd_columns(df):
    """Columns with a dot, a backtick, a map, and text ids, as a stage may meet them."""
    return df.selectExpr("cast(doc_id AS string) AS doc_id", "text", "lang", "source", "n_chars", "map('k', n_chars) AS m",
                         "source AS `a.b`", "source AS `c``d`", "named_struct('text', 1) AS node", "1 AS `key`")


def test_stages_take_any_columns(spark, docs_of):
    base = " ".join(random_texts(8, 60, 30))
    docs = odd_columns(docs_of((3, base), (7, base.upper()), (7, base.upper()), (None, "zwei drei vier"), (None, "zwei drei vier"),
                               (8, None), (9, ""), (10, "!!"), (11, "jo@ex.com is here")))
    exact = exact_dedup.drop_duplicates(docs)
    near = simhash.keep_one(docs)
    assert exact.columns == near.columns == docs.columns
    got = [(r.doc_id, r.text, r["a.b"], r["c`d"]) for r in exact.collect()]
    assert sorted(got, key=str) == sorted([("3", base, "s", "s"), ("7", base.upper(), "s", "s"), (None, "zwei drei vier", "s", "s"),
                                           ("9", "", "s", "s"), ("10", "!!", "s", "s"), ("11", "jo@ex.com is here", "s", "s")], key=str)
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, "")
        assert kept.columns == docs.columns
    left = {(r.doc_id, r.text) for r in kept.collect()}
    assert left == {("3", base), (None, "zwei drei vier"), ("11", "[EMAIL] is here")}
    assert {r.doc_id for r in corpus_pipeline.pack_sequences(spark, kept, "").collect()} == {"3", None, "11"}


def test_nothing_learned_keeps_texts(spark, docs_of):
    docs = docs_of((1, "some words", None), (2, "12 !", None), (3, None, None), (4, "ü", None), (5, "", None))
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4]


@pytest.mark.parametrize("tile_rows", [3, 8192])
def test_links_in_tiles(spark, tile_rows):
    rng, prints = random.Random(6), set()
    for _ in range(60):
        base = rng.getrandbits(64)
        prints.add(base)
        for _ in range(rng.randint(0, 5)):  # chains of near values
            for _ in range(rng.randint(1, 3)):
                base ^= 1 << rng.randrange(64)
            prints.add(base)
    prints |= {0, 1, 3, 7, 2**64 - 1, 2**63}
    signed = {p: p - 2**64 if p >= 2**63 else p for p in prints}
    df = spark.createDataFrame([(v,) for v in signed.values()], "fingerprint long")
    edges = simhash.links(df, tile_rows=tile_rows, cells=16)
    assert all((a & (2**64 - 1) ^ b & (2**64 - 1)).bit_count() > 0 for a, b in edges.collect())
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    plain = plain_components({signed[p]: p for p in prints})
    groups = collections.Counter(plain.values())
    for x, root in plain.items():
        if groups[root] > 1:
            assert found.get(x, x) == root
        else:
            assert x not in found


def test_long_chain_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (9, 9)], "a long, b long")
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    assert found == {**{i: 0 for i in range(1, 201)}, 501: 500}
    assert simhash.components(edges.limit(0)).count() == 0


# ── exact search ────────────────────────────────────────────────────────────

@pytest.mark.parametrize("size, slices, k", [(9, 2, 20), (3, 2, 5), (9, 3, 1), (10**5, 2, 7), (10**9, 2, 6)])
def test_top_k(spark, size, slices, k):
    rng = np.random.default_rng(size + k)
    vectors = rng.integers(-size, size + 1, (150, 8)).tolist()
    vectors[5:40] = [vectors[4]] * 35  # many equal rows: ties
    rows = [(i, v, "x") for i, v in enumerate(vectors)] + [(900, None, "x"), (None, [1] * 8, "x")]
    rows += [(3, vectors[3], "x"), (3, vectors[7], "x"), (10, vectors[60], "x"), (10, vectors[60], "x")]
    df = spark.createDataFrame(rows, "vec_id long, vector array<bigint>, score string")
    got = exact_topk.top_k(df, F.col("vec_id") % 10 == 0, k, slices=slices, query_rows=7, block_rows=40).collect()
    plain, known = [], [(i, v) for i, v, _ in rows if i is not None and v is not None]
    for at, (q, own) in enumerate(known):
        if q % 10 == 0:
            scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for j, (i, v) in enumerate(known) if j != at)[:k]
            plain += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    assert sorted(map(tuple, got)) == sorted(plain)


def test_top_k_edges(spark):
    kinds = "vec_id long, vector array<bigint>"
    assert exact_topk.top_k(spark.createDataFrame([], kinds), F.col("vec_id") == 0).count() == 0
    one = spark.createDataFrame([(0, [1, 2])], kinds)
    assert exact_topk.top_k(one, F.lit(True)).count() == 0
    twice = spark.createDataFrame([(1, [5, 0]), (1, [9, 0]), (2, [1, 0])], kinds)
    got = exact_topk.top_k(twice, F.col("vec_id") == 2).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(1, 1, 9), (2, 1, 5)]
    few = spark.createDataFrame([(0, [1, 2]), (1, [3]), (2, [])], kinds)
    assert {tuple(r) for r in exact_topk.top_k(few, F.col("vec_id") == 0).collect()} == {(0, 1, 1, 3), (0, 2, 2, 0)}
    odd = spark.createDataFrame([(1, [1.0, float("nan")]), (2, [None, 1.0]), (3, None), (4, [float("inf")]), (5, [1.0])],
                                "vec_id long, e array<double>")
    assert [r.vec_id for r in odd.filter(exact_topk.usable(F.col("e"))).collect()] == [5]


# ── addresses ───────────────────────────────────────────────────────────────

RULES = [url_filter.Rule("block", "net"), url_filter.Rule("allow", "example.net", "/en/"), url_filter.Rule("allow", "org", "/fr/")]


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?y#z", "http://example.net", "http://notexample.net/en/",
            "http://net/", "http://x.org/fr/a", "http://x.org/fr", "http://x.org?p=/fr/", "http://x.org#://y.net/", "a://b://c.net/",
            "http://www.bad.com/p/?utm_source=1&b=2&a=1#f", "https://bad.com:443/p?a=1&b=2", "http://bad.com/p?a=1", "http://É.net/",
            "http://user@x.net:80/", "http://bad.com/q" + "y" * 5000]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(4, urls[4], "x")], "page_id long, url string, host string")
    listed = spark.createDataFrame([("http://bad.com/p?b=2&a=1",), ("http://bad.com/p/?b=2&a=1",), (None,), ("zzz",)], "url string")
    rows = url_filter.judge(pages, RULES, listed).collect()
    assert len(rows) == len(urls) + 1
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    none = ("", "", None, "allow")
    assert [got[i] for i in range(4)] == [none] * 4
    assert got[4] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[5] == ("example.net", "", None, "allow") and got[6] == ("notexample.net", "/en/", "net/", "block")
    assert got[7] == ("net", "/", "net/", "block") and got[8] == ("x.org", "/fr/a", "org/fr/", "allow")
    assert got[9] == ("x.org", "/fr", None, "allow") and got[10] == ("x.org", "", None, "allow") and got[11] == ("x.org", "", None, "allow")
    assert got[12] == ("b:", "//c.net/", None, "allow")
    assert [got[i][3] for i in (13, 14, 15)] == ["block", "block", "allow"]
    assert got[16][0] == "É.net" and got[16][3] == "block" and got[17][2] is None
    assert url_filter.judge(pages.limit(0), RULES, listed).count() == 0
    assert url_filter.judge(pages, RULES, listed.limit(0)).filter("rule IS NULL AND verdict = 'block'").count() == 0


def test_bloom_has_no_false_negative_and_few_false_positives(spark):
    listed = spark.range(3000).select(F.concat(F.lit("h/"), "id").alias("u"))
    bloom, blocks = url_filter.blocked_bloom(listed, "u", 3000)
    others = spark.range(10**6, 10**6 + 20_000).select(F.concat(F.lit("h/"), "id").alias("u"))
    for df, low, high in ((listed, 3000, 3000), (others, 0, 600)):
        block, masks = url_filter._probes(F.col("u"), blocks)
        hit = df.withColumn("block", block).join(bloom, "block").filter(
            url_filter._all([F.col(f"w{i}").bitwiseAND(m) == m for i, m in enumerate(masks)]))
        assert low <= hit.count() <= high


def test_url_plan_is_native(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    plan = url_filter.judge(pages, RULES, pages)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# ── language model ──────────────────────────────────────────────────────────

def test_suffix_lm(spark, docs_of, monkeypatch):
    texts = random_texts(7, 150, 40) + ["one fixed line of words that comes again", None, "", "Never Seen Wörter"] * 20
    docs = docs_of(*texts, (None, "x"), (3, texts[3]), extra=True)
    monkeypatch.setattr(suffix_lm, "FLUSH", 50)
    model = suffix_lm.train(docs, fold("doc_id", 7) != 2, least_context=10, least_count=4)
    rows = suffix_lm.score(docs, model).collect()
    assert len(rows) == len(texts) + 2
    ids = [*range(len(texts)), None, 3]
    whole = [*texts, "x", texts[3]]
    counts = collections.Counter()
    for i, t in zip(ids, whole):
        if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2:
            counts.update([*(t or "").encode().lower().split(), b"\n"])
    total, kinds = sum(counts.values()), len(counts)
    assert (model.train_tokens, model.distinct) == (total, kinds)
    by_id = {r.doc_id: r for r in rows}
    for i, t in zip(ids, whole):
        tokens = [*(t or "").encode().lower().split(), b"\n"]
        r = by_id[i]
        assert (r.n_tokens, r.n_known) == (len(tokens), sum(counts[w] > 0 for w in tokens))
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in tokens), rel_tol=1e-9)
    line = by_id[150]
    assert line.score > 0.7 * line.base_score  # a repeated line is far likelier than its words
    # few words looked up in the task: the same result through the join
    small = suffix_lm.train(docs, fold("doc_id", 7) != 2, least_context=10, least_count=4, frequent=1)
    again = {r.doc_id: r for r in suffix_lm.score(docs, small).collect()}
    assert all(math.isclose(again[i].base_score, by_id[i].base_score, rel_tol=1e-9) for i in by_id)
    assert suffix_lm.score(docs.limit(0), model).count() == 0
    none = suffix_lm.train(docs, F.lit(False))
    assert all(r.score == r.base_score == 0 and r.n_known == 0 for r in suffix_lm.score(docs, none).collect())


def plain_tree(texts, least_context, least_count, divergence, types=0.5, depth=3):
    """States and edges from plain counts: {context: share left}, {(context, word): probability}, and the walk."""
    counts = [collections.Counter() for _ in range(depth + 1)]
    for t in texts:
        tokens = [*(t or "").encode().lower().split(), b""]
        for i in range(len(tokens)):
            for d in range(depth + 1):
                if i >= d:
                    counts[d][tuple(tokens[i - d:i + 1])] += 1
    total, kinds = sum(counts[0].values()), len(counts[0])
    root = lambda w: (counts[0][(w,)] + 1) / (total + kinds + 1)
    states, edges = {}, {}

    def probability(context, word):
        for k in range(len(context), 0, -1):
            own = context[-k:]
            if own in states:
                if (own, word) in edges:
                    return edges[own, word]
                return states[own] * probability(own[1:], word)
        return root(word)

    for d in range(1, depth + 1):
        follow = collections.defaultdict(dict)
        for string, n in counts[d].items():
            if n >= least_count and counts[d - 1][string[:-1]] >= least_context:
                follow[string[:-1]][string[-1]] = n
        new_states, new_edges = {}, {}
        for context, nexts in follow.items():
            n, seen = counts[d - 1][context], sum(nexts.values())
            lower = {x: probability(context[1:], x) for x in nexts}
            rest, lower_rest = (n - seen) / n, max(1e-12, 1 - sum(lower.values()))
            far = sum(k / n * math.log(k / n / lower[x]) for x, k in nexts.items())
            far += rest * math.log(rest / lower_rest) if rest > 0 else 0
            if far >= divergence:
                left, whole = n - seen + types * len(nexts), n + types * len(nexts)
                new_states[context] = left / whole
                new_edges |= {(context, x): (k + left * lower[x]) / whole for x, k in nexts.items()}
        states |= new_states
        edges |= new_edges
    return states, edges, probability


@pytest.mark.parametrize("head", [1_000_000, 7, 1])
def test_suffix_tree_against_plain(spark, docs_of, monkeypatch, head):
    """All states and the score of every text, whether they are looked up on the spot or joined."""
    rng = random.Random(4)
    pool = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choices(pool, [1 / (i + 1) for i in range(12)], k=rng.randint(0, 40))) for _ in range(120)]
    texts += ["alpha beta gamma delta epsilon"] * 30 + ["Alpha BETA gamma zeta eta"] * 25 + ["w1 w2 w1 w2 w1"] * 9 + ["new words only", None, "w1"]
    docs = docs_of(*texts, (None, "w0 w1"), (3, texts[3]), (3, "beta gamma delta"), extra=True)
    monkeypatch.setattr(suffix_lm, "PAIRS", 100)
    trained = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 != 2]
    learned = [texts[i] for i in trained]
    extra = [(i, t) for i, t in ((None, "w0 w1"), (3, texts[3]), (3, "beta gamma delta"))
             if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2]
    learned += [t for _, t in extra]
    model = suffix_lm.train(docs, fold("doc_id", 7) != 2, least_context=12, least_count=3, divergence=0.08, head=head)
    states, edges, probability = plain_tree(learned, 12, 3, 0.08)
    assert [sum(len(c) == d for c in states) for d in (1, 2, 3)] == [s.count() for s in model.states]
    assert min(sum(len(c) == d for c in states) for d in (1, 2, 3)) > 2
    assert sum(e.count() for e in model.edges) == len(edges)
    got = collections.defaultdict(list)
    for r in suffix_lm.score(docs, model).collect():
        got[r.doc_id].append(r.score)
    want = collections.defaultdict(list)
    for i, t in [*enumerate(texts), (None, "w0 w1"), (3, texts[3]), (3, "beta gamma delta")]:
        tokens = [*(t or "").encode().lower().split(), b""]
        want[i].append(sum(math.log10(probability(tuple(tokens[max(0, j - 3):j]), w)) for j, w in enumerate(tokens)))
    assert got.keys() == want.keys()
    for i in want:
        assert np.allclose(sorted(got[i]), sorted(want[i]), rtol=1e-9), i


def test_suffix_tree_is_a_distribution():
    learned = ["a b c a b d"] * 9 + ["a c", "b d d"] * 6
    states, _, probability = plain_tree(learned, 5, 2, 0.01)
    words = {w for t in learned for w in [*t.encode().split(), b""]}
    unseen = 1 / (sum(len(t.split()) + 1 for t in learned) + len(words) + 1)
    for context in [(), *states, (b"a", b"x"), (b"a", b"b", b"c")]:
        left = probability(context, b"never seen")
        assert math.isclose(sum(probability(context, w) for w in words) + left, 1, rel_tol=1e-9)
        assert context or math.isclose(left, unseen)


def test_states_grow_with_the_corpus(spark, docs_of):
    rng = random.Random(6)
    pool = [f"v{i}" for i in range(300)]
    texts = [" ".join(f"{w} then{w}" for w in rng.choices(pool, [1 / (i + 1) for i in range(300)], k=40)) for _ in range(160)]
    sizes = [sum(s.count() for s in suffix_lm.train(docs_of(*texts[:n]), F.lit(True), least_context=50, least_count=5).states) for n in (40, 160)]
    assert sizes[1] > 2.5 * sizes[0] > 0


def test_keys_are_those_of_spark(spark):
    words = [b"a", b"", "é".encode(), b"x" * 70, b"the"]
    df = spark.createDataFrame([(bytearray(w), i) for i, w in enumerate(words)], "w binary, i int").selectExpr("i", "xxhash64(w) AS k")
    mine = np.array([suffix_lm.word_key(w) for w in words], np.uint64)
    rows = {r.i: r.k for r in df.collect()}
    assert [rows[i] for i in range(5)] == mine.view(np.int64).tolist()
    pairs = spark.createDataFrame([(int(a), int(b)) for a, b in zip(mine.view(np.int64), mine[::-1].view(np.int64))], "a long, b long")
    assert [r.k for r in pairs.selectExpr("xxhash64(a, b) AS k").collect()] == suffix_lm.longer(mine, mine[::-1]).view(np.int64).tolist()
    found = suffix_lm.Tokens.of([b"B a", b"", b"a  b\n"])
    tokens = found.stream
    assert found.bounds.tolist() == [0, 3, 4, 7] and tokens[1] == tokens[4] and tokens[2] == tokens[3] == suffix_lm.END_KEY
    assert [found.words[c] for c in found.codes] == [b"b", b"a", b"", b"", b"a", b"b", b""]
    assert [(at.tolist(), len(k)) for at, k in suffix_lm.contexts_of(tokens)] == [([1, 2, 5, 6], 4), ([2, 6], 2), ([], 0)]


# ── packing ─────────────────────────────────────────────────────────────────

def check_places(rows, capacity):
    ends = collections.defaultdict(list)
    for r in rows:
        ends[r.sequence_id].append((r.offset, r.length))
    for places in ends.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(ends)


def test_pieces_and_places(spark, docs_of):
    texts = random_texts(11, 120, 60) + [None, "", "word " * 5000, "x" * 9000, "<|endoftext|>"] + ["same text"] * 40
    docs = docs_of(*texts, (0, texts[0]), extra=True)
    rows = packing.pack_documents(docs, PATH, capacity=256).collect()
    tool, plain = bpe.codec(PATH), []
    for i, t in [*enumerate(texts), (0, texts[0])]:
        ids = tool.encode(t or "") + bytes(4)
        n = len(ids) // 4
        first = n % 256 or 256
        cuts = [0, *range(first, n + 1, 256)]
        plain += [(i, p, a, b - a, zlib.crc32(ids[4 * a:4 * b])) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(plain)
    used = check_places(rows, 256)
    assert used <= math.ceil(sum(r.length for r in rows) / 256) * 1.03 + 1
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def test_a_text_is_asked_for_once(monkeypatch):
    """Whole texts go to tiktoken, also with blanks in a row; looking their words up one by one takes longer."""
    asked, own = [], tiktoken.Encoding.encode_ordinary
    monkeypatch.setattr(tiktoken.Encoding, "encode_ordinary", lambda self, text: asked.append(text) or own(self, text))
    texts = [" ".join(f"w{i}x{j}" for j in range(50)) for i in range(20)] + ["a  b", "\0 a b", ""]
    tool = packing._Library(PATH)
    assert tool.encode(texts) == tool._whole(texts) and asked == texts and not tool.known


def test_ids_are_those_of_the_tokenizers_library(monkeypatch):
    odd = ["", " ", "  ", "\n\n", " \t\n", "\u00a0", "\u0085", "\x1c", "\u2028", "\u3000", "\0", "<|endoftext|>", "'s", "'LL", "é", "e\u0301",
           "ß", "١", "²", "漢字", "\U0001f600", "\u200d", "word", "X", "12", ".,", "_"]
    rng = random.Random(6)
    texts = ["".join(rng.choices(odd, k=rng.randint(0, 40))) for _ in range(3000)]
    texts += ["\n" * 1_500_000 + "a", "a" + " \u2003\t" * 500_000, "b" * 1_200_000, "-" * 1_200_000, "7 " * 100_000]
    tool = packing._Library(PATH)
    expected = tool._whole(texts)
    assert tool.encode(texts) == expected
    monkeypatch.setattr(tool, "plain", tool._by_words)  # a file whose ids are not in the order of its merges
    assert [tool.encode([t])[0] for t in texts[:300]] == expected[:300] and tool.encode(texts[:3000]) == expected[:3000]


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_every_piece(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(2048, 1 + rng.lognormal([5, 6, 6.5, 7, 3, 6][seed], 1.0, 5000).astype(int))
    histogram = collections.Counter(lengths.tolist())
    done = collections.Counter()
    sequences = packing.plan(dict(histogram))
    for own, n in sequences:
        assert 0 < sum(own) <= 2048 and n > 0
        for x in own:
            done[x] += n
    assert done == histogram
    assert sum(n for _, n in sequences) <= first_fit(lengths, 2048) * 1.01 + 1


def first_fit(lengths, capacity):
    room = []
    for x in sorted(lengths.tolist(), reverse=True):
        for i, r in enumerate(room):
            if r >= x:
                room[i] -= x
                break
        else:
            room.append(capacity - x)
    return len(room)


def test_nnls():
    rng = np.random.default_rng(3)
    a, x = rng.random((20, 8)), np.array([0, 1, 2, 0, 0, 3, 0, 0.5])
    assert np.allclose(packing.nnls(a, a @ x, 60), x, atol=1e-4)
    got = packing.nnls(a, -np.ones(20), 60)
    assert (got >= 0).all() and np.allclose(got, 0)


# ── pipeline ────────────────────────────────────────────────────────────────

def test_pipeline_stages(spark, docs_of, tmp_path):
    rng = random.Random(4)
    en = [" ".join(rng.choices("the of and to in is that with for was this are from have not".split(), k=30)) for _ in range(25)]
    fr = [" ".join(rng.choices("le la les des que pour dans une est pas sur avec qui ce".split(), k=30)) for _ in range(25)]
    long = " ".join(en)
    items = [(i, t, "en") for i, t in enumerate(en)] + [(100 + i, t, "fr") for i, t in enumerate(fr)]
    items += [(200, en[0], "en"), (201, en[0], "en"), (300, long, "en"), (301, long + ".", "en"), (400, "1234 --", None), (401, None, None),
              (500, en[1] + " mail jo@ex.com", "en")]
    docs = docs_of(*items)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept, frames = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        frames[name] = kept = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert kept.columns == docs.columns
    ids = {name: sorted(r.doc_id for r in df.select("doc_id").distinct().collect()) for name, df in frames.items()}
    assert ids["language_id"] == sorted(i for i, *_ in items if i not in (400, 401))
    assert set(ids["language_id"]) - set(ids["exact_dedup"]) == {0, 200}
    texts = {i: t for i, t, _ in items}
    near = plain_components({i: plain_simhash(texts[i]) for i in ids["exact_dedup"]})
    assert ids["near_dedup"] == ids["pii"] == ids["packing"] == sorted(set(near.values()))
    clean = {r.doc_id: r for r in frames["pii"].collect()}
    assert clean[500].text.endswith("mail [EMAIL]") and clean[500].n_chars == len(clean[500].text)
    assert all(r.text == pii.redacted(texts[i]) for i, r in clean.items())
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in rows) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in frames["packing"].collect())
    check_places(rows, 2048)
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, str(tmp_path))
        assert none.count() == 0
