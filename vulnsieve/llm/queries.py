"""Registered queries of the operators, with check SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnsieve.llm import (
    bpe, exact_dedup, exact_topk, language_id, level_products, line_quality, packing, pii, simhash, spelling, suffix_lm, toxicity,
    url_filter)
from vulnsieve.llm.common import fold

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_pii")
def op1(spark, d):
    spans = F.col("spans")
    def count(kind: str) -> F.Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s["kind"].isin(*pii.BASE_KINDS))
    return pii.find_pii(table(spark, d, "documents")).select(
        "doc_id", *map(count, pii.BASE_KINDS),
        F.sha2(pii.listed(base).cast("binary"), 256).alias("base_sha256"), pii.listed(spans).alias("spans"))


@query("op2_language_id")
def op2(spark, d):
    docs = table(spark, d, "documents")
    model = language_id.train(docs.filter(fold("doc_id", 3) != 1))
    found = language_id.predicted(docs, model)
    return docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), found.alias("found")).select(
        "doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


@query("op3_exact_topk", """
    WITH v AS (
      SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS vector FROM embeddings
      WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
      SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.vector::DOUBLE[], c.vector::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""")
def op3(spark, d):
    rows = table(spark, d, "embeddings").filter(exact_topk.usable(F.col("embedding")))
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * 64))
    return exact_topk.top_k(rows.select("vec_id", whole.alias("vector")), F.col("vec_id") % 20 == 0, k=20)


URL_RULES = [url_filter.Rule(*r) for r in (
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))]
#: Hosts with one of these labels are listed; the list holds the canonical URLs of their pages.
LISTED_LABELS = ("adult-x", "cheap-pills", "spam-farm")


def _url_sql() -> str:
    quoted = lambda words: ", ".join(f"'{w}'" for w in words)
    fits = lambda r: (f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')")
    by_length = sorted(URL_RULES, key=lambda r: -len(r.name))
    case = lambda what: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{what(r)}'" for r in by_length) + " END"
    return f"""
    WITH cut AS (
      SELECT page_id, url,
        coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
          'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
        list_sort(list_filter(string_split(coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*\\?([^#]*)', 1), ''), '&'),
          lambda p: p <> '' AND split_part(p, '=', 1) NOT IN ({quoted(url_filter.TRACKING)}))) AS args
      FROM pages),
    named AS (
      SELECT page_id, host, path, CASE WHEN host <> '' THEN
        regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^(www|m)\\.', '') || rtrim(path, '/')
        || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END END AS canonical,
        {case(lambda r: r.name)} AS rule, {case(lambda r: r.verdict)} AS ruled
      FROM cut),
    listed AS (
      SELECT DISTINCT canonical FROM named
      WHERE len(list_filter(string_split(host, '.'), lambda x: x IN ({quoted(LISTED_LABELS)}))) > 0)
    SELECT page_id, host, path, rule, canonical, coalesce(ruled,
      CASE WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
    FROM named"""


@query("op4_url_filter", _url_sql())
def op4(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    listed = pages.filter(F.arrays_overlap(
        F.split(url_filter.host_of(F.col("url")), r"\."), F.array(*map(F.lit, LISTED_LABELS))))
    return url_filter.judge(pages, URL_RULES, listed).select("page_id", "host", "path", "rule", "verdict", "canonical")


@query("op5_suffix_lm")
def op5(spark, d):
    docs = table(spark, d, "documents")
    model = suffix_lm.train(docs, fold("doc_id", 7) != 2)
    return suffix_lm.score(docs, model).select(
        "doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


@query("op6_packing")
def op6(spark, d):
    return packing.pack_documents(table(spark, d, "documents"), BYTE_BPE)


@query("op7_simhash")
def op7(spark, d):
    return simhash.near_duplicates(table(spark, d, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query("op8_exact_dedup", """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
      doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""")
def op8(spark, d):
    return exact_dedup.mark_duplicates(table(spark, d, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op9_toxicity")
def op9(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    model = toxicity.fit(docs, labels.filter(fold("doc_id", 5) != 0).select("doc_id", "toxic"))
    return toxicity.toxic_passages(docs, model).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", toxicity.is_toxic(F.col("score")).alias("predicted"),
        F.size("passages").alias("n_passages"), "evidence")


@query("op10_bpe")
def op10(spark, d):
    return bpe.round_trip(table(spark, d, "documents"), BYTE_BPE)


def _lines_sql(rules: line_quality.LineRules = line_quality.LineRules()) -> str:
    words = r"'[^\x20\x09-\x0D]+'"
    hits = lambda pattern: f"len(regexp_extract_all(line, '{pattern}'))"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT rid, doc_id, text, regexp_extract_all(text, {words}) AS words FROM d),
    grams AS (
      SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS gram
      FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
    twice AS (SELECT rid, i FROM grams QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
    covered AS (
      SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + o AS at FROM twice, range(5) r(o)) GROUP BY rid),
    cut AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
    judged AS (
      SELECT *, (separators >= {rules.least_separators} AND separators * {rules.words_a_separator} >= n)
        OR (n <= {rules.phrase_words} AND regexp_matches(line, '{rules.boilerplate}'))
        OR (n <= {rules.heading_words} AND NOT regexp_matches(line, '{rules.sentence_mark}'))
        OR (shouts > 0 AND shouts * {rules.words_a_shout} >= n) OR symbols * {rules.chars_a_symbol} >= chars AS failed
      FROM (
        SELECT rid, line, len(regexp_extract_all(line, {words})) AS n,
          length(array_to_string(regexp_extract_all(line, {words}), '')) AS chars,
          {hits(rules.separators)} AS separators, {hits(rules.shout)} AS shouts, {hits(rules.symbols)} AS symbols
        FROM cut)
      WHERE n > 0),
    lines AS (
      SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (failed) AS n_failed_lines,
        coalesce(sum(chars) FILTER (failed), 0)::BIGINT AS lost_chars
      FROM judged GROUP BY rid),
    counted AS (
      SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n_dup_lines, 0) AS n_dup_lines,
        coalesce(c.n, 0) AS n_repeat_words, coalesce(l.n_failed_lines, 0) AS n_failed_lines,
        coalesce(l.lost_chars, 0) AS lost_chars
      FROM w LEFT JOIN lines l USING (rid) LEFT JOIN covered c USING (rid)),
    based AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted)
    SELECT *, NOT base_failed AND NOT lost_chars * 100 > word_chars * 50 AS kept FROM based"""


@query("op11_line_quality", _lines_sql())
def op11(spark, d):
    return line_quality.judge(table(spark, d, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_failed_lines", "lost_chars",
        "base_failed", "kept")


@query("op12_source_divergence", """
    WITH d AS (
      SELECT row_number() OVER () AS rid, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source
      FROM documents),
    t AS (
      SELECT rid, lang, source, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM d),
    kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= 30),
    langs AS (
      SELECT l.lang, count(k.term) AS v, coalesce(sum(k.total), 0) AS size
      FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept k USING (lang) GROUP BY l.lang),
    n AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
    groups AS (
      SELECT g.lang, g.source, coalesce(sum(n.n), 0) AS size
      FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN n USING (lang, source) GROUP BY ALL),
    p AS (
      SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 5)) // (g.size + 5 * l.v)::HUGEINT AS p,
        1 + (1000000000::HUGEINT * (k.total + 5)) // (l.size + 5 * l.v)::HUGEINT AS q
      FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN n ON (n.lang, n.source, n.term) = (g.lang, g.source, k.term)),
    pairs AS (
      SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    parts AS (
      SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
      FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN pairs x ON (x.lang, x.source, x.item) = (a.lang, a.source, b.source)
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
    ranked AS (
      SELECT lang, source, part, item, value::BIGINT AS value,
        row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM parts)
    SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50""")
def op12(spark, d):
    return level_products.divergence(table(spark, d, "documents"))


@query("op13_spelling", """
    WITH RECURSIVE poly AS MATERIALIZED (
      SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END, b)
        ORDER BY b) AS steps FROM range(256) r(b)),
    runs AS (
      SELECT doc_id, run, count(*) AS n FROM (
        SELECT doc_id, unnest(regexp_extract_all(
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run
        FROM documents) GROUP BY ALL),
    hashed AS (
      SELECT run, n, xor(list_reduce(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: unicode(c)::BIGINT),
        lambda crc, u: CASE WHEN u < 128 THEN xor(crc // 256, steps[xor(crc, u) % 256 + 1])
          ELSE xor(xor(crc // 256, steps[xor(crc, 195) % 256 + 1]) // 256,
                   steps[xor(xor(crc // 256, steps[xor(crc, 195) % 256 + 1]), u - 64) % 256 + 1]) END,
        4294967295::BIGINT), 4294967295::BIGINT) AS h
      FROM runs, poly),
    spelt AS (
      SELECT CASE WHEN h % 97 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed),
    words AS MATERIALIZED (
      SELECT word, sum(n)::BIGINT AS n FROM spelt GROUP BY word HAVING length(word) >= 5 AND sum(n) >= 3),
    cuts AS MATERIALIZED (
      SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
    near AS (
      SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
      UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
    best AS (
      SELECT word, count(*) AS n_near, max(n) AS form_n, min(other) FILTER (at_most = n) AS form
      FROM (SELECT *, max(n) OVER (PARTITION BY word) AS at_most FROM near) GROUP BY word),
    found AS MATERIALIZED (
      SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= 2 * w.n THEN b.form END AS form,
        CASE WHEN b.form_n >= 2 * w.n THEN b.form_n END AS form_n
      FROM words w LEFT JOIN best b USING (word)),
    chain AS (
      SELECT word, word AS root, form AS next FROM found
      UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN found f ON c.next = f.word)
    SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM found f JOIN chain c ON c.word = f.word WHERE c.next IS NULL""")
def op13(spark, d):
    return spelling.variants(table(spark, d, "documents"))
