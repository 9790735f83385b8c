"""Registered queries: lexing, encoding, chunks, functions, samples, metrics, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from vulnsieve.catalog import lexicon as L
from vulnsieve.catalog import patterns as P
from vulnsieve.catalog.classes import CLASS_NAMES
from vulnsieve.catalog.snippets import TEMPLATES, fill_names, template_rows
from vulnsieve.functions import text as X
from vulnsieve.operators import chunks, learn, metrics, split, tokens
from vulnsieve.scratch import written
from vulnsieve.sources.dimensions import vuln_classes
from vulnsieve.sources.samples import labelled_corpus, labelled_pairs

from workloads import base as B
from workloads import checksql as S
from workloads.base import lit, query

# ── lexing ──────────────────────────────────────────────────────────────────


def _in(column: str, words) -> str:
    return f"{column} IN ({', '.join(lit(w) for w in words)})"


_TYPE_SQL = f"""CASE WHEN regexp_matches(token, '^["'']') AND length(token) > 1 THEN 6
  WHEN starts_with(token, '#') OR starts_with(token, '//') OR starts_with(token, '/*') THEN 5
  WHEN regexp_matches(token, '^\\.?[0-9]') THEN 7
  WHEN token = '...' OR regexp_matches(token, '^[-+*/%&|^~<>!=?:]') THEN 3
  WHEN regexp_matches(token, '^[][(){{}};,.@]') THEN 4
  WHEN regexp_matches(token, '^[A-Za-z_$]') THEN CASE WHEN {_in('token', L.ALL_KEYWORDS)} THEN 0 ELSE 1 END
  ELSE 9 END"""


def _tokens_sql(corpus: str) -> list[str]:
    return [corpus, f"""lists AS (SELECT file_id, list_filter(regexp_extract_all(content, {lit(L.PORTABLE_TOKEN_PATTERN)}),
    lambda t: NOT regexp_matches(t, '^\\s')) AS ts FROM code),
plain_tokens AS (SELECT file_id, unnest(range(0, len(ts)))::INT AS pos, unnest(ts) AS token FROM lists),
tokens AS (SELECT *, {_TYPE_SQL} AS type, {_in('token', L.SENSITIVE_WORDS)} AS is_security_sensitive FROM plain_tokens)"""]


_NAMES = "[" + ", ".join(lit(n) for n in L.TOKEN_TYPES) + "]"


@query("tokenize", S.with_ctes(*_tokens_sql(B.TURNS_SQL), select=f"SELECT file_id, pos, token, type, {_NAMES}[type + 1] AS type_name, "
                               "is_security_sensitive FROM tokens"))
def tokenize(spark, d):
    return tokens.tokenize(B.turns(spark, d))


@query("token_counts", S.with_ctes(*_tokens_sql(B.CODE_SQL), select=f"""SELECT {_NAMES}[type + 1] AS type_name, count(*) AS n,
  sum(length(token))::BIGINT AS chars, count(*) FILTER (is_security_sensitive) AS sensitive, sum(pos)::BIGINT AS positions
FROM tokens GROUP BY type"""))
def token_counts(spark, d):
    return tokens.tokenize(B.code(spark, d)).groupBy("type_name").agg(
        F.count("*").alias("n"), F.sum(F.length("token")).alias("chars"),
        F.count_if(F.col("is_security_sensitive")).alias("sensitive"), F.sum("pos").alias("positions"))


_VOCAB = L.vocabulary_words()
_REAL = [w for w in _VOCAB if not w.startswith("[UNUSED_")]
_VOCAB_SQL = B.values("vocab", "token_id, token", list(enumerate(_REAL)))


@query("lookup_tokens", S.with_ctes(*_tokens_sql(B.TURNS_SQL), _VOCAB_SQL, select="SELECT token, token_id, count(*) AS n FROM tokens "
                                    "LEFT JOIN vocab USING (token) GROUP BY 1, 2"))
def lookup_tokens(spark, d):
    found = tokens.lookup_tokens(tokens.tokenize(B.turns(spark, d)), tokens.vocabulary(spark))
    return found.groupBy("token", "token_id").agg(F.count("*").alias("n"))


def _encoded_sql(corpus: str, max_length: int) -> list[str]:
    """Ids by joins: known words, else one id per character; then frame, cut and pad."""
    return [*_tokens_sql(corpus), _VOCAB_SQL, f"""kept AS (SELECT * FROM tokens WHERE pos < {max_length - 2}),
known AS (SELECT file_id, pos, 0 AS sub, token_id, type FROM kept JOIN vocab USING (token)),
letters AS (SELECT file_id, pos, type, unnest(range(1, length(token) + 1)) AS sub, token FROM kept
  WHERE token NOT IN (SELECT token FROM vocab)),
spelled AS (SELECT file_id, pos, sub, coalesce(token_id, 1) AS token_id, type FROM
  (SELECT file_id, pos, sub, type, substr(l.token, sub, 1) AS token FROM letters l) c LEFT JOIN vocab USING (token)),
pieces AS (SELECT * FROM known UNION ALL SELECT * FROM spelled),
inner_ids AS (SELECT c.file_id, coalesce(list(token_id ORDER BY pos, sub) FILTER (token_id IS NOT NULL), []) AS ids,
  coalesce(list(type ORDER BY pos, sub) FILTER (type IS NOT NULL), []) AS types
  FROM code c LEFT JOIN pieces p USING (file_id) GROUP BY 1),
framed AS (SELECT file_id, list_concat(list_concat([2], ids), [3])[1:{max_length}] AS ids,
  list_concat(list_concat([9], types), [9])[1:{max_length}] AS types FROM inner_ids),
encoded AS (SELECT file_id, list_resize(ids, {max_length}, 0) AS input_ids, list_resize(types, {max_length}, 9) AS token_type_ids,
  len(ids) AS used FROM framed)"""]


@query("encode", S.with_ctes(*_encoded_sql(B.CODE_SQL, 2048), select="""SELECT file_id, array_to_string(input_ids, ' ') AS input_ids,
  array_to_string(token_type_ids, ' ') AS token_type_ids, used::BIGINT AS real_tokens FROM encoded"""))
def encode(spark, d):
    rows = tokens.encode(B.code(spark, d), max_length=2048)
    return rows.select(
        "file_id", F.concat_ws(" ", F.col("input_ids").cast("array<string>")).alias("input_ids"),
        F.concat_ws(" ", F.col("token_type_ids").cast("array<string>")).alias("token_type_ids"),
        F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, m: a + m).alias("real_tokens"))


@query("decode_ids", S.with_ctes(*_encoded_sql(B.CODE_SQL, 2048), """ids AS (SELECT file_id, unnest(range(0, len(input_ids))) AS pos,
  unnest(input_ids) AS token_id FROM encoded)""", select="""SELECT file_id, coalesce(string_agg(token, ' ' ORDER BY pos)
  FILTER (token_id > 5), '') AS text FROM ids JOIN vocab USING (token_id) GROUP BY 1"""))
def decode_ids(spark, d):
    return tokens.decode_ids(tokens.encode(B.code(spark, d), max_length=2048))


@query("vocabulary", S.with_ctes(*_tokens_sql(B.TURNS_SQL), B.values("fixed", "token", [(w,) for w in _REAL]), f"""
counted AS (SELECT token, count(*) AS c FROM tokens WHERE type = 1 GROUP BY 1 ORDER BY c DESC, token LIMIT 200)""",
    select=f"SELECT token, count(*) AS places FROM (SELECT token FROM counted UNION SELECT token FROM fixed) GROUP BY 1"))
def vocabulary(spark, d):
    """A vocabulary seeded with the most frequent identifiers of the conversations."""
    words = tokens.frequent_identifiers(tokens.tokenize(B.turns(spark, d)), 200)
    vocab = tokens.vocabulary(spark, L.vocabulary_words(words))
    return vocab.filter(~F.startswith("token", F.lit("[UNUSED_"))).groupBy("token").agg(F.count("*").alias("places"))


@query("vocab_info", S.with_ctes(*_tokens_sql(B.TURNS_SQL), select=f"""SELECT 32000 AS vocab_size, 2048 AS max_length,
  {len(L.ALL_KEYWORDS)} AS num_keywords, {len(L.SENSITIVE_WORDS)} AS num_security_tokens,
  {lit(' '.join(L.SPECIAL_TOKENS))} AS special_tokens, count(*) AS corpus_tokens FROM tokens"""))
def vocab_info(spark, d):
    n = tokens.tokenize(B.turns(spark, d)).agg(F.count("*").alias("corpus_tokens"))
    return tokens.vocab_info(tokens.vocabulary(spark)).crossJoin(F.broadcast(n))


# ── chunks, functions, preprocessing ────────────────────────────────────────

def _chunk_ctes(corpus: str) -> str:
    """The fold over lines as a recursion: one step a line, with running lengths and the last opening line so far."""
    opens = " OR ".join(f"starts_with(trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)), {lit(w)})" for w in P.CHUNK_BOUNDARIES)
    size, back, over = P.CHUNK_SIZE, P.CHUNK_LOOKBACK, P.CHUNK_OVERLAP // P.CHUNK_CHARS_PER_LINE
    return f"""cut AS (SELECT file_id, length(content) AS chars, string_split(content, chr(10)) AS ls FROM {corpus}),
line AS (SELECT file_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS i FROM cut WHERE chars > {size}),
marked AS (SELECT file_id, i, sum(length(line) + 1) OVER w AS upto, coalesce(max(CASE WHEN {opens} THEN i END) OVER w, -1) AS opened
  FROM line WINDOW w AS (PARTITION BY file_id ORDER BY i)),
lists AS (SELECT file_id, count(*) AS n, list_concat([0], list(upto ORDER BY i)) AS us, list(opened ORDER BY i) AS os FROM marked GROUP BY 1),
fold AS (
  SELECT file_id, 0::BIGINT AS e, 0::BIGINT AS first, -1::BIGINT AS a, -1::BIGINT AS b FROM lists
  UNION ALL SELECT file_id, e + 1, CASE WHEN closed THEN greatest(first, cut - {over}) ELSE first END,
    CASE WHEN closed THEN first ELSE -1 END, CASE WHEN closed THEN cut ELSE -1 END
  FROM (SELECT f.*, us[e + 2] - us[first + 1] >= {size} AS closed,
      CASE WHEN os[e + 1] > greatest(first, e - {back}) THEN os[e + 1] ELSE e END AS cut
    FROM fold f JOIN lists USING (file_id) WHERE e < n)),
spans AS (
  SELECT file_id, a, b FROM fold WHERE b > a
  UNION ALL SELECT f.file_id, first, e FROM fold f JOIN lists l ON l.file_id = f.file_id AND f.e = l.n WHERE first < e
  UNION ALL SELECT file_id, 0, len(ls) FROM cut WHERE chars <= {size})"""


_CODE_RECURSIVE = "RECURSIVE " + B.CODE_SQL


@query("chunk", S.with_ctes(_CODE_RECURSIVE, _chunk_ctes("code"), select="""SELECT s.file_id,
  (row_number() OVER (PARTITION BY s.file_id ORDER BY a, b) - 1)::INT AS chunk_no, array_to_string(ls[a + 1:b], chr(10)) AS code,
  (a + 1)::INT AS start_line, b::INT AS end_line FROM spans s JOIN cut USING (file_id)"""))
def chunk(spark, d):
    return chunks.chunk(B.code(spark, d))


_FUNCTION_LANGUAGES = [x for x in P.FUNCTIONS if x != "python"]


def _functions_sql() -> str:
    parts = []
    for language in _FUNCTION_LANGUAGES:
        pattern, groups, _ = P.FUNCTIONS[language]
        pattern = lit("(?s)" + pattern.replace(r"\s++", r"\s"))
        name = "coalesce(" + ", ".join(f"nullif(regexp_extract(m, {pattern}, {g}), '')" for g in groups) + ")"
        parts.append(f"""SELECT file_id, name, m AS code, line AS start_line, line + {S.count_newlines('m')} AS end_line FROM (
  SELECT file_id, m, {name} AS name, 1 + {S.count_newlines("array_to_string(gs[1:i+1], '')")}
    + {S.count_newlines("array_to_string(ms[1:i], '')")} AS line FROM (
    SELECT *, ms[i + 1] AS m FROM (SELECT *, unnest(range(0, len(ms))) AS i FROM (SELECT file_id,
      regexp_extract_all(content, {pattern}) AS ms, string_split_regex(content, {pattern}) AS gs FROM feat WHERE language = {lit(language)}))))""")
    return "\nUNION ALL\n".join(parts)


@query("extract_functions", S.with_ctes(B.CODE_SQL, S.features(False), select=_functions_sql()))
def extract_functions(spark, d):
    """The six languages whose pattern needs no look-ahead."""
    files = B.code(spark, d).withColumn("language", X.language_from_path(F.col("path"))).filter(
        F.col("language").isin(_FUNCTION_LANGUAGES))
    return chunks.extract_functions(files).drop("match_idx")


@query("extract_python_functions")
def extract_python_functions(spark, d):
    files = B.code(spark, d).withColumn("language", X.language_from_path(F.col("path")))
    return chunks.extract_functions(files.filter(F.col("language") == "python"))


@query("preprocess", f"""WITH {B.CODE_SQL}, n AS (SELECT file_id, path, {S.normalize('content')} AS normal FROM code)
SELECT file_id, normal AS content, coalesce({S.PATH_LANGUAGE_SQL}, {S.content_language('normal')}) AS language,
  {S.frameworks('normal')} AS frameworks, {S.count_newlines('normal')} AS line_count, length(normal) AS char_count FROM n""")
def preprocess(spark, d):
    return chunks.preprocess(B.code(spark, d)).drop("chunks", "path").withColumn("frameworks", F.concat_ws(",", "frameworks"))


@query("preprocess_chunks", S.with_ctes(
    _CODE_RECURSIVE, f"n AS (SELECT file_id, path, {S.normalize('content')} AS content FROM code)", _chunk_ctes("n"),
    select=f"""SELECT file_id, coalesce({S.PATH_LANGUAGE_SQL}, {S.content_language('content')}) AS language, c.n_chunks
FROM n JOIN (SELECT file_id, count(*)::INT AS n_chunks FROM spans GROUP BY 1) c USING (file_id)"""))
def preprocess_chunks(spark, d):
    return chunks.preprocess(B.code(spark, d)).select("file_id", "language", F.size("chunks").alias("n_chunks"))


@query("preprocess_functions")
def preprocess_functions(spark, d):
    return chunks.preprocessed_functions(B.code(spark, d)).groupBy("file_id").agg(F.count("*").alias("n"))


# ── samples ─────────────────────────────────────────────────────────────────

def _draw_sql(key: str, purpose: str, bound: str) -> str:
    return f"(('0x' || substr(md5({key} || '-{purpose}-42'), 1, 8))::BIGINT % {bound})"


def _sample_rows() -> list[tuple]:
    rows = []
    for _, class_id, pick, language, weak, sound, why_weak, why_sound in template_rows():
        for vulnerable, text, why in ((True, weak, why_weak), (False, sound, why_sound)):
            for k in range(len(P.NAME_SETS)):
                rows.append((class_id, pick, language, vulnerable, k, fill_names(text, k), why))
    return rows


_COUNTS = "[" + ", ".join(str(len(TEMPLATES[c])) for c in range(11)) + "]"
_SAMPLES_SQL = [B.values("variants", "class_id, pick, language, is_vulnerable, k, code, description", _sample_rows()),
                B.values("class_names", "class_id, class_name", list(CLASS_NAMES.items())), f"""
pairs AS (SELECT doc_id AS pair_id, (doc_id % 11)::INT AS class_id FROM documents),
picked AS (SELECT *, {_draw_sql('pair_id', 'template', f'{_COUNTS}[class_id + 1]')} AS pick FROM pairs),
halves AS (SELECT *, pair_id * 2 + h AS sample_id, h = 0 AS is_vulnerable FROM picked, (VALUES (0), (1)) t(h)),
named AS (SELECT *, {_draw_sql('sample_id', 'names', len(P.NAME_SETS))} AS k FROM halves),
samples AS (SELECT sample_id, v.code, class_id, v.language, is_vulnerable,
  CASE WHEN is_vulnerable THEN class_name ELSE 'Safe' END AS vulnerability_name, v.description
  FROM named JOIN variants v USING (class_id, pick, is_vulnerable, k) JOIN class_names USING (class_id))"""]


def samples(spark, d):
    return labelled_pairs(B.table(spark, d, "documents").select("doc_id"), "doc_id")


@query("labelled_corpus", S.with_ctes(*_SAMPLES_SQL, select="""SELECT sample_id, code, CASE WHEN is_vulnerable THEN class_id::VARCHAR
  ELSE '' END AS labels, language, is_vulnerable, vulnerability_name, description FROM samples"""))
def labelled(spark, d):
    return samples(spark, d).withColumn("labels", F.concat_ws(",", F.col("labels").cast("array<string>")))


@query("labelled_corpus_balance", """WITH n AS (SELECT count(*) AS n FROM documents)
SELECT i::INT AS class_id, n // 22 AS pairs FROM n, range(0, 11) t(i)""")
def labelled_corpus_balance(spark, d):
    """As many samples as documents, generated; equal numbers of pairs per class."""
    n = B.table(spark, d, "documents").count()
    rows = labelled_corpus(spark, n)
    return rows.filter("is_vulnerable").groupBy(F.get("labels", F.lit(0)).alias("class_id")).agg(F.count("*").alias("pairs"))


@query("class_distribution", S.with_ctes(*_SAMPLES_SQL, select="""SELECT n.name AS vulnerability_name, count(s.sample_id) AS n FROM
  (SELECT class_name AS name FROM class_names UNION ALL SELECT 'Safe') n
  LEFT JOIN samples s ON s.vulnerability_name = n.name GROUP BY 1"""))
def class_distribution(spark, d):
    return metrics.class_distribution(samples(spark, d), vuln_classes(spark))


@query("class_weights", """WITH n AS (SELECT count(*) AS total, sum(quality) AS c0, sum(toxic) AS c1 FROM labels)
SELECT i::INT AS class_id, round(total::DOUBLE / (11 * greatest(CASE i WHEN 0 THEN c0 WHEN 1 THEN c1 ELSE 0 END, 1)), 6) AS weight
FROM n, range(0, 11) t(i)""")
def class_weights(spark, d):
    return metrics.class_weights(B.labelled(spark, d)).withColumn("weight", F.round("weight", 6))


def _split_sql(name: str, key: str) -> str:
    return f"""WITH k AS (SELECT {key} AS id, row_number() OVER (ORDER BY md5({key} || '-42'), {key}) - 1 AS pos, count(*) OVER () AS n
  FROM {name})
SELECT id, CASE WHEN pos < floor(n * 0.8::DOUBLE) THEN 'train' WHEN pos < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val'
  ELSE 'test' END AS part FROM k"""


@query("split_dataset", _split_sql("documents", "doc_id"))
def split_documents(spark, d):
    ids = B.table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return split.split_dataset(ids, "id")


@query("split_dataset_crowded", _split_sql("events", "event_id"))
def split_events(spark, d):
    """Sixteen buckets only, so the cut buckets hold many rows."""
    ids = B.table(spark, d, "events").select(F.col("event_id").alias("id"))
    return split.split_dataset(ids, "id", digits=1)


@query("shuffled", "SELECT doc_id FROM documents ORDER BY md5(doc_id || '-7'), doc_id")
def shuffled(spark, d):
    return split.shuffled(B.table(spark, d, "documents").select("doc_id"), "doc_id", 7)


# ── metrics ─────────────────────────────────────────────────────────────────

_CONFUSION = f"""confusion AS (SELECT class_id, count(*) FILTER (prob >= 0.5 AND label = 1) AS tp,
  count(*) FILTER (prob >= 0.5 AND label = 0) AS fp, count(*) FILTER (prob < 0.5 AND label = 1) AS fn,
  count(*) FILTER (prob < 0.5 AND label = 0) AS tn FROM scores GROUP BY 1),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS recall FROM confusion),
per_class AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1,
  tp + fn AS support FROM pr),
sums AS (SELECT sum(tp)::DOUBLE AS tp, sum(fp)::DOUBLE AS fp, sum(fn)::DOUBLE AS fn FROM per_class),
micro1 AS (SELECT CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM sums),
micro AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM micro1),
macro AS (SELECT avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1 FROM per_class),
auc AS (SELECT a.class_id, CASE WHEN max(p) > 0 AND max(n) > 0 THEN sum(CASE WHEN a.prob > b.prob THEN 1.0::DOUBLE
    WHEN a.prob = b.prob THEN 0.5::DOUBLE ELSE 0 END) FILTER (a.label = 1 AND b.label = 0) / (max(p) * max(n)) ELSE 0.5::DOUBLE END AS auc
  FROM scores a JOIN scores b ON a.class_id = b.class_id
  JOIN (SELECT class_id, sum(label) AS p, sum(1 - label) AS n FROM scores GROUP BY 1) t ON t.class_id = a.class_id GROUP BY 1)"""
_METRIC_CTES = [B.SCORES_SQL, _CONFUSION]
_ROUND = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"


def _rounded(df, places=6):
    return df.withColumns({c: F.round(c, places) for c in ("precision", "recall", "f1")})


def per_class(spark, d):
    return metrics.per_class_metrics(B.scores(spark, d))


@query("per_class_metrics", S.with_ctes(*_METRIC_CTES, select=f"SELECT class_id, tp, fp, fn, tn, {_ROUND}, support FROM per_class"))
def per_class_metrics(spark, d):
    return _rounded(per_class(spark, d))


@query("macro_metrics", S.with_ctes(*_METRIC_CTES, select=f"SELECT {_ROUND} FROM macro"))
def macro_metrics(spark, d):
    return _rounded(metrics.macro_metrics(per_class(spark, d)))


@query("micro_metrics", S.with_ctes(*_METRIC_CTES, select=f"SELECT {_ROUND} FROM micro"))
def micro_metrics(spark, d):
    return _rounded(metrics.micro_metrics(per_class(spark, d)))


@query("roc_auc", S.with_ctes(*_METRIC_CTES, select="SELECT class_id, round(auc, 6) AS auc FROM auc"))
def roc_auc(spark, d):
    return metrics.roc_auc(B.scores(spark, d)).withColumn("auc", F.round("auc", 6))


@query("roc_points", S.with_ctes(B.SCORES_SQL, select="""SELECT class_id, round(prob, 6) AS prob, sum(label)::BIGINT AS pos,
  sum(1 - label)::BIGINT AS neg, sum(sum(label)) OVER w::BIGINT AS tp, sum(sum(1 - label)) OVER w::BIGINT AS fp
FROM scores GROUP BY class_id, prob WINDOW w AS (PARTITION BY class_id ORDER BY prob DESC ROWS UNBOUNDED PRECEDING)""".replace(
    "sum(sum(label)) OVER w::BIGINT", "(sum(sum(label)) OVER w)::BIGINT").replace(
    "sum(sum(1 - label)) OVER w::BIGINT", "(sum(sum(1 - label)) OVER w)::BIGINT")))
def roc_points(spark, d):
    return metrics.roc_points(B.scores(spark, d)).withColumn("prob", F.round("prob", 6))


@query("metrics_table", S.with_ctes(*_METRIC_CTES, B.CLASSES_SQL, select="""
SELECT name AS class_name, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, round(auc, 4) AS auc, support
FROM per_class JOIN classes ON class_id = vuln_class JOIN auc USING (class_id)
UNION ALL SELECT 'Macro Average', round(precision, 4), round(recall, 4), round(f1, 4), NULL, NULL FROM macro
UNION ALL SELECT 'Micro Average', round(precision, 4), round(recall, 4), round(f1, 4), NULL, NULL FROM micro"""))
def metrics_table(spark, d):
    return learn.evaluate(B.scores(spark, d), vuln_classes(spark))


# ── models ──────────────────────────────────────────────────────────────────

def labelled_texts(spark, d):
    """The given texts with the given labels: class 0 is quality, class 1 is toxic."""
    texts = B.table(spark, d, "documents").select("doc_id", "text")
    return texts.join(B.labelled(spark, d), "doc_id").select(F.col("doc_id").alias("sample_id"), F.col("text").alias("code"), "labels")


@query("train_and_score")
def train_and_score(spark, d):
    """Trains on the labelled documents and scores every document; a text is tokenised once for both."""
    counted = written(learn.featurize(B.documents(spark, d), "content").select("file_id", "path", "features"), "features")
    labels = B.labelled(spark, d).withColumnRenamed("doc_id", "file_id")
    classifier, _ = learn.train(counted.join(labels, "file_id"), "file_id", "features")
    return learn.score(classifier, counted, "features")


@query("train_and_evaluate")
def train_and_evaluate(spark, d):
    classifier, test = learn.train(labelled_texts(spark, d))
    return learn.evaluate(learn.labelled_scores(classifier, test), vuln_classes(spark))
