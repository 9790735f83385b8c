"""Lexing, vocabulary, encoding and decoding of source texts."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnsieve.catalog import lexicon as L
from vulnsieve.functions.matching import sql_in, sql_text

_TYPE = {name: i for i, name in enumerate(L.TOKEN_TYPES)}


def token_array(content: Column) -> Column:
    """The tokens of a text in order, blanks dropped."""
    return F.regexp_extract_all(content, F.lit(L.EXTRACT_PATTERN), F.lit(1))


def sql_token_type(token: str) -> str:
    """SQL: the type of a token by its first characters (0 keyword … 9 unknown)."""
    first = f"substring({token}, 1, 1)"
    two = f"substring({token}, 1, 2)"
    return f"""CASE
        WHEN {sql_in(first, ['"', "'"])} AND length({token}) > 1 THEN {_TYPE['string']}
        WHEN {first} = '#' OR {two} IN ('//', '/*') THEN {_TYPE['comment']}
        WHEN {first} BETWEEN '0' AND '9' OR ({first} = '.' AND substring({token}, 2, 1) BETWEEN '0' AND '9')
            THEN {_TYPE['number']}
        WHEN {sql_in(first, '+-*/%&|^~<>!=?:')} OR {token} = '...' THEN {_TYPE['operator']}
        WHEN {sql_in(first, '(){}[];,.@')} THEN {_TYPE['delimiter']}
        WHEN {first} BETWEEN 'a' AND 'z' OR {first} BETWEEN 'A' AND 'Z' OR {first} IN ('_', '$') THEN
            CASE WHEN {sql_in(token, L.ALL_KEYWORDS)} THEN {_TYPE['keyword']} ELSE {_TYPE['identifier']} END
        ELSE {_TYPE['unknown']} END"""


def token_type(token: str = "token") -> Column:
    return F.expr(sql_token_type(token))


def _with_types(tokens: DataFrame) -> DataFrame:
    names = ", ".join(sql_text(n) for n in L.TOKEN_TYPES)
    return tokens.withColumn("type", token_type()).withColumns({
        "type_name": F.expr(f"element_at(array({names}), type + 1)"),
        "is_security_sensitive": F.col("token").isin(L.SENSITIVE_WORDS),
    })


def tokenize(files: DataFrame) -> DataFrame:
    """``file_id, pos, token, type, type_name, is_security_sensitive``: one row per token."""
    return _with_types(files.select("file_id", F.posexplode(token_array(F.col("content"))).alias("pos", "token")))


def frequent_identifiers(tokens: DataFrame, n: int) -> list[str]:
    """The ``n`` most frequent identifiers of a corpus, to seed a vocabulary (``n`` rows reach the driver)."""
    top = tokens.filter(F.col("type") == _TYPE["identifier"]).groupBy("token").agg(F.count("*").alias("c")).orderBy(
        F.col("c").desc(), "token").limit(n)
    return [row.token for row in top.collect()]


def vocabulary(spark: SparkSession, words: Sequence[str] | None = None) -> DataFrame:
    """``token_id int, token string``; its size is fixed by the vocabulary size."""
    words = L.vocabulary_words() if words is None else words
    return spark.createDataFrame(list(enumerate(words)), "token_id int, token string")


def vocab_info(vocab: DataFrame, max_length: int = L.MAX_LENGTH) -> DataFrame:
    return vocab.agg(
        F.count("*").cast("int").alias("vocab_size"),
        F.lit(max_length).alias("max_length"),
        F.count_if(F.col("token").isin(L.ALL_KEYWORDS)).cast("int").alias("num_keywords"),
        F.count_if(F.col("token").isin(L.SENSITIVE_WORDS)).cast("int").alias("num_security_tokens"),
        F.lit(" ".join(L.SPECIAL_TOKENS)).alias("special_tokens"),
    )


def lookup_tokens(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Adds ``token_id``, null for words outside the vocabulary."""
    return tokens.join(F.broadcast(vocab.select("token", "token_id")), "token", "left")


KEPT_PIECES = 200_000  # tokens whose pieces a task keeps; it starts anew when they are that many


def _type_of(token: str) -> int:
    """``sql_token_type`` of one token."""
    first = token[:1]
    if first in ("\"", "'") and len(token) > 1:
        return _TYPE["string"]
    if first == "#" or token[:2] in ("//", "/*"):
        return _TYPE["comment"]
    if "0" <= first <= "9" or first == "." and "0" <= token[1:2] <= "9":
        return _TYPE["number"]
    if first and first in "+-*/%&|^~<>!=?:" or token == "...":
        return _TYPE["operator"]
    if first and first in "(){}[];,.@":
        return _TYPE["delimiter"]
    if "a" <= first <= "z" or "A" <= first <= "Z" or first in ("_", "$"):
        return _TYPE["keyword"] if token in _KEYWORDS else _TYPE["identifier"]
    return _TYPE["unknown"]


_KEYWORDS = frozenset(L.ALL_KEYWORDS)


def _pieces(tokens: Column, ids: dict[str, int], unk: int, max_length: int) -> Column:
    """``struct<ids, types>`` of an array of tokens, at most ``max_length`` each: a known word has one id, others
    one for each character."""
    def piece(token: str) -> tuple[list[int], list[int]]:
        known = ids.get(token)
        own = [known] if known is not None else [
            ids.get(c, unk) if " " <= c <= "~" else unk for c in token[:max_length]]
        return own, [_type_of(token)] * len(own)

    def encoded(lists: pa.Array) -> pa.Array:
        kept: dict[str, tuple[list[int], list[int]]] = {}
        out: tuple[list, list] = ([], [])
        for words in lists.to_pylist():
            numbers, types = (None, None) if words is None else ([], [])
            for token in words or ():
                if len(numbers) >= max_length:
                    break
                if (found := kept.get(token)) is None:
                    if len(kept) >= KEPT_PIECES:
                        kept.clear()
                    found = kept[token] = piece(token)
                numbers += found[0]
                types += found[1]
            out[0].append(numbers and numbers[:max_length])
            out[1].append(types and types[:max_length])
        return pa.StructArray.from_arrays([pa.array(column, pa.list_(pa.int32())) for column in out], ["ids", "types"])

    encoded.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    return F.arrow_udf(encoded, "ids array<int>, types array<int>")(tokens)


def _word_list(words: Sequence[str]) -> Column:
    return F.from_json(F.lit(json.dumps(list(words))), "array<string>")


def encode(
    files: DataFrame,
    words: Sequence[str] | None = None,
    max_length: int = L.MAX_LENGTH,
    add_special_tokens: bool = True,
    padding: bool = True,
) -> DataFrame:
    """``file_id, input_ids, token_type_ids, attention_mask`` (arrays of int).

    Words outside the vocabulary become one id per character.  Everything happens inside the row: no token
    is exploded, joined or regrouped.
    """
    words = L.vocabulary_words() if words is None else list(words)
    ids = {word: i for i, word in enumerate(words)}
    pad, unk, cls, sep = (ids[t] for t in L.SPECIAL_TOKENS[:4])
    unknown_type = _TYPE["unknown"]
    kept = max_length - 2 if add_special_tokens else max_length
    tokens = F.slice(token_array(F.col("content")), 1, kept)
    pieces = files.select("file_id", _pieces(tokens, ids, unk, max_length).alias("_pieces"))

    def framed(middle: str, head: int, tail: int) -> Column:
        whole = f"concat(array({head}), {middle}, array({tail}))" if add_special_tokens else middle
        return F.expr(f"slice({whole}, 1, {max_length})")

    out = pieces.select("file_id", framed("_pieces.ids", cls, sep).alias("input_ids"),
                        framed("_pieces.types", unknown_type, unknown_type).alias("token_type_ids"))
    mask = F.array_repeat(F.lit(1), F.size("input_ids"))
    if not padding:
        return out.withColumn("attention_mask", mask)
    fill = F.lit(max_length) - F.size("input_ids")
    return out.select(
        "file_id",
        F.concat("input_ids", F.array_repeat(F.lit(pad), fill)).alias("input_ids"),
        F.concat("token_type_ids", F.array_repeat(F.lit(unknown_type), fill)).alias("token_type_ids"),
        F.concat(mask, F.array_repeat(F.lit(0), fill)).alias("attention_mask"),
    )


def decode_ids(encoded: DataFrame, words: Sequence[str] | None = None, ids: str = "input_ids") -> DataFrame:
    """``file_id, text``: ids back to words, special tokens dropped, joined by blanks, inside the row.

    An id outside the vocabulary is the unknown token, which is a special one.
    """
    words = L.vocabulary_words() if words is None else list(words)
    rows = encoded.select("file_id", F.col(ids).alias("_ids"), _word_list(words).alias("_words"))
    found = F.expr("transform(_ids, i -> get(_words, i))")
    return rows.select("file_id", F.concat_ws(" ", F.filter(
        found, lambda w: w.isNotNull() & ~w.isin(L.SPECIAL_TOKENS))).alias("text"))
