"""Personal data: patterns propose spans, checksums confirm them, context words rate them.

The scan of one text is plain Python over ``str``; Spark cuts the table into tasks.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnsieve.llm.common import named, whole_text

#: Kinds in the order in which spans are listed; the first four are kept whatever their score.
KINDS = ("email", "ip", "card", "phone", "iban", "secret", "ssn", "imei")
BASE_KINDS = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: An address starts where its run of digits starts: from a later digit it would match too, so
#: the leftmost match never begins inside a run.  The same holds for card and phone numbers.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SECRET = re.compile(
    r"(?i:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)[\"']?[ \t]{0,4}[:=][ \t]{0,4}[\"']([^\"'\s]{8,}+)[\"']")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGITS = re.compile(r"[0-9]")

#: Score of a confirmed span before its context is read, and what a context word adds.
START = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.5, "iban": 0.8, "secret": 0.7, "ssn": 0.3, "imei": 0.2}
CONTEXT = {
    "email": ("mail", "contact", "write to", "reply"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "sms"),
    "iban": ("iban", "account", "bank", "transfer"),
    "secret": ("token", "secret", "key", "password", "credential"),
    "ssn": ("ssn", "social security", "taxpayer"),
    "imei": ("imei", "device", "handset", "serial"),
}
#: Words that make a number unlikely to be personal.
AGAINST = ("version", "build", "isbn", "issn", "order", "invoice", "sample", "example")
STEP, WINDOW, LEAST = 0.3, 40, 0.5


def luhn(digits: str) -> bool:
    total = 0
    for place, ch in enumerate(reversed(digits)):
        n = ord(ch) - 48
        if place % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of ISO 13616: moved to the end, letters as 10 to 35, the remainder is one."""
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(ch, 36)) for ch in turned)) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of the email pattern, found from their @ signs: linear in the text."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        if at > done and text[at - 1] in _LOCAL and (domain := _DOMAIN.match(text, at + 1)):
            start = at - 1
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            out.append((start, domain.end()))
            done = domain.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    return out


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four base kinds: leftmost, not overlapping, failing matches dropped."""
    out = [("email", s, e) for s, e in _emails(text)]
    if not _DIGITS.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGITS.findall(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _proposed(text: str) -> list[tuple[str, int, int]]:
    """Spans of the added kinds that their checksum, where there is one, confirms."""
    out = []
    for m in _IBAN.finditer(text):
        packed = m[0].replace(" ", "")
        if 15 <= len(packed) <= 34 and mod97(packed):
            out.append(("iban", m.start(), m.end()))
    for m in _SECRET.finditer(text):
        value = m[1]
        if len(set(value)) >= 6 and any(c.isdigit() for c in value):
            out.append(("secret", m.start(1), m.end(1)))
    if _DIGITS.search(text):
        out += [("ssn", m.start(), m.end()) for m in _SSN.finditer(text)
                if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000"]
        for m in _CARD.finditer(text):
            if m.end() - m.start() == 15 and luhn(m[0].replace(" ", "").replace("-", "")) and m[0].isdigit():
                out.append(("imei", m.start(), m.end()))
    return out


def _rated(text: str, kind: str, start: int, end: int) -> float:
    near = (text[max(0, start - WINDOW):start] + " " + text[end:end + WINDOW // 2]).lower()
    words = re.split(r"[^\w]+", near)
    hit = any(w in near if " " in w else any(x.startswith(w) for x in words) for w in CONTEXT[kind])
    miss = any(any(x.startswith(w) for x in words) for w in AGAINST)
    return round(min(1.0, max(0.0, START[kind] + STEP * hit - STEP * miss)), 3)


def scan(text: str) -> list[tuple[str, int, int, float]]:
    """All spans ``(kind, start, end, score)`` of a text, ordered by kind, then start.

    Offsets count code points, ends are exclusive.  Base kinds stay whatever their score; an
    added span needs a score of ``LEAST`` and must not overlap a base span.
    """
    base = base_spans(text)
    out = [(k, s, e, _rated(text, k, s, e)) for k, s, e in base]
    # the base spans that start before an added one ends overlap it if the furthest end among them does
    places = sorted((s, e) for _, s, e in base)
    starts, ends = [s for s, _ in places], list(accumulate((e for _, e in places), max))
    for kind, s, e in _proposed(text):
        before = bisect_left(starts, e)
        if not before or ends[before - 1] <= s:
            score = _rated(text, kind, s, e)
            if score >= LEAST:
                out.append((kind, s, e, score))
    out.sort(key=lambda x: (KINDS.index(x[0]), x[1]))
    return out


def redacted(text: str) -> str:
    """The text with every span replaced by the name of its kind; overlapping spans become one."""
    parts, done = [], 0
    merged: list[list] = []
    for kind, s, e, _ in sorted(scan(text), key=lambda x: (x[1], -x[2])):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([kind, s, e])
    for kind, s, e in merged:
        parts += [text[done:s], f"[{kind.upper()}]"]
        done = e
    return "".join(parts) + text[done:]


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
_SPANS_ARROW = pa.list_(pa.struct(
    [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, spans`` for every row of ``docs``; rows are scanned where they are read.

    A null or empty text has no span.  Repeated rows give repeated results; an empty table none.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def scan_batches(batches):
        names = ("kind", "start", "end", "score")
        for batch in batches:
            found = [[dict(zip(names, span)) for span in scan(text)] for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPANS_ARROW)], [id_col, "spans"])

    return docs.select(named(id_col), whole_text(text_col).alias("_text")).mapInArrow(
        scan_batches, f"`{id_col}` {kind}, spans {SPANS}")


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced; null stays null, all columns and rows stay."""
    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else redacted(t))

    return docs.withColumn(text_col, clean(named(text_col)))
