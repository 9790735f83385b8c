"""URL filters in DataFrame functions alone: rules by longest fit, then a listed-URL test.

A blocked Bloom filter of the listed canonical URLs lets most other URLs pass without a
shuffle; what it stops goes through an exact hash join that removes its false positives.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Query parameters that do not name a page, and labels in front of a host that do not either.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref")
ALIAS_LABELS = ("www", "m")

WORDS = 4  # 64-bit words in a block; one probe sets a bit in each
SMALL_FILTER = 1 << 20  # blocks up to which the filter (40 bytes each) is broadcast


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(rest, upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null where none does.

    A rule fits its host and all subdomains where the path starts with the rule's.
    """
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def canonical(url: Column, host: Column, path: Column) -> Column:
    """One form for URLs of the same page: no scheme, alias label, default port, fragment,
    tracking parameter or trailing slash; the other parameters are sorted.  Null without a host."""
    plain = F.regexp_replace(F.regexp_replace(host, r":(80|443)\z", ""), rf"^(?:{'|'.join(ALIAS_LABELS)})\.", "")
    short = F.regexp_replace(path, r"/+\z", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.split(p, "=")[0].isin(*TRACKING))
    kept = F.array_join(F.array_sort(pairs), "&")
    return F.when(host != "", F.concat(plain, short, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def _probes(url: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block of a URL and its one-bit masks, one for each word of the block."""
    place, bits = F.xxhash64(url), F.xxhash64(url, F.lit(1))
    masks = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
             for i in range(WORDS)]
    return F.pmod(place, F.lit(blocks)), masks


def blocked_bloom(listed: DataFrame, url_col: str, rows: int, bits_per_url: int = 16) -> tuple[DataFrame, int]:
    """``block, w0 … w3`` for the blocks that are not empty, and the number of blocks.

    The number follows ``rows``, so the rate of false positives does not depend on the list.
    """
    blocks = max(1, math.ceil(rows * bits_per_url / (64 * WORDS)))
    block, masks = _probes(F.col(url_col), blocks)
    words = [F.bit_or(m).alias(f"w{i}") for i, m in enumerate(masks)]
    return listed.groupBy(block.alias("block")).agg(*words), blocks


def judge(pages: DataFrame, rules: Sequence[Rule], listed: DataFrame, id_col: str = "page_id", url_col: str = "url",
          listed_col: str = "url") -> DataFrame:
    """``id_col, host, path, canonical, rule, verdict`` for every row of ``pages``.

    The verdict is the longest fitting rule's; where no rule fits, ``block`` if the canonical
    form of the URL is among those of ``listed``, else ``allow``.  A null URL, or one without
    ``://``, has an empty host and path, no rule, and is allowed.  Repeated rows and repeated
    list entries are fine; an empty list blocks nothing.

    The filter is broadcast up to ``SMALL_FILTER`` blocks and joined by its block beyond.  The
    join with the list is left to Spark, which measures both sides; adaptive execution splits a
    URL that many pages share.
    """
    own = canonical(F.col(listed_col), host_of(F.col(listed_col)), path_of(F.col(listed_col)))
    names = listed.select(own.alias("listed_url")).filter("listed_url IS NOT NULL").distinct()
    bloom, blocks = blocked_bloom(names, "listed_url", names.count())

    url, host, path = F.col("_url"), F.col("host"), F.col("path")
    rule, verdict = rule_of(host, path, rules)
    parsed = pages.select(F.col(id_col), F.col(url_col).cast("string").alias("_url")).withColumns(
        {"host": host_of(url), "path": path_of(url)}).select(
        id_col, "host", "path", canonical(url, host, path).alias("canonical"), rule.alias("rule"), verdict.alias("verdict"))
    # rows with a rule need no test: their key is null and meets no block
    tested = F.when(F.col("rule").isNull(), F.col("canonical"))
    block, masks = _probes(tested, blocks)
    key = F.when(tested.isNotNull(), block).otherwise(-1 - F.pmod(F.xxhash64(id_col), F.lit(1 << 20)))
    side = F.broadcast(bloom) if blocks <= SMALL_FILTER else bloom
    seen = parsed.withColumn("block", key).join(side, "block", "left").withColumn(
        "possible", F.coalesce(F.expr(" AND ".join(f"w{i} IS NOT NULL" for i in range(WORDS))) & _all(
            [F.col(f"w{i}").bitwiseAND(m) == m for i, m in enumerate(masks)]), F.lit(False)))
    columns = [id_col, "host", "path", "canonical", "rule"]
    passed = seen.filter(~F.col("possible")).select(*columns, F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    hits = seen.filter("possible").join(names.withColumn("hit", F.lit(True)), F.col("canonical") == F.col("listed_url"), "left")
    return passed.unionByName(hits.select(*columns, F.when(F.col("hit"), "block").otherwise("allow").alias("verdict")))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
