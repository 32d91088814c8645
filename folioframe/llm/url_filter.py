"""URL filtering: host and path rules, then a listed-URL test by blocked Bloom filter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm.common import LOWER, UPPER, stored

# Odd multipliers of the split-block filter (fixed values).
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)
BLOCK_BITS, BITS_PER_KEY = 256, 16


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, with A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host, path without slashes at its end, and the sorted parameters that are no tracking.

    Scheme and fragment do not count. Null where there is no host.
    """
    query = F.coalesce(F.regexp_extract(url, r"://[^/?#]*[^?#]*\?([^#]*)", 1), F.lit(""))
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(?:utm_|ref=|page=)"))
    joined = F.array_join(F.array_sort(kept), "&")
    host, path = host_of(url), F.regexp_replace(path_of(url), "/+$", "")
    return F.when(host != "", F.concat(host, path, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise("")))


def fitting(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def in_filter(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key and its one bit in each of the block's eight words."""
    hashed = F.xxhash64(key)
    block = F.pmod(F.shiftrightunsigned(hashed, 32), F.lit(blocks))
    low = hashed.bitwiseAND(F.lit(0x7FFFFFFF))
    # The product stays below 2^63; the five highest of its low 32 bits choose the bit.
    bits = [F.shiftrightunsigned((low * F.lit(s)).bitwiseAND(F.lit(0xFFFFFFFF)), 27).cast("int") for s in SALTS]
    return block, [F.call_function("shiftleft", F.lit(1).cast("long"), b) for b in bits]


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter of ``keys(key)`` as a table: a row per block with its eight words."""
    block, bits = in_filter(F.col("key"), blocks)
    named = keys.select(block.alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(bits)])
    return named.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(len(SALTS))])


def listed_urls(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """``key``: the distinct canonical ``urls(key)`` that stand in ``listed(key)``.

    The filter lets all listed ones and few others pass; only those are shuffled to the exact
    join. It is a table that is joined by block, so neither side has to fit anywhere; where it
    is small, Spark sends it to all tasks.
    """
    listed = stored(listed.filter("key IS NOT NULL").distinct(), "urls-listed")
    blocks = max(1, -(-listed.count() * BITS_PER_KEY // BLOCK_BITS))
    words = stored(bloom(listed, blocks), "urls-filter")
    block, bits = in_filter(F.col("key"), blocks)
    asked = urls.filter("key IS NOT NULL").distinct().select(
        "key", block.alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(bits)])
    passes = F.lit(True)
    for i in range(len(SALTS)):
        passes = passes & (F.col(f"w{i}").bitwiseAND(F.col(f"b{i}")) != 0)
    possible = asked.join(words, "block").filter(passes).select("key")
    return possible.join(listed, "key", "left_semi")


def judge(pages: DataFrame, rules: list[Rule], listed: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict, canonical`` of every row of ``pages(page_id, url)``.

    The longest rule that fits decides; without one, a URL whose canonical form stands in
    ``listed(key)`` is blocked and any other allowed. A null url, or one without ://, has an
    empty host and path, fits no rule and is allowed. Repeated rows are judged alike; an empty
    list blocks nothing.
    """
    told = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical(F.col("url")).alias("canonical"))
    name, verdict = fitting(F.col("host"), F.col("path"), rules)
    hits = stored(listed_urls(told.select(F.col("canonical").alias("key")), listed), "urls-hit").withColumn("hit", F.lit(True))
    return told.join(hits, told.canonical == hits.key, "left").select(
        "page_id", "host", "path", name.alias("rule"),
        F.coalesce(verdict, F.when(F.col("hit"), "block"), F.lit("allow")).alias("verdict"), "canonical")
