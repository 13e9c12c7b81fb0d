"""URL filter: rules by host and path, then a blocked Bloom filter before an exact join with the listed URLs.

A block of the filter is eight 64-bit words, and a URL sets one bit in every word of
one block. There is a block for `KEYS` listed URLs, but never more than `BLOCKS`
(32 MiB), so the filter may be broadcast however long the list is: a list beyond
that only lets more false positives through, and the hash join behind it removes
them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.shared import cut

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
BLOCKS, KEYS = 1 << 19, 12
WORDS = 8

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that do not name another page.
TRACKING = r"(?s)[?&](utm_[^&#]*|ref=[^&#]*|fbclid=[^&#]*|gclid=[^&#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www. or m., path without a last slash or .html, query without tracking, no fragment; null if there is no host."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(/|\.html)$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, TRACKING, ""), r"^&", "?")
    return F.when(host != "", F.concat(host, path, query))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, kind in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, _, start = name.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _masks(key: Column) -> list[Column]:
    bits = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * w).bitwiseAND(F.lit(63)).cast("int")) for w in range(WORDS)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w7) of the keys (column key): at most `blocks` rows."""
    rows = keys.select(_block(F.col("key"), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col("key")))])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def filter_urls(pages: DataFrame, listed: DataFrame, url_col: str = "url", listed_col: str = "url", rules=RULES) -> DataFrame:
    """Pages with host, path, rule (null if none fits) and verdict: the rule's, else block if the canonical URL is listed, else allow.

    Null URLs and URLs without `://` have an empty host and path and are allowed.
    Input columns of the four names are replaced; repeated rows stay.
    """
    new = ("host", "path", "rule", "verdict")
    url = F.col(f"`{url_col}`")
    host, path = host_of(url), path_of(url)
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("__row"), host.alias("host"), path.alias("path"), canonical(url).alias("__key"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("__row", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "__key")
    keys = listed.select(canonical(F.col(f"`{listed_col}`")).alias("key")).where("key is not null").distinct()
    keys = cut(keys)
    blocks = min(BLOCKS, max(1, -(-keys.count() // KEYS)))
    bloom = F.broadcast(bloom_filter(keys, blocks))
    probed = rows.withColumn("block", _block(F.col("__key"), blocks)).join(bloom, "block", "left")
    hit = F.col("w0").isNotNull() & F.col("__key").isNotNull()
    for i, mask in enumerate(_masks(F.col("__key"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(mask) == mask)
    hit = hit & F.col("verdict").isNull()
    done = probed.where(~F.coalesce(hit, F.lit(False))).select("__row", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    sure = probed.where(F.coalesce(hit, F.lit(False))).join(keys, F.col("__key") == F.col("key"), "left")
    sure = sure.select("__row", "host", "path", "rule", F.when(F.col("key").isNotNull(), "block").otherwise("allow").alias("verdict"))
    return done.union(sure).select(*[F.col(f"__row.`{c}`") for c in pages.columns if c not in new], *new)
