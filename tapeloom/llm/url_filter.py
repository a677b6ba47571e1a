"""URL filter: host/path rules first, then a list of canonical URLs behind a blocked Bloom filter.

The filter is a table of 256-bit blocks (four longs). A key's hash names one block and two bits in
each of its longs, so a probe touches one row. URLs whose bits are all set are only *possible* hits;
an exact hash join with the list removes the false ones.

Nulls: a null URL, or one without ``://``, has an empty host and path and is never on the list. Empty
tables give empty results. Repeated rows stay repeated. Other columns of the input are not carried,
so their names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.plans.shared import settle

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Query parameters that do not change what a URL shows.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"
WORDS_PER_BLOCK = 4
BITS_PER_BLOCK = 64 * WORDS_PER_BLOCK
#: A filter of at most this many blocks (48 bytes each as a row, 24 MB) is broadcast.
BROADCAST_BLOCKS = 500_000


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and query; all empty for null or where ``://`` is missing."""
    def part(pattern: str, group: int) -> Column:
        return F.coalesce(F.regexp_extract(url, pattern, group), F.lit(""))

    host = F.translate(part("(?s)^.*?://([^/?#]*)", 1), UPPER, UPPER.lower())
    path = part("(?s)^.*?://[^/?#]*([^?#]*)", 1)
    query = part(r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    return host, path, query


def canonical_url(url: Column) -> Column:
    """Host, path without trailing slashes, and sorted parameters without tracking; null if no host."""
    host, path, query = url_parts(url)
    kept = F.array_sort(
        F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    )
    shown = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    plain = F.concat(
        F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", ""), shown
    )
    return F.when(host != "", plain)


def match_rules(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Longest fitting rule as text, and its verdict; of equally long ones the first listed."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # Built from the shortest up, so the longest ends outermost and is asked first.
    for r in sorted(reversed(rules), key=lambda r: len(r.host + r.path)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        rule = F.when(fits, F.lit(r.host + r.path)).otherwise(rule)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def _masks(key: Column) -> list[Column]:
    """Two bits for each long of the key's block, six hash bits naming each."""
    bits = F.xxhash64(key, F.lit("bits"))

    def bit(n: int) -> Column:
        place = F.shiftrightunsigned(bits, 6 * n).bitwiseAND(F.lit(63)).cast("int")
        return F.call_function("shiftleft", F.lit(1).cast("long"), place)

    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(WORDS_PER_BLOCK)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks).cast("long"))


def build_filter(listed: DataFrame, key: str, bits_per_key: int = 16) -> tuple[DataFrame, int]:
    """Table (block, w0..w3) of the blocks in use, and the number of blocks it is spread over."""
    n = listed.where(F.col(key).isNotNull()).count()
    blocks = max(1, math.ceil(n * bits_per_key / BITS_PER_BLOCK))
    words = [
        F.bit_or(mask).alias(f"w{w}") for w, mask in enumerate(_masks(F.col(key)))
    ]
    table = (
        listed.where(F.col(key).isNotNull())
        .groupBy(_block(F.col(key), blocks).alias("block"))
        .agg(*words)
    )
    return settle(table, "bloom"), blocks


def judge_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    listed_col: str = "canonical",
) -> DataFrame:
    """One row per page: id, host, path, rule, listed, verdict.

    ``listed`` holds canonical URLs to block. The rule decides where one fits; else a
    listed URL is blocked and any other allowed.
    """
    url = F.col(url_col)
    host, path, _ = url_parts(url)
    rule, ruled = match_rules(F.col("host"), F.col("path"), rules)
    judged = (
        pages.select(
            F.col(id_col).alias("page_id"),
            host.alias("host"),
            path.alias("path"),
            canonical_url(url).alias("canonical"),
        )
        .withColumns({"rule": rule, "ruled": ruled})
    )
    listed = settle(listed.select(listed_col).distinct(), "listed")
    bloom, blocks = build_filter(listed, listed_col)
    side = F.broadcast(bloom) if blocks <= BROADCAST_BLOCKS else bloom
    masks = {f"m{w}": mask for w, mask in enumerate(_masks(F.col("canonical")))}
    probed = judged.withColumns(masks | {"block": _block(F.col("canonical"), blocks)}).join(
        side, "block", "left"
    )
    possible = F.lit(True)
    for w in range(WORDS_PER_BLOCK):
        possible = possible & (F.col(f"w{w}").bitwiseAND(F.col(f"m{w}")) == F.col(f"m{w}"))
    probed = probed.withColumn("possible", F.coalesce(possible, F.lit(False)))
    wanted = ["page_id", "host", "path", "rule", "ruled"]
    exact = listed.select(F.col(listed_col).alias("canonical"), F.lit(True).alias("listed"))
    hits = (
        probed.where("possible")
        .select(*wanted, "canonical")
        .join(exact.hint("shuffle_hash"), "canonical", "left")
        .select(*wanted, F.coalesce("listed", F.lit(False)).alias("listed"))
    )
    misses = probed.where(~F.col("possible")).select(*wanted, F.lit(False).alias("listed"))
    by_list = F.when(F.col("listed"), "block").otherwise("allow")
    return hits.unionByName(misses).select(
        "page_id", "host", "path", "rule", "listed", F.coalesce("ruled", by_list).alias("verdict")
    )


def repeated_urls(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Canonical URLs that several pages share: mirrors and tracking variants of one address."""
    return (
        pages.select(canonical_url(F.col(url_col)).alias("canonical"))
        .where("canonical is not null")
        .groupBy("canonical")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("canonical")
    )
