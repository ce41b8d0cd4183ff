"""URL rules and listed URLs behind a blocked Bloom filter.

Entries are rules (host, path, verdict), which fit their host, its subdomains
and every path that starts with theirs, and listed canonical URLs, which are
blocked as they are.  A URL's candidates are the (host ending, path beginning)
pairs of the label counts and path lengths that rules have, and itself.

The filter has 512-bit blocks, one for every ``PER_BLOCK`` entries.  An entry sets
six bits of one block; a candidate is looked up in one block: up to
``BROADCAST_BLOCKS`` blocks by a broadcast join on the map side, beyond by a
shuffle of the distinct candidates by block.  Only possible hits go on to an exact
hash join with the entries, which removes the filter's false positives.  All of it
is DataFrame expressions.

Verdicts per URL are written before pages meet them, so that adaptive execution can
split a URL that very many pages share; urls without a host join nothing and are
spread by their page id.

Defined results: host and path are empty where the url is null or has no
``://``, and such a url meets no rule and is not listed; the longest rule wins,
then the longer host, then ``block``; what no rule decides is blocked if
listed and else allowed; rows that repeat an id or a url are judged one by one;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakeperf.llm.common import written

#: Entries a block of 64 bytes holds on average, bits an entry sets, least blocks, and most to be broadcast (4 MB).
PER_BLOCK, BITS, LEAST_BLOCKS, BROADCAST_BLOCKS = 32, 6, 1 << 10, 1 << 16
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Lower-cased host, and path without query or fragment."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _AZ, _AZ.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def filter_blocks(entries: int) -> int:
    """Blocks of a filter of so many entries: a power of two."""
    return max(LEAST_BLOCKS, 1 << max(0, -(-entries // PER_BLOCK) - 1).bit_length())


def _hashed(rows: DataFrame, blocks: int) -> DataFrame:
    """Rows of (exact, host, path) with their block and the numbers of their bits."""
    h = F.xxhash64("exact", "host", "path")
    bits = F.xxhash64("path", "exact", "host", F.lit("bits"))
    return rows.withColumn("block", F.pmod(h, F.lit(blocks))).withColumn("bits", F.array(*(F.shiftrightunsigned(bits, 9 * j).bitwiseAND(511).cast("int") for j in range(BITS))))


def bloom_blocks(entries: DataFrame, blocks: int) -> DataFrame:
    """(block, eight words): at most ``blocks`` rows."""
    bit = _hashed(entries, blocks).select("block", F.explode("bits").alias("bit"))
    word = F.expr("shiftleft(1L, bit & 63)")
    return bit.groupBy("block").agg(F.array(*(F.bit_or(F.when(F.expr(f"bit >> 6 = {w}"), word).otherwise(F.lit(0).cast("bigint"))) for w in range(8))).alias("words"))


def possible_hits(candidates: DataFrame, filled: DataFrame, blocks: int) -> DataFrame:
    """The candidates all of whose bits are set."""
    if blocks <= BROADCAST_BLOCKS:
        probed = _hashed(candidates, blocks).join(F.broadcast(filled), "block")
    else:
        probed = _hashed(candidates.distinct(), blocks).join(filled.hint("shuffle_hash"), "block")
    every = F.expr("forall(bits, b -> (shiftright(words[b >> 6], b & 63) & 1L) = 1L)")
    return probed.where(every).drop("block", "bits", "words")


def candidates(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url_host, url_path, exact, host, path) of every distinct candidate of rows (host, path)."""
    shape = rules.agg(F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")).first()
    labels, lengths = sorted(shape["labels"]) or [0], sorted(shape["lengths"]) or [0]  # at most a URL's length
    parts = F.split("host", r"\.")
    ending = F.explode(F.expr(f"filter(array({','.join(map(str, labels))}), n -> n <= size(split(host, '\\\\.')))")).alias("n")
    begins = F.explode(F.expr(f"filter(array({','.join(map(str, lengths))}), n -> n <= length(path))")).alias("m")
    prefix = urls.select("host", "path", ending).select("host", "path", "n", begins)
    prefix = prefix.select(F.col("host").alias("url_host"), F.col("path").alias("url_path"), F.lit(False).alias("exact"),
                           F.array_join(F.slice(parts, F.size(parts) - F.col("n") + 1, F.col("n")), ".").alias("host"), F.expr("substring(path, 1, m)").alias("path"))
    return prefix.unionByName(urls.select(F.col("host").alias("url_host"), F.col("path").alias("url_path"), F.lit(True).alias("exact"), "host", "path"))


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row.

    rules: (host, path, verdict); listed: (host, path) of canonical URLs."""
    host, path = host_and_path(url)
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    entries = rules.selectExpr("false exact", "host", "path", "verdict").unionByName(listed.selectExpr("true exact", "host", "path", "'block' verdict").distinct())
    entries = written(entries, "entries")
    blocks = filter_blocks(entries.count())
    urls = rows.where("host <> ''").select("host", "path")
    hits = possible_hits(candidates(urls, rules), bloom_blocks(entries, blocks), blocks).distinct()
    sure = hits.join(entries.hint("shuffle_hash"), ["exact", "host", "path"])
    rule = F.when(~F.col("exact"), F.struct(F.length(F.concat("host", "path")).alias("length"), F.length("host").alias("host_length"), (F.col("verdict") == "block").alias("first"), F.concat("host", "path").alias("rule"), "verdict"))
    decided = sure.groupBy("url_host", "url_path").agg(F.max(rule).alias("best"), F.max("exact").alias("listed"))
    decided = decided.select(F.col("url_host").alias("host"), F.col("url_path").alias("path"), "best", "listed")
    decided = written(decided.withColumn("spread", F.lit(0).cast("bigint")), "decided")
    rows = rows.withColumn("spread", F.when(F.col("host") == "", F.xxhash64("page_id")).otherwise(0))
    verdict = F.when(F.col("best").isNotNull(), F.col("best.verdict")).when(F.col("listed"), "block").otherwise("allow")
    return rows.join(decided, ["host", "path", "spread"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))


def repeated_urls(pages: DataFrame, url: str = "url") -> DataFrame:
    """(host, path) of the canonical URLs that more than one row has."""
    host, path = host_and_path(url)
    urls = pages.select(host.alias("host"), path.alias("path")).where("host <> ''")
    return urls.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
