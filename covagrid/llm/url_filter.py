"""URL filtering by listed host and path prefixes: a blocked Bloom filter, then an exact hash join.

A listed entry ``example.com/en/7`` fits a URL whose host is example.com or a subdomain of it and whose path starts
with ``/en/7``. So each URL has as many candidate entries as it has host suffixes times listed path lengths. The entries
set 8 bits in one 256-bit block each; a candidate finds its block in the filter, which is sent to every task up to a size and
joined by block number beyond it, and only candidates whose bits are all set go on to the exact join with the list, which
removes the false positives. So candidates are not shuffled while the list has fewer than some two million entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covagrid.llm.common import cut, sized

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
WORDS = 4
BITS_PER_KEY = 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host after the first ``://`` and the path up to ``?`` or ``#``; both empty without ``://``."""
    known = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(known, _URL, 1), UPPER, LOWER), F.regexp_extract(known, _URL, 2)


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def _masks(key: Column) -> list[Column]:
    """Two of the key's eight bits in each 64-bit word of its block."""
    bits = F.xxhash64(key, F.lit(1))
    one = F.lit(1).cast("long")

    def bit(n: int) -> Column:
        # a shift by a column is only in SQL
        place = F.shiftrightunsigned(bits, 6 * n).bitwiseAND(F.lit(63)).cast("int")
        return F.call_function("shiftleft", one, place)

    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(WORDS)]


def bloom_blocks(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """The filter as a table: (block, w0..w3), a row for each block in which a bit is set."""
    masked = keys.select(_block(F.col(key), n_blocks).alias("block"), *(m.alias(f"w{i}") for i, m in enumerate(_masks(F.col(key)))))
    return masked.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


def maybe_listed(candidates: DataFrame, key: str, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """Rows of `candidates` whose key may be in the filter: all that are, and few others."""
    probed = candidates.withColumn("block", _block(F.col(key), n_blocks)).join(blocks, "block")
    every = F.lit(True)
    for i, mask in enumerate(_masks(F.col(key))):
        every = every & (F.col(f"w{i}").bitwiseAND(mask) == mask)
    return probed.filter(every).select(candidates.columns)


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of `pages` (page_id, url).

    `rules` has rule (``host/path``) and verdict. The longest rule that fits decides, of equally long ones the one with
    the longest path, then the alphabetically first; of rows that repeat a rule the alphabetically first verdict. Where
    none fits, rule is null and the verdict is `default`. Null URLs and those without ``://`` have an empty host and
    path and fit no rule; rules that are null or without a host fit nothing. Null page_ids and repeated pages are judged
    each, other columns are ignored whatever their names; empty tables give an empty result or the default throughout.
    A URL's cost is its host labels times the distinct lengths of the rules' paths, however long it is.
    """
    known = rules.filter(F.col("rule").isNotNull() & ~F.col("rule").startswith("/") & (F.col("rule") != ""))
    listed = cut(known.groupBy("rule").agg(F.min("verdict").alias("rule_verdict")), "rules")
    host, path = host_and_path(F.col("url").cast("string"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    # the paths' lengths: at most as many as a URL has characters
    lengths = [r[0] for r in listed.select(F.length(F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1)).alias("n")).distinct().collect()]
    n_blocks = max(1, listed.count() * BITS_PER_KEY // (64 * WORDS) + 1)
    blocks = cut(bloom_blocks(listed, "rule", n_blocks), "bloom")

    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*(F.struct(F.lit(n).alias("n"), F.substring("path", 1, n).alias("p")) for n in lengths)), lambda x: F.length(x["p"]) == x["n"])
    if not lengths:
        return judged.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    known = judged.filter("host <> ''").select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
    candidates = known.select("host", "path", F.explode("prefixes").alias("prefix"), "suffix").select("host", "path", F.concat("suffix", "prefix.p").alias("rule"), F.col("prefix.n").alias("n")).filter("suffix <> ''")
    # what the filter passes is little: only that is made distinct and shuffled
    passed = cut(maybe_listed(candidates, "rule", sized(blocks), n_blocks).distinct(), "passed")
    hits = passed.join(sized(listed), "rule")
    # max wants the alphabetically first last: compare the negated place among equals by keeping the smallest
    best = hits.groupBy("host", "path").agg(F.min(F.struct((-F.length("rule")).alias("l"), (-F.col("n")).alias("n"), "rule", "rule_verdict")).alias("best"))
    best = sized(cut(best.select("host", "path", "best.rule", "best.rule_verdict"), "verdicts"))
    return judged.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict"))
