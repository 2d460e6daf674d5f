"""URL filters: rules for hosts and paths, and a list of URLs behind a blocked Bloom filter.

The list is turned into a table of blocks of eight 64-bit words; a URL has one block, by hash, and one bit in each word. The table
has a fixed largest size, so it can be sent to every executor; a list that is too long for it only lets more URLs pass the filter.
Those that pass meet the list in an exact hash join, which removes the false positives, so the answer doesn't depend on the
filter's size. URLs that don't pass are never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codescout.session import materialise

#: Bits of the filter per listed URL, and blocks (64 bytes each) that it has at most: 8 MB.
BITS_PER_URL, MOST_BLOCKS = 16, 1 << 17
WORDS = 8
#: Query parameters that don't change what a URL shows.
TRACKING = ("ref", "fbclid", "gclid")

#: (host, path, verdict)
Rule = tuple[str, str, str]


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://`` and for null."""
    return F.translate(_part(url, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return _part(url, 2)


def _part(url: Column, group: int) -> Column:
    # The first :// is found by the reluctant start; (?s) lets all characters count.
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", group)


def canonical(url: Column) -> Column:
    """What stands for all spellings of a URL: host without ``www.`` and default port, path without trailing slashes, and the query's
    parameters in order without tracking ones. Null without ``://``."""
    name = F.regexp_replace(host(url), r"^www\.|:(80|443)\z|\.\z", "")
    place = F.regexp_replace(path(url), r"/+\z", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    tracked = r"^(" + "|".join(TRACKING) + r"|utm_[^=]*)(=|\z)"
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(tracked)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(url.contains("://"), F.concat(name, place, tail))


def matching_rule(name: Column, place: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule as text, verdict) of the longest rule that fits; nulls if none does.

    A rule fits its host and all subdomains of it, if the path starts with the rule's. Rules are a parameter, so their number is
    what the caller writes down. Of rules of one length the first in alphabetical order wins.
    """
    rule = verdict = F.lit(None).cast("string")
    for own, start, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((name == own) | name.endswith("." + own)) & place.startswith(start)
        rule = F.when(fits, F.lit(own + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def bloom_table(listed: DataFrame, column: str, bits_per_url: int = BITS_PER_URL, most_blocks: int = MOST_BLOCKS) -> tuple[DataFrame, int]:
    """The filter of the distinct texts in ``column`` as rows (``_block``, ``_w0`` ... ``_w7``), and its number of blocks.

    The blocks are made in a grouped OR that is combined before the shuffle.
    """
    size = listed.agg(F.approx_count_distinct(column).alias("n")).first().n
    blocks = max(1, min(most_blocks, -(-size * bits_per_url // (64 * WORDS))))
    bits = [F.bit_or(_bit(F.col(column), i)).alias(f"_w{i}") for i in range(WORDS)]
    return listed.groupBy(_block(F.col(column), blocks).alias("_block")).agg(*bits), blocks


def _block(text: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(text, F.lit("block")), F.lit(blocks)).cast("int")


def _bit(text: Column, word: int) -> Column:
    place = F.shiftrightunsigned(F.xxhash64(text, F.lit("bits")), 6 * word)
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63).cast("long")).cast("int"))


def judge(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[Rule],
    key: str = "page_id",
    url: str = "url",
    listed_url: str = "url",
    most_blocks: int = MOST_BLOCKS,
) -> DataFrame:
    """``key``, ``host``, ``path``, ``rule``, ``listed`` and ``verdict`` of every page.

    The longest rule that fits decides; without one a page is blocked if its canonical URL is that of a listed URL, else allowed. Null
    URLs and those without ``://`` have empty host and path, fit no rule, are on no list and are allowed. Rows are neither merged nor
    dropped; other columns are ignored.
    """
    names = listed.select(canonical(F.col(listed_url)).alias("_listed")).filter("_listed is not null").distinct()
    names = materialise(names)
    table, blocks = bloom_table(names, "_listed", most_blocks=most_blocks)
    rows = pages.select(
        F.col(key).alias(key), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"), canonical(F.col(url)).alias("_canonical")
    )
    # At most ``most_blocks`` rows of 68 bytes, whatever the list.
    probed = rows.withColumn("_block", _block(F.col("_canonical"), blocks)).join(F.broadcast(table), "_block", "left")
    hit = F.lit(True)
    for i in range(WORDS):
        hit = hit & (F.col(f"_w{i}").bitwiseAND(_bit(F.col("_canonical"), i)) != 0)
    probed = probed.select(key, "host", "path", "_canonical", F.coalesce(hit & F.col("_canonical").isNotNull(), F.lit(False)).alias("_may"))
    known = names.withColumn("_known", F.lit(True))
    sure = probed.filter("_may").join(known, F.col("_canonical") == F.col("_listed"), "left")
    found = sure.select(key, "host", "path", F.coalesce("_known", F.lit(False)).alias("listed")).unionByName(
        probed.filter(~F.col("_may")).select(key, "host", "path", F.lit(False).alias("listed"))
    )
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    by_list = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return found.select(key, "host", "path", rule.alias("rule"), "listed", F.coalesce(verdict, by_list).alias("verdict"))
