"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

The list's canonical URLs are hashed into blocks of 256 bits; a URL sets one bit in each of a block's four 64-bit
words. A page's canonical URL is looked up in the one block its hash names; pages whose four bits are set are
possible hits, and a hash join with the list itself removes the false positives. Everything is DataFrame functions.

Both the filter and the list are broadcast only while their counted rows are within a limit. Beyond it, pages are
joined with the blocks by shuffle, and the candidates with the list by (URL, salt), the list's few candidate rows
repeated for each salt, so that one URL that a third of all pages share is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialise, maybe_broadcast, own_prefix

#: (verdict, host, path): a rule fits its host and all hosts below it, where the path starts with the rule's.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Code points of html below which the registered query lists a page as thin.
THIN = 2000
#: Names that only say on which front door of a site a page was seen.
FRONT_DOORS = r"^(www|m|blog)\."
BITS_PER_URL = 16
SALTS = 16


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path). Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from
    there up to ``?``, ``#`` or the end. Null, or no ``://``: both empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"(?s)^[^?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """One name for a page: host without front door and port, path without index page, suffix .html or end slashes.

    Null for an empty host, which is never on a list.
    """
    h = F.regexp_replace(F.regexp_replace(host, FRONT_DOORS, ""), r":\d*$", "")
    p = F.regexp_replace(F.regexp_replace(path, r"(/index)?\.html?$", ""), r"/+$", "")
    return F.when(host != "", F.concat(h, p))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _bits(hash_: str) -> list[Column]:
    """One bit for each of the block's four words, from four six-bit fields of the hash."""
    return [F.expr(f"shiftleft(1L, cast(shiftrightunsigned({hash_}, {6 * i}) & 63 as int))") for i in range(4)]


def bloom_blocks(listed: DataFrame, url: str, n_blocks: int) -> DataFrame:
    """The filter as a table: block, w0, w1, w2, w3; blocks without URLs are absent."""
    h = listed.select(F.xxhash64(F.col(url)).alias("h")).withColumn("block", F.pmod(F.shiftrightunsigned("h", 24), F.lit(n_blocks)))
    return h.groupBy("block").agg(*[F.bit_or(bit).alias(f"w{i}") for i, bit in enumerate(_bits("h"))])


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, listed_verdict: str = "block", else_verdict: str = "allow", url: str = "url", listed_url: str = "canonical_url", bits_per_url: int = BITS_PER_URL, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``pages`` with host, path, canonical_url, possible (the filter's answer), listed, rule and verdict.

    The rule decides where one fits, else the list. Rows are never dropped or merged: repeated pages, null and
    odd URLs (no host: never listed) each give a row. Input columns of the added names are replaced, all others
    stay, whatever their names. Nulls and repeats in the list are ignored; with an empty list nothing is listed.
    """
    p = own_prefix(pages)
    own = lambda name: f"{p}{name}"
    added = ("host", "path", "canonical_url", "possible", "listed", "rule", "verdict")
    wanted = materialise(listed.select(F.col(listed_url).alias(own("url"))).where(F.col(own("url")).isNotNull()).distinct())
    n = wanted.count()
    n_blocks = max(1, -(-n * bits_per_url // 256))
    words = [own(f"w{i}") for i in range(4)]
    blocks = bloom_blocks(wanted, own("url"), n_blocks).toDF(own("at"), *words)
    # the parts are named before they are used, so that no expression is worked out twice
    rest = [c for c in pages.columns if c not in added]
    host, path = split_url(F.col(url))
    out = pages.withColumn(own("host"), host).withColumn(own("path"), path).select(*rest, own("host"), own("path"))
    out = out.withColumn(own("canonical"), canonical(F.col(own("host")), F.col(own("path")))).withColumn(own("h"), F.xxhash64(own("canonical")))
    out = out.withColumn(own("salt"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    # pages without a host have no block; numbers below 0, which no block has, spread them
    block = F.when(F.col(own("canonical")).isNotNull(), F.pmod(F.shiftrightunsigned(own("h"), 24), F.lit(n_blocks))).otherwise(-1 - F.col(own("salt")))
    out = out.withColumn(own("block"), block).join(maybe_broadcast(blocks, n_blocks, broadcast_rows), F.col(own("block")) == F.col(own("at")), "left")
    hit = None
    for word, bit in zip(words, _bits(own("h")), strict=True):
        here = F.col(word).bitwiseAND(bit) != 0
        hit = here if hit is None else hit & here
    out = out.withColumn(own("possible"), F.coalesce(hit, F.lit(False)))
    on = own("on")
    if n <= broadcast_rows:
        exact = F.broadcast(wanted.withColumn(on, F.lit(True)))
        out = out.join(exact, F.when(F.col(own("possible")), F.col(own("canonical"))) == F.col(own("url")), "left")
    else:
        slot = own("slot")
        salted = wanted.withColumn(slot, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn(on, F.lit(True))
        # pages that the filter lets pass get keys that no URL has, spread over tasks
        key = F.when(F.col(own("possible")), F.col(own("canonical"))).otherwise(F.concat(F.lit("\0"), F.col(own("h")).cast("string")))
        out = out.withColumn(own("key"), key).join(salted, (F.col(own("key")) == F.col(own("url"))) & (F.col(own("salt")) == F.col(slot)), "left")
    out = out.withColumn(own("listed"), F.coalesce(F.col(on), F.lit(False))).withColumn(own("rule"), rule_for(F.col(own("host")), F.col(own("path")), rules))
    verdict = F.coalesce(F.col(own("rule"))["verdict"], F.when(F.col(own("listed")), F.lit(listed_verdict)).otherwise(F.lit(else_verdict)))
    named = [F.col(own("host")).alias("host"), F.col(own("path")).alias("path"), F.col(own("canonical")).alias("canonical_url"), F.col(own("possible")).alias("possible"), F.col(own("listed")).alias("listed"), F.col(own("rule"))["rule"].alias("rule"), verdict.alias("verdict")]
    return out.select(*rest, *named)


def thin_urls(pages: DataFrame, url: str = "url", html: str = "html", least: int = THIN) -> DataFrame:
    """The list of the registered query, which grows with the pages: the canonical URLs of those whose html has under
    ``least`` code points. What a URL looks like does not tell whether it is listed, and a page is listed too if only
    another front door, query or fragment of it was thin. Null html is not thin; repeats are kept once."""
    host, path = split_url(F.col(url))
    parts = pages.where(F.length(html) < least).select(host.alias("host"), path.alias("path"))
    return parts.select(canonical(F.col("host"), F.col("path")).alias("canonical_url")).where("canonical_url is not null").distinct()
