"""Line dedup by distinct-site spread.

A line that stands on many sites is boilerplate, however short or long it is. One aggregation makes a HyperLogLog sketch of
the sites of each line's hash, merged from partial sketches, so a line that a third of all rows hold sends one sketch a
task. Lines whose estimate is clearly above or under the threshold are decided by it; those near it get exact distinct
counts. The lines found leave every document. All of it is DataFrame functions.

There is one way for any number of lines to leave. A Bloom filter of bounded size lets lines pass that surely stay; the
others' hashes, once for each distinct text, meet the list in a join. What comes back to a document is the set of its own
lines' hashes, keyed by its text, and a second filter lets documents pass that surely have none: only texts that may
lose a line are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, maybe_broadcast, part_by_ids

MIN_SITES = 10
#: Shorter lines (in code points) are never boilerplate; 1 leaves out only empty lines, which part paragraphs.
MIN_CHARS = 1
LG_K = 12
#: Estimates within this share of the threshold, and at least 1, are near it: over five standard errors of a sketch.
NEAR = 0.1
#: Files of the table of lines near or above the threshold.
FILES = 16


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _hashes(docs: DataFrame, min_chars: int, *more: Column) -> DataFrame:
    """(h, ...) of the lines of each document that are long enough."""
    each = docs.select(*more, F.explode(_lines(F.col("text"))).alias("line")).where(F.length("line") >= min_chars)
    return each.select(*[c for c in each.columns if c != "line"], F.xxhash64("line").alias("h"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h, sites): hashes of the lines that stand on ``min_sites`` sites or more.

    ``docs`` has text and site; a null site is a site. sites: exact near the threshold, else the estimate.
    """
    spread = _hashes(docs, min_chars, F.xxhash64("site").alias("site")).groupBy("h").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"))
    slack = max(1.0, NEAR * min_sites)
    wide = spread.select("h", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites - slack)
    # a small share of all lines, of 16 bytes each
    wide = materialise(wide.repartition(FILES))
    near = wide.where(F.col("sites") <= min_sites + slack).select("h")
    n = near.count()
    exact = _hashes(docs, min_chars, F.xxhash64("site").alias("site")).join(maybe_broadcast(near, n), "h", "left_semi").groupBy("h").agg(F.countDistinct("site").alias("sites"))
    return wide.where(F.col("sites") > min_sites + slack).union(exact.where(F.col("sites") >= min_sites))


def remove_boilerplate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text, n_lines, n_removed): one row a row of ``docs``, its text without the lines that spread over
    ``min_sites`` sites or more.

    Lines are what stands between line feeds and are compared as they are. A text of which all lines leave is
    empty; a null text stays null, with 0 lines; an empty text has one line, which stays. Lines under ``min_chars``
    characters always stay, empty ones in any case. Repeated documents are each cleaned. Only the named columns are read.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(site).alias("site"))
    least = max(1, min_chars)
    bad = materialise(boilerplate(d, min_sites, min_chars=least).select("h").repartition(FILES))
    # sets of hashes depend on the text alone, so documents with equal texts share one, whatever their ids
    _, near = part_by_ids(_hashes(d, least, F.xxhash64("text").alias("k")), "h", bad, "h")
    own = near.distinct().join(bad, "h", "left_semi").groupBy("k").agg(F.collect_set("h").alias("bad"))
    # as a table, so that the join below is free to split a text that very many documents share
    own = materialise(own, rows=d.count())
    whole = d.select("doc_id", "text", F.xxhash64("text").alias("k"))
    stays, may = part_by_ids(whole, "k", own, "k")
    lines = _lines(F.col("text"))
    n_lines = F.coalesce(F.when(F.col("text").isNotNull(), F.size(lines)), F.lit(0)).cast("long")
    clean = stays.select("doc_id", "text", n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    kept = F.when(F.col("bad").isNull(), lines).otherwise(F.filter(lines, lambda x: (F.length(x) < least) | ~F.array_contains("bad", F.xxhash64(x))))
    cut = may.join(own, "k", "left").withColumn("left", kept)
    left = F.coalesce(F.when(F.col("text").isNotNull(), F.size("left")), F.lit(0))
    return clean.union(cut.select("doc_id", F.array_join("left", "\n").alias("text"), n_lines.alias("n_lines"), (n_lines - left).cast("long").alias("n_removed")))
