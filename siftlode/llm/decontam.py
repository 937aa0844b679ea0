"""Benchmark decontamination by spaced-seed hashing.

Tokens are lower-cased runs of letters and digits. A mask takes the tokens at its positions and ignores those between,
so a hit survives substitutions there. The two masks below find, with certainty, every window of 13 tokens in which at
most 2 differ (a search over all 78 pairs of positions; the tests repeat it). Hashes of all positions of the training texts
meet those of the benchmark in a hash join, and around each hit the windows that hold its seed are compared token by
token: an item is in a text if some window of 13 of its tokens agrees with the text in 11 or more places (similarity 0.8).

The text's token hashes stay in the row while its positions are generated, joined and compared: no text and no position is
shuffled, only the best window of each (document, item). A benchmark row holds one seed and the 18 tokens around it,
however long its item is; rows are broadcast in slices of a bounded number, dealt by seed, and each further slice is a
further pass over the texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, own_prefix, part_by_ids

MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
WINDOW = 13
MIN_MATCHES = 11
SPLIT = r"[^\p{L}\p{N}]+"
#: Rows (hash, item, the tokens around) of about 200 bytes that a broadcast may hold.
SEED_ROWS = 100_000
#: Places around a seed's first token that windows which hold the seed can reach.
BEFORE, AFTER = WINDOW - 1 - min(m[-1] for m in MASKS), WINDOW - 1


def tokens(text: Column) -> Column:
    """Hashes of the text's tokens; empty for null."""
    parts = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), "")
    return F.transform(parts, lambda t: F.xxhash64(t))


def _seed(mask: int, toks: str, at: Column) -> Column:
    return F.xxhash64(F.lit(mask), *[F.get(F.col(toks), at + i) for i in MASKS[mask]])


def seeds(rows: DataFrame, toks: str) -> DataFrame:
    """``rows`` by position of ``toks`` (``pos``) and seed hash (``seed``); rows of fewer tokens than a mask spans go."""
    last = F.size(toks) - 1
    span = min(m[-1] for m in MASKS)
    # no filter before it: a filter on the tokens would have them worked out twice
    places = F.when(last >= span, F.sequence(F.lit(0), last - span)).otherwise(F.array().cast("array<int>"))
    at = rows.select("*", F.explode(places).alias("pos"))
    each = F.array(*[F.when(F.col("pos") + m[-1] <= last, _seed(i, toks, F.col("pos"))) for i, m in enumerate(MASKS)])
    return at.select("*", F.explode(each).alias("seed"))


def _around(toks: str, at: Column) -> Column:
    """The tokens from BEFORE places before ``at`` to AFTER places behind it; null where there are none."""
    return F.array(*[F.when(at + i >= 0, F.get(F.col(toks), F.greatest(at + i, F.lit(0)))) for i in range(-BEFORE, AFTER + 1)])


def _best_window(here: str, item: str) -> Column:
    """Most agreeing places in a window of ``item`` around the seed, the surroundings laid on those of ``here``; null if no
    window fits in the item."""
    same = F.zip_with(item, here, lambda a, b: F.when(a.isNotNull(), F.coalesce((a == b).cast("int"), F.lit(0))))
    # a window that reaches beyond the item has a null and so no sum
    starts = F.sequence(F.lit(1), F.lit(BEFORE + 1))
    sums = F.transform(starts, lambda s: F.aggregate(F.slice(same, s, WINDOW), F.lit(0), lambda a, x: a + x))
    return F.array_max(sums)


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", seed_rows: int = SEED_ROWS) -> DataFrame:
    """(doc_id, item_id, matched): the benchmark items that documents contain, each pair once.

    matched: agreeing places, 11 to 13, of the best window. Items of fewer than 13 tokens (null and empty ones too)
    are too short to tell and match nothing. Null texts contain nothing. Rows that repeat an id count as one document
    or item; a null id is an id. Only the named columns are read.
    """
    items = materialise(benchmark.select(F.col(item_id).alias("item_id"), tokens(F.col(item_text)).alias("item")).where(F.size("item") >= WINDOW).distinct())
    wanted = materialise(seeds(items, "item").where("seed is not null").select("seed", "item_id", _around("item", F.col("pos")).alias("there")).distinct())
    slices = max(1, -(-wanted.count() // seed_rows))
    texts = docs.select(F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("doc"))
    found = []
    for s in range(slices):
        part = wanted if slices == 1 else wanted.where(F.pmod("seed", F.lit(slices)) == s)
        hits = seeds(texts, "doc").join(F.broadcast(part), "seed")
        found.append(hits.select("doc_id", "item_id", _around("doc", F.col("pos")).alias("here"), "there"))
    # hits with equal surroundings come together, and only then are they looked at: the count keeps the comparison, which is
    # not generated code, out of the join, where it would have every position of a text wait with the text's tokens
    once = reduce(DataFrame.union, found).groupBy("doc_id", "item_id", "here", "there").agg(F.count(F.lit(1)).alias("n"))
    looked = once.select("doc_id", "item_id", F.when(F.col("n") > 0, _best_window("here", "there")).cast("long").alias("matched"))
    return looked.where(F.col("matched") >= MIN_MATCHES).groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that contain a benchmark item; rows that share an id share its fate."""
    listed = f"{own_prefix(docs)}id"
    found = materialise(contaminated(docs, benchmark, doc_id, text).select(F.col("doc_id").alias(listed)))
    bad = materialise(found.distinct(), rows=found.count())
    clean, possible = part_by_ids(docs, doc_id, bad, listed)
    return clean.unionByName(possible.join(bad, F.col(doc_id).eqNullSafe(F.col(listed)), "left_anti"))
