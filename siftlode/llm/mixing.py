"""Mixing sources to target weights.

Targets share 100 % of all words by weight; a target stops at ``max_epochs`` times its source's words and the
excess is shared again by weight (a water level, found in closed form over the table of sources). Within a
source, records stand in the order of a hash-random key; whole epochs are taken first, and the rest of the budget
is cut off the order's front by a distributed prefix sum: sums per (source, range of the key) are added up, and
only within one range are rows ordered. A hot source is spread over all ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, hex_key, materialise, maybe_broadcast, own_prefix, words

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Hex digits of the key that make a range: 16 ** 3 = 4096 ranges in each source.
RANGE_DIGITS = 3


def mix_key(seed: int) -> Column:
    """The hash-random key of a record. It depends on the text too, so that records of one id, or of none, are spread."""
    return hex_key(F.col("doc_id"), F.lit(f"mix{seed}"), F.md5(F.coalesce(F.col("text"), F.lit(""))))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``.

    Sources in code point order, null last, take the weights in turn. The window runs over one row a source,
    never over records. A source without words has target 0.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("__r", (F.row_number().over(rank) - 1) % len(weights)).withColumn("__w", F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in weights]), (F.col("__r") + 1).cast("int")))
    w = w.withColumn("__cap", F.col("source_size") * max_epochs)
    # in the order of cap / weight, the first k sources are full; the level is what the others get a unit of weight
    fill = Window.orderBy((F.col("__cap") / F.col("__w")), F.col("source").asc_nulls_last())
    prior, every = fill.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = (
        w.withColumn("__total", F.sum("source_size").over(every))
        .withColumn("__weights", F.sum("__w").over(every))
        .withColumn("__full", F.coalesce(F.sum("__cap").over(prior), F.lit(0)))
        .withColumn("__full_w", F.coalesce(F.sum("__w").over(prior), F.lit(0)))
        .withColumn("__level", (F.col("__total") - F.col("__full")) / (F.col("__weights") - F.col("__full_w")))
        .withColumn("__stop", F.when(F.col("__level") * F.col("__w") <= F.col("__cap"), F.col("__level")))
    )
    level = F.first("__stop", ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return w.withColumn("__lambda", level).select("source", "source_size", F.least(F.col("__cap").cast("double"), F.coalesce(F.col("__lambda") * F.col("__w"), F.col("__cap").cast("double"))).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 0, range_digits: int = RANGE_DIGITS) -> DataFrame:
    """Words that the mix takes of each document: doc_id, source, size, source_size, target, taken.

    ``docs`` has doc_id, source and text (any may be null; a null or empty text has size 0 and gives 0 words; a
    null source is a source). ``taken`` adds up to each source's target, rounded to a word: the document at the
    cut gives its share only. Rows equal in doc_id and text have one key; which of them comes first makes no
    difference to the result. An empty table gives an empty one.
    """
    light = docs.select("doc_id", "source", words(F.col("text")).alias("size"), mix_key(seed).alias("__key")).withColumn("__range", F.shiftrightunsigned("__key", 60 - 4 * range_digits))
    # one pass makes the sums of ranges, and of them the sums of sources
    sums = light.groupBy("source", "__range").agg(F.sum("size").alias("__sum"))
    sizes = sums.groupBy("source").agg(F.sum("__sum").alias("source_size"))
    targets = source_targets(sizes, weights, max_epochs)
    earlier = Window.partitionBy("source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("__start", F.coalesce(F.sum("__sum").over(earlier), F.lit(0))).drop("__sum")
    a, b = starts.alias("a"), targets.alias("b")
    plan = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source"))).select(F.col("a.source").alias("__s"), F.col("a.__range").alias("__g"), "__start", "source_size", "target")
    within = Window.partitionBy("source", "__range").orderBy("__key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = light.withColumn("__before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    # plan has a row for each range of a source: both sides are dealt out by the same keys, a hot source over all its ranges
    joined = placed.join(plan, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__range") == F.col("__g")))
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("__budget") - F.col("__epochs") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("__start") - F.col("__before")))
    return (
        joined.withColumn("__budget", budget)
        .withColumn("__epochs", epochs)
        .select("doc_id", "source", "size", "source_size", "target", (F.col("__epochs") * F.col("size") + part).cast("long").alias("taken"))
    )


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 0, range_digits: int = RANGE_DIGITS) -> DataFrame:
    """The mix itself: each document as often as it is taken, whole.

    A document that the cut goes through stays if at least half of it is inside, so that no text is torn; a
    source then misses its target by half a document at most. Documents without words leave. Rows of one source that are
    equal in doc_id and text share what is taken of the first of them. The columns are those of ``docs``, whatever
    their names.

    Texts are not shuffled: of each source, the ranges of keys before the cut are taken once more than those after it,
    and only the documents of the one range that the cut is in are put in order, by id and size.
    """
    p = own_prefix(docs)
    key = mix_key(seed)
    placed = docs.withColumn(f"{p}key", key).withColumn(f"{p}range", F.shiftrightunsigned(f"{p}key", 60 - 4 * range_digits))
    light = placed.select("doc_id", "source", words(F.col("text")).alias("size"), f"{p}key", f"{p}range")
    sums = materialise(light.groupBy("source", f"{p}range").agg(F.sum("size").alias(f"{p}sum")))
    targets = source_targets(sums.groupBy("source").agg(F.sum(f"{p}sum").alias("source_size")), weights, max_epochs)
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    plan = targets.select(F.col("source").alias(f"{p}s"), epochs.alias(f"{p}epochs"), (budget - epochs * F.col("source_size")).alias(f"{p}rest"))
    upto = Window.partitionBy("source").orderBy(f"{p}range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = sums.withColumn(f"{p}end", F.sum(f"{p}sum").over(upto)).join(plan, F.col("source").eqNullSafe(F.col(f"{p}s")))
    # the first range that reaches beyond the rest, and the words before it
    cut = ends.where(F.col(f"{p}end") > F.col(f"{p}rest")).groupBy(F.col("source").alias(f"{p}cs")).agg(F.min(F.struct(f"{p}range", (F.col(f"{p}end") - F.col(f"{p}sum")).alias("start"))).alias("c"))
    plan = plan.join(cut, F.col(f"{p}s").eqNullSafe(F.col(f"{p}cs")), "left").select(f"{p}s", f"{p}epochs", f"{p}rest", F.coalesce(f"c.{p}range", F.lit(1 << 62)).alias(f"{p}cut"), F.coalesce("c.start", F.lit(0)).alias(f"{p}start"))
    plan = materialise(plan)
    sources = plan.count()
    small = maybe_broadcast(plan, sources)
    within = Window.partitionBy("source", f"{p}range").orderBy(f"{p}key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = light.join(small, F.col("source").eqNullSafe(F.col(f"{p}s")) & (F.col(f"{p}range") == F.col(f"{p}cut"))).withColumn(f"{p}before", F.col(f"{p}start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    half_in = F.col(f"{p}rest") - F.col(f"{p}before") >= F.col("size") / 2
    edge = edge.groupBy(F.col("source").alias(f"{p}es"), F.col("doc_id").alias(f"{p}ed"), F.col(f"{p}key").alias(f"{p}ek")).agg(F.max(half_in.cast("int")).alias(f"{p}more"))
    edge = materialise(edge)
    here = placed.join(small, F.col("source").eqNullSafe(F.col(f"{p}s")))
    here = here.join(maybe_broadcast(edge, edge.count()), F.col("source").eqNullSafe(F.col(f"{p}es")) & F.col("doc_id").eqNullSafe(F.col(f"{p}ed")) & (F.col(f"{p}key") == F.col(f"{p}ek")), "left")
    more = F.when(F.col(f"{p}range") < F.col(f"{p}cut"), F.lit(1)).otherwise(F.coalesce(f"{p}more", F.lit(0)))
    times = F.when(F.rlike("text", F.lit(WORD)), (F.col(f"{p}epochs") + more).cast("int")).otherwise(F.lit(0))
    return here.withColumn(f"{p}times", times).where(F.col(f"{p}times") > 0).withColumn(f"{p}copy", F.explode(F.sequence(F.lit(1), F.col(f"{p}times")))).select(*docs.columns)
