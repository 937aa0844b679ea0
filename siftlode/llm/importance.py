"""Importance resampling towards a target's distribution of hashed word runs, by the Gumbel top-k trick.

Identical texts are folded first, by grouping the full text; features are counted and weighed once a text, and counted
into the corpus as often as the text occurs. Weights then go back to the documents, each of which draws noise of its own.
The gains are one number a bucket, so they are the only thing that the driver holds. The draw's cut is read off a
histogram of whole-numbered scores, and only rows at or above it are sorted, by ranges.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, ship, with_groups
from .exact_dedup import content_hash

#: Buckets of features; the driver and each task hold one number a bucket.
BUCKETS = 10_000
#: Words of the longest run that is a feature.
RUN = 1
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")

ship(__name__)


def features(text: str | None, run: int = RUN) -> tuple[int, Counter]:
    """Number of words, and how often each feature occurs: runs of 1 to ``run`` words in UTF-8, joined by a space."""
    w = TOKEN.findall((text or "").encode().lower())
    found = Counter(w)
    for n in range(2, run + 1):
        found.update(b" ".join(w[i : i + n]) for i in range(len(w) - n + 1))
    return len(w), found


def _folded(rows: DataFrame, run: int, buckets: int) -> DataFrame:
    """(sha, copies, n_words, n_features, at, times) of each distinct text of ``rows`` (text): its buckets and how often each."""
    texts = rows.groupBy("text").agg(F.count(F.lit(1)).alias("copies")).select(content_hash(F.col("text")).alias("sha"), "copies", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                words, at, times = [], [], []
                for t in part.column(2):
                    n, found = features(t.as_py(), run)
                    by = np.fromiter((zlib.crc32(f) % buckets for f in found), np.int32, len(found))
                    many, inverse = np.unique(by, return_inverse=True)
                    words.append(n)
                    at.append(many)
                    times.append(np.bincount(inverse, np.fromiter(found.values(), np.int64, len(found)), len(many)).astype(np.int64))
                ends = pa.array(np.cumsum([0, *map(len, at)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x), k)) for x, k in ((at, pa.int32()), (times, pa.int64()))]
                n_features = pa.array([int(x.sum()) for x in times], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(words, pa.int64()), n_features, *lists], names=["sha", "copies", "n_words", "n_features", "at", "times"])

    return texts.mapInArrow(count, "sha binary, copies long, n_words long, n_features long, at array<int>, times array<long>")


def _totals(folded: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all rows: one row a bucket and task is summed up."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for b in batches:
            at, times, copies = b.column(1), b.column(2), b.column(0).to_numpy()
            np.add.at(sums, at.flatten().to_numpy(), times.flatten().to_numpy() * np.repeat(copies, np.diff(at.offsets.to_numpy())))
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], names=["bucket", "n"])

    sums, out = folded.select("copies", "at", "times").mapInArrow(add, "bucket int, n long"), np.zeros(buckets, np.int64)
    for r in sums.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row a bucket
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, a thousand times the log ratio of the target's smoothed share to the corpus's, floored."""
    n = len(corpus)
    ratio = (target + 1).astype(np.float64) * float(corpus.sum() + n) / ((corpus + 1).astype(np.float64) * float(target.sum() + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _weighed(folded: DataFrame, gain: np.ndarray) -> DataFrame:
    """(sha, copies, n_words, n_features, weight): the floored mean of the gains of a text's features; 0 if it has none."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, times, n = b.column(4), b.column(5), b.column(3).to_numpy()
            run = np.concatenate([[0], np.cumsum(gain[at.flatten().to_numpy()] * times.flatten().to_numpy())])
            ends = at.offsets.to_numpy() - at.offsets[0].as_py()
            weight = np.where(n > 0, (run[ends[1:]] - run[ends[:-1]]) // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(weight)], names=["sha", "copies", "n_words", "n_features", "weight"])

    return folded.mapInArrow(weigh, "sha binary, copies long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """A thousand times a Gumbel variate of the id, floored: drawn from 32 bits of a hash, so the same on every run."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
    run: int = RUN, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank (1 is the first drawn; null if not drawn).

    Of the rows with at least ``min_words`` words, ``percent`` of a hundred (rounded down) with the highest scores are drawn; ties go
    to the smaller id, a null id first; rows equal in id and score are drawn in any order. A null or empty text has no
    features and weight 0; an empty target or corpus counts nothing, and smoothing still gives each bucket a gain. Other columns of either table are not read.
    An empty table gives an empty one.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    folded = materialise(_folded(rows, run, buckets))
    wanted = _totals(_folded(target.select(F.coalesce(F.col(target_text), F.lit("")).alias("text")), run, buckets), buckets)
    weights = materialise(_weighed(folded, gains(_totals(folded, buckets), wanted)))
    n_rows = weights.agg(F.sum("copies")).first()[0] or 0
    light = rows.select("doc_id", content_hash(F.col("text")).alias("sha"))
    score = (F.col("weight") + noise(F.col("doc_id"), seed)).cast("long")
    scored = materialise(with_groups(light, weights, "sha", "copies", n_rows).select("doc_id", "n_words", "n_features", "weight", score.alias("score")))
    return _drawn(scored, min_words, percent)


def _drawn(scored: DataFrame, min_words: int, percent: int) -> DataFrame:
    """``scored`` with ``rank``. A score has at most some 100,000 values: gains are logs of counts, noise of 32 bits."""
    able = F.col("n_words") >= min_words
    values = materialise(scored.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")))
    draw = (values.agg(F.sum("n")).first()[0] or 0) * percent // 100
    higher = F.sum("n").over(Window.orderBy(F.desc("score")))
    cut = values.withColumn("upto", higher).where(F.col("upto") >= draw).agg(F.max("score")).first()[0] if draw else None
    columns = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if cut is None:
        return scored.select(*columns, none)
    reach = able & (F.col("score") >= cut)
    # place: the partition of the range sort, and the row in it
    first = scored.where(reach).select(*columns).repartitionByRange(F.desc("score"), "doc_id").sortWithinPartitions(F.desc("score"), "doc_id")
    placed = materialise(first.withColumn("place", F.monotonically_increasing_id())).withColumn("part", F.shiftrightunsigned("place", 33))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # one row a partition
    starts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("start"))
    at = (F.col("start") + F.col("place").bitwiseAND((1 << 33) - 1) + 1).cast("long")
    ranked = placed.join(F.broadcast(starts), "part").select(*columns, F.when(at <= draw, at).alias("rank"))
    return ranked.unionByName(scored.where(~F.coalesce(reach, F.lit(False))).select(*columns, none))


def drawn_documents(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """The documents drawn, with all their columns; ids are taken as unique."""
    ids = resample(docs, target, doc_id, **how).where("rank is not null").select(F.col("doc_id").alias(doc_id))
    return docs.join(ids, doc_id, "left_semi").select(*docs.columns)
