"""Sharding by weighted rendezvous hashing.

Each record's key is hashed once with each shard; the shard with the best weighted score ``ln(u) / weight``
takes the record. A record's score for a shard depends on nothing but its key and that shard, so a shard that
is added only takes records (into itself), and a shard that is removed only gives up its own: with ``n`` equal
shards, 1 / (n + 1) of the records move.

Slots number a shard's records without gaps. They come from a two-level prefix sum: records are counted by
(shard, bucket of the key's hash), the few counts are summed up, and only within one bucket are rows numbered,
so neither a shard nor a hot key is ever in one task as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hex_key, own_prefix

#: Hash buckets of a shard in the prefix sum; a task numbers the rows of single buckets.
SLOT_BUCKETS = 1024
#: What is hashed for a null key, so that it is not the key "null".
NO_KEY = "\0null"


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Index of the shard of ``key`` among shards 0, 1, ... of the given weights.

    A null key is a key of its own, other than the text "null". Shards of weight 0 get nothing. Ties go to the lower shard.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must not be negative, and one must be positive")
    live = [(i, w) for i, w in enumerate(weights) if w > 0]
    equal = len({w for _, w in live}) == 1
    best = None
    for i, w in live:
        h = hex_key(F.when(key.isNull(), F.lit(NO_KEY)).otherwise(key.cast("string")), F.lit(str(i)), digits=13)
        score = h.cast("double") if equal else F.log((h.cast("double") + 0.5) / float(2**52)) / F.lit(float(w))
        s = F.struct(score.alias("score"), F.lit(-i).alias("shard"))
        best = [s] if best is None else [*best, s]
    top = best[0] if len(best) == 1 else F.greatest(*best)
    return (-top["shard"]).cast("int")


def shard_records(
    rows: DataFrame, key: str, weights: Sequence[float], grown_weights: Sequence[float] | None = None, order: Sequence[str] = (), buckets: int = SLOT_BUCKETS
) -> DataFrame:
    """``rows`` with ``shard``, ``slot`` and, if ``grown_weights`` are given, ``grown_shard``.

    Input columns of these names are replaced, all others stay, whatever their names. Rows with equal keys (null is one) go to the same shard; their
    slots follow ``order``, and rows equal in that too are interchangeable. An empty table gives an empty one.
    Texts and other payload columns are never shuffled unless they are columns of ``rows``: hand in what the
    result needs.
    """
    p = own_prefix(rows)
    h, bucket, n, offset, row = (f"{p}{x}" for x in ("h", "bucket", "n", "offset", "row"))
    at, to, grown = (f"{p}{x}" for x in ("shard", "to", "grown"))
    rest = [c for c in rows.columns if c not in ("shard", "slot", "grown_shard")]
    out = rows.withColumn(at, rendezvous(F.col(key), weights))
    if grown_weights is not None:
        out = out.withColumn(grown, rendezvous(F.col(key), grown_weights))
    # rows of one key that has very many copies are spread over buckets by what else tells them apart
    out = out.withColumn(h, F.xxhash64(F.col(key), *[F.col(c) for c in order])).withColumn(bucket, F.pmod(F.col(h), F.lit(buckets)).cast("int"))
    counts = out.groupBy(at, bucket).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(at).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    # at most len(weights) * buckets rows, however large the input
    offsets = counts.select(F.col(at).alias(to), F.col(bucket).alias(f"{p}in"), F.coalesce(F.sum(n).over(before), F.lit(0)).alias(offset))
    within = Window.partitionBy(at, bucket).orderBy(h, key, *order)
    joined = out.withColumn(row, F.row_number().over(within)).join(F.broadcast(offsets), (F.col(at) == F.col(to)) & (F.col(bucket) == F.col(f"{p}in")))
    slot = (F.col(offset) + F.col(row) - 1).cast("long").alias("slot")
    return joined.select(*rest, F.col(at).alias("shard"), *[F.col(grown).alias("grown_shard")] * (grown_weights is not None), slot)


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Where each document goes: doc_id, size, text_crc32, law, shard, slot, grown_shard (with one more shard).

    size: UTF-8 bytes of the text (none if null) plus 1; text_crc32: CRC-32 of those bytes (0 if none).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    light = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"))
    return shard_records(light, "doc_id", [1.0] * shards, [1.0] * (shards + 1), order=("text_crc32", "size"))
