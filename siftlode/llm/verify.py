"""Exact Jaccard verification of candidate groups.

A group's members are sets of shingle hashes; links are the pairs whose Jaccard similarity is ``similar`` or more, and what
is given is a spanning forest of them. A small group is one task: what its sets share is a product of blocks of their
incidence matrix. Of a large group, one task takes a block of its members, dealt by hash, together with the group's leader, the
member whose fingerprint is nearest to the bitwise majority. What is then not in the group's largest piece meets
all of the group, block by block, so that no link is lost; a group that is really one is done in time in
proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import grouped, materialise, maybe_broadcast, ship
from .components import connected_components, forest

#: Least similarity, as a fraction of whole numbers.
SIMILAR = (4, 5)
#: Members and shingles that one task compares.
MEMBERS, SHINGLES = 1024, 4_000_000
COLUMNS = 4096

ship(__name__)


def similar_pairs(sets: list[np.ndarray], similar: tuple[int, int] = SIMILAR) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j), i < j, of the sets that are similar enough. Two empty sets are equal."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    own = np.repeat(np.arange(n), sizes)
    values, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True) if sizes.sum() else (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
    # what one set alone has is shared by none
    often = held > 1
    number = np.cumsum(often) - 1
    keep = often[column]
    own, column = own[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    own, column = own[order], column[order]
    shared = np.zeros((n, n), np.float32)
    for first in range(0, int(often.sum()), COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        x = np.zeros((n, min(COLUMNS, int(often.sum()) - first)), np.float32)
        x[own[a:b], column[a:b] - first] = 1
        shared += x @ x.T
    near = shared.astype(np.int64) * sum(similar) >= similar[0] * (sizes[:, None] + sizes[None, :])
    return np.nonzero(np.triu(near, 1))


def _compare(rows: DataFrame, keys: tuple[str, ...], similar: tuple[int, int]) -> DataFrame:
    """Links (u, v) within rows (*keys, t, own) that agree in ``keys``: a spanning forest of each task's group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, keys):
            t = t.combine_chunks()
            ids, first = np.unique(t.column("t").to_numpy(), return_index=True)
            own = t.column("own")
            i, j = similar_pairs([own[int(k)].values.to_numpy(zero_copy_only=False) for k in first], similar)
            label = forest(len(ids), i, j)
            tied = np.flatnonzero(label != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[label[tied]]), pa.array(ids[tied])], names=["u", "v"])

    dealt = rows.select(*keys, "t", "own").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "u long, v long")


def verified_links(sets: DataFrame, similar: tuple[int, int] = SIMILAR, members: int = MEMBERS, shingles: int = SHINGLES) -> DataFrame:
    """Links (u, v) among the members of each group: their components are those of all pairs in the group that are
    similar enough. ``sets``: (root, t, fp, own), a row a member; fp is any fingerprint of it."""
    size = sets.groupBy("root").agg(F.count(F.lit(1)).alias("g"), F.sum(F.size("own").cast("long")).alias("total"))
    size = size.withColumn("blocks", F.greatest(F.ceil(F.col("g") / members), F.ceil(F.col("total") / shingles)).cast("int"))
    members_ = sets.count()
    large = materialise(size.where("blocks > 1").select("root", "blocks"), rows=members_)
    n = large.count()
    if not n:
        return materialise(_compare(sets, ("root",), similar))
    links = _compare(sets.join(maybe_broadcast(large.select("root"), n), "root", "left_anti"), ("root",), similar)
    big = sets.join(maybe_broadcast(large, n), "root")
    bit = lambda i: F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1).cast("long"))
    majority = big.groupBy("root").agg(*[(F.sum(bit(i)) * 2 > F.count(F.lit(1))).cast("long").alias(f"b{i}") for i in range(64)])
    code = None
    for i in range(64):
        here = F.shiftleft(f"b{i}", i)
        code = here if code is None else code.bitwiseOR(here)
    majority = majority.select("root", code.alias("code"))
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("code")))
    leader = big.select("root", "blocks", "t", "fp").join(maybe_broadcast(majority, n), "root").groupBy("root", "blocks").agg(F.min(F.struct(far.alias("far"), "t")).alias("lead"))
    leader = materialise(leader.select("root", "blocks", F.col("lead.t").alias("t")), rows=n)
    heads = big.join(maybe_broadcast(leader.select("root", "t"), n), ["root", "t"], "left_semi").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = big.withColumn("block", F.pmod(F.xxhash64("t", F.lit(1)), F.col("blocks")).cast("int"))
    once = materialise(_compare(dealt.select("root", "block", "t", "own").union(heads.select("root", "block", "t", "own")), ("root", "block"), similar))
    links = materialise(links.union(once))
    # the pieces of each large group; members outside the largest are the rest
    pieces = connected_components(once).withColumnRenamed("node", "t").withColumnRenamed("root", "piece")
    placed = big.select("root", "blocks", "t").join(pieces, "t", "left").withColumn("piece", F.coalesce("piece", "t"))
    count = placed.groupBy("root", "piece").agg(F.count(F.lit(1)).alias("m"))
    most = count.groupBy("root").agg(F.max(F.struct("m", "piece")).alias("top"))
    rest = materialise(placed.join(maybe_broadcast(most, n), "root").where("piece <> top.piece").select("root", "t"), rows=members_)
    left = rest.groupBy("root").agg(F.count(F.lit(1)).alias("r")).join(large, "root").withColumn("tiles", F.ceil(F.col("r") * F.col("blocks") / members) + 1)
    left = materialise(left.select("root", F.least("tiles", "blocks").cast("int").alias("tiles")), rows=n)
    if left.isEmpty():
        return links
    tile = F.pmod(F.xxhash64("t", F.lit(2)), F.col("tiles")).cast("int")
    others = big.join(maybe_broadcast(left, n), "root")
    out = others.join(rest, ["root", "t"], "left_semi").withColumn("tile", tile).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    every = others.withColumn("block", F.pmod(F.xxhash64("t", F.lit(1)), F.col("blocks")).cast("int")).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = every.select("root", "block", "tile", "t", "own").union(out.select("root", "block", "tile", "t", "own"))
    return materialise(links.union(_compare(met, ("root", "block", "tile"), similar)))
