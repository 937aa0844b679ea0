"""Exact nearest vectors by cosine over clusters: whole cells are skipped by the triangle inequality.

Centres are fitted on a bounded sample, every vector is assigned to its nearest, and a cluster's vectors lie in rings by their
angle to the centre. A cell (cluster, ring) has a least and a largest angle, so the angle between a query and any vector in it is at
least the query's angle to the centre less the largest, or the least less the query's. A query first meets the cells that
promise most until they hold k vectors; its k-th best of these rules out all cells that cannot reach it, and it meets the
others. Cells are dealt in parts and queries in slices, so that no task holds more than two blocks. What the driver holds is the
centres and one row a cell, both bounded by parameters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import grouped
from ..functions.ship import ship
from ..sources.work import keep
from .dense import _matrix, _units, best

#: Rows that centres are fitted on, and the most centres.
SAMPLE, CENTRES = 20_000, 256
ROUNDS = 12
#: Width of a ring, in radians.
RING = 0.1
TILE = 4096
#: Slack of angles and of cosines, whose ranks are by 5 places.
ANGLE, EPS = 1e-7, 2e-5

ship(__name__)


@dataclass(frozen=True)
class Clusters:
    """items: d, vec (unit), c, ring; centres as rows; of each cell its (c, ring, n, lo, hi)."""

    items: DataFrame
    centres: np.ndarray
    cells: np.ndarray


@dataclass(frozen=True)
class Search:
    """top: q, d, rank, cos; work: of each query, the vectors there are and those it was compared with."""

    top: DataFrame
    work: DataFrame


def centres_of(x: np.ndarray, most: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Unit centres of the unit rows ``x``, about the root of their number; an empty cluster keeps its centre."""
    n = min(most, max(1, round(len(x) ** 0.5)))
    c = x[np.sort(np.random.default_rng(seed).choice(len(x), n, replace=False))]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c)
    return c


def fit(items: DataFrame, item_id: str = "item_id", vec: str = "embedding", most: int = CENTRES, sample: int = SAMPLE, ring: float = RING) -> Clusters:
    """All ``items`` with a vector that is neither null nor zero; vectors are of one length."""
    it = items.where(F.col(vec).isNotNull()).select(F.col(item_id).alias("d"), F.col(vec).cast("array<double>").alias("vec"))
    some = _units(_matrix(it.orderBy(F.xxhash64("d")).limit(sample).toArrow().column(1)))
    some = some[~np.isnan(some).any(axis=1)] if some.size else np.zeros((0, 1))
    centres = centres_of(some, most) if len(some) else np.zeros((0, 1))
    schema = T.StructType([it.schema["d"], *T.StructType.fromDDL("vec array<double>, c int, ring int, angle double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows or not len(centres):
                continue
            x = _units(_matrix(b.column(1)))
            good = ~np.isnan(x).any(axis=1)
            x = x[good]
            cos = x @ centres.T
            c = np.argmax(cos, axis=1)
            angle = np.arccos(np.clip(cos[np.arange(len(x)), c], -1, 1))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good)), flat, pa.array(c, pa.int32()), pa.array((angle / ring).astype(np.int32)), pa.array(angle)], names=["d", "vec", "c", "ring", "angle"])

    rows = keep(it.mapInArrow(run, schema))
    # at most centres x rings rows
    cells = rows.groupBy("c", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi")).orderBy("c", "ring").collect()
    return Clusters(rows.drop("angle"), centres, np.array([tuple(r) for r in cells], np.float64).reshape(-1, 5))


def _asks(index: Clusters, queries: DataFrame, k: int, first: bool) -> DataFrame:
    """(q, vec, c, ring): the cells that each query meets; ``first``: those that promise most until they hold ``k`` vectors, else
    all others that may hold one of at least its ``least``."""
    centres, cells = index.centres, index.cells
    schema = T.StructType([queries.schema["q"], *T.StructType.fromDDL("vec array<double>, c int, ring int").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, ring, n, lo, hi = cells.T
        for b in batches:
            if not b.num_rows or not len(cells):
                continue
            x = _units(_matrix(b.column(1)))
            good = np.flatnonzero(~np.isnan(x).any(axis=1))
            least = np.array([-2.0 if v is None else v for v in b.column(2).to_pylist()])
            for i in good:
                at = np.arccos(np.clip(centres @ x[i], -1, 1))[c.astype(int)]
                most = np.cos(np.maximum(0, np.maximum(at - hi, lo - at) - ANGLE))
                order = np.argsort(-most, kind="stable")
                soon = np.zeros(len(cells), bool)
                soon[order[np.cumsum(n[order]) - n[order] < k]] = True
                go = np.flatnonzero(soon if first else ~soon & (most >= least[i] - EPS))
                ids = b.column(0).take(pa.array([i] * len(go), pa.int64()))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(go) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.tile(x[i], len(go))))
                yield pa.RecordBatch.from_arrays([ids, flat, pa.array(c[go], pa.int32()), pa.array(ring[go], pa.int32())], names=["q", "vec", "c", "ring"])

    return queries.mapInArrow(run, schema)


def _meet(index: Clusters, asks: DataFrame, k: int, tile: int) -> DataFrame:
    """(q, d, cos): of each query and part of a cell that it meets, the ``k`` nearest and ties."""
    spark, cell = asks.sparkSession, ["c", "ring"]
    sizes = F.broadcast(spark.createDataFrame([(int(c), int(r), int(-(-n // tile))) for c, r, n, _, _ in index.cells.tolist()], "c int, ring int, parts int"))
    # one row a cell
    slices = F.broadcast(asks.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("slices")))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda by, n: F.pmod(F.xxhash64(by), F.col(n)).cast("int")
    no = lambda name, of: F.lit(None).cast(of.schema[name].dataType).alias(name)
    told = index.items.join(sizes, cell).join(slices, cell).select(*cell, deal("d", "parts").alias("part"), each("slices").alias("slice"), no("q", asks), "d", "vec")
    put = asks.join(sizes, cell).join(slices, cell).select(*cell, each("parts").alias("part"), deal("q", "slices").alias("slice"), "q", no("d", index.items), "vec")
    keys = (*cell, "part", "slice")
    schema = T.StructType([asks.schema["q"], index.items.schema["d"], T.StructField("cos", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, keys):
            t = t.combine_chunks()
            asked = t.column("asks").to_numpy(zero_copy_only=False)
            rows, cols, x = np.flatnonzero(asked), np.flatnonzero(~asked), _matrix(t.column("vec"))
            cos = x[rows] @ x[cols].T
            i, j = best(cos, k)
            yield pa.RecordBatch.from_arrays([t.column("q").chunk(0).take(pa.array(rows[i])), t.column("d").chunk(0).take(pa.array(cols[j])), pa.array(cos[i, j])], names=["q", "d", "cos"])

    both = put.withColumn("asks", F.lit(True)).unionByName(told.withColumn("asks", F.lit(False)))
    return both.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def search(index: Clusters, queries: DataFrame, k: int, query_id: str = "query_id", vec: str = "embedding", tile: int = TILE) -> Search:
    """The ``k`` vectors nearest to each query, by (cosine rounded to 5 places, id). Queries whose vector is null or zero have none."""
    q = queries.where(F.col(vec).isNotNull()).select(F.col(query_id).alias("q"), F.col(vec).cast("array<double>").alias("vec"))
    first = keep(_asks(index, q.withColumn("least", F.lit(None).cast("double")), k, True))
    near = keep(_meet(index, first, k, tile))
    r = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cos")))
    least = near.withColumn("r", r).where(F.col("r") == k).select("q", F.col("cos").alias("least"))
    more = keep(_asks(index, q.join(least, "q", "left").select("q", "vec", "least"), k, False))
    every = near.union(_meet(index, more, k, tile))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.bround("cos", 5)), "d"))
    top = every.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "d", "rank", "cos")
    sizes = queries.sparkSession.createDataFrame([(int(c), int(x), int(n)) for c, x, n, _, _ in index.cells.tolist()], "c int, ring int, n long")
    met = first.union(more).join(F.broadcast(sizes), ["c", "ring"]).groupBy("q").agg(F.sum("n").alias("compared"))
    return Search(top, met.withColumn("vectors", F.lit(int(index.cells[:, 2].sum()))))
