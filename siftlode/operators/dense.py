"""Dense retrieval: encoders behind an interface, exact top-k and nearest neighbours by blocked products."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ship import ship
from ..functions.arrow import grouped
from ..sources.tables import cached
from ..sources.work import keep

ship(__name__)


class Encoder(Protocol):
    """Turns texts into vectors; an instance is sent to tasks."""

    def encode(self, texts: list[str]) -> np.ndarray: ...


def encode(rows: DataFrame, text: str, encoder: Encoder, prefix: str = "", out: str = "embedding") -> DataFrame:
    """``rows`` with unit vectors of ``prefix`` + text; a null text is encoded as empty."""
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.asarray(encoder.encode([prefix + (t or "") for t in b.column(at).to_pylist()]), np.float32)
            v = v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(v), pa.list_(pa.float32()))], names=[*b.schema.names, out])

    return rows.mapInArrow(run, schema)


def cached_vectors(spark: SparkSession, root: str, config: object, rows: DataFrame, text: str, encoder: Encoder, prefix: str = "") -> DataFrame:
    """``encode``, written under ``root`` by a key of ``config`` (the model's settings and stamp, the texts' fields) and read
    from there afterwards."""
    return cached(spark, root, "vectors", [config, prefix], lambda: encode(rows, text, encoder, prefix))


def train_item_texts(train: DataFrame, items: DataFrame, text: str = "item_title_raw") -> DataFrame:
    """(item_id, text) of the distinct items of ``train``, those outside the corpus included: the corpus's text, else the
    least of those the clicks show; an item without any has an empty one. Its vectors make graphs of clicked items."""
    shown = train.groupBy("item_id").agg(F.min(text).alias("shown")) if text in train.columns else train.select("item_id", F.lit(None).cast("string").alias("shown")).distinct()
    own = items.select("item_id", F.col(text).alias("own"))
    return shown.join(own, "item_id", "left").select("item_id", F.coalesce("own", "shown", F.lit("")).alias("text"))


#: Queries that are broadcast at a time, and rows of a block.
QUERY_ROWS, BLOCK = 4096, 2048
#: Vectors that look for their neighbours at once: a product of them with a tile is some MB.
KNN_ROWS = 128


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _units(x: np.ndarray) -> np.ndarray:
    """Rows to length 1; rows of zeros become NaN."""
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, np.nan)


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's ``k`` largest numbers, with all that may tie with them once rounded to 5 places."""
    if scores.shape[1] > k:
        least = np.partition(np.where(np.isnan(scores), -np.inf, scores), -k, axis=1)[:, -k]
        return np.nonzero(scores >= (least - 2e-5)[:, None])
    return np.nonzero(~np.isnan(scores))


def topk(queries: DataFrame, items: DataFrame, k: int, query_id: str = "query_id", item_id: str = "item_id", vec: str = "embedding", query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, item_id, rank, cos): the ``k`` items nearest to each query by cosine.

    Queries are broadcast in slices of about ``query_rows``, dealt by hash; items meet each slice in blocks, each task keeps
    ``k`` (and ties at the rounded cut) a query of a block, and a last window picks among those. Vectors that are null or
    zero are left out.
    """
    q = queries.where(F.col(vec).isNotNull()).select(query_id, vec)
    slices = max(1, -(-q.count() // query_rows))
    it = items.where(F.col(vec).isNotNull()).select(item_id, vec)
    schema = T.StructType([T.StructField(query_id, queries.schema[query_id].dataType), T.StructField(item_id, items.schema[item_id].dataType), T.StructField("cos", T.DoubleType())])
    near = None
    for s in range(slices):
        part = q if slices == 1 else q.where(F.pmod(F.xxhash64(query_id), F.lit(slices)) == s)
        rows = part.toArrow()
        shared = queries.sparkSession.sparkContext.broadcast((rows.column(0).combine_chunks(), _units(_matrix(rows.column(1)))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, unit = shared.value
            for b in batches:
                for start in range(0, b.num_rows if len(names) else 0, BLOCK):
                    block = b.slice(start, BLOCK)
                    cos = unit @ _units(_matrix(block.column(1))).T
                    qi, di = best(cos, k)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(qi)), block.column(0).take(pa.array(di)), pa.array(cos[qi, di])], names=[query_id, item_id, "cos"])

        found = it.mapInArrow(run, schema)
        near = found if near is None else near.union(found)
    w = Window.partitionBy(query_id).orderBy(F.desc(F.bround("cos", 5)), item_id)
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(query_id, item_id, "rank", "cos")


def knn(vectors: DataFrame, neighbours: int, min_sim: float, vec: str = "embedding", key: str = "vec_id", group: str = "label", tile: int = 4096) -> DataFrame:
    """(key, other, sim, r): of each vector, its ``neighbours`` nearest in the same group by cosine, itself left out; those
    under ``min_sim`` are dropped after the cut.

    A group is dealt by hash in blocks of about ``tile``, and a task has one block look for its nearest in one other: pairs
    are products of matrices, never rows, and each task gives ``neighbours`` (and ties) a vector. Vectors that are null or
    zero, and those without a group, are left out.
    """
    v = vectors.select(key, group, vec).where(F.col(vec).isNotNull() & F.col(group).isNotNull())
    # one row a group
    size = keep(v.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("blocks")))
    v = v.join(size, group).withColumn("home", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    asks = v.withColumn("b", each).select(F.col(group).alias("g"), F.col("home").alias("a"), "b", F.lit(True).alias("asks"), key, vec)
    told = v.withColumn("a", each).select(F.col(group).alias("g"), "a", F.col("home").alias("b"), F.lit(False).alias("asks"), key, vec)
    kind = vectors.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("other", kind), T.StructField("sim", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ("g", "a", "b")):
            t = t.combine_chunks()
            mine = t.column("asks").to_numpy(zero_copy_only=False)
            ids = t.column(key).chunk(0)
            unit = _units(_matrix(t.column(vec)))
            rows, cols = np.flatnonzero(mine), np.flatnonzero(~mine)
            for start in range(0, len(rows), KNN_ROWS):
                here = rows[start : start + KNN_ROWS]
                sim = unit[here] @ unit[cols].T
                # a vector is not its own neighbour
                sim[ids.take(pa.array(here)).to_numpy(zero_copy_only=False)[:, None] == ids.take(pa.array(cols)).to_numpy(zero_copy_only=False)[None, :]] = np.nan
                i, j = best(sim, neighbours)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(here[i])), ids.take(pa.array(cols[j])), pa.array(sim[i, j])], names=[key, "other", "sim"])

    near = asks.union(told).repartition("g", "a", "b").sortWithinPartitions("g", "a", "b").mapInArrow(run, schema)
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.bround("sim", 5)), "other")))
    return ranked.where((F.col("r") <= neighbours) & (F.col("sim") >= min_sim))
