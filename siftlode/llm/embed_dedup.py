"""Embedding near-duplicates by randomised-rotation binary codes (RaBitQ).

A unit vector is padded to CODE_BITS dimensions and turned by a random rotation; its code is the sign of each
component, and its correction factor is the inner product f of the rotated vector with its code's unit vector. For another
vector q, ``<code, q> / f`` is an unbiased estimate of the cosine, off by more than
``EPSILON * sqrt((1 - f * f) / f / f / (bits - 1))`` only with vanishing probability. Pairs whose upper bound stays under the
threshold are dropped; all others are recomputed exactly in double precision, so no link is below the threshold.

Pairs come from the codes too: of one label, vectors that agree in all of some band of BAND_BITS code bits stand in
one bucket. At a cosine of 0.98 a bit agrees with probability 0.936, and a pair misses all 16 bands of 16 bits with
probability 0.001; the tests measure recall against brute force. Vectors alone in a bucket drop out before any vector
moves. Large buckets are dealt out in tiles of block pairs, so none is in one task as a whole. A pair counts in
the first band it shares only, so links are counted where they are found: no pair is ever a row, only counts and spanning
forests are. Equal vectors are compared as one, with the number of its copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship
from .components import connected_components, forest

THRESHOLD = 0.98
CODE_BITS = 256
BAND_BITS = 16
EPSILON = 4.5
#: Vectors of a bucket that make a block; a tile compares two blocks.
TILE = 1024

ship(__name__)


_ROTATIONS: dict[tuple[int, int], np.ndarray] = {}


def rotation(dim: int, bits: int) -> np.ndarray:
    """The first ``dim`` columns of a random rotation of ``bits`` dimensions (or of ``dim``, if that is more)."""
    if (dim, bits) not in _ROTATIONS:
        rows = max(bits, -(-dim // 64) * 64)
        q, r = np.linalg.qr(np.random.default_rng(7).standard_normal((rows, dim)))
        _ROTATIONS[dim, bits] = (q * np.sign(np.diag(r))).astype(np.float32)
    return _ROTATIONS[dim, bits]


def encode(x: np.ndarray, bits: int = CODE_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotated unit vectors, packed codes, correction factors) of the rows of ``x``."""
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    turned = unit.astype(np.float32) @ rotation(x.shape[1], bits).T
    return turned, np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])


def estimates(codes: np.ndarray, factors: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines (code row, vector column) and the half-width of each row's confidence interval."""
    n = turned.shape[1]
    signs = np.unpackbits(codes, axis=1).astype(np.float32) * 2 - 1
    f = factors.astype(np.float32)[:, None]
    return signs @ turned.T / (f * np.float32(np.sqrt(n))), EPSILON * np.sqrt(np.maximum(0, 1 - f * f) / (f * f) / (n - 1))


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def usable(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(vec_id, kind, dim, vec) of the vectors that can link: one a vec_id, with a label, no null or non-finite
    component and not all zero. Of rows that share an id the least (label, vector) counts."""
    ok = F.col("vec").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    fine = F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("vec", lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("vec")).where(ok & fine)
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("s"))
    return one.select("vec_id", F.xxhash64("s.label", F.size("s.vec")).alias("kind"), F.size("s.vec").alias("dim"), "s.vec")


def distinct_vectors(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``usable`` vectors, one of each group that is equal in kind and components, as (vec_id, kind, dim, vec, copies), and
    of each vec_id that one's: (vec_id, one, copies)."""
    same = materialise(vectors.withColumn("h1", F.xxhash64("kind", "vec")).withColumn("h2", F.xxhash64("vec", F.lit(1), "kind")))
    one = same.groupBy("h1", "h2").agg(F.min(F.struct("vec_id", "kind", "dim", "vec")).alias("s"), F.count(F.lit(1)).alias("copies"))
    # as a table, so that the join is free to split a vector that a third of all rows repeat
    one = materialise(one.select("h1", "h2", "s.vec_id", "s.kind", "s.dim", "s.vec", "copies"))
    names = same.select("vec_id", "h1", "h2").join(one.select("h1", "h2", F.col("vec_id").alias("one"), "copies"), ["h1", "h2"]).select("vec_id", "one", "copies")
    return one.drop("h1", "h2"), names


def with_codes(vectors: DataFrame, bits: int = CODE_BITS) -> DataFrame:
    """``vectors`` (vec_id, kind, dim, vec, copies) with ``code`` (packed bits) and ``factor``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                part = b.filter(pa.array(dims == d))
                _, codes, factors = encode(_vectors(part.column("vec")), bits)
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, packed, pa.array(factors.astype(np.float64))], names=[*part.schema.names, "code", "factor"])

    return vectors.mapInArrow(run, "vec_id long, kind long, dim int, vec array<double>, copies long, code binary, factor double")


def compare(kind: np.ndarray, block: np.ndarray, x: np.ndarray, codes: np.ndarray, factors: np.ndarray, band: int, across: bool, threshold: float, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j), i < j, of the links in one tile that have ``band`` as the first band they share."""
    turned, _, _ = encode(x, bits)
    est, half = estimates(codes, factors, turned)
    i, j = np.nonzero(np.triu(est + half >= threshold, 1))
    keep = kind[i] == kind[j]
    if across:
        keep &= block[i] != block[j]
    i, j = i[keep], j[keep]
    if not len(i):
        return i, j
    keys = codes[:, : BAND_BITS // 8 * (CODE_BITS // BAND_BITS)].reshape(len(codes), -1, BAND_BITS // 8)
    norms = np.sqrt((x * x).sum(axis=1))
    good = np.zeros(len(i), bool)
    for at in range(0, len(i), 100_000):
        p, q = i[at : at + 100_000], j[at : at + 100_000]
        cos = np.einsum("nd,nd->n", x[p], x[q]) / (norms[p] * norms[q])
        same = (keys[p] == keys[q]).all(axis=2)
        good[at : at + 100_000] = (cos >= threshold) & (same.argmax(axis=1) == band)
    return i[good], j[good]


def find_links(vectors: DataFrame, threshold: float = THRESHOLD, bits: int = CODE_BITS, tile: int = TILE) -> DataFrame:
    """What tiles find: rows (u, v, n) with either a link (u, v) of a tile's spanning forest, or v null and n links of u.
    ``vectors`` are distinct; a link to one counts for each of its copies."""
    coded = materialise(with_codes(vectors, bits))
    width = BAND_BITS // 4
    bands = F.array(*[F.struct(F.lit(i).alias("band"), F.substring("hex", 1 + width * i, width).alias("key")) for i in range(CODE_BITS // BAND_BITS)])
    keyed = coded.select("vec_id", "kind", F.hex("code").alias("hex")).select("vec_id", "kind", F.explode(bands).alias("b")).select("vec_id", "b.band", F.xxhash64("kind", "b.band", "b.key").alias("bucket"))
    crowded = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    placed = keyed.join(crowded, "bucket").withColumn("blocks", F.ceil(F.col("n") / tile).cast("int")).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")).cast("int"))
    tiled = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("t1", F.least("block", "with")).withColumn("t2", F.greatest("block", "with"))
    rows = tiled.select("vec_id", "bucket", "band", "block", "t1", "t2").join(coded, "vec_id").select("bucket", "t1", "t2", "band", "block", "vec_id", "kind", "vec", "copies", "code", "factor")

    def one(t: pa.Table) -> pa.RecordBatch | None:
        if t.num_rows < 2:
            return None
        t = t.combine_chunks()
        ids = t.column("vec_id").to_numpy()
        x = _vectors(t.column("vec").chunk(0))
        codes = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        across = t.column("t1")[0].as_py() != t.column("t2")[0].as_py()
        i, j = compare(t.column("kind").to_numpy(), t.column("block").to_numpy(), x, codes, t.column("factor").to_numpy(), t.column("band")[0].as_py(), across, threshold, bits)
        if not len(i):
            return None
        copies = t.column("copies").to_numpy()
        n = (np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))).astype(np.int64)
        label = forest(len(ids), i, j)
        tied, has = np.flatnonzero(label != np.arange(len(ids))), np.flatnonzero(n)
        u = np.r_[ids[tied], ids[has]]
        v = pa.array(np.r_[ids[label[tied]], ids[has]], mask=np.r_[np.zeros(len(tied), bool), np.ones(len(has), bool)])
        return pa.RecordBatch.from_arrays([pa.array(u), v, pa.array(np.r_[np.zeros(len(tied), np.int64), n[has]])], names=["u", "v", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            at = [t.column(c).to_numpy() for c in ("bucket", "t1", "t2")]
            ends = np.flatnonzero(np.any([a[1:] != a[:-1] for a in at], axis=0)) + 1
            start = 0
            for end in ends:
                if (out := one(t.slice(start, end - start))) is not None:
                    yield out
                start = end
            rest = t.slice(start)
        if rest is not None and (out := one(rest)) is not None:
            yield out

    dealt = rows.repartition("bucket", "t1", "t2").sortWithinPartitions("bucket", "t1", "t2")
    return dealt.mapInArrow(run, "u long, v long, n long")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row a vec_id.

    n_links: other vectors of the same label at a cosine of ``threshold`` or more; component_id: the smallest
    vec_id reachable over links, itself included; kept: whether that is itself. Vectors that are null, empty, zero or
    hold null or non-finite components, and those without a label, link with nothing; so do vectors of different
    lengths. Rows that repeat a vec_id are one vector. A null vec_id gives one row: no link, no component, kept.
    """
    ids = vectors.select(F.col(vec_id).cast("long").alias("vec_id")).distinct()
    distinct, names = distinct_vectors(usable(vectors, vec_id, embedding, label))
    found = materialise(find_links(distinct, threshold))
    counts = found.where("v is null").groupBy(F.col("u").alias("vec_id")).agg(F.sum("n").alias("n_links"))
    roots = connected_components(found.where("v is not null").select("u", "v"))
    least = roots.groupBy("root").agg(F.min("node").alias("component_id"))
    named = roots.join(least, "root").select(F.col("node").alias("vec_id"), "component_id")
    of_one = distinct.select("vec_id").join(counts, "vec_id", "left").join(named, "vec_id", "left").select(F.col("vec_id").alias("one"), "n_links", F.coalesce("component_id", "vec_id").alias("component_id"))
    linked = names.join(materialise(of_one), "one").select("vec_id", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = ids.join(linked, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
