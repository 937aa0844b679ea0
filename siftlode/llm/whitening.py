"""Whitening of embeddings by matrix-free block subspace iteration.

The covariance is never formed: a pass computes X'(XQ) on centred rows, block by block, and what leaves a task is one matrix of the
size of Q. Between passes the driver orthonormalises Q (QR) and solves the small projected problem
(Rayleigh-Ritz). The iteration ends when the residuals of all wanted components are within the tolerance. Where the
spectrum is so flat that they do not get there soon, the block is doubled; a block of all dimensions is exact.
The driver holds matrices of dimensions x block, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, own_prefix, ship

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Scaled entries beyond are drawn to it, so that sums of long numbers stay exact.
MOST = 1 << 40
#: The first block has this many times the wanted components, and is doubled after so many passes without an end.
BLOCK, PASSES = 2, 4
#: Residual, as a part of the largest eigenvalue, at which a component is certified.
TOLERANCE = 1e-14
#: Eigenvalues below this part of the largest are those of a space that the rows do not fill.
RANK = 1e-12
#: Entries of a block of rows that are multiplied at once, 32 MB of them.
ENTRIES = 4_000_000

ship(__name__)


@dataclass(frozen=True)
class Fit:
    """n distinct vectors, their sums by dimension, the trace of their covariance, and its leading components (columns)."""

    n: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    passes: int


def scaled(vectors: DataFrame, embedding: str = "embedding", to: str = "scaled") -> DataFrame:
    """``vectors`` that have an embedding with finite entries only, with ``to``: floor(64 * entry), which is x - 1000000.

    Embeddings of another length than the commonest (of equally common ones the longest) are dropped too, and empty ones.
    """
    p = own_prefix(vectors)
    inf = F.lit(float("inf"))
    good = F.col(embedding).isNotNull() & (F.size(embedding) > 0) & F.forall(embedding, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < inf), F.lit(False)))
    rows = vectors.where(good)
    common = rows.groupBy(F.size(embedding).alias(f"{p}d")).count().orderBy(F.desc("count"), F.desc(f"{p}d")).first()
    bound = lambda c: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(c.cast("double") * SCALE)))
    return rows.where(F.size(embedding) == (common[0] if common else 0)).withColumn(to, F.transform(embedding, bound))


def _blocks(b: pa.RecordBatch, column: int, dim: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows as a matrix of longs)."""
    flat, step = b.column(column).flatten().to_numpy().reshape(-1, dim), max(1, ENTRIES // dim)
    for i in range(0, len(flat), step):
        yield i, flat[i : i + step]


def _sums(fit: DataFrame, dim: int) -> tuple[int, tuple[int, ...]]:
    """Number of rows and exact sums by dimension of the scaled entries, without the shift."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dim
        for b in batches:
            for _, y in _blocks(b, 0, dim):
                n, sums = n + len(y), [s + int(t) for s, t in zip(sums, y.sum(0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dim), pa.int32()), pa.array([Decimal(x) for x in (n, *sums)], pa.decimal128(38, 0))], names=["at", "s"])

    got = dict(fit.mapInArrow(add, "at int, s decimal(38,0)").groupBy("at").agg(F.sum("s")).collect())
    return int(got.get(-1, 0)), tuple(int(got.get(i, 0)) for i in range(dim))


def _centred(y: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Rows less the mean: exact differences n * y - sums where a long holds them."""
    if n * float(MOST) < 2.0**62 or n * max(1.0, float(np.abs(y).max(initial=0))) < 2.0**62:
        return (n * y - sums) / n
    return y - sums / n


def _product(fit: DataFrame, n: int, sums: tuple[int, ...], q: np.ndarray) -> tuple[np.ndarray, float]:
    """V q and the trace of V, the covariance of ``fit``, in one pass over the rows."""
    dim, width = q.shape
    s = np.array(sums, dtype=np.float64 if max(map(abs, sums)) >= 2**62 else np.int64)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(dim * width + 1)
        for b in batches:
            for _, y in _blocks(b, 0, dim):
                x = _centred(y, n, s)
                out[:-1] += (x.T @ (x @ q)).ravel()
                out[-1] += np.square(x).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)], names=["at", "s"])

    out = np.zeros(dim * width + 1)
    # dimensions x block sums, however many rows
    for r in fit.mapInArrow(multiply, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect():
        out[r.at] = r.s
    out /= n
    return out[:-1].reshape(dim, width), float(out[-1])


def principal(fit: DataFrame, k: int = COMPONENTS, tolerance: float = TOLERANCE, block: int = BLOCK, passes: int = PASSES) -> Fit | None:
    """The leading ``k`` components of the covariance of ``fit`` (scaled), whose rows are distinct; fewer if its rank is less, None if it has no rows."""
    first = fit.first()
    if first is None:
        return None
    dim = len(first["scaled"])
    n, sums = _sums(fit, dim)
    k, rnd = min(k, dim), np.random.default_rng(0)
    q = np.linalg.qr(rnd.standard_normal((dim, min(dim, block * k))))[0]
    done = 0
    while True:
        y, trace = _product(fit, n, sums, q)
        done += 1
        h = q.T @ y
        values, turn = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-values, kind="stable")
        values, turn = values[order], turn[:, order]
        ritz, image = q @ turn, y @ turn
        residuals = np.linalg.norm(image - ritz * values, axis=0)[:k]
        if q.shape[1] == dim or residuals.max() <= tolerance * max(values[0], 0):
            break
        # components of eigenvalue zero leave empty columns, which the fresh ones replace
        width = min(dim, q.shape[1] * (2 if done % passes == 0 else 1))
        fresh = rnd.standard_normal((dim, width)) * (1e-8 * np.abs(image).max())
        fresh[:, : image.shape[1]] = image + fresh[:, : image.shape[1]] * 1e-8
        q = np.linalg.qr(fresh)[0]
    held = int((values[:k] > RANK * max(values[0], 0)).sum()) if values[0] > 0 else 0
    v = ritz[:, :held]
    return Fit(n, sums, trace, values[:held], v / np.linalg.norm(v, axis=0), residuals[:held], done)


def _identity_error(fit: DataFrame, model: Fit) -> float:
    """Largest absolute entry of the covariance of the whitened rows of ``fit``, less the identity."""
    k, dim = len(model.values), len(model.sums)
    project, n, sums = model.vectors / np.sqrt(model.values), model.n, np.array(model.sums, dtype=np.float64 if max(map(abs, model.sums)) >= 2**62 else np.int64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(k * k + k)
        for b in batches:
            for _, y in _blocks(b, 0, dim):
                w = _centred(y, n, sums) @ project
                out += np.concatenate([(w.T @ w).ravel(), w.sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)], names=["at", "s"])

    out = np.zeros(k * k + k)
    for r in fit.mapInArrow(add, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect():
        out[r.at] = r.s / n
    mean = out[k * k :]
    return float(np.abs(out[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def deviations(y: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Of each row, the exact sum of (n * y - sums) squared; None where a long cannot hold it."""
    top = float(n) * float(np.abs(y).max(initial=0)) + max(map(abs, sums))
    if top * top * y.shape[1] < 2.0**62:
        return np.square(n * y - np.array(sums)).sum(1).tolist()
    exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in y]
    return [e if e < 2**63 else None for e in exact]


def whiten(vectors: DataFrame, embedding: str = "embedding", k: int = COMPONENTS, **how) -> DataFrame:
    """Rows of ``vectors`` with usable embeddings (``scaled``), with all their columns and n, deviation, whitened, explained, identity_error.

    The components are those of the distinct scaled vectors, each once, however often it is repeated; all rows are projected on
    them. ``whitened`` and ``explained`` have an entry for each component: fewer than ``k`` where the distinct vectors span
    less, none where all vectors are equal; identity_error is null then. Input columns of those names are replaced, others stay. A ``deviation``
    beyond a long is null. An empty table gives an empty one.
    """
    names = ("n", "deviation", "whitened", "explained", "identity_error")
    p = own_prefix(vectors)
    rows = scaled(vectors.drop(*names), embedding, f"{p}scaled")
    fit = materialise(rows.select(F.col(f"{p}scaled").alias("scaled")).distinct())
    model = principal(fit, k, **how)
    rest = [c for c in rows.columns if c != f"{p}scaled"]
    fields = "n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    schema = T.StructType([*rows.select(*rest).schema.fields, *T.StructType.fromDDL(fields).fields])
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    held, dim, n, sums = len(model.values), len(model.sums), model.n, model.sums
    error = _identity_error(fit, model) if held else None
    project, shares = model.vectors / np.sqrt(model.values), model.values / model.trace if held else model.values
    s = np.array(sums, dtype=np.float64 if max(map(abs, sums)) >= 2**62 else np.int64)
    at = len(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, y in _blocks(b, at, dim):
                w, m = _centred(y, n, s) @ project, len(y)
                ends = pa.array(np.arange(m + 1, dtype=np.int32) * held)
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (w, np.broadcast_to(shares, (m, held)))]
                made = [pa.array([n] * m, pa.int64()), pa.array(deviations(y, n, sums), pa.int64()), *lists, pa.array([error] * m, pa.float64())]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, m) for c in range(at)), *made], names=[*rest, *names])

    return rows.select(*rest, f"{p}scaled").mapInArrow(run, schema)
