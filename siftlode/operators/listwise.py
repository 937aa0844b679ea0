"""Listwise re-ranking: boosted trees whose gradients are lambdas, weighted by the change of NDCG that a swap would make.

Rows are packed once, one record a query: binned features, labels, the score so far. A query's candidates are bounded by
the pool's channels and depth, so lambdas are made inside one record. A level of a tree is one pass: each task sums gradient, hessian
and rows by (leaf, feature, bin), Spark adds the sums up, and only they reach the driver, which picks the splits. Sums are whole
numbers of a fixed unit, so they do not depend on the order of rows or tasks and reruns agree.

The first pass of a round also measures NDCG on the queries held out, which stops the fit early without jobs of its own. Scores are
written with the records every few trees, so that a pass never evaluates the whole forest.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship
from ..sources.work import keep

#: Unit of gradients in sums, and of NDCG.
UNIT = 1 << 30
#: Trees between two writes of the scores.
WRITE_EVERY = 10
#: Queries whose rows a task adds up at once.
AT_ONCE = 64
LEAST_HESSIAN = 1e-3

ship(__name__)


@dataclass(frozen=True)
class Settings:
    """``trees`` are the most that are grown; ``patience`` None grows all of them on all queries. ``at`` is the depth of NDCG."""

    trees: int = 1000
    step: float = 0.05
    leaves: int = 31
    depth: int = 6
    least_rows: int = 50
    rows_share: float = 0.8
    columns_share: float = 0.8
    penalty: float = 1.0
    bins: int = 64
    at: int = 50
    patience: int | None = 50
    held_share: float = 0.2
    seed: int = 42


@dataclass(frozen=True)
class Tree:
    """Nodes in order of making: rows whose ``feature`` is in ``split`` or a lower bin go ``left``. Leaves have feature -1."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of binned features."""
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            low = x[rows, np.maximum(f, 0)] <= self.split[at]
            at = np.where(inner, np.where(low, self.left[at], self.right[at]), at)


@dataclass(frozen=True)
class Forest:
    """``edges``: upper ends of the bins of each feature. ``curve``: NDCG of the queries held out, without trees and after each."""

    features: tuple[str, ...]
    edges: tuple[np.ndarray, ...]
    trees: tuple[Tree, ...]
    gains: np.ndarray
    curve: tuple[float, ...] = field(default=())

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for t in self.trees:
            out += t.value[t.nodes(x)]
        return out


def binned(columns: Sequence[np.ndarray], edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bins of each row's features: 0 for what is missing, then 1 for values up to the first edge, and so on."""
    return np.stack([np.where(np.isnan(c), 0, np.searchsorted(e, c, "left") + 1) for c, e in zip(columns, edges, strict=True)], axis=1).astype(np.uint8)


def places(score: np.ndarray) -> np.ndarray:
    """Place of each row in the order of falling scores, from 0; ties in the order of rows."""
    out = np.empty(len(score), np.int64)
    out[np.argsort(-score, kind="stable")] = np.arange(len(score))
    return out


def _discount(place: np.ndarray, at: int) -> np.ndarray:
    return np.where(place < at, 1 / np.log2(place + 2.0), 0.0)


def ideal(label: np.ndarray, at: int) -> float:
    gain = np.sort(2.0**label - 1)[::-1][:at]
    return float((gain * _discount(np.arange(len(gain)), at)).sum())


def ndcg(label: np.ndarray, score: np.ndarray, at: int) -> float:
    """NDCG of one query's rows to depth ``at``; 0 if none is relevant."""
    best = ideal(label, at)
    return float(((2.0**label - 1) * _discount(places(score), at)).sum()) / best if best else 0.0


def lambdas(label: np.ndarray, score: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    """(gradient, hessian) of one query's rows: each pair of different labels pulls by its logistic loss's slope, times what
    NDCG changes by if the two swap places."""
    g, h = np.zeros(len(label)), np.zeros(len(label))
    best = ideal(label, at)
    if not best:
        return g, h
    gain, disc = 2.0**label - 1, _discount(places(score), at)
    for level in np.unique(label)[1:]:
        hi, lo = np.flatnonzero(label == level), np.flatnonzero(label < level)
        swap = (gain[hi][:, None] - gain[lo]) * np.abs(disc[hi][:, None] - disc[lo]) / best
        rho = 1 / (1 + np.exp(np.clip(score[hi][:, None] - score[lo], -500, 500)))
        pull, bend = rho * swap, rho * (1 - rho) * swap
        g[hi] -= pull.sum(1)
        g[lo] += pull.sum(0)
        h[hi] += bend.sum(1)
        h[lo] += bend.sum(0)
    return g, h


def _edges(rows: DataFrame, features: Sequence[str], bins: int) -> tuple[np.ndarray, ...]:
    """Quantiles of each feature, in one job; as many values as bins have edges of their own."""
    shares = F.array(*[F.lit(i / (bins - 2)) for i in range(1, bins - 2)])
    got = rows.agg(*[F.percentile_approx(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")), shares, 10_000).alias(f"e{i}") for i, f in enumerate(features)]).first()
    return tuple(np.unique(np.array(e if e is not None else [], np.float64)) for e in got)


def _records(rows: DataFrame, features: Sequence[str], edges: Sequence[np.ndarray]) -> DataFrame:
    """(query_id, held, n, label, draw, x, base): one record a query, its rows by item id. Queries without a relevant row leave."""
    x = F.array(*[F.col(f).cast("double") for f in features]).alias("x")
    one = F.struct("item_id", F.col("label").cast("double").alias("label"), F.xxhash64("query_id", "item_id").alias("draw"), x)
    packed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("r")).where(F.exists("r", lambda r: r["label"] > 0))
    packed = packed.select("query_id", F.col("r.label"), F.col("r.draw"), F.flatten("r.x").alias("x"))
    width = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.diff(b.column(1).offsets.to_numpy())
            flat = b.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            x, ends = binned(list(flat.T), edges), np.cumsum([0, *n])
            cut = [pa.array([x[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())]
            base = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.zeros(len(x))))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *cut, base], names=["query_id", "label", "draw", "x", "base"])

    kind = rows.schema["query_id"].dataType.simpleString()
    return packed.mapInArrow(run, f"query_id {kind}, label array<double>, draw array<long>, x binary, base array<double>")


def gradients(rows: DataFrame, score: str, at: int = 50) -> DataFrame:
    """(query_id, item_id, label, g, h): lambdas of the rows of queries with a relevant one, at the scores that are given; ties by item id."""
    one = F.struct("item_id", F.col("label").cast("double").alias("label"), F.col(score).cast("double").alias("score"))
    packed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("r")).where(F.exists("r", lambda r: r["label"] > 0)).select("query_id", F.col("r.item_id"), F.col("r.label"), F.col("r.score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.cumsum([0, *np.diff(b.column(2).offsets.to_numpy())])
            label, value = (b.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))
            parts = [lambdas(label[i:j], value[i:j], at) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0))) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *lists], names=["query_id", "item_id", "label", "g", "h"])

    kinds = {n: rows.schema[n].dataType.simpleString() for n in ("query_id", "item_id")}
    out = packed.mapInArrow(run, f"query_id {kinds['query_id']}, item_id array<{kinds['item_id']}>, label array<double>, g array<double>, h array<double>")
    return out.select("query_id", F.explode(F.arrays_zip("item_id", "label", "g", "h")).alias("x")).select("query_id", "x.item_id", "x.label", "x.g", "x.h")


def drawn(draw: np.ndarray, tree: int, seed: int, share: float) -> np.ndarray:
    """Which rows a tree sees: a hash of the row and the tree's number is below ``share``."""
    if share >= 1:
        return np.ones(len(draw), bool)
    z = draw.astype(np.uint64) ^ np.uint64((tree * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) < share * float(1 << 53)


def _decode(b: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Up to AT_ONCE queries' (held, ends, label, draw, x, base), laid end to end."""
    for i in range(0, b.num_rows, AT_ONCE):
        p = b.slice(i, AT_ONCE)
        at = {n: k for k, n in enumerate(p.schema.names)}
        ends = np.cumsum([0, *np.diff(p.column(at["label"]).offsets.to_numpy())]).tolist()
        flat = {n: p.column(at[n]).flatten().to_numpy(zero_copy_only=False) for n in ("label", "draw", "base")}
        x = np.frombuffer(b"".join(p.column(at["x"]).to_pylist()), np.uint8).reshape(-1, width)
        yield p.column(at["held"]).to_numpy(zero_copy_only=False), ends, flat["label"], flat["draw"], x, flat["base"]


def _histograms(records: DataFrame, s: Settings, width: int, since: Sequence[Tree], growing: Tree, open_leaves: Sequence[int], number: int, measure: bool) -> tuple[np.ndarray, tuple[int, int]]:
    """(sums [open leaf, feature, bin, (gradient, hessian, rows)] in units, (NDCG, queries) of those held out)."""
    bins, cells = s.bins, len(open_leaves) * width * s.bins
    where = np.full(len(growing.feature), -1)
    where[list(open_leaves)] = np.arange(len(open_leaves))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, told = np.zeros((cells, 3), np.int64), [0, 0]
        for b in batches:
            for held, ends, label, draw, x, base in _decode(b, width):
                score = base.copy()
                for t in since:
                    score += t.value[t.nodes(x)]
                g, h, mine = np.zeros(len(score)), np.zeros(len(score)), np.zeros(len(score), bool)
                for k, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                    if held[k]:
                        if measure:
                            told[0] += round(ndcg(label[i:j], score[i:j], s.at) * UNIT)
                            told[1] += 1
                    else:
                        g[i:j], h[i:j] = lambdas(label[i:j], score[i:j], s.at)
                        mine[i:j] = True
                leaf = where[growing.nodes(x)]
                mine &= (leaf >= 0) & drawn(draw, number, s.seed, s.rows_share)
                at = ((leaf[mine, None] * width + np.arange(width)) * bins + x[mine]).ravel()
                for c, v in enumerate((np.rint(g[mine] * UNIT), np.rint(h[mine] * UNIT), np.ones(int(mine.sum())))):
                    sums[:, c] += np.bincount(at, np.repeat(v, width), cells).astype(np.int64)
        some = np.flatnonzero(sums[:, 2])
        values = [np.append(sums[some, c], x) for c, x in enumerate((*told, 0))]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), *map(pa.array, values)], names=["cell", "g", "h", "n"])

    # at most leaves x features x bins rows, however many queries
    got = records.select("held", "label", "draw", "x", "base").mapInArrow(run, "cell long, g long, h long, n long").groupBy("cell").agg(*[F.sum(c).alias(c) for c in "ghn"]).toArrow()
    cell, *v = (got.column(c).to_numpy() for c in ("cell", "g", "h", "n"))
    out = np.zeros((cells, 3), np.int64)
    real = cell >= 0
    out[cell[real]] = np.stack(v, 1)[real]
    return out.reshape(len(open_leaves), width, bins, 3), (int(v[0][~real].sum()), int(v[1][~real].sum()))


def best_split(sums: np.ndarray, columns: Sequence[int], s: Settings) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of the best split of one leaf by its sums [feature, bin, 3]; ties go to the first. None if no split gains."""
    best = None
    for f in columns:
        low = np.cumsum(sums[f], 0)
        high = low[-1] - low
        (gl, hl, nl), (gr, hr, nr) = low.T / np.array([[UNIT], [UNIT], [1]]), high.T / np.array([[UNIT], [UNIT], [1]])
        g, h = gl[-1], hl[-1]
        gain = gl**2 / (hl + s.penalty) + gr**2 / (hr + s.penalty) - g**2 / (h + s.penalty)
        gain = np.where((nl >= s.least_rows) & (nr >= s.least_rows) & (hl >= LEAST_HESSIAN) & (hr >= LEAST_HESSIAN), gain, -np.inf)
        b = int(np.argmax(gain))
        if gain[b] > 1e-12 and (best is None or gain[b] > best[0]):
            best = (float(gain[b]), int(f), b)
    return best


def _grow(records: DataFrame, s: Settings, width: int, since: Sequence[Tree], number: int, measure: bool) -> tuple[Tree | None, np.ndarray, float | None]:
    """One tree, level by level (None if the root cannot be split), the gains of its features, and the NDCG before it."""
    rnd = np.random.default_rng([s.seed, number])
    columns = sorted(rnd.choice(width, max(1, round(s.columns_share * width)), replace=False).tolist())
    feature, split, left, right, value = [-1], [0], [0], [0], [0.0]
    made = lambda: Tree(*(np.array(v, k) for v, k in ((feature, np.int64), (split, np.int64), (left, np.int64), (right, np.int64), (value, np.float64))))
    gains, score, leaves, open_leaves = np.zeros(width), None, 1, [0]
    for level in range(s.depth):
        sums, (told, queries) = _histograms(records, s, width, since, made(), open_leaves, number, measure and level == 0)
        if queries:
            score = told / UNIT / queries
        found = [(node, sums[k], best_split(sums[k], columns, s)) for k, node in enumerate(open_leaves)]
        # where the leaves left do not suffice, the splits that gain most are made
        found = sorted((x for x in found if x[2]), key=lambda x: (-x[2][0], x[0]))[: s.leaves - leaves]
        open_leaves = []
        for node, cells, (gain, f, b) in sorted(found, key=lambda x: x[0]):
            low, both = cells[f, : b + 1].sum(0), cells[f].sum(0)
            gains[f] += gain
            feature[node], split[node], left[node], right[node] = f, b, len(feature), len(feature) + 1
            for g, h, _ in (low, both - low):
                feature.append(-1)
                split.append(0)
                left.append(0)
                right.append(0)
                value.append(-s.step * (g / UNIT) / (h / UNIT + s.penalty))
                open_leaves.append(len(feature) - 1)
            leaves += 1
        if not open_leaves or leaves >= s.leaves:
            break
    return (made() if len(feature) > 1 else None), gains, score


def _with_scores(records: DataFrame, trees: Sequence[Tree], width: int) -> DataFrame:
    """``records`` whose ``base`` has the values of ``trees`` added."""
    names = records.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for *_, x, base in _decode(b, width):
                score = base.copy()
                for t in trees:
                    score += t.value[t.nodes(x)]
                parts.append(score)
            offsets = b.column(names.index("label")).offsets.to_numpy()
            base = pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(np.concatenate(parts) if parts else np.zeros(0)))
            yield pa.RecordBatch.from_arrays([base if n == "base" else b.column(i) for i, n in enumerate(names)], names=names)

    return records.mapInArrow(run, records.schema)


def fit(rows: DataFrame, features: Sequence[str], settings: Settings | None = None) -> Forest:
    """Fit on ``rows`` (query_id, item_id, label, features); labels are grades from 0.

    Missing features have a bin of their own. Queries without a relevant row are left out. With ``patience``, a share of the
    queries (by a hash of their ids) is held out, and the trees up to the best NDCG are kept; without, all trees are fitted on all queries. Trees
    end where no split gains.
    """
    s = settings or Settings()
    features, width = tuple(features), len(features)
    edges = _edges(rows, features, s.bins)
    share = s.held_share if s.patience is not None else 0.0
    held = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(s.seed)), F.col("query_id").cast("string"))), 1, 8), 16, 10).cast("double") < share * 2.0**32
    records = keep(_records(rows, features, edges).withColumn("held", held))
    trees, gains, curve, since = [], [], [], []
    for number in range(s.trees + 1):
        last = number == s.trees
        if last and s.patience is None:
            break
        tree, gain, score = _grow(records, replace(s, depth=1) if last else s, width, since, number, s.patience is not None)
        if score is not None:
            curve.append(score)
            if len(curve) - 1 - int(np.argmax(curve)) >= s.patience:
                break
        if tree is None or last:
            break
        trees.append(tree)
        gains.append(gain)
        since.append(tree)
        if len(since) == WRITE_EVERY:
            records, since = keep(_with_scores(records, since, width)), []
    best = int(np.argmax(curve)) if curve else len(trees)
    return Forest(features, edges, tuple(trees[:best]), np.sum(gains[:best], axis=0) if best else np.zeros(width), tuple(curve))


def predict(model: Forest, rows: DataFrame) -> DataFrame:
    """``rows`` with ``prediction``, the forest's score; other columns stay."""
    out = rows.drop("prediction")
    names = out.columns
    packed = out.select(*names, F.array(*[F.col(f).cast("double") for f in model.features]).alias("__x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(model.features)
        for b in batches:
            x = b.column(len(names)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(model.scores(binned(list(x.T), model.edges)))], names=[*names, "prediction"])

    schema = out.withColumn("prediction", F.lit(0.0)).schema
    return packed.mapInArrow(run, schema)


def cross_fit(rows: DataFrame, folds: DataFrame, features: Sequence[str], settings: Settings | None = None) -> tuple[DataFrame, list[Forest]]:
    """Predictions of each half (``folds``: query_id, half) by a model of the other, and both models."""
    r = keep(rows.join(folds.select("query_id", "half"), "query_id"))
    out, models = None, []
    for mine, other in (("A", "B"), ("B", "A")):
        m = fit(r.where(F.col("half") == other), features, settings)
        p = predict(m, r.where(F.col("half") == mine))
        out, models = (p if out is None else out.unionByName(p)), [*models, m]
    return out, models


def final_settings(models: Sequence[Forest], settings: Settings | None = None) -> Settings:
    """Settings of the last fit, on all queries: as many trees as the folds' best rounds on average, none held out."""
    trees = max(1, round(sum(len(m.trees) for m in models) / len(models)))
    return replace(settings or Settings(), trees=trees, patience=None)


def importance(models: Sequence[Forest]) -> list[tuple[str, float]]:
    """(feature, mean share of gain), largest first."""
    shares = np.mean([m.gains / max(m.gains.sum(), 1e-300) for m in models], axis=0)
    return sorted(zip(models[0].features, shares.tolist(), strict=True), key=lambda x: (-x[1], x[0]))
