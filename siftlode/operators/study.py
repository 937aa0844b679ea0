"""Weight search by Parzen estimates, many trials in one pass.

Terms are packed once, one record a query: the raw terms of its candidates, whether each is relevant, and its cell. A batch of
trials is one Spark job: each task multiplies a query's terms with the matrix of all trials' weights, ranks, counts hits
and sums recall by (trial, cell); what reaches the driver is trials x cells sums, in whole units, so reruns agree. New trials are drawn
where parameters of the good trials lie denser than those of the others.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship
from ..sources.work import keep
from . import fusion
from .metrics import K

UNIT = 1 << 40
#: Trials drawn at random before densities are estimated; share of them that count as good; points tried for each draw.
START, GOOD, POINTS = 10, 0.25, 24
PRIORS = {"loc": ("loc_p", "loc_eps", fusion.LOC_EPS), "mc": ("mc_p", "mc_eps", fusion.MC_EPS)}
Trial = Mapping[str, float]
Space = Mapping[str, tuple[float, float, str]]

ship(__name__)


def records(terms: DataFrame, columns: Sequence[str], queries: DataFrame, rel: DataFrame) -> DataFrame:
    """(cell, is_agg, n_rel, x, hit): one record a query that has relevant items, written once.

    ``terms``: query_id, item_id, loc_p, mc_p and the other ``columns``, for a bounded number of candidates a query (a pool); ``queries``:
    query_id, cell, is_agg; ``rel``: query_id, item_id. Relevant items that are not candidates count as missed.
    """
    yes = rel.select("query_id", "item_id").distinct()
    asked = queries.select("query_id", "cell", F.coalesce("is_agg", F.lit(False)).alias("is_agg")).join(yes.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel")), "query_id")
    names = [*columns, *[p for p, _, _ in PRIORS.values()]]
    rows = terms.select("query_id", "item_id", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names]).alias("x")).join(yes.withColumn("y", F.lit(True)), ["query_id", "item_id"], "left")
    r = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("item_id", "x", F.coalesce("y", F.lit(False)).alias("y")))).alias("r"))
    out = asked.join(r, "query_id", "left").select("cell", "is_agg", "n_rel", F.coalesce(F.flatten("r.x"), F.array().cast("array<double>")).alias("x"), F.coalesce(F.col("r.y"), F.array().cast("array<boolean>")).alias("hit"))
    return keep(out)


def weights_of(trials: Sequence[Trial], names: Sequence[str], region: bool) -> np.ndarray:
    """Matrix of names x trials; ``<name>_agg`` takes the place of a name for queries from aggregate regions."""
    pick = lambda t, n: t.get(f"{n}_agg", t.get(n, 0.0)) if region else t.get(n, 0.0)
    return np.array([[float(pick(t, n)) for t in trials] for n in names])


def score(packed: DataFrame, columns: Sequence[str], trials: Sequence[Trial], k: int = K) -> list[dict[str, tuple[float, int]]]:
    """Of each trial, {cell: (mean recall, queries)}, in one job. A trial has weights by term, "loc" and "mc", and may have
    loc_eps and mc_eps. Ties of scores rounded to 5 places go by item id."""
    columns, trials, width = list(columns), [dict(t) for t in trials], len(columns) + len(PRIORS)
    w = [weights_of(trials, [*columns, *PRIORS], region) for region in (False, True)]
    eps = [np.array([float(t.get(e, d)) for t in trials]) for _, e, d in PRIORS.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[np.ndarray]] = {}
        for b in batches:
            for r in range(b.num_rows):
                cell, region, n_rel = (b.column(c)[r].as_py() for c in (0, 1, 2))
                x, hit = (b.column(c)[r].values.to_numpy(zero_copy_only=False) for c in (3, 4))
                told = sums.setdefault(cell, [np.zeros(len(trials), np.int64), np.zeros(1, np.int64)])
                told[1] += 1
                if not len(hit):
                    continue
                x = x.reshape(-1, width)
                m, c = w[int(region)], len(columns)
                s = x[:, :c] @ m[:c] if c else np.zeros((len(x), len(trials)))
                for i, e in enumerate(eps):
                    s = s + m[c + i] * np.log(x[:, [c + i]] + e)
                top = np.argsort(-np.round(s, 5), axis=0, kind="stable")[:k]
                told[0] += np.rint(hit[top].sum(0) / n_rel * UNIT).astype(np.int64)
        rows = [(t, cell, int(v[0][t]), int(v[1][0])) for cell, v in sums.items() for t in range(len(trials))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["trial", "cell", "s", "n"])

    out: list[dict[str, tuple[float, int]]] = [{} for _ in trials]
    for r in packed.mapInArrow(run, "trial int, cell string, s long, n long").groupBy("trial", "cell").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():
        out[r.trial][r.cell] = (r.s / UNIT / r.n, r.n)
    return out


def adjusted(by_cell: Mapping[str, tuple[float, int]], cell_weights: Mapping[str, float]) -> float:
    """Recall weighted by the benchmark's cells; cells without held-out queries leave their weight to the others."""
    there = {c: w for c, w in cell_weights.items() if c in by_cell and w > 0}
    total = sum(there.values())
    return sum(w * by_cell[c][0] for c, w in there.items()) / total if total else float("nan")


def _to_unit(v: float, bounds: tuple[float, float, str]) -> float:
    lo, hi, kind = bounds
    a, b, v = (math.log(lo), math.log(hi), math.log(v)) if kind == "log" else (lo, hi, v)
    return min(1.0, max(0.0, (v - a) / (b - a)))


def _from_unit(u: float, bounds: tuple[float, float, str]) -> float:
    lo, hi, kind = bounds
    return math.exp(math.log(lo) + u * (math.log(hi) - math.log(lo))) if kind == "log" else lo + u * (hi - lo)


def _density(points: Sequence[float], u: float) -> float:
    """Parzen estimate on [0, 1]: normal kernels cut at the ends, and one uniform part."""
    width = max(0.05, len(points) ** -0.2 * 0.25)
    mass = lambda p: 0.5 * (math.erf((1 - p) / width / 2**0.5) + math.erf(p / width / 2**0.5))
    kernels = sum(math.exp(-0.5 * ((u - p) / width) ** 2) / (width * (2 * math.pi) ** 0.5) / mass(p) for p in points)
    return (kernels + 1) / (len(points) + 1)


def suggest(space: Space, history: Sequence[tuple[Trial, float]], n: int, seed: int = 42) -> list[dict[str, float]]:
    """``n`` new points: at random until ``START`` trials are known, then, of ``POINTS`` points about the good ones, that where the
    good are densest against the others, each parameter by itself."""
    rnd = random.Random(f"{seed}:{len(history)}")
    ordered = sorted(history, key=lambda x: -x[1])
    cut = max(1, math.ceil(GOOD * len(ordered)))
    out = []
    for _ in range(n):
        point = {}
        for name, bounds in space.items():
            if len(history) < START:
                u = rnd.random()
            else:
                good, rest = ([_to_unit(t[name], bounds) for t, _ in part] for part in (ordered[:cut], ordered[cut:]))
                width = max(0.05, len(good) ** -0.2 * 0.25)
                tried = [min(1.0, max(0.0, rnd.gauss(rnd.choice(good), width))) if rnd.random() * (len(good) + 1) >= 1 else rnd.random() for _ in range(POINTS)]
                u = max(tried, key=lambda x: _density(good, x) / _density(rest, x))
            point[name] = _from_unit(u, bounds)
        out.append(point)
    return out


def study(packed: DataFrame, columns: Sequence[str], space: Space, base: Trial, cell_weights: Mapping[str, float], trials: int = 60, batch: int = 10, k: int = K, seed: int = 42) -> list[tuple[dict[str, float], float]]:
    """(weights, adjusted recall) of each trial in the order drawn, ``base`` first, a job for each ``batch``. What the space does not name
    stays as in ``base``; ``<name>_agg`` that base lacks begins as its ``<name>``."""
    first = {n: base.get(n, base.get(n.removesuffix("_agg"))) for n in space}
    if missing := [n for n, v in first.items() if v is None]:
        raise ValueError(f"base has no {missing}")
    found: list[tuple[dict[str, float], float]] = []
    while len(found) < trials:
        new = [first] if not found else suggest(space, [({n: t[n] for n in space}, v) for t, v in found], min(batch, trials - len(found)), seed)
        whole = [{**base, **t} for t in new]
        found += [(t, adjusted(cells, cell_weights)) for t, cells in zip(whole, score(packed, columns, whole, k), strict=True)]
    return found


def tune_and_check(half_a: DataFrame, half_b: DataFrame, columns: Sequence[str], space: Space, base: Trial, cell_weights: Mapping[str, float], **how) -> dict:
    """The best weights on half A (of equal ones the first), and their adjusted recall on half B beside the base's."""
    found = study(half_a, columns, space, base, cell_weights, **how)
    best, on_a = max(found, key=lambda x: x[1])
    on_b = [adjusted(c, cell_weights) for c in score(half_b, columns, [base, best], how.get("k", K))]
    return {"best": best, "half_a": on_a, "half_b": dict(zip(("base", "best"), on_b, strict=True)), "trials": len(found)}
