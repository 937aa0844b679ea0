"""Weight search over a cached table of terms, and named runs.

Every trial re-weights terms that were joined once; the search is a seeded random one that tries the present weights
first (no Bayesian optimiser is assumed).
"""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fusion, metrics
from .splits import Split, subset


def score_params(terms: DataFrame, columns: Sequence[str], weights: Mapping[str, float], queries: DataFrame, rel: DataFrame, k: int = metrics.K) -> float:
    """Mean recall of the ranking by weighted ``columns`` of ``terms`` (query_id, item_id, idx, columns)."""
    score = sum((F.lit(float(weights.get(c, 0.0))) * F.col(c) for c in columns), F.lit(0.0))
    top = fusion.ranked(terms.withColumn("score", score), k)
    return float(metrics.recall(top, queries, rel, k).agg(F.avg("recall").alias("r")).first()["r"])


def suggest(space: Mapping[str, tuple[float, float]], n: int, base: Mapping[str, float], seed: int = 42) -> list[dict[str, float]]:
    """``base``, then ``n`` - 1 points of the space at random."""
    rnd = random.Random(seed)
    return [dict(base), *[{**base, **{k: rnd.uniform(lo, hi) for k, (lo, hi) in space.items()}} for _ in range(n - 1)]]


def search(terms: DataFrame, columns: Sequence[str], trials: Sequence[Mapping[str, float]], queries: DataFrame, rel: DataFrame, k: int = metrics.K) -> list[tuple[dict[str, float], float]]:
    """(weights, recall) of each trial, best first, ties by order; ``terms`` is kept in memory meanwhile."""
    kept = terms.persist()
    try:
        found = [(dict(w), score_params(kept, columns, w, queries, rel, k)) for w in trials]
    finally:
        kept.unpersist()
    return sorted(found, key=lambda x: -x[1])


def tune_and_check(terms: DataFrame, columns: Sequence[str], trials: Sequence[Mapping[str, float]], halves: DataFrame, rel: DataFrame, k: int = metrics.K) -> dict:
    """The best weights on half A and their recall on half B, beside the first trial's."""
    a, b = (halves.where(F.col("half") == h).drop("half") for h in "AB")
    whole = Split(halves, rel, rel)
    pick = lambda q: subset(whole, q).rel
    best, on_a = search(terms, columns, trials, a, pick(a), k)[0]
    on_b = {name: score_params(terms, columns, w, b, pick(b), k) for name, w in (("base", trials[0]), ("best", best))}
    return {"best": best, "half_a": on_a, "half_b": on_b}


def ablation_grid(tops: Mapping[str, DataFrame], queries: DataFrame, rel: DataFrame, k: int = metrics.K) -> DataFrame:
    """(run, recall, n): mean recall of each named run's ranking (query_id, item_id, rank)."""
    out = None
    for name, top in tops.items():
        r = metrics.recall(top, queries, rel, k).agg(F.lit(name).alias("run"), F.avg("recall").alias("recall"), F.count(F.lit(1)).alias("n"))
        out = r if out is None else out.union(r)
    return out
