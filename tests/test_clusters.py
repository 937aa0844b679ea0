"""Nearest vectors over clusters against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlode.operators import clusters


def blobs(n, dim, groups, noise, seed):
    rnd = np.random.default_rng(seed)
    x = rnd.standard_normal((groups, dim))[rnd.integers(0, groups, n)] + noise * rnd.standard_normal((n, dim))
    x[5], x[9] = 0, x[8]
    return np.round(x, 3)


def frame(spark, x, name):
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(10_000, None)]
    return spark.createDataFrame(rows, f"{name} long, embedding array<float>").repartition(3)


def plain(q, x, k):
    q, x = q.astype(np.float32).astype(float), x.astype(np.float32).astype(float)
    out = {}
    for i, v in enumerate(q):
        if v.any():
            cos = [(-round(float(v @ w / np.sqrt(v @ v) / np.sqrt(w @ w)), 5) + 0.0, j) for j, w in enumerate(x) if w.any()]
            out[i] = [j for _, j in sorted(cos)[:k]]
    return out


def found(search):
    by = {}
    for r in search.top.orderBy("q", "rank").collect():
        by.setdefault(r.q, []).append(r.d)
    return by


@pytest.mark.parametrize(("noise", "k", "tile", "most"), [(0.05, 5, 4096, 256), (3.0, 20, 16, 6), (0.3, 700, 64, 256), (0.3, 1, 4096, 1)])
def test_against_all_pairs(spark, noise, k, tile, most):
    x, q = blobs(500, 12, 15, noise, 1), blobs(60, 12, 15, noise, 2)
    index = clusters.fit(frame(spark, x, "item_id"), most=most)
    assert len(index.centres) <= most and index.cells[:, 2].sum() == 499
    got = clusters.search(index, frame(spark, q, "query_id"), k, tile=tile)
    assert found(got) == plain(q, x, k)
    work = got.work.agg(F.sum("compared").alias("compared"), F.sum("vectors").alias("vectors"), F.count(F.lit(1)).alias("n")).first()
    assert work.n == 59 and (noise > 0.05 or work.compared < work.vectors / 4)


def test_a_sample_fits_and_all_are_indexed(spark):
    x = blobs(400, 8, 10, 0.1, 3)
    index = clusters.fit(frame(spark, x, "item_id"), sample=50)
    assert len(index.centres) <= 7 and index.items.count() == 399
    assert found(clusters.search(index, frame(spark, x[:20], "query_id"), 4)) == plain(x[:20], x, 4)


def test_nothing(spark):
    x = blobs(20, 4, 3, 0.1, 3)
    none = clusters.fit(frame(spark, x, "item_id").limit(0))
    assert found(clusters.search(none, frame(spark, x, "query_id"), 3)) == {}
    assert found(clusters.search(clusters.fit(frame(spark, x, "item_id")), frame(spark, x, "query_id").limit(0), 3)) == {}
