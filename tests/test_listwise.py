"""The listwise ranker against plain loops."""

import math

import numpy as np
import pytest

from siftlode.operators import listwise, ranker
from siftlode.operators.listwise import Settings

SMALL = Settings(trees=3, depth=3, least_rows=3, bins=16, rows_share=1.0, columns_share=1.0, patience=None)


def plain_ndcg(label, score, at):
    order = sorted(range(len(label)), key=lambda i: (-score[i], i))
    dcg = sum((2 ** label[i] - 1) / math.log2(r + 2) for r, i in enumerate(order[:at]))
    best = sum((2**x - 1) / math.log2(r + 2) for r, x in enumerate(sorted(label, reverse=True)[:at]))
    return dcg / best if best else 0.0


def plain_lambdas(label, score, at):
    n = len(label)
    g, h = [0.0] * n, [0.0] * n
    for i in range(n):
        for j in range(n):
            if label[i] > label[j]:
                # what NDCG loses or wins if the two change places
                order = sorted(range(n), key=lambda k: (-score[k], k))
                swapped = list(order)
                a, b = order.index(i), order.index(j)
                swapped[a], swapped[b] = j, i
                one = plain_ndcg([label[k] for k in order], range(n, 0, -1), at)
                two = plain_ndcg([label[k] for k in swapped], range(n, 0, -1), at)
                rho = 1 / (1 + math.exp(score[i] - score[j]))
                g[i] -= rho * abs(one - two)
                g[j] += rho * abs(one - two)
                h[i] += rho * (1 - rho) * abs(one - two)
                h[j] += rho * (1 - rho) * abs(one - two)
    return g, h


@pytest.mark.parametrize("at", [3, 50])
def test_lambdas_and_ndcg(at):
    rnd = np.random.default_rng(at)
    for n in (1, 2, 9, 14):
        label, score = rnd.integers(0, 3, n).astype(float), np.round(rnd.standard_normal(n), 1)
        assert listwise.ndcg(label, score, at) == pytest.approx(plain_ndcg(label, score, at))
        for got, want in zip(listwise.lambdas(label, score, at), plain_lambdas(label, score, at), strict=True):
            assert np.allclose(got, want)


def made_rows(queries=40, seed=1, most=30):
    """Label 1 where a product of two features is large, with noise; some features are missing."""
    rnd, rows = np.random.default_rng(seed), []
    for q in range(queries):
        n = int(rnd.integers(4, most))
        x = np.round(rnd.standard_normal((n, 3)), 2)
        hit = x[:, 0] * x[:, 1] + 0.3 * rnd.standard_normal(n)
        yes = hit >= np.sort(hit)[-2]
        for i in range(n):
            a, b, c = x[i].tolist()
            rows.append((f"q{q:03}", f"i{i:03}", int(yes[i]) if q % 10 else 0, a, b, float("nan") if i % 7 == 0 else None if i % 5 == 0 else c))
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "query_id string, item_id string, label int, a double, b double, c double").repartition(parts)


def plain_forest(rows, edges, s):
    """Leaf values of each row, tree after tree, by recursion over plain lists."""
    queries = sorted({r[0] for r in rows if any(x[0] == r[0] and x[2] for x in rows)})
    data = [[r for r in sorted(rows) if r[0] == q] for q in queries]

    def bin_of(v, e):
        return 0 if v is None or v != v else sum(x < v for x in e) + 1

    flat = [(k, i) for k, q in enumerate(data) for i in range(len(q))]
    x = {(k, i): [bin_of(v, e) for v, e in zip(data[k][i][3:], edges, strict=True)] for k, i in flat}
    score = dict.fromkeys(flat, 0.0)
    for _ in range(s.trees):
        g, h = {}, {}
        for k, q in enumerate(data):
            gs, hs = plain_lambdas([r[2] for r in q], [score[k, i] for i in range(len(q))], s.at)
            for i in range(len(q)):
                g[k, i], h[k, i] = gs[i], hs[i]

        def gain_of(rows_):
            return sum(g[r] for r in rows_) ** 2 / (sum(h[r] for r in rows_) + s.penalty)

        level, leaves = [flat], []
        for _ in range(s.depth):
            following = []
            for node in level:
                best = None
                for f in range(len(edges)):
                    for b in range(len(edges[f]) + 1):
                        lo, hi = [r for r in node if x[r][f] <= b], [r for r in node if x[r][f] > b]
                        if min(len(lo), len(hi)) < s.least_rows or min(sum(h[r] for r in lo), sum(h[r] for r in hi)) < 1e-3:
                            continue
                        gain = gain_of(lo) + gain_of(hi) - gain_of(node)
                        if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, lo, hi)
                if best:
                    following += best[1:]
                else:
                    leaves.append(node)
            level = following
        for node in leaves + level:
            v = -s.step * sum(g[r] for r in node) / (sum(h[r] for r in node) + s.penalty)
            for r in node:
                score[r] += v
    return {(data[k][i][0], data[k][i][1]): v for (k, i), v in score.items()}


def test_trees_against_plain_recursion(spark):
    rows = made_rows(10, most=14)
    df = frame(spark, rows)
    model = listwise.fit(df, ["a", "b", "c"], SMALL)
    assert len(model.trees) == 3
    want = plain_forest(rows, [e.tolist() for e in model.edges], SMALL)
    got = {(r.query_id, r.item_id): r.prediction for r in listwise.predict(model, df).collect()}
    assert len(got) == len(rows) and all(got[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())


def test_reruns_agree_however_rows_are_dealt(spark):
    rows, s = made_rows(), Settings(trees=12, depth=3, least_rows=5, bins=32, patience=5, leaves=7)
    models = [listwise.fit(frame(spark, r, n), ["a", "b", "c"], s) for r, n in ((rows, 1), (rows[::-1], 7))]
    assert models[0].curve == models[1].curve and len(models[0].trees) == len(models[1].trees) > 0
    for a, b in zip(*(m.trees for m in models), strict=True):
        assert a.feature.tolist() == b.feature.tolist() and a.split.tolist() == b.split.tolist() and a.value.tolist() == b.value.tolist()
        assert (a.feature < 0).sum() <= 7
    shares = listwise.importance(models)
    assert sum(v for _, v in shares) == pytest.approx(1.0) and {shares[0][0], shares[1][0]} == {"a", "b"}


def test_early_stopping_returns_the_best_round(spark):
    rows = made_rows(60)
    # steps this long overshoot: later rounds are worse on the queries held out
    model = listwise.fit(frame(spark, rows), ["a", "b", "c"], Settings(trees=40, step=3.0, least_rows=2, bins=32, depth=3, patience=3, held_share=0.3))
    best = int(np.argmax(model.curve))
    assert len(model.trees) == best and len(model.curve) == best + 4 < 41 and model.curve[-1] < model.curve[best]
    fixed = listwise.final_settings([model, model], Settings(patience=6))
    assert (fixed.trees, fixed.patience) == (max(1, best), None)


def uneven_rows(queries, seed):
    """Queries of very different shares of relevant rows, which a feature of the query tells: of no use for the order within one."""
    rnd, rows = np.random.default_rng(seed), []
    for q in range(queries):
        n, easy = int(rnd.integers(10, 40)), float(rnd.integers(0, 5))
        x = np.round(rnd.standard_normal((n, 2)), 2)
        hit = x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.5 * rnd.standard_normal(n)
        yes = hit >= np.sort(hit)[-max(1, int(n * (0.02 + 0.2 * easy)))]
        rows += [(f"q{q:03}", f"i{i:03}", int(yes[i]), *x[i].tolist(), easy) for i in range(n)]
    return rows


def test_ndcg_beats_the_binary_trees(spark):
    train, other, names = frame(spark, uneven_rows(80, 2)), frame(spark, uneven_rows(60, 3)), ["a", "b", "c"]
    s = Settings(trees=12, step=0.2, depth=3, least_rows=20, bins=32, rows_share=1.0, columns_share=1.0, patience=None)
    a = listwise.predict(listwise.fit(train, names, s), other).collect()
    b = ranker.predict(ranker.fit(train, names, trees=12, depth=3, step=0.2), other, names).collect()

    def mean(rows):
        by = {}
        for r in sorted(rows, key=lambda r: r.item_id):
            by.setdefault(r.query_id, []).append(r)
        return float(np.mean([listwise.ndcg(np.array([x.label for x in q], float), np.array([x.prediction for x in q]), 50) for q in by.values()]))

    assert mean(a) > mean(b)


def test_cross_fit_and_nothing_to_learn(spark):
    rows = made_rows(30)
    folds = spark.createDataFrame([(f"q{i:03}", "A" if i % 2 else "B") for i in range(30)], "query_id string, half string")
    out, models = listwise.cross_fit(frame(spark, rows), folds, ["a", "b", "c"], SMALL)
    mine = {r.query_id: r.prediction for r in out.where("item_id = 'i000'").collect()}
    assert out.count() == len(rows) and len(models) == 2
    again = {r.query_id: r.prediction for r in listwise.predict(models[0], frame(spark, rows)).where("item_id = 'i000'").collect()}
    assert all(mine[q] == again[q] for q in mine if int(q[1:]) % 2)
    none = listwise.fit(frame(spark, rows).where("label = 0"), ["a", "b", "c"], Settings(trees=5))
    assert none.trees == () and {r.prediction for r in listwise.predict(none, frame(spark, rows)).collect()} == {0.0}
