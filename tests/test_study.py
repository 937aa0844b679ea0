"""The weight search against plain loops."""

import math
import random

import pytest

from siftlode.operators import study

COLUMNS = ["char", "dense"]


def made(n=30, seed=1):
    rnd = random.Random(seed)
    terms, queries, rel = [], [], []
    for q in range(n):
        queries.append((f"q{q}", f"cell{q % 3}", q % 4 == 0))
        for i in range(rnd.randrange(3, 15)):
            good = rnd.random() < 0.3
            terms.append((f"q{q}", f"i{i:02}", round(rnd.random() + 0.3 * good, 2), round(rnd.random() - 0.2 * good, 2), rnd.choice((0.0, 0.2, 0.5)), rnd.choice((0.1, 0.9)), "more"))
            if good:
                rel += [(f"q{q}", f"i{i:02}")] * 2
        if q % 5 == 0:
            rel.append((f"q{q}", "elsewhere"))
    queries.append(("lonely", "cell1", None))
    rel.append(("lonely", "elsewhere"))
    return terms, queries, rel


def packed(spark, data, parts=3):
    terms, queries, rel = data
    t = spark.createDataFrame(terms, "query_id string, item_id string, char double, dense double, loc_p double, mc_p double, x string").repartition(parts)
    return study.records(t, COLUMNS, spark.createDataFrame(queries, "query_id string, cell string, is_agg boolean"), spark.createDataFrame(rel, "query_id string, item_id string"))


def plain(data, trial, k):
    terms, queries, rel = data
    cells = {}
    for q, cell, region in queries:
        yes = {i for r, i in rel if r == q}
        if not yes:
            continue
        w = lambda n: trial.get(f"{n}_agg", trial.get(n, 0.0)) if region else trial.get(n, 0.0)  # noqa: B023, E731
        s = [(-round(w("char") * c + w("dense") * d + w("loc") * math.log(lp + trial.get("loc_eps", 3e-6)) + w("mc") * math.log(mp + trial.get("mc_eps", 8.6e-4)), 5), i) for r, i, c, d, lp, mp, _ in terms if r == q]
        cells.setdefault(cell, []).append(len(yes & {i for _, i in sorted(s)[:k]}) / len(yes))
    return {c: (pytest.approx(sum(v) / len(v), abs=1e-9), len(v)) for c, v in cells.items()}


def test_a_batch_is_one_job_and_equals_a_plain_loop(spark):
    data = made()
    p = packed(spark, data)
    trials = [{"char": 1.0}, {"char": 1.0, "dense": 0.5, "loc": 0.1, "mc": 0.02}, {"dense": 1.0, "loc": 0.3, "loc_eps": 0.1, "loc_agg": 0.01}, {}]
    sc = spark.sparkContext
    sc.setJobGroup("trials", "")
    got = study.score(p, COLUMNS, trials, 3)
    jobs = sc.statusTracker().getJobIdsForGroup("trials")
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == [plain(data, t, 3) for t in trials]
    # AQE runs the one shuffle and the result as two
    assert len(jobs) <= 2


def test_study_begins_with_the_base_and_reruns_agree(spark):
    data = made(60, 2)
    space = {"dense": (0.0, 2.0, "uniform"), "loc": (1e-3, 1.0, "log"), "char_agg": (0.5, 2.0, "uniform")}
    base, cells = {"char": 1.0, "dense": 2.0, "loc": 0.9}, {"cell0": 0.5, "cell1": 0.3, "cell2": 0.1, "absent": 0.1}
    runs = [study.study(packed(spark, data, n), COLUMNS, space, base, cells, trials=24, batch=7, k=3) for n in (1, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == 24
    first, value = runs[0][0]
    assert first == {"char": 1.0, "dense": 2.0, "loc": 0.9, "char_agg": 1.0}
    by = plain(data, first, 3)
    assert value == pytest.approx(sum(w * by[c][0].expected for c, w in cells.items() if c in by) / 0.9)
    assert max(v for _, v in runs[0]) > value and all(0 <= t["dense"] <= 2 and 1e-3 <= t["loc"] <= 1 for t, _ in runs[0])
    with pytest.raises(ValueError, match="word"):
        study.study(packed(spark, data), COLUMNS, {"word": (0, 1, "uniform")}, base, cells)


def test_draws_come_near_the_good(spark):
    space = {"x": (1e-4, 1.0, "log"), "y": (0.0, 1.0, "uniform")}
    history = [(t, -abs(math.log10(t["x"]) + 3) - t["y"]) for t in study.suggest(space, [], 40)]
    new = study.suggest(space, history, 50, 1)
    assert new == study.suggest(space, history, 50, 1)
    mean = lambda ts: (sum(abs(math.log10(t["x"]) + 3) for t in ts) / len(ts), sum(t["y"] for t in ts) / len(ts))
    before, after = mean([t for t, _ in history]), mean(new)
    assert after[0] < before[0] * 0.7 and after[1] < before[1] * 0.7


def test_check_on_the_other_half(spark):
    a, b = packed(spark, made(40, 3)), packed(spark, made(40, 4))
    out = study.tune_and_check(a, b, COLUMNS, {"dense": (0.0, 3.0, "uniform")}, {"char": 1.0, "dense": 3.0}, {"cell0": 1.0, "cell1": 1.0}, trials=12, batch=4, k=3)
    assert out["trials"] == 12 and out["half_b"]["best"] > out["half_b"]["base"]
