import pytest
from pyspark.sql import functions as F

from siftlode.operators import fusion, metrics, pool, priors, splits, tune
from siftlode.plans import recipe
from siftlode.sources import config, tables


def ranking(spark, ids, q="q"):
    return spark.createDataFrame([(q, x, i + 1, x) for i, x in enumerate(ids)], "query_id string, item_id string, rank int, idx string")


def test_rrf(spark):
    got = fusion.rrf([(ranking(spark, "abc"), 1.0), (ranking(spark, "cda"), 0.5)], 4).orderBy("rank").collect()
    assert [(r.item_id, round(r.score, 6)) for r in got] == [("a", 0.024330), ("c", 0.024070), ("b", 0.016129), ("d", 0.008065)]


def test_quota_and_backfill(spark):
    a, b = ranking(spark, "abcd"), ranking(spark, "baef")
    assert [r.item_id for r in fusion.quota([(a, 2), (b, 1)], 4).orderBy("rank").collect()] == list("abec")
    assert [r.item_id for r in fusion.backfill(ranking(spark, "ca"), [ranking(spark, "abd"), ranking(spark, "xyz")], 5).orderBy("rank").collect()] == list("cabdx")


def test_location_prior(spark):
    clicks = spark.createDataFrame([(1, 1)] * 3 + [(1, 2)] + [(9, 2)] * 2, "search_location_id int, item_location_id int")
    n = priors.location_counts(clicks)
    q = spark.createDataFrame([(1,), (9,), (5,), (7,)], "search_loc int")
    p = lambda locs: {(r.search_loc, r.item_loc): r.p for r in priors.location_prior(n, q, spark.createDataFrame([(x,) for x in locs], "item_loc int")).collect()}
    assert p([1, 2, 5]) == pytest.approx({(1, 1): 0.75, (1, 2): 0.25, (9, 2): 1.0, (5, 5): 1.0, (7, 1): 1 / 3, (7, 2): 1 / 3, (7, 5): 1 / 3})
    assert p([1])[(1, 1)] == 0.75


@pytest.fixture(scope="module")
def small(spark):
    import random

    rnd = random.Random(3)
    words = ["red", "blue", "small", "lamp", "ring", "bolt", "gear"]
    items = [(f"{i:016x}", " ".join(rnd.sample(words, 2)), f"Type t{i % 3}", None, i % 4, f"t{i % 3}", None, None, float(i)) for i in range(60)]
    it = spark.createDataFrame(items, "item_id string, item_title_raw string, item_infm_params_text string, item_description_raw string, item_location_id int, item_microcat_id string, item_latitude double, item_longitude double, item_price double")
    train = [(" ".join(rnd.sample(words, 2)), rnd.randrange(5), "", 0, 0, items[j][0], rnd.randrange(5), items[j][5]) for j in (rnd.randrange(60) for _ in range(400))]
    tr = spark.createDataFrame(train, "search_query string, search_location_id int, search_infm_params_text string, search_is_delivery_search int, search_category int, item_id string, item_location_id int, item_microcat_id string").withColumn("query_norm", F.col("search_query"))
    q = spark.createDataFrame([(f"q{i}", " ".join(rnd.sample(words, 2)) if i else "unknown", i % 6, f"Type t{i % 3}" if i % 2 else None) for i in range(8)], "query_id string, query_norm string, search_location_id int, search_infm_params_text string")
    q = q.withColumn("search_query", F.col("query_norm"))
    return it, tr, q, recipe.build(tr, it, q, [{"col": "item_title_raw"}], ["Type"], {"Type": 1.0})


@pytest.mark.parametrize("k", [3, 20])
def test_pruned_topk_is_that_of_all_pairs(small, k):
    c = small[3].components
    w = fusion.WEIGHTS | {"memory": 0.2, "loc_agg": 0.01}
    want = fusion.ranked(fusion.score_pairs(fusion.all_pairs(c), c, w), k)
    key = lambda df: sorted((r.query_id, r["rank"], r.item_id) for r in df.collect())
    assert key(fusion.topk_linear(c, w, k)) == key(want)


def test_contributions_add_up(small):
    c = small[3].components
    rows = fusion.explain(fusion.all_pairs(c), c, fusion.WEIGHTS).collect()
    assert all(abs(sum(r[x] for x in r.asDict() if x.startswith("c_")) - r.score) < 1e-9 for r in rows)


def test_features(small):
    it, tr, q, b = small
    c, w = b.components, fusion.WEIGHTS
    tops = recipe.rank_channels(c, {"final": w, "char": {"char": 1.0}}, 5)
    p = pool.build_pool(tops, 5)
    more = {"item_rating": F.lit(None).cast("int"), "item_rating_reviews_count": F.lit(3), "item_is_phone_hidden": F.lit(True), "item_is_message_forbidden": F.lit(False)}
    items, queries = pool.drop_features(pool.item_features(it.withColumns(more), tr)), pool.query_features(q, tr, c.mc_p, c.n_mc, b.shares)
    x = pool.feature_table(p, c, w, items, queries, b.centroids, ("Type",), places=None)
    rows = {(r.query_id, r.item_id): r for r in x.collect()}
    assert set(rows) == {(r.query_id, r.item_id) for r in p.collect()} and x.count() == len(rows)
    # every term is what the fusion scores with
    for r in fusion.score_pairs(p, c, w | {"memory": 1e-12}).collect():
        f = rows[r.query_id, r.item_id]
        assert abs(f.final - r.score) < 1e-6 and f.loc_p == r.loc_p and f.mc_p == r.mc_p and f.same_loc == float(r.loc == r.item_loc)
        assert all(abs(f[n] - (r[n] or 0.0)) < 1e-9 for n in ("char", "word", "filter", "memory"))
    best = {}
    for (i, _), f in rows.items():
        best.setdefault(i, []).append(f)
    for f in best.values():
        assert max(r.final_gap for r in f) == 0 and {r.q_pool_size for r in f} == {len(f)} and all(abs(r.final - r.final_gap - max(x.final for x in f)) < 1e-9 for r in f)
    assert all(r.dist_km > 0 and r.filter_Type in (0, 1) and r.rank_final <= 6 for r in rows.values())
    one = {r.item_id: r for r in items.collect()}
    assert all(rows[k].item_log_price == one[k[1]].item_log_price for k in rows)


@pytest.fixture(scope="module")
def built(spark, small):
    it, tr, q, _ = small
    return splits.build(tr, it.where("item_price < 50"), 6, 4)


def test_splits_leak_nothing(built):
    for name, s in built.items():
        qs = s.queries.collect()
        unseen = {r.query_norm for r in qs if r.slice == "unseen"}
        rest = s.rest.collect()
        assert not unseen & {r.query_norm for r in rest}, name
        held = {(r.query_norm, r.search_location_id) for r in qs if r.slice == "seen"}
        if name == "ql":
            assert not held & {(r.query_norm, r.search_location_id) for r in rest}
    cold = built["ctx_cold"]
    assert not {r.item_id for r in cold.rel.collect()} & {r.item_id for r in cold.rest.collect()}


def test_rebuilding_gives_the_same(built, small):
    it, tr, *_ = small
    again = splits.build(tr.repartition(3), it.where("item_price < 50"), 6, 4)
    for name, s in built.items():
        for part in ("queries", "rel", "rest"):
            assert splits.digest(getattr(s, part)) == splits.digest(getattr(again[name], part)), (name, part)


def test_recall(built, spark):
    s = built["ctx"]
    perfect = s.rel.withColumn("rank", F.lit(1))
    mean = lambda a: metrics.recall(a, s.queries, s.rel).agg(F.avg("recall")).first()[0]
    assert mean(perfect) == 1.0
    assert mean(perfect.limit(0)) == 0.0
    some = perfect.where(F.crc32("item_id") % 2 == 0)
    assert 0 < mean(some) < 1
    assert mean(some.union(some)) == mean(some)
    metrics.check_known(perfect, s.queries)
    with pytest.raises(ValueError, match="unknown"):
        metrics.check_known(ranking(spark, "a", "nobody"), s.queries)


def test_halves_and_tuning(built):
    h = splits.halves(built["ctx"].queries).groupBy("cell").pivot("half", ["A", "B"]).count().na.fill(0).collect()
    assert all(0 <= r.B - r.A <= 1 for r in h)
    trials = tune.suggest({"x": (0, 1)}, 3, {"x": 0.5})
    assert trials[0] == {"x": 0.5} and trials == tune.suggest({"x": (0, 1)}, 3, {"x": 0.5})


A, B = "0" * 16, "f" * 16


@pytest.mark.parametrize(
    ("rows", "rule"),
    [
        ([("q" * 16, f"{A} {A}")], "repeated_item"), ([("q" * 16, f"{A}  {B}")], "spacing"), ([("q" * 16, "")], "spacing"), ([("q" * 16, A), ("q" * 16, B)], "repeated_query"), ([("z" * 16, A)], "unknown_query"),
        ([], "missing_query"), ([("q" * 16, "g" * 16)], "not_hex"), ([("q" * 16, "1" * 16)], "not_in_corpus"), ([("short", A)], "query_length"), ([("q" * 16, " ".join(f"{i:016x}" for i in range(51)))], "too_many"),
    ],
)
def test_answer_rules(spark, rows, rule):
    q, items = spark.createDataFrame([("q" * 16,)], "query_id string"), spark.createDataFrame([(A,), (B,)], "item_id string")
    a = spark.createDataFrame(rows, "query_id string, answer string")
    assert {r.rule: r.n for r in tables.answer_problems(a, q, items).collect()}[rule] > 0
    with pytest.raises(ValueError, match="rules"):
        tables.validate_answers(a, q, items)


def test_good_answers(spark, tmp_path):
    q, items = spark.createDataFrame([("q" * 16,)], "query_id string"), spark.createDataFrame([(A,), (B,)], "item_id string")
    a = spark.createDataFrame([("q" * 16, f"{B} {A}")], "query_id string, answer string")
    tables.write_answers(a, str(tmp_path / "a"))
    assert tables.validate_answers(tables.read_answers(spark, str(tmp_path / "a")), q, items)["mean_len"] == 2


def test_config():
    base = {"a": {"b": [1, {"c": 2}]}, "d": "x"}
    out = config.apply_overrides(base, ["a.b.1.c=[3, 4]", "e.f=true", "d=null"])
    assert out == {"a": {"b": [1, {"c": [3, 4]}]}, "d": None, "e": {"f": True}} and base["d"] == "x"
    assert config.config_key({"b": 1, "a": 2}) == config.config_key({"a": 2, "b": 1})


def test_text_branch_goes_on_with_what_reaches_the_bound(small):
    # a query went on with the k best of every location and bonus
    c, k = small[3].components, 3
    w = {"char": 1.0, "loc": 0.067, "mc": 0.012, "filter": 0.31}
    texts = fusion.text_scores(c, w)
    of = ["query_norm", "side", "item_loc"]
    sides = c.queries.select("query_id", "query_norm", "params", F.lit(False).alias("side"))
    every = fusion._group_best(texts, of, k).join(sides, ["query_norm", "side"]).count()
    assert 0 < fusion.by_texts(c, w, k, texts).count() < every / 2


def test_pruned_topk_with_unknown_places_and_a_mask(spark, small):
    it, tr, q, _ = small
    it = it.withColumn("item_location_id", F.when(F.col("item_location_id") != 2, F.col("item_location_id")))
    c = recipe.build(tr, it, q, [{"col": "item_title_raw"}], ["Type"], {"Type": 1.0}).components
    key = lambda df: sorted((r.query_id, r["rank"], r.item_id) for r in df.collect())
    for w, least in ((fusion.WEIGHTS | {"filter_agg": 0.1}, None), ({"char": 1.0, "loc": 0.067}, 0.2)):
        want = fusion.ranked(fusion.score_pairs(fusion.all_pairs(c), c, w, loc_min_p=least), 4)
        assert key(fusion.topk_linear(c, w, 4, loc_min_p=least)) == key(want)


def test_cosines_of_pairs_without_vectors_are_zero(spark, small):
    from dataclasses import replace

    q = spark.createDataFrame([("a", [3.0, 4.0]), ("b", None), ("c", [0.0, 0.0])], "query_norm string, vec array<double>")
    i = spark.createDataFrame([("x", [4.0, 3.0]), ("y", [-3.0, -4.0]), ("z", None)], "item_id string, vec array<double>")
    rows = q.select("query_norm").union(spark.createDataFrame([("d",)], "query_norm string")).crossJoin(i.select("item_id").union(spark.createDataFrame([("n",)], "item_id string")))
    got = {(r.query_norm, r.item_id): round(r.dense, 9) for r in fusion.with_dense(rows, replace(small[3].components, dense=(q, i))).collect()}
    assert len(got) == 16 and {p: d for p, d in got.items() if d} == {("a", "x"): 0.96, ("a", "y"): -1.0}
