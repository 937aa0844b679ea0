"""Models, channels, caches, reports and other parts that no SQL expresses, on small rows."""

import json
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlode.functions.ship import ship
from siftlode.operators import dense, eda, fusion, history, lexical, pool, priors, ranker, splits, tune
from siftlode.plans import recipe
from siftlode.sources import config, reports, tables

ship(__name__)


@pytest.fixture(scope="module")
def pairs(spark):
    """Queries with pools of items of which a feature tells the relevant ones, with noise."""
    rnd = random.Random(1)
    rows = []
    for q in range(40):
        for i in range(12):
            y = int(rnd.random() < 0.25)
            rows.append((f"q{q}", f"i{i:02d}", y, y + rnd.gauss(0, 0.4), rnd.random()))
    rows += [("none", f"i{i:02d}", 0, 5.0, 0.0) for i in range(5)]
    return spark.createDataFrame(rows, "query_id string, item_id string, label int, good double, noise double")


FEATURES = ("good", "noise")


def auc(rows):
    pos, neg = [r.prediction for r in rows if r.label], [r.prediction for r in rows if not r.label]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)


def test_ranker_learns_and_reruns_agree(pairs):
    train, test = pairs.where("query_id < 'q3'"), pairs.where("query_id >= 'q3'")
    m = ranker.fit(train, FEATURES, trees=15)
    got = ranker.predict(m, test, FEATURES).collect()
    assert auc(got) > 0.85 and all(0 <= r.prediction <= 1 for r in got)
    again = ranker.predict(ranker.fit(train.repartition(7), FEATURES, trees=15), test, FEATURES).collect()
    key = lambda rows: sorted((r.query_id, r.item_id, r.prediction) for r in rows)
    assert key(got) == key(again)
    names = ranker.importance([m], FEATURES)
    assert [n for n, _ in names] == ["good", "noise"] and sum(x for _, x in names) == pytest.approx(1)
    # a query without a relevant item does not take part
    same = ranker.fit(train.where("query_id <> 'none'"), FEATURES, trees=15)
    assert key(ranker.predict(same, test, FEATURES).collect()) == key(got)


def test_cross_fit_predicts_each_half_by_the_other(pairs):
    folds = pairs.where("query_id <> 'none'").select("query_id").distinct().withColumn("half", F.when(F.crc32("query_id") % 2 == 0, "A").otherwise("B"))
    out, models = ranker.cross_fit(pairs, folds, FEATURES, trees=8)
    rows = out.collect()
    assert len(models) == 2 and len(rows) == 480 and auc(rows) > 0.85 and "half" not in out.columns
    a = folds.where("half = 'A'").select("query_id")
    alone = ranker.predict(ranker.fit(pairs.join(a, "query_id"), FEATURES, trees=8), pairs.join(folds.where("half = 'B'").select("query_id"), "query_id"), FEATURES)
    b = {(r.query_id, r.item_id): r.prediction for r in alone.collect()}
    assert b and all(b[r.query_id, r.item_id] == r.prediction for r in rows if (r.query_id, r.item_id) in b)
    moved = ranker.transfer(pairs.where("query_id < 'q2'"), pairs.where("query_id >= 'q2'"), FEATURES, trees=8).collect()
    assert auc(moved) > 0.85


def test_channels_labels_and_dropped_features(spark, pairs):
    final = {"char": 1.0}
    assert pool.channel_weights({"final": "final", "word": {"word": 1.0}, "old": "skip"}, final) == {"final": final, "word": {"word": 1.0}}
    rel = spark.createDataFrame([("q1", "i03"), ("q1", "i03"), ("q9", "zz")], "query_id string, item_id string")
    got = pool.labelled(pairs.drop("label"), rel)
    assert [(r.query_id, r.item_id) for r in got.where("label = 1").collect()] == [("q1", "i03")] and got.count() == pairs.count()
    assert pool.drop_features(got, ("noise", "absent")).columns == ["query_id", "item_id", "good", "label"]


class Letters:
    """Counts of letters stand for a model."""

    def __init__(self):
        self.seen = 0

    def encode(self, texts):
        return np.array([[t.count(c) for c in "abcde"] for t in texts], float)


def test_encoder_prefixes_and_cached_vectors(spark, tmp_path):
    rows = spark.createDataFrame([(1, "aab"), (2, None), (3, "cc")], "id int, text string")
    got = {r.id: r.embedding for r in dense.encode(rows, "text", Letters(), "ad").collect()}
    assert got[1] == pytest.approx([3 / 11**0.5, 1 / 11**0.5, 0, 1 / 11**0.5, 0]) and got[2] == pytest.approx([0.5**0.5, 0, 0, 0.5**0.5, 0])
    make = lambda: dense.cached_vectors(spark, f"file://{tmp_path}/v", {"model": "letters", "stamp": 1}, rows, "text", Letters(), "ad")
    first = sorted(make().collect())
    files = sorted(p.name for p in (tmp_path / "v").rglob("*.parquet"))
    assert sorted(make().collect()) == first and sorted(p.name for p in (tmp_path / "v").rglob("*.parquet")) == files
    clicks = spark.createDataFrame([("a", "x"), ("a", "w"), ("b", "y"), ("c", None)], "item_id string, item_title_raw string")
    items = spark.createDataFrame([("a", "corpus"), ("z", "unclicked")], "item_id string, item_title_raw string")
    assert sorted(tuple(r) for r in dense.train_item_texts(clicks, items).collect()) == [("a", "corpus"), ("b", "y"), ("c", "")]


def vectors(spark, n, seed, groups=3):
    rnd = np.random.default_rng(seed)
    x = rnd.standard_normal((n, 8))
    rows = [(i, [float(v) for v in x[i]], i % groups) for i in range(n)] + [(n, None, 0), (n + 1, [0.0] * 8, 0), (n + 2, [1.0] * 8, None), (n + 3, list(map(float, x[0])), 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def unit(v):
    v = np.array(v)
    return v / np.sqrt(v @ v)


@pytest.mark.parametrize("rows", [4096, 7])
def test_nearest_items_against_all_pairs(spark, rows):
    data, df = vectors(spark, 90, 3)
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in dense.topk(df.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id"), df, 4, item_id="vec_id", query_rows=rows).collect())
    live = [(i, unit(v)) for i, v, _ in data if v is not None and any(v)]
    want = []
    for q, v in live:
        if q % 5 == 0:
            best = sorted(((-round(float(v @ u), 5), i) for i, u in live))[:4]
            want += [(q, k + 1, i) for k, (_, i) in enumerate(best)]
    assert got == sorted(want)
    assert dense.topk(df.limit(0).withColumnRenamed("vec_id", "query_id"), df, 4, item_id="vec_id").collect() == []


@pytest.mark.parametrize("tile", [4096, 9])
def test_neighbours_against_all_pairs(spark, tile):
    data, df = vectors(spark, 100, 5)
    got = sorted((r.vec_id, r.r, r.other) for r in dense.knn(df, 5, 0.2, tile=tile).collect())
    live = [(i, unit(v), g) for i, v, g in data if v is not None and any(v) and g is not None]
    want = []
    for i, v, g in live:
        best = sorted(((-round(float(v @ u), 5), j, float(v @ u)) for j, u, h in live if h == g and j != i))[:5]
        want += [(i, k + 1, j) for k, (_, j, s) in enumerate(best) if s >= 0.2]
    assert got == sorted(want)


@pytest.mark.parametrize("match", ["pair", "value"])
def test_filter_bonus_against_all_pairs(spark, match):
    rnd = random.Random(7)
    values = ["", "a", "ab", "long value", "long value two", "Brand#1", "Brand#12", "A B"]
    params = [f"Type {rnd.choice(values)} Brand {rnd.choice(values)}" for _ in range(40)] + [None, "", "Size 3"]
    items = [f"xType {rnd.choice(values)} Brand {rnd.choice(values)} end" for _ in range(60)] + ["", "Brand"]
    df = lambda rows, name: spark.createDataFrame([(x,) for x in rows], f"{name} string")
    got = {(r.params, r.item_params): (round(r.bonus, 6), r.hits) for r in priors.filter_bonus(df(params, "params"), df(items, "item_params"), ("Type", "Brand"), {"Type": 0.7, "Brand": 0.3}, match).collect()}
    want = {}
    for p in set(filter(None, params)):
        parts = dict(zip(("Type", "Brand"), map(str.strip, p.removeprefix("Type ").split("Brand ", 1)), strict=False)) if p.startswith("Type") else {}
        for i in set(items):
            hits = sorted(k for k, v in parts.items() if v and (f"{k} {v}" if match == "pair" else v) in i)
            if hits:
                want[p, i] = (round(sum({"Type": 0.7, "Brand": 0.3}[k] for k in hits), 6), hits)
    assert len(got) > 100
    assert {k: v for k, v in got.items() if k[0].count("Brand") == 1} == {k: v for k, v in want.items() if k[0].count("Brand") == 1}


@pytest.fixture(scope="module")
def small(spark):
    """A corpus with vectors, some of them absent, whose cosines are negative as often as not."""
    rnd = random.Random(9)
    words = ["red", "blue", "small", "lamp", "ring", "bolt", "gear"]
    items = [(f"{i:016x}", " ".join(rnd.sample(words, 2)), f"Type t{i % 3}", None, i % 4, f"t{i % 3}", None, None, float(i)) for i in range(70)]
    it = spark.createDataFrame(items, "item_id string, item_title_raw string, item_infm_params_text string, item_description_raw string, item_location_id int, item_microcat_id string, item_latitude double, item_longitude double, item_price double")
    train = [(" ".join(rnd.sample(words, 2)), rnd.randrange(5), "", 0, 0, items[j][0], rnd.randrange(4), items[j][5]) for j in (rnd.randrange(70) for _ in range(300))]
    tr = spark.createDataFrame(train, "search_query string, search_location_id int, search_infm_params_text string, search_is_delivery_search int, search_category int, item_id string, item_location_id int, item_microcat_id string").withColumn("query_norm", F.col("search_query"))
    q = spark.createDataFrame([(f"q{i}", " ".join(rnd.sample(words, 2)) if i else "unknown", i % 6, f"Type t{i % 3}" if i % 2 else None) for i in range(9)], "query_id string, query_norm string, search_location_id int, search_infm_params_text string").withColumn("search_query", F.col("query_norm"))
    vec = lambda: [rnd.gauss(0, 1) for _ in range(6)]
    qv = spark.createDataFrame([(t, vec()) for t in sorted({r.query_norm for r in q.collect()})[1:]], "query_norm string, vec array<double>")
    iv = spark.createDataFrame([(r[0], vec()) for r in items[3:]] + [(items[0][0], [0.0] * 6)], "item_id string, vec array<double>")
    fields = [{"col": "item_title_raw"}]
    extra = {"title": ("char", it.select("item_id", F.col("item_title_raw").alias("text"))), "clicks": ("word", history.expansion_texts(tr, it).withColumnRenamed("expansion", "text"))}
    return it, tr, q, recipe.build(tr, it, q, fields, ["Type"], {"Type": 1.0}, vectors=(qv, iv), sources=extra).components


KEY = lambda df: sorted((r.query_id, r["rank"], r.item_id) for r in df.collect())


@pytest.mark.parametrize("k", [1, 4, 25])
@pytest.mark.parametrize("least", [None, 0.2])
@pytest.mark.parametrize("weights", [fusion.WEIGHTS, {"dense": 2.0, "loc": 0.1, "dense_agg": 0.5}, {"char": 0.1, "title": 0.4, "clicks": 0.3, "dense": 0.5, "mc": 0.2}, {"loc": 0.067}])
def test_pruned_topk_is_that_of_all_pairs(small, k, least, weights):
    c = small[3]
    want = fusion.ranked(fusion.score_pairs(fusion.all_pairs(c), c, weights, loc_min_p=least), k)
    assert KEY(fusion.topk_linear(c, weights, k, loc_min_p=least)) == KEY(want)


def test_slices_of_contexts_change_nothing(small, monkeypatch):
    c = small[3]
    want = KEY(fusion.topk_linear(c, fusion.WEIGHTS, 5))
    monkeypatch.setattr(fusion.by_priors_and_vectors, "__defaults__", (*fusion.by_priors_and_vectors.__defaults__[:-1], 2))
    monkeypatch.setattr(fusion, "BLOCK", 8)
    assert KEY(fusion.topk_linear(c, fusion.WEIGHTS, 5)) == want


@pytest.mark.parametrize("weights", [fusion.WEIGHTS, {"char": 1.0, "mc": 0.1, "char_agg": 0.3, "loc": 0.067, "filter": 0.31}, {"dense": 1.0, "loc": 0.1, "filter": 0.5}, {"loc": 0.1, "mc": 0.2, "filter": 0.1}])
def test_what_goes_on_does_not_grow_with_the_corpus(spark, small, weights):
    """Eight copies of each item: the same rows as of all pairs, and no query meets more than its groups' best."""
    c, n, k = small[3], 8, 5
    copies = spark.range(n).select(F.col("id").alias("copy"))
    name = F.concat("item_id", F.lit("-"), "copy").alias("item_id")
    rest = lambda df: df.crossJoin(copies).select(name, *[x for x in df.columns if x not in ("item_id", "idx")], *([name.alias("idx")] if "idx" in df.columns else []))
    big = replace(c, items=rest(c.items), texts={t: rest(df) for t, df in c.texts.items()}, pairs={}, dense=(c.dense[0], rest(c.dense[1])))
    want = fusion.ranked(fusion.score_pairs(fusion.all_pairs(big), big, weights), k)
    assert KEY(fusion.topk_linear(big, weights, k)) == KEY(want)
    texts = fusion.text_scores(big, weights)
    if texts is not None:
        per_query = fusion.by_texts(big, weights, k, texts).groupBy("query_id").count().agg(F.max("count")).first()[0]
        # four locations, with and without a bonus; ties are the copies of the last
        assert per_query <= 2 * 4 * (k - 1 + n)


def test_totals_are_those_of_all_pairs(small):
    c = small[3]
    every = fusion.score_pairs(fusion.all_pairs(c), c, fusion.WEIGHTS).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"))
    want = {r.query_id: (r.n, r.total) for r in every.collect()}
    got = {r.query_id: (r.n, r.total) for r in fusion.totals(c, fusion.WEIGHTS).collect()}
    assert {k: n for k, (n, _) in got.items()} == {k: n for k, (n, _) in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_new_parameters_of_the_priors(small):
    """Weights and epsilons are arguments: what a scorer would set anew."""
    c = small[3]
    for eps in (1e-3, 0.5):
        rows = fusion.score_pairs(fusion.all_pairs(c), c, {"loc": 2.0}, loc_eps=eps).collect()
        assert len(rows) == 9 * 70 and all(r.score == pytest.approx(2 * np.log(r.loc_p + eps)) for r in rows)


def test_cached_cosines_are_read(spark, small, tmp_path):
    it, tr, q, _ = small
    make = lambda: recipe.build(tr, it, q, [{"col": "item_title_raw"}], ["Type"], {"Type": 1.0}, cache=(f"file://{tmp_path}", {"data": 1})).components.texts["char"]
    first = sorted(map(str, make().collect()))
    files = sorted(map(str, tmp_path.rglob("*.parquet")))
    assert sorted(map(str, make().collect())) == first and sorted(map(str, tmp_path.rglob("*.parquet"))) == files and len(list(tmp_path.iterdir())) == 2


def test_lexical_weights_against_a_plain_loop(spark):
    rnd = random.Random(2)
    texts = [(i, " ".join(rnd.choice("abcdefg") * rnd.randrange(1, 3) for _ in range(rnd.randrange(9)))) for i in range(40)]
    asks = [("x", "a bb c"), ("y", "zz zz"), ("z", "")]
    grams = lambda t: [" ".join(w[i : i + n]) for w in [t.split()] for n in (1, 2) for i in range(len(w) - n + 1)]
    n = len(texts)
    df = {}
    for _, t in texts:
        for g in set(grams(t)):
            df[g] = df.get(g, 0) + 1

    def weigh(t, unseen):
        w = {g: (1 + np.log(grams(t).count(g))) * (np.log((1 + n) / (1 + df.get(g, 0))) + 1) for g in set(grams(t)) if unseen or g in df}
        length = sum(x * x for x in w.values()) ** 0.5
        return {g: x / length for g, x in w.items()}

    want = {}
    for q, t in asks:
        for d, u in texts:
            a, b = weigh(t, True), weigh(u, True)
            if set(a) & set(b):
                want[q, d] = sum(a[g] * b[g] for g in set(a) & set(b))
    got = lexical.text_cosine(spark.createDataFrame(asks, "q string, t string"), spark.createDataFrame(texts, "d int, t string"), "q", "t", "d", "t", "word")
    assert {(r.q, r.d): r.cos for r in got.collect()} == pytest.approx(want)


def test_splits_are_kept_and_subset(spark, small, tmp_path):
    it, tr, *_ = small
    built = splits.build(tr, it, 6, 4)
    tables.save_splits(built, f"file://{tmp_path}/s")
    for name, s in built.items():
        again = tables.load_split(spark, f"file://{tmp_path}/s", name)
        assert all(splits.digest(getattr(again, p)) == splits.digest(getattr(s, p)) for p in ("queries", "rel", "rest"))
    s = built["ctx"]
    assert tables.query_set(tr, it, s) == (s.queries, s.rest) and tables.query_set(tr, it) == (it, tr)
    part = splits.subset(s, s.queries.orderBy("query_id").limit(3))
    assert part.queries.count() == 3 and part.rest is s.rest
    assert {r.query_id for r in part.rel.collect()} <= {r.query_id for r in part.queries.collect()}


def test_tuning_finds_the_telling_term(spark, small):
    it, tr, *_ = small
    s = splits.build(tr, it, 8, 6)["ctx"]
    rel = s.rel.withColumn("y", F.lit(1.0)).select("query_id", "item_id", "y")
    terms = s.queries.select("query_id").crossJoin(it.select("item_id", F.col("item_id").alias("idx"))).join(rel, ["query_id", "item_id"], "left").withColumn("good", F.coalesce("y", F.lit(0.0))).withColumn("bad", 1 - F.col("good")).drop("y")
    trials = [{"good": 0.0, "bad": 1.0}, {"good": 1.0, "bad": 0.0}]
    assert tune.score_params(terms, ["good", "bad"], trials[1], s.queries, s.rel, 20) == 1.0
    found = tune.search(terms, ["good", "bad"], trials, s.queries, s.rel, 20)
    assert found[0][0] == trials[1] and found[0][1] > found[1][1]
    halves = splits.halves(s.queries)
    out = tune.tune_and_check(terms, ["good", "bad"], trials, halves, s.rel, 20)
    assert out["best"] == trials[1] and out["half_a"] == 1.0 == out["half_b"]["best"] > out["half_b"]["base"]


def test_tables_are_read_and_described(spark, tmp_path):
    spark.createDataFrame([(7, 1, "1.50")], "item_id long, x int, p string").withColumn("p", F.col("p").cast("decimal(8,2)")).write.parquet(f"{tmp_path}/t")
    df = tables.read_table(spark, f"{tmp_path}/t", ["item_id", "p"])
    assert df.dtypes == [("item_id", "string"), ("p", "double")] and tuple(df.first()) == ("7", 1.5)
    q = spark.createDataFrame([("q" * 16, 1)], "query_id string, search_location_id int")
    items = spark.createDataFrame([("0" * 16, 1), ("0" * 16, 2)], "item_id string, item_location_id int")
    train = spark.createDataFrame([("0" * 16, 1, 1)], "item_id string, search_location_id int, item_location_id long")
    bad = tables.describe({"train": train, "queries": q, "items": items}, {"train": 1, "items": 3})
    assert len(bad) == 3 and "items: 2 rows, not 3" in bad


def test_configuration_file(tmp_path):
    (tmp_path / "c.yaml").write_text('{"a": {"b": 1}}')
    assert config.apply_overrides(config.load_config(str(tmp_path / "c.yaml")), ["a.b=2"]) == {"a": {"b": 2}}


def test_facts_prefixes_and_reports(spark, tmp_path):
    facts = [eda.Fact("n", 100, 101, abs_tol=1), eda.Fact("share", 0.5, 0.6, rel_tol=0.1)]
    assert [f.ok for f in facts] == [True, False]
    t = spark.createDataFrame([("Type a",), ("Other",), ("",), (None,), ("Brand b",)], "search_infm_params_text string")
    assert eda.unknown_prefix_share(t, ("Type", "Brand")).first()[0] == pytest.approx(1 / 3)
    reports.write(str(tmp_path / "r"), "Title", {"rows": spark.createDataFrame([(1, "a|b", 0.5)], "n int, s string, x double"), "none": []}, facts)
    text = (tmp_path / "r.md").read_text()
    assert "| 1 | a\\|b | 0.5000 |" in text and "| share | 0.5000 | 0.6000 | False |" in text
    assert [f["ok"] for f in json.loads((tmp_path / "r.json").read_text())["facts"]] == [True, False]
    with pytest.raises(ValueError, match="rows"):
        reports.table(spark.range(reports.MOST + 1))
