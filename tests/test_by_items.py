import random

import pyarrow as pa
from pyspark.sql import functions as F

from siftlode.operators import fusion, lexical
from siftlode.plans import recipe


def parts(spark):
    rnd = random.Random(5)
    words = ["red", "blue", "small", "lamp", "ring", "bolt"]
    items = [(f"{i:016x}", " ".join(rnd.sample(words, 2)), f"Type t{i % 3}", i % 4, f"t{i % 3}") for i in range(40)]
    it = spark.createDataFrame(items, "item_id string, item_title_raw string, item_infm_params_text string, item_location_id int, item_microcat_id string")
    it = it.withColumns({"item_latitude": F.lit(1.0), "item_longitude": F.lit(2.0)})
    clicks = [(rnd.choice(words), rnd.randrange(4), *rnd.choice(items)[::4], rnd.randrange(4)) for _ in range(60)]
    tr = spark.createDataFrame([(q, a, i, f"t{int(i, 16) % 3}", b) for q, a, i, _, b in clicks], "query_norm string, search_location_id int, item_id string, item_microcat_id string, item_location_id int")
    tr = tr.withColumn("in_corpus", F.lit(True))
    q = spark.createDataFrame([(f"q{i}", rnd.choice(words), i % 4, f"Type t{i % 3}" if i % 2 else "") for i in range(7)], "query_id string, query_norm string, search_location_id int, search_infm_params_text string")
    vec = lambda: [rnd.uniform(-1, 1) for _ in range(3)]
    qv = spark.createDataFrame([(w, vec()) for w in words], "query_norm string, vec array<double>")
    iv = spark.createDataFrame([(i[0], vec()) for i in items], "item_id string, vec array<double>")
    return recipe.build(tr, it, q, [{"col": "item_title_raw"}], ["Type"], {"Type": 1.0}, vectors=(qv, iv)).components


def test_rankings_make_no_table_of_pairs(spark):
    c = parts(spark)
    w = fusion.WEIGHTS
    got = fusion.by_items(c, [w, {"char": 1.0}], 5, contexts=3)
    made = {at: sorted((r.query_id, r.item_id, round(r.score, 9)) for r in got.where(F.col("channel") == at).collect()) for at in (0, 1)}
    # neither this ranking nor what explains it has met all texts with all items
    fusion.explain(fusion.topk_linear(c, w, 5), c, w).collect()
    assert not c.texts._tables
    for at, weights in enumerate((w, {"char": 1.0})):
        want = fusion.ranked(fusion.score_pairs(fusion.all_pairs(c), c, weights), 5)
        assert made[at] == sorted((r.query_id, r.item_id, round(r.score, 9)) for r in want.collect())


def test_texts_are_cut_together():
    cut = lexical.cutter("char")
    texts = ["red ring red", None, "", "blue", "ring"]
    row, term, tf = cut(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        alone = cut(pa.array([t], pa.string()))
        assert (term[row == i].tolist(), tf[row == i].tolist()) == (alone[1].tolist(), alone[2].tolist())
    assert sorted(tf[row == 0].tolist()) == [1] * len(lexical.grams_of_word("ring", 3, 5)) + [2] * len(lexical.grams_of_word("red", 3, 5))


def test_words_are_counted_where_they_are_read(spark, monkeypatch):
    from siftlode.functions import text as tx

    rows = spark.createDataFrame([(1, "red ring red ring"), (2, None), (3, ""), (4, "ring red"), (5, "red")], "doc_id long, text string")
    want = {r.term: r.df for r in lexical.fit_idf(lexical.document_terms(rows, "doc_id", tx.word_ngrams(F.col("text"))), 5).collect()}
    for folded in (lexical.FOLDED, 1):
        monkeypatch.setattr(lexical, "FOLDED", folded)
        assert {r.term: r.df for r in lexical.word_frequencies(rows, "doc_id", "text").collect()} == want
    assert want["red ring"] == 1 and want["ring red"] == 2


def test_neighbours_are_found_a_few_vectors_at_a_time(spark, monkeypatch):
    from siftlode.operators import dense

    rnd = random.Random(1)
    v = spark.createDataFrame([(i, i % 2, [rnd.uniform(-1, 1) for _ in range(4)]) for i in range(15)], "vec_id long, label int, embedding array<double>")
    found = lambda: sorted((r.vec_id, r.other, r.r) for r in dense.knn(v, 3, -1.0).collect())
    want = found()
    monkeypatch.setattr(dense, "KNN_ROWS", 2)
    assert found() == want
