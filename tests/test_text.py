import math

import pytest
from pyspark.sql import functions as F

from siftlode.functions import text as tx
from siftlode.operators import lexical

KEYS = ["Тип услуги автосервиса", "Вид услуги", "Тип услуги"]


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("given", "want"), [("Ремонт  Холодильников-Samsung!", "ремонт холодильников samsung"), (None, ""), ("!!!", ""), ("Ёлка 5м", "елка 5м"), ("Été café", "t caf")])
def test_normalize(spark, given, want):
    assert one(spark, given, tx.normalize) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("Тип услуги Сантехника Вид услуги Ремонт и отделка", [("Тип услуги", "Сантехника"), ("Вид услуги", "Ремонт и отделка")]),
        ("Вид услуги", [("Вид услуги", "")]),
        ("Аренда авто Вид услуги А", [("Вид услуги", "А")]),
        ("Тип услуги автосервиса Мойка Тип услуги X", [("Тип услуги автосервиса", "Мойка"), ("Тип услуги", "X")]),
        ("Тип услуги A Тип услуги B", [("Тип услуги", "A"), ("Тип услуги", "B")]),
        ("", []),
        (None, []),
    ],
)
def test_parse_filters(spark, given, want):
    assert [tuple(p) for p in one(spark, given, lambda c: tx.parse_filters(c, KEYS))] == want


def test_char_ngrams(spark):
    assert sorted(one(spark, "ab c", lambda c: tx.char_ngrams(c, 3, 5))) == sorted([" ab", "ab ", " ab ", " c "])
    assert one(spark, "", lambda c: tx.char_ngrams(c, 3, 5)) == []
    assert one(spark, "a", lambda c: tx.char_ngrams(c, 4, 5)) == [" a "]


def test_word_ngrams(spark):
    assert one(spark, "a b  c", tx.word_ngrams) == ["a", "b", "c", "a b", "b c"]
    assert one(spark, None, tx.word_ngrams) == []


GOLD = {
    "word": {"red lamp": [0.245272, 0.846140, 0.245272], "green lamp": [0, 0.131724, 0.168847]},
    "char": {"red lamp": [0.333641, 0.966429, 0.468901], "green lamp": [0, 0.248135, 0.256288]},
}


@pytest.mark.parametrize("kind", ["word", "char"])
def test_cosine(spark, kind):
    docs = spark.createDataFrame([(0, "red ring"), (1, "red red lamp"), (2, "blue lamp")], "d long, t string")
    q = spark.createDataFrame([("red lamp",), ("green lamp",)], "t string")
    got = {(r.q, r.d): r.cos for r in lexical.text_cosine(q, docs, "t", "t", "d", "t", kind).collect()}
    for text, want in GOLD[kind].items():
        assert [round(got.get((text, d), 0), 6) for d in range(3)] == pytest.approx(want, abs=1e-6)


def test_idf(spark):
    docs = spark.createDataFrame([(0, "red ring"), (1, "red red lamp"), (2, "blue lamp")], "d long, t string")
    idf = lexical.fit_idf(lexical.term_counts(docs, "d", tx.word_ngrams(F.col("t"))), 3)
    assert idf.where("term = 'lamp'").first().idf == pytest.approx(1.287682, abs=1e-6)
    assert math.log(4) + 1 == pytest.approx(2.386294, abs=1e-6)


def test_haversine(spark):
    df = spark.createDataFrame([(55.75, 37.62, 59.93, 30.31)], "a double, b double, c double, d double")
    assert df.select(tx.haversine_km(*map(F.col, "abcd")).alias("km")).first().km == pytest.approx(634.298, abs=1e-3)


def test_raw_text_and_lemmas(spark):
    df = spark.createDataFrame([(1, "Title.", None), (2, None, "abcdef")], "i long, t string, d string")
    got = [r.x for r in df.select(tx.raw_doc_text([{"col": "t"}, {"col": "d", "max_chars": 3}]).alias("x"), "i").orderBy("i").collect()]
    assert got == ["Title", "abc"]
    rows = spark.createDataFrame([(1, "cats run"), (2, ""), (3, None)], "i long, t string")
    lemmas = spark.createDataFrame([("cats", "cat")], "word string, lemma string")
    assert sorted((r.i, r.l) for r in tx.lemmatize(rows, "t", lemmas, "l", "i").collect()) == [(1, "cat run"), (2, ""), (3, "")]


@pytest.mark.parametrize("kind", ["char", "word"])
def test_summaries_of_terms_need_no_row_for_each(spark, kind):
    from siftlode.operators import lexical

    texts = ["red lamp red", "", "a", "blue blue blue ring", None, "b c b c b", "äö lämp abcdef"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    grams = lexical.ANALYZERS[kind](F.col("text"))
    got = lexical.term_summary(rows, "id", "text", kind)
    counts = lexical.term_counts(rows, "id", grams).groupBy("id").agg(F.sum("tf").alias("n"), F.count("term").alias("n_distinct"), F.min("term").alias("first"), F.max("term").alias("last"))
    assert sorted(got.collect()) == sorted(counts.collect()) and got.count() == 5
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("analyzer", ["char", "word"])
def test_cosines_weighed_where_texts_are_read(spark, monkeypatch, analyzer):
    # the terms of documents were all written, joined with their idf and dealt out by it
    docs = spark.createDataFrame([(1, "red lamp red ring"), (2, "blue lamp a"), (3, ""), (4, None), (5, "красный ring ring bolt lamp"), (6, "a")], "d long, text string")
    asked = spark.createDataFrame([("x", "red lamp lamp"), ("y", "ring unseen"), ("z", "nothing"), ("e", "")], "q string, text string")
    n, grams = docs.count(), lexical.ANALYZERS[analyzer](F.col("text"))
    counts = lexical.term_counts(docs, "d", grams)
    idf = lexical.fit_idf(counts, n)
    qw, dw = lexical.weights(lexical.term_counts(asked, "q", grams), idf, n), lexical.weights(counts, idf, n)
    of = lambda df: {(r.q, r.d): round(r.cos, 9) for r in df.collect()}
    want = of(lexical.cosine(qw, dw))
    whole = {r.id: (r.n, round(r.total, 9), round(r.top, 9)) for r in dw.groupBy("id").agg(F.count("w").alias("n"), F.sum("w").alias("total"), F.max("w").alias("top")).collect()}
    args = (asked, docs, "q", "text", "d", "text", analyzer)
    for frequent, slice_, folded in ((lexical.FREQUENT, lexical.ASKED, lexical.FOLDED), (3, 6, 4)):
        monkeypatch.setattr(lexical, "FREQUENT", frequent), monkeypatch.setattr(lexical, "ASKED", slice_), monkeypatch.setattr(lexical, "FOLDED", folded)
        got = lexical.text_cosine(*args)
        assert want and of(got) == want
        sums = lexical.document_sums(docs, "d", "text", analyzer, n).where("terms > 0").collect()
        assert {r.id: (r.terms, round(r.total / r.square**0.5, 9), round(r.top / r.square**0.5, 9)) for r in sums} == whole
        if slice_ > 6:
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "HashAggregate" not in plan


@pytest.mark.parametrize("frequent", [lexical.FREQUENT, 40])
def test_best_of_two_cosines_without_a_table_of_pairs(spark, monkeypatch, frequent):
    # all pairs of both cosines were made, joined and ranked; of terms that are not frequent, only those of the documents that may be among the best meet their idf
    import random

    from siftlode.operators import fusion

    rnd = random.Random(3)
    words = [f"{a}{b}" for a in "abcdefghij" for b in ("ring", "lamp", "x", "кот")]
    text = lambda n: " ".join(rnd.choices(words, range(1, len(words) + 1), k=n))
    own = [text(rnd.randint(1, 12)) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate([*own, *own[:9], "", None, "zz"])], "d long, text string")
    asked = spark.createDataFrame([*enumerate([*(text(4) for _ in range(6)), "", "zz", "unseen99"])], "q long, text string")
    args = ("q", "text", "d", "text")
    char, word = (lexical.text_cosine(asked, docs, *args, a) for a in ("char", "word"))
    scored = char.join(word.withColumnRenamed("cos", "cw"), ["q", "d"], "left").withColumn("score", F.col("cos") + 0.61 * F.coalesce("cw", F.lit(0.0)))
    want = sorted((r.q, r.d, round(r.score, 9)) for r in fusion.ranked(scored, 5, by="q", idx="d").collect())
    monkeypatch.setattr(lexical, "FREQUENT", frequent)
    for held, cells in ((lexical.HELD, lexical.CELLS), (3, 50)):
        monkeypatch.setattr(lexical, "HELD", held), monkeypatch.setattr(lexical, "CELLS", cells)
        made = [(lexical.source(asked, docs, *args, a), w) for a, w in (("char", 1.0), ("word", 0.61))]
        assert made[0][0].fitted.every == (frequent > 40)
        pairs = lexical.best_pairs(made, 5)
        char, word = (s.cosines(pairs) for s, _ in made)
        found = char.join(word.withColumnRenamed("cos", "cw"), ["q", "d"], "left").withColumn("score", F.col("cos") + 0.61 * F.coalesce("cw", F.lit(0.0)))
        assert want and sorted((r.q, r.d, round(r.score, 9)) for r in fusion.ranked(found, 5, by="q", idx="d").collect()) == want
        assert held == 3 or pairs.count() < scored.count() / 2


def test_text_topk_scores_only_what_may_be_among_the_best(spark, monkeypatch):
    from siftlode.plans import registry

    asked, cosines = [], lexical.Source.cosines
    monkeypatch.setattr(lexical.Source, "cosines", lambda self, pairs=None: asked.append(pairs) or cosines(self, pairs))
    assert registry.QUERIES["text_topk"](spark, "/root/testdata/sf0.001").count()
    assert len(asked) == 2 and all(p is not None for p in asked)


@pytest.mark.parametrize("analyzer", ["char", "word"])
def test_lowered_texts_are_told_apart_where_they_are_cut(spark, analyzer):
    # documents were normalised before, which took most of the time
    import pyarrow as pa

    from siftlode.plans import registry

    raw = ["Red,  LAMP--red\nЁлка ёж", "Été café 5м", "!!", None, "a中\U0001f600b", "İstanbul ß ſ", "x_y\tz"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "i long, t string").select("i", tx.lowered(F.col("t")).alias("l"), tx.normalize(F.col("t")).alias("n")).orderBy("i")
    rows, cut = df.collect(), lexical.cutter(analyzer)
    got, want = (cut(pa.array([r[c] for r in rows], pa.string())) for c in ("l", "n"))
    assert len(want[0]) and all(x.tolist() == y.tolist() for x, y in zip(got, want, strict=True))
    if analyzer == "char":
        plan = registry.QUERIES["cos_char"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "regexp_replace" not in plan and "Generate" not in plan and "Join" not in plan


def test_grams_as_numbers():
    words = ["a", "ring", "кот", "abcdefg", "aaaa", "中文字", "a😀b"]
    for low, high in ((3, 5), (2, 4), (4, 5)):
        codes, size = lexical.grams_of_words(words, low, high)
        want = [g for w in words for g in lexical.grams_of_word(w, low, high)]
        assert size.tolist() == [len(lexical.grams_of_word(w, low, high)) for w in words] and len(codes) == len(want)
        begin = 0
        numbers = {}
        for w, n in zip(words, size.tolist(), strict=True):
            # a word's own numbers, in whatever order
            assert sorted({c: codes[begin : begin + n].tolist().count(c) for c in codes[begin : begin + n].tolist()}.values()) == sorted({g: lexical.grams_of_word(w, low, high).count(g) for g in lexical.grams_of_word(w, low, high)}.values())
            numbers[w] = set(codes[begin : begin + n].tolist())
            begin += n
        assert len(set(codes.tolist())) == len(set(want))
