import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftlode.llm import simhash, verify

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def slow_set(text):
    w = (text or "").lower().split()
    return frozenset(" ".join(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([" ".join(w)] if w else [])


def slow_components(rows):
    """The least id of each row's component, by all pairs."""
    sets = [slow_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                up[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [least.get(find(i)) for i in range(len(rows))]


def edited(rnd, words, n):
    """``words`` with ``n`` of them replaced."""
    w = list(words)
    for i in rnd.sample(range(len(w)), n):
        w[i] = f"other{rnd.random()}"
    return w


def corpus(rnd):
    line = [f"line{i}" for i in range(15)]  # a passage that most documents hold
    texts = []
    for _ in range(50):
        t = [f"w{rnd.randrange(400)}" for _ in range(rnd.randint(3, 120))] + (line if rnd.random() < 0.7 else [])
        texts.append(t)
        for n in rnd.sample(range(8), 3):
            texts.append(edited(rnd, t, min(n, len(t))))
    hub = [f"hub{i}" for i in range(200)]
    texts += [edited(rnd, hub, rnd.randint(0, 5)) for _ in range(120)]  # one large group of near copies
    rows = [(3 * i, " ".join(t)) for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    return [*rows, (1, None), (2, " \t"), (None, rows[0][1].upper()), (None, "nobody else"), (rows[1][0], rows[1][1]), (4, "one two"), (5, "One  two")]


def recall(rows, got):
    """Share of the pairs of one component by all pairs that are together in ``got`` too; and that no other pair is."""
    want = slow_components(rows)
    both = together = 0
    for i in range(len(rows)):
        for j in range(i):
            if want[i] == want[j]:
                both += 1
                together += got[i] == got[j]
            else:
                assert got[i] != got[j] or got[i] is None
    return together / both


@pytest.mark.parametrize("members", [1024, 40])
def test_components_against_all_pairs(spark, members, monkeypatch):
    monkeypatch.setattr(verify.verified_links, "__defaults__", (verify.SIMILAR, members, verify.SHINGLES))
    rows = corpus(random.Random(3))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("t", F.lit(1)).withColumn("root", F.lit("clash"))
    found = {}
    for r in simhash.similar_documents(docs).collect():
        found.setdefault(r.doc_id, []).append(r.component_id)
    assert sum(map(len, found.values())) == len(rows)
    got = [found[k].pop(0) if len(set(found[k])) == 1 or k is None else found[k][0] for k, _ in rows]
    named = [i for i, (k, _) in enumerate(rows) if k is not None]
    assert recall([rows[i] for i in named], [got[i] for i in named]) >= 0.97


def test_verified_links_are_those_of_all_pairs(spark):
    """Groups in one task and in many, with members that only one other is like, and empty and equal sets."""
    rnd = random.Random(5)
    sets = []
    for root, n in ((1, 12), (2, 90)):
        base = [rnd.getrandbits(62) for _ in range(60)]
        for _ in range(n):
            sets.append((root, sorted({*base[rnd.randrange(8) :], *(rnd.getrandbits(62) for _ in range(rnd.randrange(9)))})))
        for _ in range(6):
            odd = [rnd.getrandbits(62) for _ in range(40)]
            sets += [(root, sorted(odd)), (root, sorted(odd[2:]))]
    sets += [(1, []), (1, []), (2, [])]
    rows = [(root, t, rnd.getrandbits(62), own) for t, (root, own) in enumerate(sets)]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (r, s) in enumerate(sets):
        for j in range(i):
            if r == sets[j][0] and 5 * len(set(s) & set(sets[j][1])) >= 4 * len({*s, *sets[j][1]}):
                up[max(find(i), find(j))] = min(find(i), find(j))
    df = spark.createDataFrame(rows, "root long, t long, fp long, own array<long>")
    for members, shingles in ((1024, 10**9), (20, 10**9), (7, 10**9), (1024, 2000)):
        links = verify.verified_links(df, members=members, shingles=shingles).collect()
        mine = list(range(len(rows)))

        def own(i, mine=mine):
            while mine[i] != i:
                i = mine[i]
            return i

        for u, v in links:
            mine[max(own(u), own(v))] = min(own(u), own(v))
        assert [own(i) for i in range(len(rows))] == [find(i) for i in range(len(rows))]


def test_the_pipeline_takes_copies_at_a_similarity_of_0_8(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(40):
        t = [f"w{rnd.randrange(3000)}" for _ in range(100)]
        rows += [(10 * i + 1, " ".join(t)), (10 * i + 2, " ".join(edited(rnd, t, 1))), (10 * i + 3, " ".join(edited(rnd, t, 2)))]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], SCHEMA)
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert kept.columns == docs.columns
    want = {k for (k, _), least in zip(rows, slow_components(rows), strict=True) if k == least}
    assert len(want) < 60  # most copies are of 0.8 or more
    left = {r.doc_id for r in kept.collect()}
    assert want <= left and len(left - want) <= 2


def test_recall_of_pairs_just_similar_enough(spark):
    """Pairs alone in their group, at a similarity of 0.8 to 0.85: the hardest."""
    rnd = random.Random(12)
    rows = []
    for i in range(400):
        t = [f"w{rnd.randrange(4000)}" for _ in range(rnd.randint(60, 300))]
        n = max(1, round(len(t) * 0.019))
        rows += [(2 * i, " ".join(t)), (2 * i + 1, " ".join(edited(rnd, t, n)))]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = slow_components(rows)
    pairs = [i for i in range(400) if want[2 * i] == want[2 * i + 1]]
    assert len(pairs) > 150
    assert sum(got[2 * i] == got[2 * i + 1] for i in pairs) >= 0.93 * len(pairs)
    assert all(got[2 * i] != got[2 * i + 1] for i in range(400) if i not in set(pairs))


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.similar_documents(empty).collect() == []
    assert simhash.drop_similar(empty).collect() == []
