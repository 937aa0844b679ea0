import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siftlode.llm import common, components, simhash

SCHEMA = "doc_id long, text string"


def slow_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def classes(n, pairs):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "One TWO x  three", "a b c d", "É é a B\x0bc\x0cd e " * 9000, "x " * 70_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_spark_hash_agrees(spark):
    got = spark.sql("select hex(xxhash64('a b c d')) h").first()["h"]
    assert got.lower() == xxhash.xxh64_hexdigest(b"a b c d", seed=42)


@pytest.mark.parametrize(("key_rows", "run"), [(65_536, 2_000_000), (50, 3_000)])
def test_links_are_those_of_brute_force(spark, key_rows, run):
    rnd = random.Random(5)
    fps = {rnd.getrandbits(64) for _ in range(120)} | {0, 2**64 - 1}
    for x in list(fps)[:40]:
        for k in (1, 2, 3, 4, 4, 5, 6):
            y = x
            for b in rnd.sample(range(64), k):
                y ^= 1 << b
            fps.add(y)
    hub = rnd.getrandbits(64)
    for _ in range(150):  # one dense clump
        fps.add(hub ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 3))))
    fps = sorted(fps)
    signed = lambda x: int(np.uint64(x).astype(np.int64))
    codes = {0: fps, 3: fps[::2]}
    df = spark.createDataFrame([(c, signed(x)) for c, own in codes.items() for x in own], "code int, fp long")
    links = simhash.ball_links(df, key_rows=key_rows, run=run).collect()
    for c, own in codes.items():
        pairs = [(i, j) for i in range(len(own)) for j in range(i) if (own[i] ^ own[j]).bit_count() <= 4]
        at = {signed(x): i for i, x in enumerate(own)}
        assert classes(len(own), [(at[r.u], at[r.v]) for r in links if r.code == c]) == classes(len(own), pairs)


@pytest.mark.parametrize("most", [2_000, 40_000])
def test_a_key_is_dealt_out_in_its_task(most):
    rng = np.random.default_rng(3)
    fp = np.unique(np.r_[rng.integers(0, 1 << 56, 60, np.uint64), rng.integers(0, 1 << 9, 200, np.uint64)]) | np.uint64(7 << 56)
    left = rng.integers(0, 3, len(fp)).astype(np.int32)

    def having(key, left, fp, bits):  # of each variant, the rows that have it
        out = {}
        for k, n, x in zip(key.tolist(), left.tolist(), fp.tolist(), strict=True):
            for m, _ in simhash._flips(bits, n):
                out.setdefault(k << bits | (x & ((1 << bits) - 1)) ^ m, set()).add(x)
        return out

    want = having(np.full(len(fp), 7, np.uint64), left, fp, 56)
    pieces = [having(*x) for x in simhash._dealt(np.full(len(fp), 7, np.uint64), left, fp, 56, 4, most)]
    assert len(pieces) > 1 and sum(map(len, pieces)) == len(want)
    assert {v: rows for p in pieces for v, rows in p.items()} == want
    assert all(sum(map(len, p.values())) <= most for p in pieces)


@pytest.mark.parametrize("links", [simhash.LINKS, 40, 0])
def test_a_task_gives_one_forest_a_code(spark, links):
    """One clump of two codes in one task: however many runs and pieces it takes, a fingerprint has one link, or few where the
    task lets go of links early; what is connected stays."""
    rnd = random.Random(11)
    fps = sorted({0x5A5A << 40 | sum(1 << b for b in rnd.sample(range(64), rnd.randrange(3))) for _ in range(150)})
    signed = [(c, f - 2**64 if f >= 2**63 else f) for c in (0, 1) for f in fps]
    rows = simhash._keyed(spark.createDataFrame(signed, "code int, fp long"), 4)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        found = simhash._meet(rows, 56, 4, 3000, links).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    at = {f: i for i, (_, f) in enumerate(signed[: len(fps)])}
    want = classes(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    for code in (0, 1):
        own = [(at[r.u], at[r.v]) for r in found if r.code == code]
        assert classes(len(fps), own) == want
        assert links != simhash.LINKS or len(own) == len(fps) - len(set(want))


def test_keys_that_a_task_holds_are_not_dealt_out_in_the_shuffle(spark, monkeypatch):
    def deeper(*_):
        raise AssertionError("each fingerprint would be shuffled 137 times instead of 37")

    monkeypatch.setattr(simhash, "_deeper", deeper)
    simhash.ball_links(spark.range(70_000).select(F.lit(0).alias("code"), F.xxhash64("id").bitwiseAND(F.lit((1 << 56) - 1)).alias("fp")))


def test_near_duplicates(spark):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(60):
        t = [rnd.choice(words) for _ in range(300)]
        rows.append((3 * i, " ".join(t)))
        if i % 3 == 0:
            rows.append((3 * i + 1, " ".join(t).upper().replace("W", "w ") if i % 2 else "\n".join(t).upper()))
            t[rnd.randrange(300)] = "other"
            rows.append((3 * i + 2, "  ".join(t)))
    rows += [(900, None), (901, ""), (None, rows[0][1]), (0, rows[0][1]), (902, "two words")]
    got = {(r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    fps = [slow_fingerprint(t) for _, t in rows]
    cls = classes(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    least = {c: min(r[0] for r, k in zip(rows, cls, strict=True) if k == c and r[0] is not None) for c in set(cls)}
    assert got == {(r[0], f, least[c]) for r, f, c in zip(rows, fps, cls, strict=True)}


def test_one_document_stays(spark):
    rows = [(5, "a b c d e", 1), (2, "a b c d e", 2), (2, "a b c d e", 3), (7, "p q r s t u", 4), (None, "x y z v w", 5), (8, None, 6), (9, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int").withColumn("__id", F.lit(1))
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or -1 for r in out.collect())) == [-1, 2, 7, 8]


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.drop_near_duplicates(empty).collect() == []


def test_components_of_a_chain_a_star_and_a_clique(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(i, j) for i in range(200, 212) for j in range(200, i)] + [(1, 1), (None, 3)]
    out = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    groups = {}
    for n, r in out.items():
        groups.setdefault(r, set()).add(n)
    assert sorted(map(sorted, groups.values())) == [list(range(7, 60)), list(range(100, 161)), list(range(200, 212))]
    assert all(r in g for r, g in groups.items())
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


@pytest.mark.parametrize("last_links", [0, 60, 500_000])
def test_components_in_rounds_and_finished_by_one_task(spark, last_links):
    rnd = random.Random(8)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(150)]
    links = spark.createDataFrame([(a, b) if rnd.random() < 0.5 else (b, a) for a, b in pairs] + [(None, 3)], "u long, v long")
    out = {r.node: r.root for r in components.connected_components(links, last_links=last_links).collect()}
    want = classes(1151, pairs)
    assert set(out) == {i for a, b in pairs if a != b for i in (a, b)}
    assert all(want[node] == want[root] for node, root in out.items())
    assert len(set(out.values())) == len({want[i] for i in out})


def test_few_links_take_few_jobs(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(2000)], "u long, v long")
    spark.sparkContext.setJobGroup("few links", "")
    try:
        assert components.connected_components(links).select("root").distinct().count() == 1
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few links")) <= 10


def test_rows_are_parted_without_missing_an_id(spark):
    rows = spark.createDataFrame([(i % 700, "x") for i in range(1400)] + [(None, "n")], "doc_id long, __set string")
    for ids, n_words in (([*range(0, 700, 9), None], 1 << 17), (list(range(350)), 4), ([], 1 << 17)):
        away, near = common.part_by_ids(rows, "doc_id", spark.createDataFrame([(i,) for i in ids], "listed long"), "listed", n_words)
        assert away.columns == near.columns == rows.columns
        a, b = [r.doc_id for r in away.collect()], [r.doc_id for r in near.collect()]
        assert len(a) + len(b) == 1401 and not set(ids) & set(a)
        assert n_words == 4 or len(b) <= 2 * len(ids) + 4
