"""Exact dedup, importance resampling and whitening against plain loops, and their nulls, ties, copies and empty tables."""

import hashlib
import math
import zlib

import numpy as np
import pytest

from siftlode.llm import exact_dedup, importance, queries, whitening

DOCS = "doc_id long, text string, id string, sha string, n long"
LONG = "Wort ÄÖ " * 8_000


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 7) for i, t in rows], DOCS)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# ---- exact dedup

ROWS = [(1, "Ab"), (2, "aB"), (3, None), (4, ""), (5, "ÄB"), (6, "äb"), (7, "Äb"), (8, LONG), (9, LONG.upper()), (10, LONG + "."), (None, "ab"), (None, "null"), (11, "x"), (11, "x"), (12, "X"), (12, "y"), (2, "ab"), (13, LONG)]
ROWS += [(100 + i, "hot") for i in range(300)]


def plain_copies(rows, keep):
    out, same = [], {}
    rows = [(i, lower(t)) for i, t in rows]
    for i, t in rows:
        same.setdefault(t, []).append(i)
    for i, t in rows:
        ids = same[t]
        real = [j for j in ids if j is not None]
        best = keep(real) if real else None
        out.append((i, best, len(ids), i == best, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize(("keep", "key_bytes"), [("largest", 16), ("smallest", 16), ("largest", 0), ("smallest", 1)])
def test_copies_against_a_plain_loop(spark, keep, key_bytes):
    # without a key, or with one of a byte, all or many texts collide and are told apart by their bytes
    got = exact_dedup.copies(docs(spark, ROWS), keep=keep, key_bytes=key_bytes)
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_copies(ROWS, max if keep == "largest" else min)


def test_drop_copies_keeps_one_row_of_each_text(spark):
    rows = ROWS + [(11, "x")] * 3
    for bytes_ in (16, 1):
        got = exact_dedup.drop_copies(docs(spark, rows), key_bytes=bytes_)
        assert got.columns == ["doc_id", "text", "id", "sha", "n"]
        kept = got.collect()
        assert len(kept) == len({lower(t) for _, t in rows}) == len({lower(r.text) for r in kept})
        best = {}
        for i, t in rows:
            t = lower(t)
            best[t] = max((x for x in (best.get(t), i) if x is not None), default=None)
        assert all(r.doc_id == best[lower(r.text)] and (r.id, r.sha, r.n) == ("x", "y", 7) for r in kept)


def test_copies_of_nothing(spark):
    none = docs(spark, [])
    assert exact_dedup.copies(none).collect() == [] and exact_dedup.drop_copies(none).collect() == []
    with pytest.raises(ValueError, match="largest"):
        exact_dedup.copies(none, keep="first")


# ---- importance


def plain_resample(rows, target, run=1, buckets=importance.BUCKETS, min_words=20, percent=10, seed=2024):
    def feats(t):
        w = [x for x in "".join(c if c.isdigit() and c < "\x80" or "a" <= c <= "z" or c >= "\x80" else " " for c in lower(t)).split(" ") if x]
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, run + 1) for i in range(len(w) - n + 1)]

    found = [feats(t) for _, t in rows]
    s, t = np.zeros(buckets), np.zeros(buckets)
    for _, f in found:
        np.add.at(s, f, 1)
    for x in target:
        np.add.at(t, feats(x)[1], 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    out = []
    for (i, _), (words, f) in zip(rows, found, strict=True):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    able = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    drawn = {id(r): k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return sorted(str((*r[:4], drawn.get(id(r)))) for r in out)


def some_texts():
    rnd = np.random.default_rng(3)
    words = np.array(["Haus", "été", "b2b", "the", "AND", "x", "ÇA", "lamp", "red", "ring"])
    rows = [(int(i), " ".join(rnd.choice(words, rnd.integers(0, 60)))) for i in range(300)]
    rows += [(1000 + i, "the same text, again and again: " * 5) for i in range(80)]
    rows += [(2000, None), (2001, ""), (2002, "?! \x7f[]"), (None, "lamp " * 30), (2003, LONG), (2004, "a.b,c\td"), (5, "red ring " * 20)]
    return rows, ["red lamp ring", "THE lamp", None, "", "red-lamp", "the same text"]


@pytest.mark.parametrize("how", [{}, {"run": 2, "buckets": 50, "percent": 100}, {"min_words": 0, "percent": 35, "seed": 1}, {"percent": 0}])
def test_resampling_against_a_plain_loop(spark, how):
    rows, target = some_texts()
    bench = spark.createDataFrame([(i, t, "z") for i, t in enumerate(target)], "item_id long, text string, score string")
    got = importance.resample(docs(spark, rows), bench, **how).collect()
    assert sorted(str((r.doc_id, r.n_features, r.weight, r.score, r["rank"])) for r in got) == plain_resample(rows, target, **how)


def test_resampling_of_ties_and_nothing(spark):
    bench = spark.createDataFrame([("red",)], "text string")
    # 40 rows of one id and text: equal scores, ranks without gaps
    got = importance.resample(docs(spark, [(1, "red " * 30)] * 40), bench, percent=50).collect()
    assert len({r.score for r in got}) == 1 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 21))
    assert importance.resample(docs(spark, []), bench).collect() == []
    rows = [(i, f"word {i} " * 12) for i in range(20)]
    got = importance.resample(docs(spark, rows), bench.limit(0)).collect()
    assert sorted(str((r.doc_id, r.n_features, r.weight, r.score, r["rank"])) for r in got) == plain_resample(rows, [])
    drawn = importance.drawn_documents(docs(spark, rows), bench)
    assert drawn.count() == 2 and drawn.columns == ["doc_id", "text", "id", "sha", "n"]


# ---- whitening


def plain_whitening(vectors, k=16):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = (n * fit - s) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(1), ((n * x - s) / n) @ v / np.sqrt(e), e / np.square(c).sum() * n


def vectors_of(spark, rows, label="whitened string"):
    return spark.createDataFrame([(i, v, "keep", "old") for i, v in enumerate(rows)], f"vec_id long, embedding array<float>, label string, {label}")


@pytest.mark.parametrize(("dim", "rows", "decay"), [(20, 300, 1.0), (64, 500, 1.0), (300, 700, 0.8), (3, 50, 0.5)])
def test_whitening_against_eigenvectors(spark, dim, rows, decay):
    rnd = np.random.default_rng(dim)
    x = np.round(rnd.standard_normal((rows, dim)) * decay ** (np.arange(dim) * 20 / dim) * 2, 4).astype(np.float32)
    x = np.concatenate([x, np.repeat(x[:1], rows // 2, 0)])
    got = sorted(whitening.whiten(vectors_of(spark, x.tolist())).collect(), key=lambda r: r.vec_id)
    n, deviation, whitened, explained = plain_whitening(x)
    assert len(got) == len(x) and {r.n for r in got} == {n} and [r.deviation for r in got] == deviation.tolist()
    w = np.array([r.whitened for r in got])
    assert w.shape == whitened.shape
    assert np.abs(w - whitened * np.sign((w * whitened).sum(0))).max() < 1e-8
    assert np.allclose([r.explained for r in got], explained, rtol=1e-9)
    assert all(r.identity_error < 1e-9 and r.label == "keep" for r in got)


def test_the_block_iteration_certifies_before_the_block_is_whole(spark):
    rnd = np.random.default_rng(0)
    x = rnd.standard_normal((400, 120)) * 0.7 ** np.arange(120) * 100
    fit = whitening.scaled(vectors_of(spark, x.tolist())).select("scaled").distinct()
    model = whitening.principal(fit, 5, passes=100)
    assert 2 < model.passes < 60 and model.residuals.max() <= 1e-14 * model.values[0]
    y = np.floor(64 * x.astype(np.float32).astype(np.float64))
    e, v = np.linalg.eigh(np.cov(y.T, bias=True))
    assert np.allclose(model.values, e[::-1][:5], rtol=1e-10)
    assert np.abs(np.abs((model.vectors * v[:, ::-1][:, :5]).sum(0)) - 1).max() < 1e-10


def test_whitening_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    line = [[float(i), 2.0 * i, 1.0] for i in range(6)]
    rows = [*line, None, [], [1.0, None, 2.0], [nan, 1.0, 1.0], [inf, 1.0, 1.0], [1.0, 2.0]]
    got = {r.vec_id: r for r in whitening.whiten(vectors_of(spark, rows, "n string")).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 5]
    assert all(len(r.whitened) == 1 and r.explained[0] == pytest.approx(1.0) and r.n == 6 and r.label == "keep" for r in got.values())
    equal = whitening.whiten(vectors_of(spark, [[1.0, 2.0]] * 4)).collect()
    assert [(r.n, r.deviation, r.whitened, r.identity_error) for r in equal] == [(1, 0, [], None)] * 4
    assert whitening.whiten(vectors_of(spark, [])).collect() == [] and whitening.whiten(vectors_of(spark, [None])).collect() == []
    far = whitening.whiten(vectors_of(spark, [[1e30, 0.0], [-1e30, 1.0], [0.0, 0.0]])).collect()
    assert len(far) == 3 and all(len(r.whitened) == 1 for r in far)  # the second dimension is lost beside the first
    assert whitening.deviations(np.array([[2**40], [0]]), 2**30, (0,)) == [None, 0]


def test_registered_whitening(spark):
    d = "/root/testdata/sf0.001"
    got = queries.QUERIES["op12_whitening"](spark, d).collect()
    x = {r.vec_id: r.embedding for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}
    ids = sorted(x)
    n, deviation, whitened, explained = plain_whitening([x[i] for i in ids])
    assert len(got) == 16 * len(ids) and {r.component for r in got} == set(range(1, 17))
    at = {i: k for k, i in enumerate(ids)}
    w = np.zeros(whitened.shape)
    for r in got:
        w[at[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.deviation == deviation[at[r.vec_id]] and math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-9)
    assert np.abs(w - whitened * np.sign((w * whitened).sum(0))).max() < 1e-9
