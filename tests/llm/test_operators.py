"""Null, empty, repeated and clashing inputs, and results by brute force, of the operators without an SQL equivalent or with
cases that the tables lack."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow.fs as fs
import pytest
from pyspark.sql import functions as F

from siftlode.llm import decontam, embed_dedup, html_extract, line_dedup, mixing, quality, queries, sharding, url_filter, warc
from siftlode.llm.common import work_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


# ---- URL filter


def test_url_filter(spark):
    urls = [None, "nothing", "http://A.Example.NET/en/x?q#f", "https://www.bad.test/p/1.html?x=1", "http://bad.test/p/1/", "http://bad.test/p/2", "ftp://org/fr/", "http://xorg/fr/", "http://h", "http://bad.test/p/1"]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, host string")
    listed = spark.createDataFrame([("bad.test/p/1",), ("bad.test/p/1",), (None,), *[(f"other.test/{i}",) for i in range(500)]], "canonical_url string")
    for limit in (10_000, 10):  # broadcast, and shuffled
        got = {r.page_id: r for r in url_filter.filter_urls(pages, listed, broadcast_rows=limit).collect()}
        assert len(got) == len(urls)
        assert (got[0].host, got[0].path, got[0].verdict, got[0].rule) == ("", "", "allow", None)
        assert (got[2].host, got[2].path, got[2].rule, got[2].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
        assert [got[i].verdict for i in (3, 4, 5, 9)] == ["block", "block", "allow", "block"]
        assert (got[6].rule, got[7].rule, got[8].path) == ("org/fr/", None, "")
        assert all(got[i].possible for i in (3, 4, 9))
    assert url_filter.filter_urls(pages.limit(0), listed).collect() == []
    assert not any(r.listed for r in url_filter.filter_urls(pages, listed.limit(0)).collect())


def test_url_filter_keeps_columns_of_any_name(spark):
    names = ["__on", "__url", "__h", "__rule", "block", "w0", "w1", "___h", "salt"]
    pages = spark.createDataFrame([(1, "http://bad.test/p/1", *names)], ["page_id", "url", *names])
    listed = spark.createDataFrame([("bad.test/p/1",)], "canonical_url string")
    for limit in (10, 0):
        r = url_filter.filter_urls(pages, listed, broadcast_rows=limit).first()
        assert [r[n] for n in names] == names and (r.page_id, r.listed, r.verdict) == (1, True, "block")


def test_the_registered_list_is_what_pages_say_not_their_urls(spark):
    thin, long_ = "x" * 1999, "ä" * 2000
    rows = [("http://www.a.test/en/1.html?q", thin), ("http://a.test/en/1", long_), ("http://a.test/en/1", thin), ("http://ok.test/1", long_), ("http://no.test/1", None), (None, thin), ("odd", thin)]
    pages = spark.createDataFrame(rows, "url string, html string")
    assert [r[0] for r in url_filter.thin_urls(pages).collect()] == ["a.test/en/1"]
    assert url_filter.thin_urls(pages.limit(0)).count() == 0


def test_the_registered_query_lists_by_filter_and_join(spark, tmp_path):
    """Pages of one site whose URLs differ by number only: the list decides, not a pattern; a query through a page's other name too."""
    rows = [(i, f"http://{'www.' if i % 3 == 0 else ''}site.test/de/{i // 2}{'?s' if i % 5 == 0 else ''}", "y" * (100 if i % 4 == 0 else 3000)) for i in range(400)]
    rows += [(1000, None, "t"), (1001, "http://x.org/fr/1", "t"), (1002, "http://x.org/fr/2", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = {r.page_id: r for r in queries.op1_url_filter(spark, str(tmp_path)).collect()}
    assert len(out) == len(rows)
    assert all(out[i].listed == (i // 2 % 2 == 0) and out[i].verdict == ("block" if i // 2 % 2 == 0 else "allow") for i in range(400))
    assert (out[1000].listed, out[1000].verdict) == (False, "allow")
    assert (out[1001].listed, out[1001].rule, out[1001].verdict) == (True, "org/fr/", "allow") and not out[1002].listed


# ---- HTML


def test_repeated_runs_by_brute_force():
    rnd = random.Random(2)
    pages = [[rnd.randrange(4) for _ in range(rnd.randrange(40))] for _ in range(12)] + [[], [1]]
    shared = [9, 8, 7, 6, 5, 4, 9, 9]
    for i in (0, 3, 7):
        pages[i][5:5] = shared
    run, least = 6, 3
    where = {}
    for p, toks in enumerate(pages):
        for i in range(len(toks) - run + 1):
            where.setdefault(tuple(toks[i : i + run]), set()).add(p)
    want = []
    for toks in pages:
        mark = [False] * len(toks)
        for i in range(len(toks) - run + 1):
            if len(where[tuple(toks[i : i + run])]) >= least:
                mark[i : i + run] = [True] * run
        want.append(mark)
    got = html_extract.repeated([np.array(p, np.int64) for p in pages], least, run=run)[0]
    assert [g.tolist() for g in got] == want


def test_main_text(spark):
    article = "<html><head><title>T</title><script>'</p>'</script></head><body><nav><a>Home</a></nav><article><h1>Head</h1><p>One&nbsp;&amp; <b>two</b>\n three<p>Four<div class='ad'>Buy</div><form>x</form><aside>y</aside></article><section class='comments'><p>me too</p></section><footer>f"
    plain = [f"<body><div>Home News About Contact Search Login</div><div>page {i} has its own words {i * 7} here</div></body>" for i in range(4)]
    rows = [(1, "http://h/1", article), (1, "http://h/1", article), (2, None, None), (3, "http://h/3", ""), *[(10 + i, f"http://p/{i}", p) for i, p in enumerate(plain)], (20, "http://h/4", "<article>" + "word " * 50_000)]
    got = html_extract.main_text(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    assert by[1].text == "Head\nOne & two three\nFour"
    assert (by[2].text, by[3].text, by[2].n_chars) == ("", "", 0)
    assert [by[10 + i].text for i in range(4)] == [f"page {i} has its own words {i * 7} here" for i in range(4)]
    assert by[20].n_chars == 50_000 * 5 - 1


# ---- sharding


def test_sharding(spark):
    rows = [(i, "é" * (i % 5), "s") for i in range(3000)] + [(7, "same", "s")] * 50 + [(None, None, None), (None, "", "s")]
    got = sharding.shard_documents(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for s in range(16):
        assert sorted(r.slot for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert {r.grown_shard for r in got if r.grown_shard != r["shard"]} == {16}
    assert 100 < sum(r.grown_shard == 16 for r in got) < 270
    assert all(r.size == len(("é" * (r.doc_id % 5)).encode()) + 1 for r in got if r.doc_id is not None and r.size != 5 or r.doc_id not in (7, None) and r.size == 5)
    assert {(r.size, r.text_crc32) for r in got if r.doc_id is None} == {(1, 0)}
    assert {r.text_crc32 for r in got if r.doc_id == 4} == {zlib.crc32(("é" * 4).encode())}
    assert len({r["shard"] for r in got if r.doc_id == 7}) == 1
    assert sharding.shard_documents(docs(spark, rows[:1]).limit(0)).collect() == []


def slow_winner(key, shards):
    text = "\0null" if key is None else str(key)
    return max(range(shards), key=lambda i: (int(hashlib.md5(f"{text}:{i}".encode()).hexdigest()[:13], 16), -i))


def test_winners_and_slots_against_a_plain_loop(spark):
    rows = [(i * 7919 % 4001, f"t{i}", "s") for i in range(700)] + [(None, "", None), (5, "x" * 400_000, "s")]
    got = sharding.shard_documents(docs(spark, rows)).collect()
    assert all((r["shard"], r.grown_shard) == (slow_winner(r.doc_id, 16), slow_winner(r.doc_id, 17)) for r in got)
    assert {r.size for r in got if r.doc_id == 5} == {len(t) + 1 for i, t, _ in rows if i == 5}


def test_shards_keep_columns_of_any_name(spark):
    names = ["__h", "__bucket", "__row", "__offset", "__n", "__shard"]
    df = spark.createDataFrame([(k, *names) for k in ("a", "null", None, "a")], ["k", *names])
    out = sharding.shard_records(df, "k", [1.0] * 64, [1.0] * 65)
    assert out.columns == ["k", *names, "shard", "grown_shard", "slot"]
    got = out.collect()
    assert all([r[n] for n in names] == names for r in got)
    assert len({r["shard"] for r in got if r.k in ("null", None)}) == 2


def test_weighted_shards(spark):
    df = spark.range(4000).select(sharding.rendezvous(F.col("id"), [1, 3, 0]).alias("s"), sharding.rendezvous(F.col("id"), [1, 3, 0, 4]).alias("g"))
    rows = df.collect()
    assert 850 < sum(r.s == 0 for r in rows) < 1150 and not any(r.s == 2 for r in rows)
    assert all(r.g in (r.s, 3) for r in rows)


# ---- mixing


def level(sizes):
    """Targets by resharing the excess until none is above its cap."""
    total, w = sum(sizes.values()), {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, open_ = {}, dict(w)
    left = float(total)
    while open_:
        share = {s: left * w[s] / sum(open_.values()) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            del open_[s]
    return target


def test_mix(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(["w"] * rnd.randrange(40)), rnd.choice(["a", "b", "b", "b", "c", "d", None])) for i in range(600)] + [(1, "x y", "b")] * 3 + [(None, "q\x0br", "a"), (None, None, "e"), (5, "", "")]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = level(sizes)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert mine[0].target == pytest.approx(want[s]) and sum(r.taken for r in mine) == int(want[s] + 0.5)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    again = mixing.mix(docs(spark, rows[::-1]).repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixed_documents_follow_the_mix(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(["w"] * rnd.randrange(1, 60)), rnd.choice("aabbbbbbcd")) for i in range(900)] + [(None, "n n", None), (1000, "", "a"), (1001, None, "a")]
    rows += [(7, " ".join(["w"] * (i % 9)) + f" x{i}", "b") for i in range(200)] + [(8, "v " * 50_000, "c")]
    clash = ["target", "__more", "__s", "__cut", "__key", "__range", "__times", "__copy", "__edge", "size", "c"]
    d = docs(spark, rows)
    for c in clash:
        d = d.withColumn(c, F.lit(f"own {c}"))
    out = mixing.mixed_documents(d)
    assert out.columns == d.columns
    times, want = {}, {}
    for r in out.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
        assert all(r[c] == f"own {c}" for c in clash)
    for r in mixing.mix(d).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + (int(r.taken / r.size + 0.5) if r.size else 0)
    assert times == {k: n for k, n in want.items() if n}
    assert mixing.mixed_documents(d.limit(0)).collect() == []


# ---- WARC


def test_warc_round_trip(spark):
    big = "é" * 3_000_000
    rows = [(5, "u5", "same " * 40), (3, "u3", "same " * 40), (9, "u\r\n9", "same " * 40), (4, None, None), (6, "u6", ""), (7, "u7", "short"), (8, "u8", "short"), (None, "n", "same " * 40), (3, "u3", "same " * 40), (10, "b", big)]
    got = warc.round_trip(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string"))
    out = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got.collect()}
    assert out == {(5, "revisit", 3, 200), (3, "response", None, 200), (9, "revisit", 3, 200), (4, "response", None, 0), (6, "response", None, 0), (7, "response", None, 5), (8, "response", None, 5), (None, "revisit", 3, 200), (10, "response", None, 6_000_000)}
    assert got.count() == len(rows)
    assert {r.page_id: r.url for r in got.collect()} == {5: "u5", 3: "u3", 9: "u%0D%0A9", 4: None, 6: "u6", 7: "u7", 8: "u8", None: "n", 10: "b"}
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_bundles_are_plain_seekable_zstandard(spark):
    import zstandard

    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i}" * 500) for i in range(40)], "page_id long, url string, html string")
    index, where = warc.archive(pages, work_dir(spark))
    rows = warc.read_records(index.where("page_id = 17"), where, payloads=True).collect()
    assert bytes(rows[0].payload).decode() == "<p>17" * 500
    store, base = fs.FileSystem.from_uri(where)
    names = {r.bundle for r in index.collect()}
    whole = b"".join(zstandard.ZstdDecompressor().stream_reader(store.open_input_stream(f"{base}/{n}", compression=None), read_across_frames=True).read() for n in sorted(names))
    assert whole.count(b"WARC/1.1\r\n") == 40


# ---- quality


def test_quality(spark):
    rnd = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "their", "which", "about"]
    good = [" ".join(rnd.choice(words) for _ in range(60)) + "." for _ in range(150)]
    junk = [" ".join(rnd.choice(words) + rnd.choice(["$$$", "###"]) for _ in range(60)) for _ in range(150)]
    rows = [(i, t, "s") for i, t in enumerate(itertools.chain(*zip(good, junk, strict=True)))] + [(1000, "", "s"), (1001, None, "s"), (None, good[0], None), (0, good[0], "s")]
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(300)] + [(None, 1, 0), (5, None, 0), (4, 1, 0), (10_000, 1, 1)], "doc_id long, quality int, toxic int")
    d = docs(spark, rows)
    got = quality.score_documents(d, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 300]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    assert sum(r.predicted == 1 - r.doc_id % 2 for r in held) >= 0.95 * len(held)
    kept = quality.keep_good(d.withColumn("score", F.lit("clash")), labels)
    assert kept.columns == [*d.columns, "score"] and 145 <= kept.count() <= 158
    assert {r.score for r in quality.score_documents(d, labels.limit(0)).collect()} == {0.5}
    assert quality.score_documents(d.limit(0), labels).collect() == []


def test_votes_against_a_plain_loop():
    """Exact nearest neighbours and their votes, ties at the cut included, one text and one labelled vector at a time."""
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["ab", "cd.", "EF", "12", "g-h"]) for _ in range(rnd.randrange(1, 40))) for _ in range(60)]
    texts += [texts[0]] * 20 + ["", None, "long " * 60_000, "é\x00 \n"]
    model = fitted(texts[:70], [i % 3 > 0 for i in range(70)])
    for text, score in zip(texts, model.scores(texts), strict=True):
        x = model.project(text)
        cos = [sum(float(a) * float(b) for a, b in zip(x, v, strict=True)) for v in model.vectors]
        least = sorted(cos, reverse=True)[quality.NEIGHBOURS - 1] - 1e-6
        votes = [(max(c, 0) ** quality.SHARPNESS * w, y) for c, w, y in zip(cos, model.weights, model.labels, strict=True) if c >= least]
        total = sum(v for v, _ in votes)
        assert score == pytest.approx(sum(v * y for v, y in votes) / total if total > 1e-12 else model.prior, abs=1e-4)


def fitted(texts, labels):
    import pyarrow as pa

    rows = []
    for i, (t, y) in enumerate(zip(texts, labels, strict=True)):
        at, n = quality.term_counts(t)
        rows.append({"doc_id": i, "label": int(y), "at": at.tolist(), "n": n.tolist()})
    return quality._fitted(pa.Table.from_pylist(rows), {0: labels.count(False), 1: labels.count(True)})


def test_recurrence():
    assert quality.recurrence("a b a c c a b".split()) == [0, 0, 2, 0, 1, 2, 3]


def test_kept_documents_keep_columns_of_any_name(spark):
    d = docs(spark, [(i, f"text {i}", "s") for i in range(9)]).withColumn("__score", F.lit("own"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(d, labels)
    assert kept.columns == d.columns and {r["__score"] for r in kept.collect()} == {"own"} and kept.count() == 9


# ---- embeddings


def test_estimates_are_unbiased_and_bounded():
    rnd = np.random.default_rng(0)
    x = rnd.standard_normal((300, 64))
    turned, codes, factors = embed_dedup.encode(x)
    est, half = embed_dedup.estimates(codes, factors, turned)
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    error = (est - unit @ unit.T)[~np.eye(300, dtype=bool)]
    assert abs(error.mean()) < 2e-3 and (np.abs(est - unit @ unit.T) <= half).mean() > 0.9999


@pytest.mark.parametrize("tile", [1024, 16])
def test_embedding_links_against_brute_force(spark, tile):
    rnd = np.random.default_rng(1)
    base = rnd.standard_normal((120, 64))
    near = np.concatenate([base[:60] + rnd.standard_normal((60, 64)) * s for s in (0.0, 0.0, 0.05, 0.1, 0.15)])
    clump = base[0] + rnd.standard_normal((80, 64)) * 0.05
    clump[:40:4] = clump[0]
    x = np.concatenate([base, near, clump]).astype(np.float32)
    label = [int(i) % 2 for i in range(len(x))]
    rows = [(i, [float(v) for v in x[i]], label[i]) for i in range(len(x))]
    odd = [(900, None, 0), (901, [0.0] * 64, 0), (902, [float("nan")] + [1.0] * 63, 0), (903, [None] + [1.0] * 63, 0), (904, rows[0][1], None), (905, [1.0] * 3, 0), (None, rows[0][1], 0), rows[0], (906, [float("inf")] + [1.0] * 63, 0), (907, [], 0)]
    df = spark.createDataFrame([(*r, 5) for r in rows + odd], "vec_id long, embedding array<float>, label int, n_links int")
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(df).collect()} if tile == 1024 else None
    y = x.astype(np.float64)
    unit = y / np.sqrt((y * y).sum(axis=1, keepdims=True))
    want = [(i, j) for i in range(len(x)) for j in range(i) if label[i] == label[j] and unit[i] @ unit[j] >= 0.98]
    if got is None:  # large buckets in tiles
        distinct, names = embed_dedup.distinct_vectors(embed_dedup.usable(df, "vec_id", "embedding", "label"))
        found = embed_dedup.find_links(distinct, tile=tile).where("v is null").groupBy(F.col("u").alias("one")).agg(F.sum("n").alias("n"))
        n = names.join(found, "one", "left").agg(F.sum(F.coalesce("n", F.lit(0)) + F.col("copies") - 1)).first()[0] / 2
        assert 0.99 * len(want) <= n <= len(want)
        return
    n = np.zeros(len(x), int)
    for i, j in want:
        n[i] += 1
        n[j] += 1
    mine = np.array([got[i].n_links for i in range(len(x))])
    assert (mine <= n).all() and mine.sum() >= 0.99 * n.sum() and len(want) > 500
    assert set(got) == {*range(len(x)), *range(900, 908), None}
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(900, 908))
    assert all(got[i].kept == (got[i].component_id == i) and got[i].component_id <= i for i in range(len(x)))
    assert embed_dedup.near_duplicates(df.limit(0)).collect() == []


def test_the_registered_embedding_query_on_rows_with_links(spark, tmp_path):
    rnd = np.random.default_rng(4)
    base = rnd.standard_normal((40, 64))
    x = np.concatenate([base, base[:20] + rnd.standard_normal((20, 64)) * 0.02, np.repeat(base[:1], 200, axis=0)])
    spark.createDataFrame([(i, [float(v) for v in r], 0) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r for r in queries.QUERIES["op7_embedding_dedup"](spark, str(tmp_path)).collect()}
    y = x.astype(np.float32).astype(np.float64)
    unit = y / np.sqrt((y * y).sum(axis=1, keepdims=True))
    n = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    assert [got[i].n_links for i in range(len(x))] == n.tolist() and n[0] >= 200
    assert all(got[i].component_id == (i - 40 if 40 <= i < 60 else i if i < 60 else 0) for i in range(len(x)))


# ---- lines


def slow_clean(rows, min_sites, min_chars=1):
    sites = {}
    for _, t, s in rows:
        for x in (t or "").split("\n") if t is not None else []:
            sites.setdefault(x, set()).add(s)
    out = []
    for i, t, _ in rows:
        own = t.split("\n") if t is not None else []
        left = [x for x in own if len(x) < min_chars or len(sites[x]) < min_sites]
        out.append((i, "\n".join(left) if t is not None else None, len(own), len(own) - len(left)))
    return sorted(out, key=str)


def test_line_dedup(spark):
    rnd = random.Random(5)
    line = "this line stands on every site of all"
    rows = [(i, f"own line number {i} of document\n{line}\nshort\n\nx", f"s{i}") for i in range(12)] + [(50, None, "s1"), (51, "", None), (52, line, None), (0, f"own line number 0 of document\n{line}\nshort", "s0"), (None, "\n\nshort\n", "s1"), (53, line + " " + "long " * 100_000 + "\nshort", "s2")]
    rows += [(100 + i, "\n".join(rnd.choice(["a", "b b", "", "c", f"u{i}", f"v{i % 7}"]) for _ in range(rnd.randrange(9))), f"s{rnd.randrange(14)}") for i in range(300)]
    rows += [(700 + i, "one of very many copies\nshort", "s3") for i in range(200)]
    d = docs(spark, rows).withColumn("k", F.lit(1)).withColumn("site", F.lit("clash")).withColumn("bad", F.lit("clash")).withColumn("__h", F.lit("clash"))
    for sites, chars in ((10, 1), (3, 1), (10, 20), (14, 1)):
        got = line_dedup.remove_boilerplate(d, min_sites=sites, min_chars=chars).collect()
        assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got), key=str) == slow_clean(rows, sites, chars)
    assert any(r.text == "" and r.n_removed for r in line_dedup.remove_boilerplate(d).collect())
    assert not any(r.n_removed for r in line_dedup.remove_boilerplate(d, min_sites=400).collect())
    assert line_dedup.remove_boilerplate(docs(spark, rows).limit(0)).collect() == []


def test_sketches_decide_far_from_the_threshold(spark):
    rows = [(i, f"wide line on very many sites\nnarrow line on {i % 150} sites", f"s{i}") for i in range(600)]
    found = line_dedup.boilerplate(docs(spark, rows).select("text", F.col("source").alias("site")), 100).collect()
    assert len(found) == 1 and 560 < found[0].sites < 640


# ---- benchmark


def test_masks_find_every_window_with_two_substitutions():
    for bad in itertools.combinations(range(decontam.WINDOW), 2):
        assert any(all(o + p not in bad for p in m) for m in decontam.MASKS for o in range(decontam.WINDOW - m[-1]))


def test_decontamination(spark):
    rnd = random.Random(6)
    vocab = [f"v{i}" for i in range(80)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(13, 40)))) for i in range(30)] + [(90, "v1 v2 v3"), (91, None), (92, ""), (0, None)]
    rows = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(0, 200)))) for i in range(150)]
    for i in range(100):
        w, t = rows[i][1].split(), rnd.choice(items[:30])[1].split()
        a = rnd.randrange(len(t) - 12)
        t = t[a : a + rnd.randrange(12, 25)]
        for p in rnd.sample(range(len(t)), min(len(t), rnd.randrange(5))):
            t[p] = "other"
        at = rnd.randrange(len(w) + 1)
        rows[i] = (i, rnd.choice([" ", ", ", "\n"]).join([*w[:at], *[x.upper() for x in t], *w[at:]]))
    rows += [(500, None), (501, ""), (None, items[0][1]), (502, "pre " * 30_000 + items[1][1])]

    def best(doc, item):
        d, b = doc.lower().replace(",", " ").split(), item.split()
        top = 0
        for o in range(-len(b) + 1, len(d)):
            same = [0 <= o + j < len(d) and d[o + j] == b[j] for j in range(len(b))]
            top = max([top, *(sum(same[s : s + 13]) for s in range(len(b) - 12))])
        return top

    want = {(i, j, n) for i, t in rows if t and i != 502 for j, b in items if b and len(b.split()) >= 13 and (n := best(t, b)) >= 11} | {(502, 1, 13)}
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (100_000, 300):
        assert {tuple(r) for r in decontam.contaminated(d, bench, seed_rows=limit).collect()} == want
    clean = decontam.decontaminate(d, bench)
    assert clean.columns == d.columns and {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {i for i, *_ in want}
    # a long item is rows of a bounded size, found wherever a window of it is
    long = [f"q{i}" for i in range(30_000)]
    bench = spark.createDataFrame([(7, " ".join(long)), (8, " ".join(long[::-1]))], "item_id long, text string")
    d = spark.createDataFrame([(1, " ".join(["x", *long[20_000:20_013], "y"])), (2, " ".join(long[29_990:])), (3, " ".join(long[29_987:]))], "doc_id long, text string")
    for limit in (10**6, 50_000):
        assert sorted(tuple(r) for r in decontam.contaminated(d, bench, seed_rows=limit).collect()) == [(1, 7, 13), (3, 7, 13)]
    assert decontam.contaminated(d, bench.limit(0)).collect() == [] and decontam.contaminated(d.limit(0), bench).collect() == []
