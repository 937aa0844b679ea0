"""The pipeline's stages against plain loops, and on null, empty and clashing rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftlode.llm import decontam, mixing, sharding
from tests.llm.test_similar import edited, slow_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Good texts, junk, near copies, benchmark passages, nulls and repeated rows in several sources."""
    rnd = random.Random(11)
    vocab = [f"word{i}" for i in range(600)]
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randrange(30, 120))) + "." for _ in range(240)]
    texts += [" ".join(edited(rnd, t.split(), 1)) for t in texts[:40]]
    items = [" ".join(rnd.choice(vocab) for _ in range(25)) for _ in range(10)]
    texts += [" ".join([texts[60 + i], items[i % 10], "end"]) for i in range(20)]
    junk = [" ".join(rnd.choice(vocab).upper() + "!!" for _ in range(60)) for _ in range(100)]
    rows = [(i, t, "en", rnd.choice(["a", "b", "c", None]), len(t)) for i, t in enumerate(texts)] + [(1000 + i, t, "en", "a", len(t)) for i, t in enumerate(junk)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "a", 0), (None, texts[100], "en", "b", 1), rows[3], rows[3]]
    rnd.shuffle(rows)
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(300)] + [(1000 + i, 0, 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def test_stages_one_after_the_other(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    good = corpus_pipeline.quality_stage(spark, docs, path).cache()
    kept = [(r.doc_id, r.text) for r in good.collect()]
    assert not any(k is not None and 1000 <= k < 1100 for k, _ in kept)
    assert sum(k is not None and k < 300 for k, _ in kept) == sum(r[0] is not None and r[0] < 300 for r in rows)

    one = corpus_pipeline.near_duplicate_stage(spark, good, path).cache()
    left = [(r.doc_id, r.text) for r in one.collect()]
    least = slow_components(kept)
    assert {k for (k, _), c in zip(kept, least, strict=True) if k is not None and k == c} <= {k for k, _ in left}
    assert len(left) <= len({c for c in least if c is not None}) + 3  # what three pairs at most are missed by

    clean = corpus_pipeline.decontamination_stage(spark, one, path).cache()
    bad = {k for k, t in left if any(i in (t or "") for i in items)}
    assert len(bad) >= 15 and sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(k) for k, _ in left if k not in bad)

    mixed = corpus_pipeline.mixing_stage(spark, clean, path).cache()
    taken = {}
    for r in mixing.mix(clean).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + (int(r.taken / r.size + 0.5) if r.size else 0)
    times = {}
    for r in mixed.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert times == {k: n for k, n in taken.items() if n}

    out = corpus_pipeline.sharding_stage(spark, mixed, path).collect()
    assert len(out) == sum(times.values())
    for s in range(16):
        assert sorted(r.slot for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    assert all(x.columns == docs.columns for x in (good, one, clean, mixed))


def test_run_is_all_stages(spark, folder):
    path, *_ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
    got, want = (sorted(map(str, x.select("doc_id", "text", "shard", "slot", "grown_shard").collect())) for x in (corpus_pipeline.run(spark, path), docs))
    assert got == want and len(got) > 100


def test_clashing_columns_and_empty_tables(spark, folder, tmp_path):
    path, *_ = folder
    names = ["__score", "__id", "__crc", "__key", "score", "component_id", "item_id", "shard", "t", "root", "label", "size", "h"]
    docs = spark.read.parquet(f"{path}/documents.parquet").where("doc_id < 60 or doc_id is null")
    for n in names:
        docs = docs.withColumn(n, F.lit(f"own {n}"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        own = [n for n in names if not (name == "sharding" and n == "shard")]
        assert set(docs.columns) <= set(out.columns), name
        rows = out.collect()
        assert rows and all(r[n] == f"own {n}" for r in rows for n in own), name
        assert stage(spark, docs.limit(0), path).collect() == []
    for t, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.quality_stage(spark, docs, str(tmp_path)).count() == docs.count()  # nothing learnt, nothing rejected
    assert corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path)).count() == docs.count()
    assert decontam.contaminated(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert sharding.shard_documents(docs.limit(0)).count() == 0
