"""Hold-out splits of a click log, without leakage.

Every draw orders by the md5 of a seed and a key, so that it is the same on every run and in every engine. A group is
a tuple of key columns (null is a value); clicks are told apart by these, never by their place in a file.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cell_name, has_filter
from ..sources.work import keep

SEARCH = ("search_query", "search_location_id", "search_infm_params_text", "search_is_delivery_search", "search_category")
CONTEXT = ("query_norm", *SEARCH[1:])
QUERY_LOCATION = ("query_norm", "search_location_id")
PREFIX = {"unseen": "vu", "seen": "vs"}


def draw(seed: int, *keys: str) -> Column:
    """Random-looking order key; null is spelt out so that no two tuples share a key by it."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("<null>")) for k in keys]))


def with_corpus_flag(train: DataFrame, items: DataFrame) -> DataFrame:
    """``train`` with in_corpus: whether the corpus has the clicked item."""
    ids = items.select("item_id").distinct().withColumn("__has", F.lit(True))
    return train.join(ids, "item_id", "left").withColumn("in_corpus", F.coalesce("__has", F.lit(False))).drop("__has")


def groups(train: DataFrame, keys: Sequence[str] = CONTEXT) -> DataFrame:
    """(keys, n, n_corp): each group's clicks, and those on corpus items."""
    return train.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("in_corpus").cast("long")).alias("n_corp"))


def pick_groups(g: DataFrame, seed: int, keys: Sequence[str] = CONTEXT) -> DataFrame:
    """One group of each text, at random among those with corpus items."""
    w = Window.partitionBy("query_norm").orderBy(draw(seed, *keys))
    return g.where("n_corp > 0").withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "n", "n_corp")


def eligibility(g: DataFrame) -> DataFrame:
    """(query_norm, n_groups, n_corp_groups, can_unseen, can_seen): empty texts are no candidates."""
    t = g.where("query_norm <> ''").groupBy("query_norm").agg(F.count(F.lit(1)).alias("n_groups"), F.sum((F.col("n_corp") > 0).cast("long")).alias("n_corp_groups"))
    return t.withColumn("can_unseen", F.col("n_corp_groups") >= 1).withColumn("can_seen", (F.col("n_groups") >= 2) & (F.col("n_corp_groups") >= 1))


def sample_texts(texts: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` texts at random (a limit that is the feature); ties by text."""
    return texts.orderBy(draw(seed, "query_norm"), "query_norm").limit(n)


def choose(g: DataFrame, n_unseen: int, n_seen: int, seed: int, keys: Sequence[str] = CONTEXT) -> DataFrame:
    """(keys, slice, query_id) of the held-out groups: one of each sampled text."""
    e = eligibility(g)
    unseen = sample_texts(e.where("can_unseen").select("query_norm"), n_unseen, seed).withColumn("slice", F.lit("unseen"))
    seen = sample_texts(e.where("can_seen").select("query_norm").join(unseen.select("query_norm"), "query_norm", "left_anti"), n_seen, seed).withColumn("slice", F.lit("seen"))
    texts = unseen.union(seen)
    # at most n_unseen + n_seen rows
    place = F.row_number().over(Window.partitionBy("slice").orderBy("query_norm")) - 1
    name = F.when(F.col("slice") == "unseen", F.lit(PREFIX["unseen"])).otherwise(F.lit(PREFIX["seen"]))
    texts = texts.withColumn("query_id", F.concat(name, F.lit("_"), F.lpad(place.cast("string"), 5, "0")))
    return pick_groups(g.join(texts.select("query_norm"), "query_norm", "left_semi"), seed, keys).join(texts, "query_norm")


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = None
    for k in keys:
        one = left[k].eqNullSafe(right[f"__{k}"])
        cond = one if cond is None else cond & one
    return cond


def _renamed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in rows.columns if c not in keys])


def rest_of(train: DataFrame, chosen: DataFrame, keys: Sequence[str] = CONTEXT) -> DataFrame:
    """Clicks that stay: without all of unseen texts, and without the held-out groups of seen ones."""
    unseen = chosen.where("slice = 'unseen'").select("query_norm").distinct()
    held = _renamed(chosen.where("slice = 'seen'").select(*keys).distinct(), keys)
    out = train.join(unseen, "query_norm", "left_anti")
    return out.join(held, _same(out, held, keys), "left_anti")


def widen(train: DataFrame, chosen: DataFrame, keys: Sequence[str] = QUERY_LOCATION) -> tuple[DataFrame, DataFrame]:
    """The variant with wider groups: (chosen, rest). Seen texts that have nothing left are no longer among the chosen."""
    wide = chosen.select(*keys, "slice", "query_id")
    rest = rest_of(train, wide, keys)
    left = rest.select("query_norm").distinct()
    kept = wide.where("slice = 'unseen'").union(wide.where("slice = 'seen'").join(left, "query_norm", "left_semi").select(*wide.columns))
    return kept, rest


def joint_mode(rows: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Of each group the most frequent tuple of ``columns``; ties go to the smaller, nulls last."""
    n = rows.groupBy(*dict.fromkeys([*group, *columns])).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*group).orderBy(F.desc("__n"), *[F.asc_nulls_last(c) for c in columns])
    return n.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__n")


def materialize(train: DataFrame, chosen: DataFrame, rest: DataFrame, keys: Sequence[str] = CONTEXT) -> tuple[DataFrame, DataFrame]:
    """(queries, relevance) of the chosen groups.

    queries: query_id, slice, cell, has_filter, has_memory (the rest has corpus clicks of the text), query_norm and the
    search columns; relevance: query_id, item_id, n_clicks, in_rest (the rest has the item).
    """
    c = _renamed(chosen.select(*keys, "slice", "query_id"), keys)
    rows = train.join(c, _same(train, c, keys)).drop(*[f"__{k}" for k in keys])
    mode = joint_mode(rows.select("query_id", "slice", "query_norm", *SEARCH), ["query_id", "slice", "query_norm"], SEARCH)
    memory = rest.where("in_corpus").select("query_norm").distinct().withColumn("__m", F.lit(True))
    q = mode.join(memory, "query_norm", "left").withColumn("has_memory", F.coalesce("__m", F.lit(False))).withColumn("has_filter", has_filter(F.col("search_infm_params_text")))
    q = q.withColumn("cell", cell_name(F.col("slice"), F.col("has_filter"))).select("query_id", "slice", "cell", "has_filter", "has_memory", "query_norm", *SEARCH)
    clicks = rows.where("in_corpus").groupBy("query_id", "item_id").agg(F.count(F.lit(1)).alias("n_clicks"))
    there = rest.select("item_id").distinct().withColumn("__in", F.lit(True))
    rel = clicks.join(there, "item_id", "left").select("query_id", "item_id", "n_clicks", F.coalesce("__in", F.lit(False)).alias("in_rest"))
    return q, rel


def cold(train: DataFrame, chosen: DataFrame, rest: DataFrame, rel: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The cold variant: (queries, relevance, rest), the rest without any click on a relevant item."""
    left = rest.join(rel.select("item_id").distinct(), "item_id", "left_anti")
    return (*materialize(train, chosen, left), left)


@dataclass(frozen=True)
class Split:
    queries: DataFrame
    rel: DataFrame
    rest: DataFrame


def build(train: DataFrame, items: DataFrame, n_unseen: int, n_seen: int, seed: int = 42) -> dict[str, Split]:
    """The variants ctx, ql and ctx_cold. A ``train`` that has in_corpus is read as it is; else the flag is made, and written once."""
    t = train if "in_corpus" in train.columns else keep(with_corpus_flag(train, items))
    # the held-out groups are a few rows that everything else reads
    chosen = keep(choose(groups(t), n_unseen, n_seen, seed))
    rest = keep(rest_of(t, chosen))
    q, rel = materialize(t, chosen, rest)
    wide, rest_wide = widen(t, chosen)
    qw, relw = materialize(t, wide, rest_wide, QUERY_LOCATION)
    qc, relc, rest_cold = cold(t, chosen, rest, rel)
    return {"ctx": Split(q, rel, rest), "ql": Split(qw, relw, rest_wide), "ctx_cold": Split(qc, relc, rest_cold)}


def halves(queries: DataFrame, seed: int = 42) -> DataFrame:
    """``queries`` with half: in each cell, floor(n / 2) queries at random are A, the others B."""
    place = F.row_number().over(Window.partitionBy("cell").orderBy(draw(seed, "query_id")))
    size = F.count(F.lit(1)).over(Window.partitionBy("cell"))
    return queries.withColumn("half", F.when(place <= F.floor(size / 2), F.lit("A")).otherwise(F.lit("B")))


def subset(split: Split, queries: DataFrame) -> Split:
    """The split with only the queries in ``queries`` (query_id); its rest stays whole."""
    ids = queries.select("query_id").distinct()
    return Split(split.queries.join(ids, "query_id", "left_semi"), split.rel.join(ids, "query_id", "left_semi"), split.rest)


def digest(rows: DataFrame) -> str:
    """A hash of a table's rows that does not depend on their order."""
    whole = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in sorted(rows.columns)]), 256)
    # the sum of 60-bit pieces is the same in any order, and each task sends one number a piece
    pieces = [F.sum(F.conv(F.substring(whole, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(4)]
    return "-".join(str(x) for x in rows.agg(F.count(F.lit(1)).alias("n"), *pieces).first())
