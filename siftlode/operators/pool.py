"""Candidate pools, pair, query and item features, and ranking by a model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import haversine_km, has_filter
from ..functions.text import words as split_words
from . import fusion
from .fusion import Components

DEPTH = 100
FAR_KM = 5000.0
#: Features that the final recipe builds and then drops.
DROPPED = ("item_rating", "item_reviews", "item_title_len", "item_desc_len", "item_pop", "q_memory_items", "has_memory")


def channel_weights(channels: Mapping[str, object], final: Mapping[str, float]) -> dict[str, Mapping[str, float]]:
    """Weights of the pool's channels: "final" stands for the fusion's, "skip" leaves a channel out."""
    return {n: (final if w == "final" else w) for n, w in channels.items() if w != "skip"}


def build_pool(tops: Mapping[str, DataFrame], depth: int = DEPTH) -> DataFrame:
    """(query_id, item_id, rank_<channel>...): all items among a channel's first ``depth``; elsewhere rank depth + 1."""
    rows = None
    for name, top in tops.items():
        r = top.where(F.col("rank") <= depth).select("query_id", "item_id", F.lit(name).alias("channel"), "rank")
        rows = r if rows is None else rows.union(r)
    ranks = [F.coalesce(F.min(F.when(F.col("channel") == n, F.col("rank"))), F.lit(depth + 1)).alias(f"rank_{n}") for n in tops]
    return rows.groupBy("query_id", "item_id").agg(*ranks)


def item_features(items: DataFrame, train: DataFrame) -> DataFrame:
    """(item_id, item_rating, item_reviews, item_log_price, item_title_len, item_desc_len, item_phone_hidden,
    item_msg_forbidden, item_pop); item_pop is log1p of the item's clicks in a million."""
    n = train.count()
    clicks = train.groupBy("item_id").agg(F.count(F.lit(1)).alias("__clicks"))
    text = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    return items.join(clicks, "item_id", "left").select(
        "item_id", F.coalesce(F.col("item_rating").cast("double"), F.lit(-1.0)).alias("item_rating"), F.log1p(F.coalesce(F.col("item_rating_reviews_count").cast("double"), F.lit(0.0))).alias("item_reviews"),
        F.log1p(F.greatest(F.coalesce("item_price", F.lit(0.0)), F.lit(0.0))).alias("item_log_price"), text("item_title_raw").cast("double").alias("item_title_len"), F.log1p(text("item_description_raw").cast("double")).alias("item_desc_len"),
        F.col("item_is_phone_hidden").cast("double").alias("item_phone_hidden"), F.col("item_is_message_forbidden").cast("double").alias("item_msg_forbidden"), F.log1p(F.coalesce("__clicks", F.lit(0)) * 1e6 / F.lit(float(max(1, n)))).alias("item_pop"),
    )


def query_features(queries: DataFrame, train: DataFrame, mc_p: DataFrame, n_mc: int, shares: DataFrame) -> DataFrame:
    """(query_id, q_words, q_has_filter, q_is_agg, q_seen, q_mc_max, q_mc_entropy, q_loc_self_share).

    ``shares`` is what ``priors.self_share`` gives. A query without category rows is uniform over ``n_mc``.
    """
    seen = train.select("query_norm").distinct().withColumn("__seen", F.lit(1.0))
    # the mixture is 0 outside its rows, and 0 * ln(1e-12) is 0
    mc = mc_p.groupBy("query_norm").agg(F.max("p").alias("mx"), F.sum(-F.col("p") * F.log(F.col("p") + 1e-12)).alias("h"))
    p = 1.0 / max(1, n_mc)
    flat = F.lit(-n_mc * p) * F.log(F.lit(p + 1e-12))
    q = queries.join(seen, "query_norm", "left").join(mc, "query_norm", "left").join(shares.withColumnRenamed("search_loc", "search_location_id"), "search_location_id", "left")
    return q.select(
        "query_id", F.size(split_words(F.col("query_norm"))).cast("double").alias("q_words"), has_filter(F.col("search_infm_params_text")).cast("double").alias("q_has_filter"), F.coalesce(F.col("is_agg").cast("double"), F.lit(1.0)).alias("q_is_agg"),
        F.coalesce("__seen", F.lit(0.0)).alias("q_seen"), F.coalesce("mx", F.lit(p)).alias("q_mc_max"), F.coalesce("h", flat).alias("q_mc_entropy"), F.coalesce("self_share", F.lit(0.0)).alias("q_loc_self_share"),
    )


#: The columns of the final recipe's feature table, besides filter_<key> of each main key and rank_<channel> of each channel.
PAIR = ("char", "word", "dense", "memory", "loc_logp", "mc_logp", "filter", "final", "loc_p", "final_gap", "mc_p", "same_loc", "dist_km")
ITEM = ("item_log_price", "item_phone_hidden", "item_msg_forbidden")
QUERY = ("q_words", "q_has_filter", "q_is_agg", "q_seen", "q_mc_max", "q_mc_entropy", "q_loc_self_share")


def feature_table(pool: DataFrame, c: Components, weights: Mapping[str, float], items: DataFrame, queries: DataFrame, centroids: DataFrame, filter_keys: Sequence[str] = (), places: int | None = 4) -> DataFrame:
    """``pool`` with its features, one row a pair: raw terms, priors and their logs, ``final`` and its gap to the query's best,
    filter_<key> flags, same_loc, dist_km (log1p; FAR_KM where a place is unknown), the pool's ranks, all columns of ``items``
    (``item_features``) and ``queries`` (``query_features``), and q_pool_size; rounded to ``places``.

    What depends on the query alone, or on the item alone, is put together before pairs are met: the pool is joined once with
    each side, once with all lexical terms and once with filters and their hits; pairs are grouped by query for one window.
    """
    lat, lon = (lambda n: [F.col(x).alias(f"{x}{n}") for x in ("lat", "lon")]), F.col("loc")
    q = c.queries.select("query_id", "query_norm", "loc", "params", "is_agg").join(queries, "query_id").join(centroids.select(lon, *lat(1)), "loc", "left")
    i = c.items.select("item_id", F.col("loc").alias("item_loc"), F.col("mc").alias("item_mc"), "item_params").join(items, "item_id").join(centroids.select(F.col("loc").alias("item_loc"), *lat(2)), "item_loc", "left")
    every = dict.fromkeys(fusion.named(c), 1.0)
    met = pool.join(q, "query_id").join(i, "item_id")
    rows = fusion.priors_of(met, c)
    if c.texts:
        terms = fusion.lexical_terms(replace(c, dense=None), every, met)
        rows = rows.join(terms, ["query_norm", "item_id"], "left")
    if c.dense is not None:
        rows = fusion.with_dense(rows, c)
    if c.filters is not None:
        rows = rows.join(c.filters.select("params", "item_params", F.col("bonus").alias("filter"), "hits"), ["params", "item_params"], "left")
        rows = rows.withColumns({f"filter_{k}": F.coalesce(F.array_contains("hits", k).cast("double"), F.lit(0.0)) for k in filter_keys}).drop("hits")
    for name, of in c.pairs.items():
        rows = rows.join(of.select("query_id", "item_id", name), ["query_id", "item_id"], "left")
    rows = rows.withColumns({n: F.coalesce(F.col(n), F.lit(0.0)) for n in every})
    km = F.coalesce(haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")), F.lit(FAR_KM))
    rows = rows.withColumns({
        "final": fusion.linear(c, weights), "loc_logp": F.log(F.col("loc_p") + fusion.LOC_EPS), "mc_logp": F.log(F.col("mc_p") + fusion.MC_EPS),
        "same_loc": F.coalesce((F.col("loc") == F.col("item_loc")).cast("double"), F.lit(0.0)), "dist_km": F.log1p(km),
    })
    by_query = Window.partitionBy("query_id")
    rows = rows.withColumns({"final_gap": F.col("final") - F.max("final").over(by_query), "q_pool_size": F.count(F.lit(1)).over(by_query).cast("double")})
    ids, ranks = ["query_id", "item_id"], [n for n in pool.columns if n.startswith("rank_")]
    own = [*every, *[n for n in PAIR if n not in every and n in rows.columns], *[f"filter_{k}" for k in filter_keys if c.filters is not None], *[n for n in (*items.columns, *queries.columns) if n not in ids], "q_pool_size"]
    out = rows.select(*ids, *[F.col(n).cast("double").alias(n) for n in own], *ranks)
    return out if places is None else rounded(out, own, places)


def rounded(features: DataFrame, columns: Sequence[str], places: int = 4) -> DataFrame:
    """Half-even rounding, against noise in the last places."""
    return features.withColumns({c: F.bround(F.col(c).cast("double"), places) for c in columns})


def labelled(features: DataFrame, rel: DataFrame) -> DataFrame:
    """``features`` with label 1 for relevant items, else 0."""
    yes = rel.select("query_id", "item_id").distinct().withColumn("__y", F.lit(1))
    return features.join(yes, ["query_id", "item_id"], "left").withColumn("label", F.coalesce("__y", F.lit(0)).cast("byte")).drop("__y")


def drop_features(features: DataFrame, names: Sequence[str] = DROPPED) -> DataFrame:
    """Without ``names``; those that are missing are ignored."""
    return features.drop(*names)


def add_ce_features(rows: DataFrame, score: str = "ce_score") -> DataFrame:
    """``rows`` (query_id, item_id, score) with rank_ce (1 is best, ties by item) and ce_gap to the query's best."""
    w = Window.partitionBy("query_id")
    return rows.withColumn("rank_ce", F.row_number().over(w.orderBy(F.desc(score), "item_id"))).withColumn("ce_gap", F.col(score) - F.max(score).over(w))


def top_by_model(rows: DataFrame, k: int, prediction: str = "prediction", tie: str = "item_id") -> DataFrame:
    """(query_id, item_id, rank) of each query's ``k`` best by prediction."""
    w = Window.partitionBy("query_id").orderBy(F.desc(prediction), tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "item_id", "rank")


def to_candidates(model_top: DataFrame, linear_top: DataFrame, k: int) -> DataFrame:
    """The model's order, then the linear one's, each item once, up to ``k``."""
    return fusion.backfill(model_top, [linear_top], k)


def answer_lists(ranking: DataFrame, out: str = "answer") -> DataFrame:
    """(query_id, answer): item ids by rank, joined by a space."""
    got = F.array_sort(F.collect_list(F.struct("rank", "item_id")))
    return ranking.groupBy("query_id").agg(F.array_join(F.transform(got, lambda x: x["item_id"]), " ").alias(out))


def miss_rank(scored: DataFrame, rel: DataFrame, score: str = "score") -> DataFrame:
    """(query_id, item_id, rank): of each relevant item, 1 + the number of items that score more."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.bround(score, 5)))
    return scored.withColumn("rank", F.rank().over(w)).join(rel.select("query_id", "item_id"), ["query_id", "item_id"], "left_semi").select("query_id", "item_id", "rank")


def main_source(contributions: Sequence[str]) -> Column:
    """Name of the largest contribution; ties go to the first."""
    best = F.greatest(*contributions)
    out = F.lit(None).cast("string")
    for n in reversed(contributions):
        out = F.when(F.col(n) == best, F.lit(n)).otherwise(out)
    return out


def demo_pick(per_query: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(cell, query_id, hit): ``n`` queries with a hit and ``n`` without in each cell, at random."""
    p = per_query.withColumn("hit", F.col("hits") > 0)
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), "query_id"))
    return p.withColumn("__r", F.row_number().over(Window.partitionBy("cell", "hit").orderBy(order))).where(F.col("__r") <= n).select("cell", "query_id", "hit")
