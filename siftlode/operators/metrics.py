"""Recall@K by slices and cells, benchmark strata and adjusted averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_filter

K = 50
CELLS = ("unseen_filter", "unseen_nofilter", "seen_filter", "seen_nofilter")


def bench_strata(queries: DataFrame, train: DataFrame) -> DataFrame:
    """One row of shares: seen (normalised and exact), filter (all, among seen, among unseen), memory among seen.

    ``queries`` has query_norm, search_query, search_infm_params_text; ``train`` also in_corpus.
    """
    f = strata_flags(queries, train)
    share = lambda c, of=None: F.avg((F.when(of, c.cast("double")) if of is not None else c.cast("double")))
    seen, filt, mem = F.col("seen"), F.col("filt"), F.col("mem")
    return f.agg(F.count(F.lit(1)).alias("n_queries"), share(seen).alias("seen_share_norm"), share(F.col("exact")).alias("seen_share_exact"), share(filt).alias("filter_share"), share(filt, seen).alias("filter_share_seen"), share(filt, ~seen).alias("filter_share_unseen"), share(mem, seen).alias("seen_memory_share"))


def strata_flags(queries: DataFrame, train: DataFrame) -> DataFrame:
    """``queries`` with seen, exact, filt, mem."""
    flag = lambda rows, key, name: rows.select(key).distinct().withColumn(f"__{name}", F.lit(True))
    out = queries.join(flag(train, "query_norm", "seen"), "query_norm", "left").join(flag(train, "search_query", "exact"), "search_query", "left").join(flag(train.where("in_corpus"), "query_norm", "mem"), "query_norm", "left")
    for name in ("seen", "exact", "mem"):
        out = out.withColumn(name, F.coalesce(f"__{name}", F.lit(False))).drop(f"__{name}")
    return out.withColumn("filt", has_filter(F.col("search_infm_params_text")))


def cell_weights(queries: DataFrame, train: DataFrame) -> DataFrame:
    """(cell, weight): each cell's share of the queries; a cell without any has 0."""
    f = strata_flags(queries, train)
    cells = [(f"{s}_{n}", (F.col("seen") == (s == "seen")) & (F.col("filt") == (n == "filter"))) for s in ("unseen", "seen") for n in ("filter", "nofilter")]
    row = f.agg(*[F.avg(c.cast("double")).alias(n) for n, c in cells])
    return row.unpivot([], [n for n, _ in cells], "cell", "weight")


def top_locations(queries: DataFrame, n: int) -> DataFrame:
    """(search_location_id, n): the ``n`` most frequent, ties by id."""
    return queries.groupBy("search_location_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "search_location_id").limit(n)


def check_known(answers: DataFrame, queries: DataFrame) -> None:
    """Unknown query ids are an error."""
    unknown = answers.select("query_id").distinct().join(queries, "query_id", "left_anti").limit(3).collect()
    if unknown:
        raise ValueError(f"answers to unknown queries: {[r[0] for r in unknown]}")


def recall(answers: DataFrame, queries: DataFrame, rel: DataFrame, k: int = K) -> DataFrame:
    """(query_id, slice, cell, has_filter, search_location_id, n_rel, n_rest, n_list, hits, hits_rest, recall).

    ``answers`` (query_id, item_id, rank): repeats count at their first place, then the first ``k`` count. A query
    without answers has recall 0.
    """
    first = answers.groupBy("query_id", "item_id").agg(F.min("rank").alias("rank"))
    top = first.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "item_id"))).where(F.col("r") <= k)
    hit = rel.join(top.select("query_id", "item_id", F.lit(1).alias("hit")), ["query_id", "item_id"], "left")
    per = hit.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel"), F.sum(F.col("in_rest").cast("long")).alias("n_rest"), F.count("hit").alias("hits"), F.count(F.when(F.col("in_rest"), F.col("hit"))).alias("hits_rest"))
    length = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_list"))
    out = queries.select("query_id", "slice", "cell", "has_filter", "search_location_id").join(per, "query_id", "left").join(length, "query_id", "left").na.fill(0, ["n_rel", "n_rest", "hits", "hits_rest", "n_list"])
    return out.withColumn("recall", F.when(F.col("n_rel") > 0, F.col("hits") / F.col("n_rel")).otherwise(F.lit(float("nan"))))


def stats(per_query: DataFrame, top_locs: DataFrame) -> DataFrame:
    """(name, recall, se, n) of the seven slices and the four cells; NaN where there are too few queries."""
    tl = F.broadcast(top_locs.select("search_location_id").distinct().withColumn("__top", F.lit(True)))
    p = per_query.join(tl, "search_location_id", "left").withColumn("top", F.coalesce("__top", F.lit(False)))
    parts: dict[str, Column] = {"all": F.lit(True), "unseen": F.col("slice") == "unseen", "seen": F.col("slice") == "seen", "filter": F.col("has_filter"), "no_filter": ~F.col("has_filter"), "top_loc": F.col("top"), "other_loc": ~F.col("top")}
    parts |= {c: F.col("cell") == c for c in CELLS}
    nan = F.lit(float("nan"))
    # one pass: each query is counted in its slices
    each = p.select("recall", F.explode(F.array(*[F.when(cond, F.lit(name)) for name, cond in parts.items()])).alias("name")).where("name is not null")
    got = each.groupBy("name").agg(F.avg("recall").alias("recall"), F.stddev_samp("recall").alias("sd"), F.count(F.lit(1)).alias("n"))
    names = per_query.sparkSession.createDataFrame([(n,) for n in parts], "name string")
    out = names.join(got, "name", "left")
    return out.select("name", F.coalesce("recall", nan).alias("recall"), F.coalesce(F.when(F.col("n") > 1, F.col("sd") / F.sqrt("n")), nan).alias("se"), F.coalesce("n", F.lit(0)).alias("n"))


def adjusted(stat: DataFrame, weights: DataFrame, strata: DataFrame) -> DataFrame:
    """One row: bench_adj, weighted, their standard errors, and the averages by the benchmark's share of filters.

    ``stat`` is what ``stats`` gives, ``weights`` what ``cell_weights``, ``strata`` what ``bench_strata`` gives; all of a few
    rows.
    """
    cells = stat.join(weights.withColumnRenamed("cell", "name"), "name").agg(F.sum(F.col("weight") * F.col("recall")).alias("bench_adj"), F.sqrt(F.sum(F.pow(F.col("weight") * F.col("se"), 2))).alias("bench_adj_se"))
    at = {n: F.max(F.when(F.col("name") == n, F.col("recall"))).alias(f"r_{n}") for n in ("unseen", "seen", "filter", "no_filter", *CELLS)}
    se = {n: F.max(F.when(F.col("name") == n, F.col("se"))).alias(f"s_{n}") for n in ("unseen", "seen")}
    row = stat.agg(*at.values(), *se.values()).crossJoin(cells).crossJoin(strata)
    s = F.col("seen_share_norm")
    mixed = lambda a, b, w: w * F.col(a) + (1 - w) * F.col(b)
    return row.select(
        "bench_adj", "bench_adj_se", mixed("r_seen", "r_unseen", s).alias("weighted"), F.sqrt(F.pow((1 - s) * F.col("s_unseen"), 2) + F.pow(s * F.col("s_seen"), 2)).alias("weighted_se"),
        mixed("r_unseen_filter", "r_unseen_nofilter", F.col("filter_share_unseen")).alias("unseen_fadj"), mixed("r_seen_filter", "r_seen_nofilter", F.col("filter_share_seen")).alias("seen_fadj"), mixed("r_filter", "r_no_filter", F.col("filter_share")).alias("filter_adj"),
    )


def item_micro(per_query: DataFrame, k: int = K) -> DataFrame:
    """One row: recall over relevant items that the rest has and has not, their numbers, and list lengths."""
    p = per_query.agg(F.sum("hits_rest").alias("hr"), F.sum("n_rest").alias("n_item_in_rest"), F.sum(F.col("hits") - F.col("hits_rest")).alias("hn"), F.sum(F.col("n_rel") - F.col("n_rest")).alias("n_item_new"), F.avg("n_list").alias("mean_len"), F.avg((F.col("n_list") < k).cast("double")).alias("share_short"), F.sum((F.col("n_list") == 0).cast("long")).alias("n_missing"))
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(float("nan")))
    return p.select(over("hr", "n_item_in_rest").alias("item_in_rest"), over("hn", "n_item_new").alias("item_new"), "n_item_in_rest", "n_item_new", "mean_len", "share_short", "n_missing")


def relevance_stats(rel: DataFrame, k: int = K) -> DataFrame:
    """One row: mean, median, 90 % point and maximum of the relevant items of a query, shares of 1 and of over ``k``, and
    the share of items that the rest has."""
    n = rel.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("in_rest").cast("long")).alias("r"))
    return n.agg(F.avg("n").alias("mean"), F.median("n").alias("median"), F.percentile("n", F.lit(0.9)).alias("p90"), F.max("n").alias("max"), F.avg((F.col("n") == 1).cast("double")).alias("share_eq_1"), F.avg((F.col("n") > k).cast("double")).alias("share_gt_k"), (F.sum("r") / F.sum("n")).alias("in_rest_share"))
