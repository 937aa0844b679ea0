"""Priors from clicks: location, category by nearest query texts, and filters.

A prior is a long table of what is not zero; readers fill the rest.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import char_ngrams, haversine_km, parse_filters
from ..sources.work import keep
from . import lexical

KNN = 20
KNN_POWER = 3.0
#: Characters of a run by which texts and what they may contain meet.
GRAM = 8


def location_counts(train: DataFrame) -> DataFrame:
    """(search_loc, item_loc, n); rows without a location are left out."""
    t = train.where("search_location_id is not null and item_location_id is not null")
    return t.groupBy(F.col("search_location_id").alias("search_loc"), F.col("item_location_id").alias("item_loc")).agg(F.count(F.lit(1)).alias("n"))


def location_prior(counts: DataFrame, query_locs: DataFrame, item_locs: DataFrame, fallback: str = "self") -> DataFrame:
    """(search_loc, item_loc, p) for the queries' locations over the corpus's.

    p = n / all clicks of the search location, those outside the corpus included (rows are not rescaled). A location
    without clicks puts 1 on itself if the corpus has it, else (or with ``fallback`` uniform) the same on each.
    """
    total = F.sum("n").over(Window.partitionBy("search_loc"))
    seen = counts.withColumn("p", F.col("n") / total).join(item_locs, "item_loc", "left_semi").join(query_locs, "search_loc", "left_semi").select("search_loc", "item_loc", "p")
    cold = query_locs.select("search_loc").distinct().join(counts.select("search_loc").distinct(), "search_loc", "left_anti")
    locs = item_locs.select("item_loc").distinct()
    n = locs.count()
    own = cold.join(locs.select(F.col("item_loc").alias("search_loc")), "search_loc", "left_semi") if fallback == "self" else cold.limit(0)
    single = own.select("search_loc", F.col("search_loc").alias("item_loc"), F.lit(1.0).alias("p"))
    # few locations on either side: a row for each pair is the prior itself
    even = cold.join(own, "search_loc", "left_anti").crossJoin(locs).select("search_loc", "item_loc", F.lit(1.0 / max(1, n)).alias("p"))
    return seen.union(single).union(even)


def location_centroids(items: DataFrame, counts: DataFrame) -> DataFrame:
    """(loc, lat, lon): the median of a location's items; a search location without items gets the click-weighted mean
    of its items' locations, coordinates that are not known counting as 0."""
    own = items.groupBy(F.col("item_location_id").alias("loc")).agg(F.median("item_latitude").alias("lat"), F.median("item_longitude").alias("lon"))
    far = counts.join(own.withColumnRenamed("loc", "item_loc"), "item_loc").groupBy(F.col("search_loc").alias("loc"))
    mean = lambda c: (F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0.0))) / F.sum("n")).alias(c)
    return own.union(far.agg(mean("lat"), mean("lon")).join(own.select("loc"), "loc", "left_anti"))


def self_share(counts: DataFrame, query_locs: DataFrame, item_locs: DataFrame, below: float = 0.5) -> DataFrame:
    """(search_loc, self_share, is_agg): the share of a location's clicks that stay in it, 0 if the corpus lacks it or it
    has none; an aggregate region is one under ``below``."""
    s = counts.groupBy("search_loc").agg((F.sum(F.when(F.col("search_loc") == F.col("item_loc"), F.col("n")).otherwise(0)) / F.sum("n")).alias("s"))
    has = item_locs.select(F.col("item_loc").alias("search_loc")).distinct().withColumn("has", F.lit(True))
    out = query_locs.select("search_loc").distinct().join(s, "search_loc", "left").join(has, "search_loc", "left")
    share = F.when(F.col("has"), F.coalesce("s", F.lit(0.0))).otherwise(F.lit(0.0))
    return out.select("search_loc", share.alias("self_share")).withColumn("is_agg", F.col("self_share") < below)


def geo_smoothed(counts: DataFrame, centroids: DataFrame, query_locs: DataFrame, items: DataFrame, sigma: float, lam: float) -> DataFrame:
    """(search_loc, item_loc, p) with p = (C + lam * K) / (N + lam), where K falls with distance and grows with the
    number of items, and a row of K adds up to 1; unknown distances leave the number of items alone. C and N count
    clicks in the corpus's locations and all clicks."""
    w = items.groupBy(F.col("item_location_id").alias("item_loc")).agg(F.count(F.lit(1)).alias("w"))
    a, b = centroids.select(F.col("loc").alias("search_loc"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1")), centroids.select(F.col("loc").alias("item_loc"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    # locations times locations is the size of the prior
    pairs = query_locs.select("search_loc").distinct().join(a, "search_loc", "left").crossJoin(w.join(b, "item_loc", "left"))
    d = haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    k = pairs.withColumn("k", F.col("w") * F.coalesce(F.exp(-d / sigma), F.lit(1.0)))
    k = k.withColumn("k", F.col("k") / F.greatest(F.sum("k").over(Window.partitionBy("search_loc")), F.lit(1e-12)))
    n = counts.groupBy("search_loc").agg(F.sum("n").alias("total"))
    j = k.join(counts, ["search_loc", "item_loc"], "left").join(n, "search_loc", "left")
    return j.select("search_loc", "item_loc", ((F.coalesce("n", F.lit(0)) + lam * F.col("k")) / (F.coalesce("total", F.lit(0)) + lam)).alias("p"))


def category_distribution(train: DataFrame, corpus_mcs: DataFrame) -> DataFrame:
    """(query_norm, mc, p): shares of the corpus's categories among a text's clicks; empty texts are left out."""
    t = train.where("query_norm <> ''").select("query_norm", F.col("item_microcat_id").alias("mc")).join(corpus_mcs, "mc", "left_semi")
    n = t.groupBy("query_norm", "mc").agg(F.count(F.lit(1)).alias("n"))
    return n.select("query_norm", "mc", (F.col("n") / F.sum("n").over(Window.partitionBy("query_norm"))).alias("p"))


def category_prior(query_texts: DataFrame, dist: DataFrame, k: int = KNN, power: float = KNN_POWER) -> DataFrame:
    """(query_norm, mc, p) of the distinct texts in ``query_texts`` (query_norm).

    The ``k`` train texts nearest by character 2-4-gram cosine, rounded half-even to 5 places, mix their distributions
    with weights sim ** power; ties go to the smaller text. N-grams that train lacks are dropped. Texts that are like
    none are absent: uniform.
    """
    texts = dist.select("query_norm").distinct()
    n = texts.count()
    grams = char_ngrams(F.col("query_norm"), 2, 4)
    dc = lexical.term_counts(texts, "query_norm", grams)
    idf = lexical.fit_idf(dc, n)
    qw = lexical.weights(lexical.term_counts(query_texts.select("query_norm").distinct(), "query_norm", grams), idf, n, keep_unseen=False)
    sims = lexical.cosine(qw, lexical.weights(dc, idf, n)).withColumn("sim", F.bround("cos", 5))
    near = sims.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "d"))).where(F.col("r") <= k)
    near = near.withColumn("w", F.pow(F.greatest("sim", F.lit(0.0)), power)).withColumn("total", F.sum("w").over(Window.partitionBy("q"))).where("total > 0")
    mixed = near.join(dist.withColumnRenamed("query_norm", "d"), "d").groupBy("q", "mc").agg((F.sum(F.col("w") * F.col("p")) / F.max("total")).alias("p"))
    return mixed.select(F.col("q").alias("query_norm"), "mc", "p")


def filter_bonus(query_params: DataFrame, item_params: DataFrame, keys: Sequence[str], key_weights: Mapping[str, float], match: str = "pair") -> DataFrame:
    """(params, item_params, bonus, hits) of distinct filter strings and distinct item parameters that match.

    Each distinct pair (key, value) of a main key with a value adds the key's weight if the parameters hold
    "key value" (``pair``) or "value" (``value``); hits lists the keys that did. Only distinct strings meet.
    """
    main = F.create_map(*[x for k, w in key_weights.items() for x in (F.lit(k), F.lit(float(w)))])
    pairs = query_params.select("params").distinct().select("params", F.explode(F.array_distinct(parse_filters(F.col("params"), keys))).alias("f")).select("params", "f.key", "f.value")
    pairs = pairs.withColumn("w", main[F.col("key")]).where("w is not null and value <> ''")
    needles = pairs.select("key", "value").distinct().withColumn("needle", F.concat_ws(" ", "key", "value") if match == "pair" else F.col("value"))
    found = _containing(item_params.select("item_params").distinct(), needles).select("item_params", "key", "value")
    return pairs.join(found, ["key", "value"]).groupBy("params", "item_params").agg(F.sum("w").alias("bonus"), F.array_sort(F.collect_set("key")).alias("hits"))


def _containing(hay: DataFrame, needles: DataFrame, longest: int = GRAM) -> DataFrame:
    """``hay`` (item_params) joined with the ``needles`` (needle, ...) that it contains.

    Texts and needles meet by runs of characters: of each needle, the one of its runs of ``longest`` (or, if it is
    shorter, itself) that fewest texts have. What meets is then compared.
    """
    hay = keep(hay)
    needles = keep(needles.withColumn("__n", F.least(F.length("needle"), F.lit(longest))))
    # at most ``longest`` numbers
    lengths = sorted(r["__n"] for r in needles.select("__n").distinct().collect())
    runs = lambda text, n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n)))
    some = lambda text, n: F.when(F.length(text) >= n, runs(text, n)).otherwise(F.array().cast("array<string>"))
    grams = hay.select("item_params", F.explode(F.array_distinct(F.flatten(F.array(*[some(F.col("item_params"), n) for n in lengths])))).alias("gram")) if lengths else hay.select("item_params", F.col("item_params").alias("gram")).limit(0)
    grams = keep(grams)
    spread = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    own = F.explode(F.when(F.col("__n") == longest, runs(F.col("needle"), longest)).otherwise(F.array("needle")))
    rarest = needles.select("needle", own.alias("gram")).join(spread, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("x"))
    met = rarest.where("x.df > 0").select("needle", "x.gram").join(grams, "gram").where(F.contains("item_params", "needle"))
    return met.select("item_params", "needle").join(needles.drop("__n"), "needle")
