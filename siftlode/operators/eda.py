"""Aggregates that describe a click log, its queries and its corpus."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_filter, parse_filters, words
from .splits import CONTEXT


def distincts(train: DataFrame) -> DataFrame:
    """One row: distinct raw texts, normalised texts and contexts (null is a value)."""
    whole = F.struct(*CONTEXT)
    return train.agg(F.countDistinct("search_query").alias("n_raw"), F.countDistinct("query_norm").alias("n_norm"), F.countDistinct(whole).alias("n_groups"))


def seen_memory(queries: DataFrame, train: DataFrame) -> DataFrame:
    """One row: queries whose text is in train, whose (text, location) is, and whose text has corpus clicks."""
    pair = train.select("query_norm", "search_location_id").distinct().withColumn("__p", F.lit(1))
    text = train.groupBy("query_norm").agg(F.max(F.col("in_corpus").cast("int")).alias("__m"))
    j = queries.join(text, "query_norm", "left").join(pair, ["query_norm", "search_location_id"], "left")
    return j.agg(F.count(F.lit(1)).alias("n"), F.count("__m").alias("n_seen"), F.count("__p").alias("n_seen_loc"), F.sum(F.coalesce("__m", F.lit(0))).alias("n_memory"))


def location_match(train: DataFrame) -> DataFrame:
    """One row: shares of clicks inside the search location, with delivery, and of category 0."""
    share = lambda c, n: F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias(n)
    return train.agg(share(F.col("search_location_id") == F.col("item_location_id"), "same_loc"), share(F.col("search_is_delivery_search") == 1, "delivery"), share(F.col("search_category") == 0, "category_0"))


def filter_keys(train: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(key, n, share, pair_rate, value_rate): clicks whose filter has the key, their share of filtered clicks, and how
    often the clicked item's parameters hold "key value" and "value". Distinct combinations are looked at once."""
    n = train.where(has_filter(F.col("search_infm_params_text"))).groupBy("search_infm_params_text", "item_infm_params_text").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    f = n.select("n", F.coalesce("item_infm_params_text", F.lit("")).alias("p"), F.explode(F.array_distinct(parse_filters(F.col("search_infm_params_text"), keys))).alias("f")).select("n", "p", "f.key", "f.value").where("value <> ''")
    hit = lambda needle: F.sum(F.when(F.contains("p", needle), F.col("n")).otherwise(0)) / F.sum("n")
    g = f.groupBy("key").agg(F.sum("n").alias("n"), hit(F.concat_ws(" ", "key", "value")).alias("pair_rate"), hit(F.col("value")).alias("value_rate"))
    return g.crossJoin(F.broadcast(total)).select("key", "n", (F.col("n") / F.col("total")).alias("share"), "pair_rate", "value_rate")


def unknown_prefix_share(train: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: the share of filters that do not begin with a known key."""
    starts = F.lit(False)
    for k in keys:
        starts = starts | F.startswith("search_infm_params_text", F.lit(k))
    return train.where(has_filter(F.col("search_infm_params_text"))).agg(F.avg((~starts).cast("double")).alias("unknown_share"))


def main_category_share(train: DataFrame) -> DataFrame:
    """One row: of texts' clicks, the share in the text's commonest category, over clicks (micro) and over texts (macro)."""
    n = train.where("item_microcat_id is not null").groupBy("query_norm", "item_microcat_id").agg(F.count(F.lit(1)).alias("n"))
    t = n.groupBy("query_norm").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    return t.agg((F.sum("top") / F.sum("n")).alias("micro"), F.avg(F.col("top") / F.col("n")).alias("macro"))


def clipped_histogram(a: DataFrame, b: DataFrame, text: str = "query_norm", most: int = 10) -> DataFrame:
    """(length, share_a, share_b): shares of word counts, those over ``most`` counted there, of two tables side by side."""

    def one(rows: DataFrame, name: str) -> DataFrame:
        n = rows.groupBy(F.least(F.size(words(F.col(text))), F.lit(most)).alias("length")).agg(F.count(F.lit(1)).alias("n"))
        return n.select("length", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).alias(name))

    return one(a, "share_a").join(one(b, "share_b"), "length", "full").na.fill(0.0, ["share_a", "share_b"])


def location_shares(a: DataFrame, b: DataFrame, key: str = "search_location_id") -> DataFrame:
    """(key, share_a, share_b): shares of two tables' rows by key, 0 where one has none."""

    def one(rows: DataFrame, name: str) -> DataFrame:
        n = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select(key, (F.col("n") / F.col("total")).alias(name))

    return one(a, "share_a").join(one(b, "share_b"), key, "full").na.fill(0.0, ["share_a", "share_b"])


def top_locations(a: DataFrame, b: DataFrame, n: int, key: str = "search_location_id") -> DataFrame:
    """The ``n`` largest of ``a``, with their shares of both."""
    return location_shares(a, b, key).orderBy(F.desc("share_a"), key).limit(n)


def share_correlation(a: DataFrame, b: DataFrame, key: str = "search_location_id") -> DataFrame:
    """One row: Pearson correlation of the two tables' shares."""
    return location_shares(a, b, key).agg(F.corr("share_a", "share_b").alias("corr"), F.count(F.lit(1)).alias("n"))


def multi_context(train: DataFrame) -> DataFrame:
    """One row: the share of texts that are searched in more than one context, and that of their clicks."""
    g = train.groupBy(*CONTEXT).agg(F.count(F.lit(1)).alias("n"))
    t = g.groupBy("query_norm").agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("n"))
    many = F.col("contexts") > 1
    return t.agg(F.avg(many.cast("double")).alias("text_share"), (F.sum(F.when(many, F.col("n")).otherwise(0)) / F.sum("n")).alias("click_share"))


def items_per_group(train: DataFrame, keys: Sequence[str] = CONTEXT) -> DataFrame:
    """One row: distinct items of a context: mean, 90 % point, share with one."""
    g = train.groupBy(*keys).agg(F.countDistinct("item_id").alias("n"))
    return g.agg(F.avg("n").alias("mean"), F.percentile("n", F.lit(0.9)).alias("p90"), F.avg((F.col("n") == 1).cast("double")).alias("share_1"))


@dataclass(frozen=True)
class Fact:
    """A number that is expected, with what it was found to be."""

    name: str
    expected: float
    found: float
    abs_tol: float = 0.0
    rel_tol: float = 0.0

    @property
    def ok(self) -> bool:
        return abs(self.found - self.expected) <= max(self.abs_tol, self.rel_tol * abs(self.expected))


def id_check(rows: DataFrame, column: str, pattern: str) -> DataFrame:
    """One row: n, nulls, bad (not null, other than the pattern), repeats."""
    c = F.col(column)
    return rows.agg(F.lit(column).alias("column"), F.count(F.lit(1)).alias("n"), F.sum(c.isNull().cast("long")).alias("nulls"), F.sum(F.coalesce(~c.rlike(pattern), F.lit(False)).cast("long")).alias("bad"), (F.count(c) - F.countDistinct(c)).alias("repeats"))


def share(condition: Column) -> Column:
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))
