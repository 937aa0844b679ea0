"""What clicks say about items: memory, document expansion, graph expansion, and training pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP_QUERIES = 30


def memory_scores(queries: DataFrame, train: DataFrame, items: DataFrame, bonus: float = 1.0) -> DataFrame:
    """(query_id, item_id, s): log1p of the clicks that the query's text gave a corpus item, and ``bonus`` times log1p of
    those from the query's location."""
    t = train.join(items.select("item_id"), "item_id", "left_semi")
    # one aggregation serves both counts
    by_loc = t.groupBy("query_norm", "item_id", F.col("search_location_id").alias("loc")).agg(F.count(F.lit(1)).alias("n"))
    by_text = by_loc.groupBy("query_norm", "item_id").agg(F.sum("n").alias("n"))
    q = queries.select("query_id", "query_norm", F.col("search_location_id").alias("loc"))
    j = q.join(by_text, "query_norm").join(by_loc.withColumnRenamed("n", "n_loc"), ["query_norm", "item_id", "loc"], "left")
    return j.select("query_id", "item_id", (F.log1p("n") + bonus * F.log1p(F.coalesce("n_loc", F.lit(0)))).alias("s"))


def top_queries(train: DataFrame, key: str = "item_id", top: int = TOP_QUERIES) -> DataFrame:
    """(item_id, query_norm, r): an item's most frequent query texts, ties by text; empty texts are none."""
    n = train.where("query_norm <> ''").groupBy(key, "query_norm").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "query_norm"))).where(F.col("r") <= top).select(key, "query_norm", "r")


def _joined(rows: DataFrame, key: str, order: list[str], text: str, out: str) -> DataFrame:
    got = F.array_sort(F.collect_list(F.struct(*order, text)))
    return rows.groupBy(key).agg(F.array_join(F.transform(got, lambda x: x[text]), " ").alias(out))


def expansion_texts(train: DataFrame, items: DataFrame, top: int = TOP_QUERIES) -> DataFrame:
    """(item_id, expansion): top queries of each corpus item joined by a space, most frequent first; else empty."""
    joined = _joined(top_queries(train, "item_id", top), "item_id", ["r"], "query_norm", "expansion")
    return items.select("item_id").join(joined, "item_id", "left").select("item_id", F.coalesce("expansion", F.lit("")).alias("expansion"))


def graph_expansion(near: DataFrame, texts: DataFrame, key: str = "vec_id") -> DataFrame:
    """(key, expansion): texts (other, text) of a vector's neighbours, most similar first; those without text are left out."""
    j = near.join(texts.where("text <> ''"), "other").select(key, F.col("r"), "text")
    return _joined(j, key, ["r"], "text", "expansion")


def train_pairs(train: DataFrame) -> DataFrame:
    """(query_norm, item_id, query): distinct pairs with the least raw text that normalises to the query."""
    return train.where("query_norm <> ''").groupBy("query_norm", "item_id").agg(F.min("search_query").alias("query"))


def negatives(pairs: DataFrame, items: DataFrame, n: int = 1, seed: int = 0) -> DataFrame:
    """(query_norm, item_id, negative, level, r): ``n`` other items for each pair, of the same location and category if
    there are any, else of the same category.

    Where the items of a group stand in md5 order, the negatives are those that follow the positive, round and round:
    a draw that is the same on every run, without meeting all items of the group.
    """
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), "item_id"))
    out = []
    base = items.select("item_id", F.col("item_location_id").alias("loc"), F.col("item_microcat_id").alias("mc"))
    for level, by in (("same", ["loc", "mc"]), ("mc", ["mc"])):
        w = Window.partitionBy(*by).orderBy(order, "item_id")
        placed = base.withColumn("at", F.row_number().over(w)).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy(*by)))
        steps = placed.where("size > 1").select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(n), (F.col("size") - 1).cast("int")))).alias("r"))
        steps = steps.withColumn("next", (F.col("at") - 1 + F.col("r")) % F.col("size") + 1)
        after = placed.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("at").alias("next"), F.col("item_id").alias("negative"))
        j = steps.join(after, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] + [steps["next"] == after["next"]])
        out.append(j.select("item_id", "negative", F.lit(level).alias("level"), "r"))
    same, wide = out
    both = same.union(wide.join(same.select("item_id").distinct(), "item_id", "left_anti"))
    return pairs.select("query_norm", "item_id").join(both, "item_id").select("query_norm", "item_id", "negative", "level", "r")
