"""Assembly: from clicks, items and queries to the fused ranking.

Every learned table takes the train slice that it may see as an argument. Components are written once, as several
channels and every trial of a search read them: a ranking's plan begins at their scans. A term of weight 0 is never joined.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import doc_text
from ..operators import fusion, history, lexical, priors
from ..operators.fusion import Components
from ..sources.tables import cached
from ..sources.work import keep, together


@dataclass(frozen=True)
class Built:
    components: Components
    location_counts: DataFrame
    centroids: DataFrame
    shares: DataFrame
    filters: DataFrame


def indexed(items: DataFrame) -> DataFrame:
    """``items`` with ``idx``, an order key of the corpus: the id itself, so that no window runs over the corpus."""
    return items.withColumn("idx", F.col("item_id"))


def build(train: DataFrame, items: DataFrame, queries: DataFrame, fields: Sequence[dict], keys: Sequence[str], key_weights: Mapping[str, float], noise: Sequence[str] = (), fallback: str = "self", match: str = "pair", memory_bonus: float = 1.0, vectors: tuple[DataFrame, DataFrame] | None = None, sources: Mapping[str, tuple[str, DataFrame]] | None = None, cache: tuple[str, object] | None = None, terms: Sequence[str] | None = None) -> Built:
    """All components for ``queries`` from the slice ``train``.

    ``vectors``: of texts (query_norm, vec) and items (item_id, vec). ``sources``: further lexical terms by name, as (analyzer,
    documents (item_id, text)): titles alone, or texts expanded by clicks or by a graph, each with an idf of its own.
    ``cache``: a folder and what the cosines depend on (data and settings); cosines made under it before are read.
    Without it, cosines stay sources until they are asked for: rankings make them where items are read. ``terms``: the lexical terms
    that are made, all if None. The three tables are read several times, so a caller keeps those that are not cheap to make.
    """
    it = indexed(items)
    q_locs, i_locs = queries.select(F.col("search_location_id").alias("search_loc")).distinct(), items.select(F.col("item_location_id").alias("item_loc")).distinct()
    mcs = items.select(F.col("item_microcat_id").alias("mc")).where("mc is not null").distinct()
    i = it.select("item_id", "idx", F.col("item_location_id").alias("loc"), F.col("item_microcat_id").alias("mc"), F.coalesce("item_infm_params_text", F.lit("")).alias("item_params"))
    listed = i
    counts, texts, docs, i, dist, n_mc = together(
        lambda: keep(priors.location_counts(train)),
        lambda: keep(queries.select("query_norm").distinct()),
        lambda: keep(items.select("item_id", doc_text(fields, noise).alias("text"))),
        lambda: keep(listed),
        lambda: keep(priors.category_distribution(train, mcs)),
        mcs.count,
    )
    n_docs = docs.count()

    def contexts() -> tuple[DataFrame, DataFrame, DataFrame]:
        shares = keep(priors.self_share(counts, q_locs, i_locs))
        q = queries.join(shares.select(F.col("search_loc").alias("search_location_id"), "is_agg"), "search_location_id", "left").select("query_id", "query_norm", F.col("search_location_id").alias("loc"), F.coalesce("search_infm_params_text", F.lit("")).alias("params"), F.coalesce("is_agg", F.lit(True)).alias("is_agg"))
        q = keep(q)
        return shares, q, keep(priors.filter_bonus(q.select("params"), i.select("item_params"), keys, key_weights, match))

    lexicals = {"char": ("char", docs), "word": ("word", docs)} | dict(sources or {})

    lexicals = {n: x for n, x in lexicals.items() if terms is None or n in terms}

    def cosines(name: str) -> DataFrame | lexical.Source:
        # distinct query texts meet the corpus once, however many queries share them
        analyzer, own = lexicals[name]
        args = (texts, own, "query_norm", "query_norm", "item_id", "text", analyzer, n_docs)
        if cache is None:
            return lexical.source(*args)
        cos = cached(texts.sparkSession, cache[0], f"cos-{name}", [cache[1], analyzer], lambda: lexical.text_cosine(*args))
        return cos.select(F.col("q").alias("query_norm"), F.col("d").alias("item_id"), F.col("cos").alias(name))

    def vectored() -> tuple[DataFrame, ...] | None:
        return tuple(keep(v) for v in vectors) if vectors else None

    (shares, q, filters), loc_p, mc_p, dense, *cos = together(
        contexts,
        lambda: keep(priors.location_prior(counts, q_locs, i_locs, fallback)),
        lambda: keep(priors.category_prior(texts, dist)),
        vectored,
        *[lambda n=n: cosines(n) for n in lexicals],
    )
    pairs = {"memory": history.memory_scores(queries, train, items, memory_bonus).withColumnRenamed("s", "memory")}
    made = dict(zip(lexicals, cos, strict=True))
    c = Components(q, i, loc_p, mc_p, n_mc, made if cache is not None else lexical.Sources(made), pairs, filters, dense)
    return Built(c, counts, priors.location_centroids(items, counts), shares, filters)


def rank_channels(c: Components, channels: Mapping[str, Mapping[str, float]], depth: int) -> dict[str, DataFrame]:
    """Each channel's ranking to ``depth``, by its own weights, written once; those that items are met for together read them once."""
    apart = {n: w for n, w in channels.items() if not fusion.meets_items(c, w)}
    joint = {n: w for n, w in channels.items() if n not in apart}
    made = together(*[lambda w=w: keep(fusion.topk_linear(c, w, depth)) for w in apart.values()], *([lambda: fusion.topk_channels(c, joint, depth)] if joint else []))
    out = dict(zip(apart, made, strict=False)) | (made[-1] if joint else {})
    return {n: out[n] for n in channels}
