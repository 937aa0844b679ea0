"""Queries over clicks, items and queries: priors, history, fusion, pools, splits, metrics and descriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import clusters, dense, eda, fusion, history, listwise, metrics, pool, postings, priors, splits, study, tune
from ..sources import tables
from ..sources.work import keep, together
from . import recipe
from .mapping import FIELDS, KEY_WEIGHTS, KEYS, NOISE, Frames, frames, queries_of, vectors
from .registry import ORACLE, register
from .text_queries import ALL, NORM, sql, tfidf_ctes

W = fusion.WEIGHTS
N_UNSEEN, N_SEEN, SEED = 20, 10, 42
#: The fusions' channels, and the pool's: each source with the priors and the filter.
BASE = {n: W[n] for n in ("loc", "mc", "filter")}
CHANNELS = {"final": W, "char": {"char": 1.0}, "priors": {"loc": 0.067, "mc": 0.012}} | {f"p_{n}": {n: 1.0} | BASE for n in ("char", "word", "dense")}
DEPTH = pool.DEPTH


def r6(c):
    return F.round(c, 6)


def built(spark, sf_dir, terms=None, dense=True):
    """The recipe's parts; only the lexical ``terms`` (all if None), and vectors if ``dense``."""
    f = frames(spark, sf_dir)
    train = keep(f.train)
    items, queries = together(lambda: keep(f.items), lambda: keep(queries_of(train)))
    f = Frames(train, items, queries)
    return f, recipe.build(f.train, f.items, f.queries, FIELDS, KEYS, KEY_WEIGHTS, NOISE, vectors=vectors(spark, sf_dir, f) if dense else None, terms=terms)


# ---- checks, priors ----------------------------------------------------------------------------------------------

ALL |= {
    "lc": ("SELECT search_location_id AS search_loc, item_location_id AS item_loc, count(*) AS n FROM train GROUP BY ALL", ["train"]),
    "ilocs": ("SELECT DISTINCT item_location_id AS item_loc FROM items", ["items"]),
    "qlocs": ("SELECT DISTINCT search_location_id AS search_loc FROM queries", ["queries"]),
    "locp": ("SELECT search_loc, item_loc, n / t AS p FROM (SELECT *, sum(n) OVER (PARTITION BY search_loc) AS t FROM lc) SEMI JOIN ilocs USING (item_loc) SEMI JOIN qlocs USING (search_loc)", ["lc", "ilocs", "qlocs"]),
    "cent0": ("SELECT item_location_id AS loc, median(item_latitude) AS lat, median(item_longitude) AS lon FROM items GROUP BY 1", ["items"]),
    "cent": ("SELECT * FROM cent0 UNION ALL SELECT search_loc AS loc, sum(n * coalesce(lat, 0)) / sum(n) AS lat, sum(n * coalesce(lon, 0)) / sum(n) AS lon FROM lc JOIN cent0 ON item_loc = cent0.loc WHERE search_loc NOT IN (SELECT loc FROM cent0) GROUP BY 1", ["lc", "cent0"]),
    "share": ("SELECT q.search_loc, CASE WHEN i.item_loc IS NOT NULL THEN coalesce(s, 0) ELSE 0 END AS self_share FROM qlocs q LEFT JOIN (SELECT search_loc, sum(CASE WHEN search_loc = item_loc THEN n ELSE 0 END) / sum(n) AS s FROM lc GROUP BY 1) USING (search_loc) LEFT JOIN ilocs i ON q.search_loc = i.item_loc", ["qlocs", "lc", "ilocs"]),
    "mcs": ("SELECT DISTINCT item_microcat_id AS mc FROM items", ["items"]),
    "mcd": ("SELECT query_norm, mc, n / sum(n) OVER (PARTITION BY query_norm) AS p FROM (SELECT query_norm, item_microcat_id AS mc, count(*) AS n FROM train SEMI JOIN mcs ON item_microcat_id = mc WHERE query_norm <> '' GROUP BY ALL)", ["train", "mcs"]),
    "mctexts": ("SELECT DISTINCT query_norm FROM mcd", ["mcd"]),
}
ALL |= tfidf_ctes("mccos", "mctexts", "query_norm", "query_norm", "qtexts", "query_norm", "query_norm", "char", 2, 4, unseen=False)
ALL |= {
    "mcnear": (f"SELECT * FROM (SELECT q, d, pow(greatest(round_even(cos, 5), 0), {priors.KNN_POWER}) AS w, row_number() OVER (PARTITION BY q ORDER BY round_even(cos, 5) DESC, d) AS r FROM mccos) WHERE r <= {priors.KNN}", ["mccos"]),
    "mcp": ("SELECT q AS query_norm, mc, sum(w * p) / any_value(t) AS p FROM (SELECT *, sum(w) OVER (PARTITION BY q) AS t FROM mcnear) JOIN mcd ON d = query_norm WHERE t > 0 GROUP BY ALL", ["mcnear", "mcd"]),
    "bonus": ("""SELECT q.params, i.item_infm_params_text AS item_params, sum(CASE key WHEN 'Type' THEN 0.7 ELSE 0.3 END::DOUBLE) AS bonus, string_agg(key, ',' ORDER BY key) AS hits
        FROM (SELECT DISTINCT params, key, value FROM parsed WHERE params IN (SELECT search_infm_params_text FROM queries) AND value <> '') q
        JOIN (SELECT DISTINCT item_infm_params_text FROM items) i ON contains(i.item_infm_params_text, q.key || ' ' || q.value) GROUP BY ALL""", ["parsed", "queries", "items"]),
    "memory": ("""SELECT q.query_id, t.item_id, ln(1 + t.n) + ln(1 + coalesce(l.n, 0)) AS s FROM queries q JOIN (SELECT query_norm, item_id, count(*) AS n FROM train WHERE in_corpus GROUP BY ALL) t USING (query_norm)
        LEFT JOIN (SELECT query_norm, item_id, search_location_id, count(*) AS n FROM train WHERE in_corpus GROUP BY ALL) l ON l.query_norm = q.query_norm AND l.item_id = t.item_id AND l.search_location_id = q.search_location_id""", ["queries", "train"]),
    "vcos": ("""SELECT query_norm, b.vec_id AS y, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cos FROM (SELECT DISTINCT query_norm, ('0x' || substr(md5(query_norm), 1, 4))::BIGINT % (SELECT count(*) FROM embeddings) AS x FROM queries)
        JOIN embeddings a ON a.vec_id = x CROSS JOIN embeddings b""", ["queries"]),
    "pairs": (f"""SELECT q.query_id, q.query_norm, q.search_location_id AS loc, i.item_id, i.item_location_id AS item_loc, i.item_microcat_id AS item_mc,
        coalesce(c.cos, 0) AS char, coalesce(w.cos, 0) AS word, v.cos AS dense, coalesce(b.bonus, 0) AS filter, coalesce(l.p, 0) AS loc_p,
        CASE WHEN k.query_norm IS NULL THEN 1.0 / (SELECT count(*) FROM mcs) ELSE coalesce(m.p, 0) END AS mc_p, s.self_share < 0.5 AS is_agg
        FROM queries q CROSS JOIN items i JOIN vcos v ON v.query_norm = q.query_norm AND v.y = i.item_vec % (SELECT count(*) FROM embeddings) LEFT JOIN char c ON c.q = q.query_norm AND c.d = i.item_id LEFT JOIN word w ON w.q = q.query_norm AND w.d = i.item_id
        LEFT JOIN bonus b ON b.params = q.search_infm_params_text AND b.item_params = i.item_infm_params_text LEFT JOIN locp l ON l.search_loc = q.search_location_id AND l.item_loc = i.item_location_id
        LEFT JOIN mcp m ON m.query_norm = q.query_norm AND m.mc = i.item_microcat_id LEFT JOIN (SELECT DISTINCT query_norm FROM mcp) k ON k.query_norm = q.query_norm LEFT JOIN share s ON s.search_loc = q.search_location_id""", ["queries", "items", "vcos", "char", "word", "bonus", "locp", "mcp", "mcs", "share"]),
}


def score_sql(weights, masked=None):
    parts = [f"{w} * ln(loc_p + {fusion.LOC_EPS})" if n == "loc" else f"{w} * ln(mc_p + {fusion.MC_EPS})" if n == "mc" else f"{w} * {n}" for n, w in weights.items() if not n.endswith("_agg")]
    for i, n in enumerate([n for n in weights if not n.endswith("_agg")]):
        if f"{n}_agg" in weights:
            parts[i] = parts[i].replace(f"{weights[n]} *", f"(CASE WHEN is_agg THEN {weights[f'{n}_agg']} ELSE {weights[n]} END) *", 1)
    s = " + ".join(f"({p})" for p in parts)
    return s if masked is None else f"CASE WHEN loc_p < {masked} THEN {fusion.MASKED} ELSE {s} END"


def top_terms_sql(weights, k):
    """The best pairs with all their terms: one pass over the pairs."""
    return f"SELECT * FROM (SELECT *, {score_sql(weights)} AS score FROM pairs) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round_even(score, 5) DESC, item_id) <= {k}"


def top_sql(weights, k, masked=None):
    return f"SELECT query_id, item_id, rank, score FROM (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round_even(score, 5) DESC, item_id) AS rank FROM (SELECT query_id, item_id, {score_sql(weights, masked)} AS score FROM pairs)) WHERE rank <= {k}"


for _n, _w in CHANNELS.items():
    ALL[f"deep_{_n}"] = (top_sql(_w, DEPTH), ["pairs"])
    ALL[f"top_{_n}"] = (f"SELECT * FROM deep_{_n} WHERE rank <= 50", [f"deep_{_n}"])


def ranks(top):
    return top.select("query_id", "item_id", F.col("rank").cast("long").alias("rank"))


@register("check_ids", sql("""SELECT 'items' AS t, count(*) AS n, count(*) - count(item_id) AS nulls, count(*) FILTER (NOT regexp_matches(item_id, '^[0-9a-f]{16}$')) AS bad, count(item_id) - count(DISTINCT item_id) AS repeats FROM items
    UNION ALL SELECT 'train', count(*), count(*) - count(item_id), count(*) FILTER (NOT regexp_matches(item_id, '^[0-9a-f]{16}$')), count(item_id) - count(DISTINCT item_id) FROM train
    UNION ALL SELECT 'queries', count(*), count(*) - count(query_id), count(*) FILTER (NOT regexp_matches(query_id, '^[0-9A-Za-z]{16}$')), count(query_id) - count(DISTINCT query_id) FROM queries""", "items", "train", "queries"))  # fmt: skip
def check_ids(spark, sf_dir):
    f = frames(spark, sf_dir)
    out = [eda.id_check(rows, col, pat).withColumn("t", F.lit(name)) for name, rows, col, pat in (("items", f.items, "item_id", tables.HEX16), ("train", f.train, "item_id", tables.HEX16), ("queries", f.queries, "query_id", tables.BASE62_16))]
    return out[0].union(out[1]).union(out[2]).select("t", "n", "nulls", "bad", "repeats")


@register("loc_transition_counts", sql("SELECT * FROM lc", "lc"))
def loc_transition_counts(spark, sf_dir):
    return priors.location_counts(frames(spark, sf_dir).train)


def _locs(f):
    return f.queries.select(F.col("search_location_id").alias("search_loc")).distinct(), f.items.select(F.col("item_location_id").alias("item_loc")).distinct()


@register("loc_prior", sql("SELECT search_loc, item_loc, round(p, 6) AS p FROM locp", "locp"))
def loc_prior(spark, sf_dir):
    f = frames(spark, sf_dir)
    return priors.location_prior(priors.location_counts(f.train), *_locs(f)).select("search_loc", "item_loc", r6("p").alias("p"))


# locations 0 to 29 ask, of which 25 and more are unknown to both clicks and corpus
@register("loc_prior_fallback", sql("""SELECT search_loc, item_loc, round(p, 6) AS p FROM locp UNION ALL
    SELECT s, item_loc, round(1.0 / (SELECT count(*) FROM ilocs), 6) FROM (SELECT unnest(range(25, 30))::INT AS s) CROSS JOIN ilocs""", "locp"))  # fmt: skip
def loc_prior_fallback(spark, sf_dir):
    f = frames(spark, sf_dir)
    q, i = _locs(f)
    more = spark.range(25, 30).select(F.col("id").cast("int").alias("search_loc"))
    return priors.location_prior(priors.location_counts(f.train), q.union(more), i).select("search_loc", "item_loc", r6("p").alias("p"))


@register("loc_centroid", sql("SELECT loc, round(lat, 6) AS lat, round(lon, 6) AS lon FROM cent", "cent"))
def loc_centroid(spark, sf_dir):
    f = frames(spark, sf_dir)
    return priors.location_centroids(f.items, priors.location_counts(f.train)).select("loc", r6("lat").alias("lat"), r6("lon").alias("lon"))


@register("loc_self_share", sql("SELECT search_loc, round(self_share, 6) AS self_share, self_share < 0.5 AS is_agg FROM share", "share"))
def loc_self_share(spark, sf_dir):
    f = frames(spark, sf_dir)
    return priors.self_share(priors.location_counts(f.train), *_locs(f)).select("search_loc", r6("self_share").alias("self_share"), "is_agg")


@register("loc_geo_smooth", sql("""SELECT k.search_loc, k.item_loc, round((coalesce(n, 0) + 5.0 * k.k / greatest(sum(k.k) OVER (PARTITION BY k.search_loc), 1e-12)) / (coalesce(t, 0) + 5.0), 6) AS p FROM
    (SELECT q.search_loc, w.item_loc, w.w * coalesce(exp(-2 * 6371.0 * asin(sqrt(greatest(0, least(1, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))) / 300.0), 1) AS k
     FROM qlocs q LEFT JOIN cent a ON a.loc = q.search_loc CROSS JOIN (SELECT item_location_id AS item_loc, count(*) AS w FROM items GROUP BY 1) w LEFT JOIN cent b ON b.loc = w.item_loc) k
    LEFT JOIN lc USING (search_loc, item_loc) LEFT JOIN (SELECT search_loc, sum(n) AS t FROM lc GROUP BY 1) USING (search_loc)""", "qlocs", "cent", "items", "lc"))  # fmt: skip
def loc_geo_smooth(spark, sf_dir):
    f = frames(spark, sf_dir)
    n = priors.location_counts(f.train)
    return priors.geo_smoothed(n, priors.location_centroids(f.items, n), _locs(f)[0], f.items, 300.0, 5.0).select("search_loc", "item_loc", r6("p").alias("p"))


def _mcs(f):
    return f.items.select(F.col("item_microcat_id").alias("mc")).distinct()


@register("mc_text_dist", sql("SELECT query_norm, mc, round(p, 6) AS p FROM mcd", "mcd"))
def mc_text_dist(spark, sf_dir):
    f = frames(spark, sf_dir)
    return priors.category_distribution(f.train, _mcs(f)).select("query_norm", "mc", r6("p").alias("p"))


@register("mc_knn_prior", sql("SELECT query_norm, mc, round(p, 6) AS p FROM mcp", "mcp"))
def mc_knn_prior(spark, sf_dir):
    f = frames(spark, sf_dir)
    return priors.category_prior(f.queries.select("query_norm"), priors.category_distribution(f.train, _mcs(f))).select("query_norm", "mc", r6("p").alias("p"))


@register("filter_bonus", sql("SELECT params, item_params, round(bonus, 6) AS bonus, hits FROM bonus", "bonus"))
def filter_bonus(spark, sf_dir):
    f = frames(spark, sf_dir)
    b = priors.filter_bonus(f.queries.select(F.col("search_infm_params_text").alias("params")), f.items.select(F.col("item_infm_params_text").alias("item_params")), KEYS, KEY_WEIGHTS)
    return b.select("params", "item_params", r6("bonus").alias("bonus"), F.array_join("hits", ",").alias("hits"))


# ---- history -----------------------------------------------------------------------------------------------------


@register("memory_scores", sql("SELECT query_id, item_id, round(s, 6) AS s FROM memory", "memory"))
def memory_scores(spark, sf_dir):
    f = frames(spark, sf_dir)
    return history.memory_scores(f.queries, f.train, f.items).select("query_id", "item_id", r6("s").alias("s"))


ALL["topq"] = ("SELECT * FROM (SELECT item_id, query_norm, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, query_norm) AS r FROM (SELECT item_id, query_norm, count(*) AS n FROM train WHERE query_norm <> '' GROUP BY ALL)) WHERE r <= 30", ["train"])


@register("doc_expansion", sql("SELECT i.item_id, coalesce(string_agg(query_norm, ' ' ORDER BY r), '') AS expansion FROM items i LEFT JOIN topq USING (item_id) GROUP BY i.item_id", "items", "topq"))
def doc_expansion(spark, sf_dir):
    f = frames(spark, sf_dir)
    return history.expansion_texts(f.train, f.items)


ALL["expanded"] = ("SELECT i.item_id, coalesce(string_agg(query_norm, ' ' ORDER BY r), '') AS text FROM items i LEFT JOIN topq USING (item_id) GROUP BY i.item_id", ["items", "topq"])
ALL["titles"] = ("SELECT item_id, " + NORM.format("item_title_raw") + " AS text FROM items", ["items"])
ALL |= tfidf_ctes("xword", "expanded", "item_id", "text", "qtexts", "query_norm", "query_norm", "word", 1, 2)
ALL |= tfidf_ctes("tchar", "titles", "item_id", "text", "qtexts", "query_norm", "query_norm", "char", 3, 5)


def _source(spark, sf_dir, name, analyzer, docs):
    """A further lexical term of the recipe."""
    f = frames(spark, sf_dir)
    train = keep(f.train)
    f = Frames(train, keep(f.items), keep(queries_of(train)))
    b = recipe.build(f.train, f.items, f.queries, FIELDS, KEYS, KEY_WEIGHTS, NOISE, sources={name: (analyzer, docs(f))}, terms=(name,))
    return b.components.texts[name].join(f.queries.select("query_id", "query_norm"), "query_norm").select("query_id", "item_id", r6(name).alias("cos"))


@register("expansion_source", sql("SELECT query_id, d AS item_id, round(cos, 6) AS cos FROM xword JOIN queries ON q = query_norm", "xword", "queries"))
def expansion_source(spark, sf_dir):
    return _source(spark, sf_dir, "expansion", "word", lambda f: history.expansion_texts(f.train, f.items).withColumnRenamed("expansion", "text"))


@register("title_source", sql("SELECT query_id, d AS item_id, round(cos, 6) AS cos FROM tchar JOIN queries ON q = query_norm", "tchar", "queries"))
def title_source(spark, sf_dir):
    return _source(spark, sf_dir, "title", "char", lambda f: f.items.select("item_id", tx.doc_text([{"col": "item_title_raw"}]).alias("text")))


@register("train_pairs", sql("SELECT query_norm, item_id, min(search_query) AS query FROM train WHERE query_norm <> '' GROUP BY ALL", "train"))
def train_pairs(spark, sf_dir):
    return history.train_pairs(frames(spark, sf_dir).train)


def _negatives_sql(n):
    def level(name, by):
        same = " AND ".join(f"a.{b} IS NOT DISTINCT FROM b.{b}" for b in by)
        return f"""SELECT a.item_id, b.item_id AS negative, '{name}' AS level, r.r FROM p_{name} a CROSS JOIN (SELECT unnest(range(1, {n} + 1)) AS r) r JOIN p_{name} b ON {same} AND b.at = (a.at - 1 + r.r) % a.size + 1 WHERE a.size > 1 AND r.r <= a.size - 1"""

    place = lambda by: f"SELECT item_id, item_location_id AS loc, item_microcat_id AS mc, row_number() OVER (PARTITION BY {by} ORDER BY md5('0:' || item_id), item_id) AS at, count(*) OVER (PARTITION BY {by}) AS size FROM items"
    return f"""WITH p_same AS ({place("item_location_id, item_microcat_id")}), p_mc AS ({place("item_microcat_id")}), s AS ({level("same", ["loc", "mc"])}), m AS ({level("mc", ["mc"])}),
        neg AS (SELECT * FROM s UNION ALL SELECT * FROM m WHERE item_id NOT IN (SELECT item_id FROM s))
        SELECT query_norm, item_id, negative, level, r FROM (SELECT DISTINCT query_norm, item_id FROM train WHERE query_norm <> '') JOIN neg USING (item_id)"""


@register("hard_negatives", sql(f"SELECT query_norm, item_id, negative, level FROM ({_negatives_sql(1)})", "items", "train"))
def hard_negatives(spark, sf_dir):
    f = frames(spark, sf_dir)
    return history.negatives(history.train_pairs(f.train), f.items).select("query_norm", "item_id", "negative", "level")


@register("ce_negatives", sql(f"SELECT query_norm, item_id, negative, level, r FROM ({_negatives_sql(3)})", "items", "train"))
def ce_negatives(spark, sf_dir):
    f = frames(spark, sf_dir)
    return history.negatives(history.train_pairs(f.train), f.items, 3).withColumn("r", F.col("r").cast("long"))


ALL["knn"] = ("""SELECT vec_id, other, sim, r FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round_even(sim, 5) DESC, other) AS r FROM
    (SELECT a.vec_id, b.vec_id AS other, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)) WHERE r <= 5 AND sim >= 0.2""", [])  # fmt: skip


def _knn(spark, sf_dir):
    return dense.knn(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 5, 0.2)


@register("graph_knn", sql("SELECT vec_id, other, round(sim, 6) AS sim, r FROM knn", "knn"))
def graph_knn(spark, sf_dir):
    return _knn(spark, sf_dir).select("vec_id", "other", r6("sim").alias("sim"), F.col("r").cast("long").alias("r"))


@register("graph_expansion", sql("SELECT vec_id, string_agg(text, ' ' ORDER BY r) AS expansion FROM knn JOIN (SELECT item_id AS other, text FROM nbench WHERE text <> '') USING (other) GROUP BY vec_id", "knn", "nbench"))
def graph_expansion(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("other"), tx.normalize(F.col("text")).alias("text"))
    return history.graph_expansion(_knn(spark, sf_dir), b)


@register("dense_topk", sql("""SELECT query_id, item_id, rank, round(cos, 6) AS cos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round_even(cos, 5) DESC, item_id) AS rank FROM
    (SELECT a.vec_id AS query_id, b.vec_id AS item_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cos FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 50 = 0)) WHERE rank <= 50"""))  # fmt: skip
def dense_topk(spark, sf_dir):
    """Queries: every vector whose id is divisible by 50, against all vectors."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    q = e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return dense.topk(q, e.withColumnRenamed("vec_id", "item_id"), 50).select("query_id", "item_id", F.col("rank").cast("long").alias("rank"), r6("cos").alias("cos"))


@register("cluster_topk", ORACLE["dense_topk"])
def cluster_topk(spark, sf_dir):
    """``dense_topk`` over clusters, cells that cannot reach a query's 50th best left out."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    found = clusters.search(clusters.fit(e, "vec_id"), e.where("vec_id % 50 = 0"), 50, "vec_id")
    return found.top.select(F.col("q").alias("query_id"), F.col("d").alias("item_id"), F.col("rank").cast("long").alias("rank"), r6("cos").alias("cos"))


# ---- the stored index: short texts against the items, both analyzers in one search --------------------------------


def _index(spark, sf_dir):
    f = frames(spark, sf_dir)
    docs, texts = together(lambda: keep(f.items.select("item_id", tx.doc_text(FIELDS, NOISE).alias("text"))), lambda: keep(f.queries.select("query_norm").distinct()))
    index = postings.build(docs, "item_id", "text")
    return postings.search(index, texts.withColumn("text", F.col("query_norm")), 50, "query_norm", "text", {"char": W["char"], "word": W["word"]})


@register("index_topk", sql(f"""SELECT q AS query_norm, d AS item_id, rank, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round_even(s, 5) DESC, d) AS rank FROM
    (SELECT coalesce(c.q, w.q) AS q, coalesce(c.d, w.d) AS d, {W['char']} * coalesce(c.cos, 0) + {W['word']} * coalesce(w.cos, 0) AS s FROM char c FULL JOIN word w ON c.q = w.q AND c.d = w.d)) WHERE rank <= 50""", "char", "word"))  # fmt: skip
def index_topk(spark, sf_dir):
    return _index(spark, sf_dir).top.select(F.col("q").alias("query_norm"), F.col("d").alias("item_id"), F.col("rank").cast("long").alias("rank"), r6("score").alias("score"))


@register("index_work")
def index_work(spark, sf_dir):
    """Postings of each text's terms, and how many of them the search read; candidates found and completed."""
    return _index(spark, sf_dir).work.withColumnRenamed("q", "query_norm")


# ---- fusion ------------------------------------------------------------------------------------------------------


@register("linear_fusion", sql(f"SELECT query_id, count(*) AS n, round(sum(s), 3) AS total, max(round_even(s, 5)) AS best FROM (SELECT query_id, {score_sql(W)} AS s FROM pairs) GROUP BY query_id", "pairs"))
def linear_fusion(spark, sf_dir):
    _, b = built(spark, sf_dir)
    best = fusion.topk_linear(b.components, W, 1).select("query_id", F.bround("score", 5).alias("best"))
    return fusion.totals(b.components, W).join(best, "query_id").select("query_id", "n", F.round("total", 3).alias("total"), "best")


@register("topk_linear", sql("SELECT query_id, item_id, rank, round(score, 6) AS score FROM top_final", "top_final"))
def topk_linear(spark, sf_dir):
    _, b = built(spark, sf_dir)
    return fusion.topk_linear(b.components, W, 50).select("query_id", "item_id", F.col("rank").cast("long").alias("rank"), r6("score").alias("score"))


AGG = W | {"loc_agg": 0.02, "char_agg": 1.2}


@register("agg_weight_routing", sql(f"SELECT query_id, item_id, rank, round(score, 6) AS score FROM ({top_sql(AGG, 10)})", "pairs"))
def agg_weight_routing(spark, sf_dir):
    _, b = built(spark, sf_dir)
    return fusion.topk_linear(b.components, AGG, 10).select("query_id", "item_id", F.col("rank").cast("long").alias("rank"), r6("score").alias("score"))


@register("loc_mask", sql(f"SELECT query_id, item_id, rank, round(score, 6) AS score FROM ({top_sql(W, 10, 0.01)})", "pairs"))
def loc_mask(spark, sf_dir):
    _, b = built(spark, sf_dir)
    return fusion.topk_linear(b.components, W, 10, loc_min_p=0.01).select("query_id", "item_id", F.col("rank").cast("long").alias("rank"), r6("score").alias("score"))


@register("explain_contrib", sql(f"""SELECT query_id, item_id, round({W['char']} * char, 6) AS c_char, round({W['word']} * word, 6) AS c_word, round({W['dense']} * dense, 6) AS c_dense, round({W['filter']} * filter, 6) AS c_filter,
    round({W['loc']} * ln(loc_p + {fusion.LOC_EPS}), 6) AS c_loc, round({W['mc']} * ln(mc_p + {fusion.MC_EPS}), 6) AS c_mc, round(score, 6) AS score FROM ({top_terms_sql(W, 10)})""", "pairs"))  # fmt: skip
def explain_contrib(spark, sf_dir):
    _, b = built(spark, sf_dir)
    e = fusion.explain(fusion.topk_linear(b.components, W, 10), b.components, W)
    return e.select("query_id", "item_id", *[r6(c).alias(c) for c in ("c_char", "c_word", "c_dense", "c_filter", "c_loc", "c_mc", "score")])


def _tops(spark, sf_dir, names, depth=50, **parts):
    f, b = built(spark, sf_dir, **parts)
    return f, b, recipe.rank_channels(b.components, {n: CHANNELS[n] for n in names}, depth)


@register("rrf_fusion", sql("""SELECT query_id, item_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round_even(score, 12) DESC, item_id) AS rank FROM
    (SELECT query_id, item_id, sum(s) AS score FROM (SELECT query_id, item_id, 1.0::DOUBLE / (60 + rank) AS s FROM top_char UNION ALL SELECT query_id, item_id, 0.5::DOUBLE / (60 + rank) FROM top_priors) GROUP BY ALL)) WHERE rank <= 20""", "top_char", "top_priors"))  # fmt: skip
def rrf_fusion(spark, sf_dir):
    _, _, t = _tops(spark, sf_dir, ("char", "priors"), terms=("char",), dense=False)
    t = {n: x.withColumn("idx", F.col("item_id")) for n, x in t.items()}
    return fusion.rrf([(t["char"], 1.0), (t["priors"], 0.5)], 20).select("query_id", "item_id", F.col("rank").cast("long").alias("rank"), r6("score").alias("score"))


ALL["quota1"] = ("SELECT query_id, item_id, 0 AS step, rank AS r FROM top_char WHERE rank <= 12", ["top_char"])
ALL["quota2"] = ("SELECT * FROM (SELECT query_id, item_id, 1 AS step, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM top_priors ANTI JOIN quota1 USING (query_id, item_id)) WHERE r <= 5", ["top_priors", "quota1"])


@register("quota_fusion", sql("""SELECT query_id, item_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY step, r) AS rank FROM (SELECT * FROM quota1 UNION ALL SELECT * FROM quota2 UNION ALL
    SELECT query_id, item_id, 2, row_number() OVER (PARTITION BY query_id ORDER BY rank) FROM top_char ANTI JOIN (SELECT * FROM quota1 UNION ALL SELECT * FROM quota2) USING (query_id, item_id))) WHERE rank <= 20""", "quota1", "quota2", "top_char"))  # fmt: skip
def quota_fusion(spark, sf_dir):
    _, _, t = _tops(spark, sf_dir, ("char", "priors"), terms=("char",), dense=False)
    return ranks(fusion.quota([(t["char"], 12), (t["priors"], 5)], 20))


ALL["shortlist"] = ("SELECT query_id, item_id, rank FROM top_char WHERE rank <= 3", ["top_char"])
ALL["popular"] = ("SELECT i.item_id, i.item_location_id AS loc, i.item_microcat_id AS mc, count(t.item_id) AS pop FROM items i LEFT JOIN train t USING (item_id) GROUP BY ALL", ["items", "train"])
ALL["guess"] = ("""SELECT q.query_id, l.best_loc, m.best_mc FROM queries q LEFT JOIN (SELECT search_loc, arg_max(item_loc, (p, -item_loc)) AS best_loc FROM locp GROUP BY 1) l ON l.search_loc = q.search_location_id
    LEFT JOIN (SELECT query_norm, arg_max(mc, (p, mc)) AS best_mc FROM mcp GROUP BY 1) m USING (query_norm)""", ["queries", "locp", "mcp"])  # fmt: skip
ALL["fillers"] = ("""SELECT query_id, item_id, 0 AS pool, rank AS r FROM shortlist
    UNION ALL SELECT query_id, item_id, 1, row_number() OVER (PARTITION BY query_id ORDER BY pop DESC, item_id) FROM guess JOIN popular ON loc = best_loc AND mc = best_mc
    UNION ALL SELECT query_id, item_id, 2, row_number() OVER (PARTITION BY query_id ORDER BY pop DESC, item_id) FROM guess JOIN popular ON loc = best_loc
    UNION ALL SELECT query_id, item_id, 3, r FROM queries CROSS JOIN (SELECT item_id, row_number() OVER (ORDER BY pop DESC, item_id) AS r FROM popular)""", ["shortlist", "guess", "popular", "queries"])  # fmt: skip


@register("backfill", sql("""SELECT query_id, item_id, rank FROM (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM
    (SELECT query_id, item_id, min(pool * 1000000 + r) AS place FROM fillers WHERE r <= 30 GROUP BY ALL)) WHERE rank <= 30""", "fillers"))  # fmt: skip
def backfill(spark, sf_dir):
    f, b = built(spark, sf_dir, ("char",), False)
    short = fusion.topk_linear(b.components, CHANNELS["char"], 3)
    return ranks(fusion.backfill(short, fusion.popularity_pools(b.components, f.train, 30), 30))


@register("answer_lists", sql("SELECT query_id, string_agg(item_id, ' ' ORDER BY rank) AS answer FROM top_final GROUP BY query_id", "top_final"))
def answer_lists(spark, sf_dir):
    _, b = built(spark, sf_dir)
    return pool.answer_lists(fusion.topk_linear(b.components, W, 50))


# answers that break some rules on purpose: parts as queries, ids of all parts
@register("answer_validate", sql("""SELECT * FROM (VALUES ('repeated_query', 0), ('query_length', 0), ('spacing', 0), ('too_many', 0), ('repeated_item', 0), ('not_hex', 0)) AS t(rule, n)
    UNION ALL SELECT 'unknown_query', 0 UNION ALL SELECT 'missing_query', 0
    UNION ALL SELECT 'not_in_corpus', count(*) FROM (SELECT query_id, unnest(ids) AS item_id FROM (SELECT query_norm, search_location_id, list(DISTINCT item_id ORDER BY item_id)[1:50] AS ids FROM train GROUP BY ALL) JOIN queries USING (query_norm, search_location_id)) ANTI JOIN items USING (item_id)""", "train", "queries", "items"))  # fmt: skip
def answer_validate(spark, sf_dir):
    f = frames(spark, sf_dir)
    a = f.train.groupBy("query_norm", "search_location_id").agg(F.slice(F.array_sort(F.collect_set("item_id")), 1, 50).alias("ids"))
    a = a.join(f.queries, ["query_norm", "search_location_id"]).select("query_id", F.array_join("ids", " ").alias("answer"))
    return tables.answer_problems(a, f.queries, f.items)


# ---- pools and features ------------------------------------------------------------------------------------------

ALL["clicked"] = ("SELECT DISTINCT query_id, item_id FROM train JOIN queries USING (query_norm, search_location_id)", ["train", "queries"])
POOLED = ("final", "p_char", "p_word", "p_dense")
ALL["pool"] = ("SELECT query_id, item_id, " + ", ".join(f"coalesce(min(rank) FILTER (c = '{n}'), {DEPTH + 1}) AS rank_{n}" for n in POOLED) + " FROM (" + " UNION ALL ".join(f"SELECT query_id, item_id, '{n}' AS c, rank FROM deep_{n}" for n in POOLED) + ") GROUP BY ALL", [f"deep_{n}" for n in POOLED])


def _pool(spark, sf_dir):
    f, b, t = _tops(spark, sf_dir, POOLED, DEPTH)
    return f, b, keep(pool.build_pool(t, DEPTH))


@register("pool_union", sql("SELECT * FROM pool", "pool"))
def pool_union(spark, sf_dir):
    p = _pool(spark, sf_dir)[2]
    return p.select("query_id", "item_id", *[F.col(f"rank_{n}").cast("long").alias(f"rank_{n}") for n in POOLED])


MAIN_KEYS = tuple(KEY_WEIGHTS)
#: The 30 features of the final recipe.
FEATURES = (*pool.PAIR, *[f"filter_{k}" for k in MAIN_KEYS], *pool.ITEM, *pool.QUERY, "q_pool_size", *[f"rank_{n}" for n in POOLED])
ALL["qfeat"] = ("""SELECT q.query_id, len(list_filter(string_split(q.query_norm, ' '), lambda x: x <> ''))::DOUBLE AS q_words, (trim(search_infm_params_text) <> '')::INT::DOUBLE AS q_has_filter, (self_share < 0.5)::INT::DOUBLE AS q_is_agg, 1.0::DOUBLE AS q_seen,
    m.mx AS q_mc_max, m.h AS q_mc_entropy, self_share AS q_loc_self_share FROM queries q JOIN share s ON s.search_loc = q.search_location_id JOIN (SELECT query_norm, max(p) AS mx, sum(-p * ln(p + 1e-12)) AS h FROM mcp GROUP BY 1) m USING (query_norm)""", ["queries", "share", "mcp"])
ALL["ifeat"] = ("SELECT item_id, ln(1 + greatest(coalesce(item_price, 0), 0)) AS item_log_price, item_is_phone_hidden::INT::DOUBLE AS item_phone_hidden, item_is_message_forbidden::INT::DOUBLE AS item_msg_forbidden FROM items", ["items"])
_KM = "2 * 6371.0 * asin(sqrt(greatest(0, least(1, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))))"
ALL["places"] = (f"SELECT s.search_loc AS loc, i.item_loc, ln(1 + coalesce({_KM}, {pool.FAR_KM})) AS dist_km FROM qlocs s CROSS JOIN ilocs i LEFT JOIN cent a ON a.loc = s.search_loc LEFT JOIN cent b ON b.loc = i.item_loc", ["qlocs", "ilocs", "cent"])
ALL["pooled"] = (f"""SELECT *, final - max(final) OVER (PARTITION BY query_id) AS final_gap, count(*) OVER (PARTITION BY query_id) AS q_pool_size FROM
    (SELECT f.*, p.* EXCLUDE (query_id, item_id), {score_sql(W)} AS final, ln(loc_p + {fusion.LOC_EPS}) AS loc_logp, ln(mc_p + {fusion.MC_EPS}) AS mc_logp, CASE WHEN loc = item_loc THEN 1 ELSE 0 END AS same_loc FROM pool p JOIN pairs f USING (query_id, item_id))""", ["pool", "pairs"])
ALL["features"] = (f"""SELECT p.query_id, p.item_id, {', '.join(f'round_even({c}::DOUBLE, 4) + 0.0::DOUBLE AS {c}' for c in FEATURES if not c.startswith('rank_'))}, {', '.join(f'rank_{n}' for n in POOLED)} FROM
    (SELECT p.*, coalesce(m.s, 0) AS memory, {', '.join(f"(coalesce(b.hits, '') LIKE '%{k}%')::INT AS filter_{k}" for k in MAIN_KEYS)} FROM pooled p LEFT JOIN memory m USING (query_id, item_id) JOIN queries q ON q.query_id = p.query_id JOIN items i ON i.item_id = p.item_id
     LEFT JOIN bonus b ON b.params = q.search_infm_params_text AND b.item_params = i.item_infm_params_text) p
    JOIN qfeat USING (query_id) JOIN ifeat USING (item_id) JOIN places g ON g.loc = p.loc AND g.item_loc = p.item_loc""", ["pooled", "memory", "queries", "items", "bonus", "qfeat", "ifeat", "places"])


def _clicks_of(f):
    """(query_id, item_id) of the clicks in each query's context."""
    return f.train.join(f.queries.select("query_id", "query_norm", "search_location_id"), ["query_norm", "search_location_id"]).select("query_id", "item_id")


def _features(spark, sf_dir):
    """The pool's table of all features; what the recipe drops is left out."""
    f, b, p = _pool(spark, sf_dir)
    items = pool.drop_features(pool.item_features(f.items, f.train))
    queries = pool.query_features(f.queries, f.train, b.components.mc_p, b.components.n_mc, b.shares)
    return f, b, pool.feature_table(p, b.components, W, items, queries, b.centroids, MAIN_KEYS)


@register("pool_features", sql("SELECT * FROM features", "features"))
def pool_features(spark, sf_dir):
    x = _features(spark, sf_dir)[2]
    return x.select("query_id", "item_id", *[F.col(c).cast("long").alias(c) if c.startswith("rank_") else F.col(c) for c in FEATURES])


# lambdas at the linear scores; a query's relevant items are those that its context clicked
_D50 = lambda at: f"CASE WHEN {at} <= 50 THEN 1.0 / log2({at} + 1.0) ELSE 0.0 END"
ALL["judged"] = (f"""SELECT query_id, item_id, s, label, {_D50('pos')} AS d, sum(label) OVER (PARTITION BY query_id) AS n_yes FROM
    (SELECT f.query_id, f.item_id, final AS s, (c.item_id IS NOT NULL)::INT AS label, row_number() OVER (PARTITION BY f.query_id ORDER BY final DESC, f.item_id) AS pos
     FROM features f LEFT JOIN clicked c ON c.query_id = f.query_id AND c.item_id = f.item_id)""", ["features", "clicked"])
ALL["swaps"] = (f"""SELECT a.query_id, a.item_id AS yes, b.item_id AS no, abs(a.d - b.d) / ideal AS delta, 1 / (1 + exp(a.s - b.s)) AS rho FROM judged a JOIN judged b ON a.query_id = b.query_id AND a.label = 1 AND b.label = 0
    JOIN (SELECT n, sum({_D50('r')}) AS ideal FROM (SELECT DISTINCT n_yes AS n FROM judged) JOIN (SELECT unnest(range(1, 51)) AS r) ON r <= n GROUP BY n) ON n = a.n_yes""", ["judged"])


@register("listwise_lambdas", sql("""SELECT query_id, item_id, label, round(coalesce(g, 0), 6) + 0.0::DOUBLE AS g, round(coalesce(h, 0), 6) AS h FROM judged LEFT JOIN (SELECT query_id, item_id, sum(g) AS g, sum(h) AS h FROM
    (SELECT query_id, yes AS item_id, -rho * delta AS g, rho * (1 - rho) * delta AS h FROM swaps UNION ALL SELECT query_id, no, rho * delta, rho * (1 - rho) * delta FROM swaps) GROUP BY ALL) USING (query_id, item_id) WHERE n_yes > 0""", "judged", "swaps"))  # fmt: skip
def listwise_lambdas(spark, sf_dir):
    f, _, x = _features(spark, sf_dir)
    g = listwise.gradients(pool.labelled(x, _clicks_of(f)), "final", 50)
    return g.select("query_id", "item_id", F.col("label").cast("int").alias("label"), (F.round("g", 6) + 0.0).alias("g"), r6("h").alias("h"))


#: Settings of the registered rankers: the recipe's, but fewer and longer steps, as each level of a tree is a job.
RANKER = listwise.Settings(trees=24, step=0.2, depth=4, leaves=12, patience=6)


#: Labels are the very clicks that memory counts, so it stays out.
LEARNED = tuple(n for n in FEATURES if n != "memory")


def _halves(f):
    """Half of the queries of each of 256 cells by a hash, so that no task has all of them."""
    return splits.halves(f.queries.select("query_id", F.substring(F.md5("query_id"), 1, 2).alias("cell")), SEED)


def _judged(spark, sf_dir):
    f, b, x = _features(spark, sf_dir)
    return f, b, keep(pool.labelled(x, _clicks_of(f)))


@register("ranker_listwise")
def ranker_listwise(spark, sf_dir):
    """Each query's 50 best by a model of the other half of the queries, then by the linear ranking."""
    f, b, x = _judged(spark, sf_dir)
    halves = _halves(f)
    scored, _ = listwise.cross_fit(x, halves, LEARNED, RANKER)
    return ranks(pool.to_candidates(pool.top_by_model(scored, 50), fusion.topk_linear(b.components, W, 50), 50))


@register("ranker_importance")
def ranker_importance(spark, sf_dir):
    """Mean share of gain of each feature over the models of both halves, and the trees that each kept."""
    f, _, x = _judged(spark, sf_dir)
    halves = _halves(f)
    _, models = listwise.cross_fit(x, halves, LEARNED, RANKER)
    rows = [(n, s, len(models[0].trees), len(models[1].trees)) for n, s in listwise.importance(models)]
    return spark.createDataFrame(rows, "feature string, share double, trees_a int, trees_b int")


#: Weights that are scored together: those of the recipe, without the dense term, and with weights and an epsilon of their own.
TRIALS = (dict(W), {n: w for n, w in W.items() if n != "dense"}, W | {"char": 0.5, "loc": 0.2, "filter_agg": 0.1, "loc_eps": 0.001})
TERMS = ("char", "word", "dense", "filter", "memory")


def _trial_sql(t):
    parts = [f"{t.get(n, 0.0)} * {n}" if f"{n}_agg" not in t else f"(CASE WHEN q_is_agg = 1 THEN {t[f'{n}_agg']} ELSE {t.get(n, 0.0)} END) * {n}" for n in TERMS]
    parts += [f"{t.get('loc', 0.0)} * ln(loc_p + {t.get('loc_eps', fusion.LOC_EPS)})", f"{t.get('mc', 0.0)} * ln(mc_p + {t.get('mc_eps', fusion.MC_EPS)})"]
    return " + ".join(parts)


@register("tune_trials", sql(f"""SELECT trial, cell, round(avg(hits / n_rel), 6) AS recall, count(*) AS n FROM
    (SELECT trial, q.query_id, any_value(CASE WHEN trim(search_infm_params_text) <> '' THEN 'filter' ELSE 'nofilter' END) AS cell, any_value(n_rel) AS n_rel, count(c.item_id) AS hits
     FROM queries q JOIN (SELECT query_id, count(*) AS n_rel FROM clicked GROUP BY 1) USING (query_id) JOIN
     ({' UNION ALL '.join(f"SELECT {i} AS trial, query_id, item_id FROM features QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round_even({_trial_sql(t)}, 5) DESC, item_id) <= 50" for i, t in enumerate(TRIALS))}) p USING (query_id)
     LEFT JOIN clicked c ON c.query_id = q.query_id AND c.item_id = p.item_id GROUP BY ALL) GROUP BY ALL""", "queries", "clicked", "features"))  # fmt: skip
def tune_trials(spark, sf_dir):
    """Recall at 50 over the pool by cell, of all trials in one job."""
    f, b, x = _features(spark, sf_dir)
    cell = F.when(tx.has_filter(F.col("search_infm_params_text")), F.lit("filter")).otherwise(F.lit("nofilter"))
    q = f.queries.join(b.components.queries.select("query_id", "is_agg"), "query_id").select("query_id", "is_agg", cell.alias("cell"))
    got = study.score(study.records(x, TERMS, q, _clicks_of(f)), TERMS, TRIALS, 50)
    rows = [(i, c, round(r, 6), n) for i, by in enumerate(got) for c, (r, n) in by.items()]
    return spark.createDataFrame(rows, "trial int, cell string, recall double, n long")


@register("query_features", sql(f"""SELECT q.query_id, len(list_filter(string_split(q.query_norm, ' '), lambda x: x <> ''))::DOUBLE AS q_words, (trim(search_infm_params_text) <> '')::INT::DOUBLE AS q_has_filter, (self_share < 0.5)::INT::DOUBLE AS q_is_agg, 1.0::DOUBLE AS q_seen,
    round(m.mx, 6) AS q_mc_max, round(m.h, 6) AS q_mc_entropy, round(self_share, 6) AS q_loc_self_share FROM queries q JOIN share s ON s.search_loc = q.search_location_id JOIN (SELECT query_norm, max(p) AS mx, sum(-p * ln(p + 1e-12)) AS h FROM mcp GROUP BY 1) m USING (query_norm)""", "queries", "share", "mcp"))  # fmt: skip
def query_features(spark, sf_dir):
    f, b = built(spark, sf_dir, (), False)
    x = pool.query_features(f.queries, f.train, b.components.mc_p, b.components.n_mc, b.shares)
    return x.select("query_id", "q_words", "q_has_filter", "q_is_agg", "q_seen", *[r6(c).alias(c) for c in ("q_mc_max", "q_mc_entropy", "q_loc_self_share")])


@register("item_static_features", sql("""SELECT i.item_id, coalesce(item_rating, -1)::DOUBLE AS item_rating, round(ln(1 + coalesce(item_rating_reviews_count, 0)), 6) AS item_reviews, round(ln(1 + greatest(coalesce(item_price, 0), 0)), 6) AS item_log_price,
    length(coalesce(item_title_raw, ''))::DOUBLE AS item_title_len, round(ln(1 + length(coalesce(item_description_raw, ''))), 6) AS item_desc_len, item_is_phone_hidden::INT::DOUBLE AS item_phone_hidden, item_is_message_forbidden::INT::DOUBLE AS item_msg_forbidden,
    round(ln(1 + coalesce(n, 0) * 1e6 / (SELECT count(*) FROM train)), 6) AS item_pop FROM items i LEFT JOIN (SELECT item_id, count(*) AS n FROM train GROUP BY 1) USING (item_id)""", "items", "train"))  # fmt: skip
def item_static_features(spark, sf_dir):
    f = frames(spark, sf_dir)
    x = pool.item_features(f.items, f.train)
    return x.select("item_id", "item_rating", "item_title_len", "item_phone_hidden", "item_msg_forbidden", *[r6(c).alias(c) for c in ("item_reviews", "item_log_price", "item_desc_len", "item_pop")])


# a cross-encoder's scores come from outside; a price stands for one here
@register("ce_rank_gap", sql("SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY item_price DESC, item_id) AS rank_ce, round(item_price - max(item_price) OVER (PARTITION BY query_id), 6) AS ce_gap FROM pool JOIN items USING (item_id)", "pool", "items"))
def ce_rank_gap(spark, sf_dir):
    f, _, p = _pool(spark, sf_dir)
    x = pool.add_ce_features(p.join(f.items.select("item_id", F.col("item_price").alias("ce_score")), "item_id"))
    return x.select("query_id", "item_id", F.col("rank_ce").cast("long").alias("rank_ce"), r6("ce_gap").alias("ce_gap"))


@register("rank_top", sql("SELECT query_id, item_id, rank FROM (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY item_price DESC, item_id) AS rank FROM pool JOIN items USING (item_id)) WHERE rank <= 10", "pool", "items"))
def rank_top(spark, sf_dir):
    f, _, p = _pool(spark, sf_dir)
    return ranks(pool.top_by_model(p.join(f.items.select("item_id", F.col("item_price").alias("prediction")), "item_id"), 10))


@register("pool_labels", sql(f"SELECT p.query_id, p.item_id, {', '.join(f'rank_{n}' for n in POOLED if n != 'p_word')}, (c.item_id IS NOT NULL)::INT AS label FROM pool p LEFT JOIN clicked c ON p.query_id = c.query_id AND p.item_id = c.item_id", "pool", "clicked"))
def pool_labels(spark, sf_dir):
    f, _, p = _pool(spark, sf_dir)
    x = pool.drop_features(pool.labelled(p, _clicks_of(f)), ("rank_p_word", "not_there"))
    return x.select("query_id", "item_id", *[F.col(f"rank_{n}").cast("long").alias(f"rank_{n}") for n in POOLED if n != "p_word"], F.col("label").cast("int").alias("label"))


# a price stands for a model's score
@register("model_then_linear", sql("""SELECT query_id, item_id, rank FROM (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM (SELECT query_id, item_id, min(place) AS place FROM
    (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY item_price DESC, item_id) AS place FROM pool JOIN items USING (item_id) QUALIFY place <= 5 UNION ALL SELECT query_id, item_id, 1000 + rank FROM top_final) GROUP BY ALL)) WHERE rank <= 20""", "pool", "items", "top_final"))  # fmt: skip
def model_then_linear(spark, sf_dir):
    f, b, p = _pool(spark, sf_dir)
    model = pool.top_by_model(p.join(f.items.select("item_id", F.col("item_price").alias("prediction")), "item_id"), 5)
    return ranks(pool.to_candidates(model, fusion.topk_linear(b.components, W, 50), 20))


@register("main_source", sql(f"""SELECT query_id, item_id, CASE WHEN a >= greatest(b, c) THEN 'char' WHEN b >= c THEN 'word' ELSE 'dense' END AS main FROM
    (SELECT query_id, item_id, round({W['char']} * char, 6) AS a, round({W['word']} * word, 6) AS b, round({W['dense']} * dense, 6) AS c FROM ({top_terms_sql(W, 10)}))""", "pairs"))  # fmt: skip
def main_source(spark, sf_dir):
    _, b = built(spark, sf_dir)
    e = fusion.explain(fusion.topk_linear(b.components, W, 10), b.components, W)
    e = e.select("query_id", "item_id", *[r6(f"c_{n}").alias(n) for n in ("char", "word", "dense")])
    return e.select("query_id", "item_id", pool.main_source(("char", "word", "dense")).alias("main"))


# ---- splits ------------------------------------------------------------------------------------------------------

_KEY = lambda cols: f"md5(concat_ws('|', '{SEED}', {', '.join(f'''coalesce(CAST({c} AS STRING), '<null>')''' for c in cols)}))"
_C = ", ".join(splits.CONTEXT)
_S = ", ".join(splits.SEARCH)


def _variant(name, chosen, rest, keys):
    """SQL tables <name>_q and <name>_rel of a split."""
    on = " AND ".join(f"t.{k} IS NOT DISTINCT FROM c.{k}" for k in keys)
    rows = f"SELECT t.*, c.query_id, c.slice FROM train t JOIN {chosen} c ON {on}"
    return {
        f"{name}_q": (f"""SELECT query_id, slice, slice || CASE WHEN trim(coalesce(search_infm_params_text, '')) <> '' THEN '_filter' ELSE '_nofilter' END AS cell, trim(coalesce(search_infm_params_text, '')) <> '' AS has_filter,
            query_norm IN (SELECT query_norm FROM {rest} WHERE in_corpus) AS has_memory, query_norm, {_S} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, {', '.join(f'{c} NULLS LAST' for c in splits.SEARCH)}) AS r FROM
            (SELECT query_id, slice, query_norm, {_S}, count(*) AS n FROM ({rows}) GROUP BY ALL)) WHERE r = 1""", ["train", chosen, rest]),
        f"{name}_rel": (f"SELECT query_id, item_id, count(*) AS n_clicks, item_id IN (SELECT item_id FROM {rest}) AS in_rest FROM ({rows}) WHERE in_corpus GROUP BY query_id, item_id", ["train", chosen, rest]),
    }


def _rest(chosen, keys):
    on = " AND ".join(f"t.{k} IS NOT DISTINCT FROM c.{k}" for k in keys)
    return (f"SELECT t.* FROM train t WHERE query_norm NOT IN (SELECT query_norm FROM {chosen} WHERE slice = 'unseen') AND NOT EXISTS (SELECT 1 FROM {chosen} c WHERE slice = 'seen' AND {on})", ["train", chosen])


ALL |= {
    "grp": (f"SELECT {_C}, count(*) AS n, sum(in_corpus::INT)::BIGINT AS n_corp FROM train GROUP BY {_C}", ["train"]),
    "picked": (f"SELECT {_C} FROM (SELECT *, row_number() OVER (PARTITION BY query_norm ORDER BY {_KEY(splits.CONTEXT)}) AS r FROM grp WHERE n_corp > 0) WHERE r = 1", ["grp"]),
    "elig": ("SELECT query_norm, count(*) AS n_groups, sum((n_corp > 0)::INT)::BIGINT AS n_corp_groups FROM grp WHERE query_norm <> '' GROUP BY 1", ["grp"]),
    "unseen_t": (f"SELECT query_norm FROM elig WHERE n_corp_groups >= 1 ORDER BY {_KEY(['query_norm'])}, query_norm LIMIT {N_UNSEEN}", ["elig"]),
    "seen_t": (f"SELECT query_norm FROM elig WHERE n_groups >= 2 AND n_corp_groups >= 1 AND query_norm NOT IN (SELECT * FROM unseen_t) ORDER BY {_KEY(['query_norm'])}, query_norm LIMIT {N_SEEN}", ["elig", "unseen_t"]),
    "chosen": ("SELECT p.*, slice, (CASE slice WHEN 'unseen' THEN 'vu_' ELSE 'vs_' END) || lpad((row_number() OVER (PARTITION BY slice ORDER BY query_norm) - 1)::VARCHAR, 5, '0') AS query_id FROM picked p JOIN (SELECT query_norm, 'unseen' AS slice FROM unseen_t UNION ALL SELECT query_norm, 'seen' FROM seen_t) USING (query_norm)", ["picked", "unseen_t", "seen_t"]),
    "rest": _rest("chosen", splits.CONTEXT),
    "wide0": ("SELECT query_norm, search_location_id, slice, query_id FROM chosen", ["chosen"]),
    "restql": _rest("wide0", splits.QUERY_LOCATION),
    "wide": ("SELECT * FROM wide0 WHERE slice = 'unseen' OR query_norm IN (SELECT query_norm FROM restql)", ["wide0", "restql"]),
}
ALL |= _variant("ctx", "chosen", "rest", splits.CONTEXT)
ALL |= _variant("ql", "wide", "restql", splits.QUERY_LOCATION)
ALL["restcold"] = ("SELECT * FROM rest WHERE item_id NOT IN (SELECT item_id FROM ctx_rel)", ["rest", "ctx_rel"])
ALL |= _variant("cold", "chosen", "restcold", splits.CONTEXT)


@register("train_in_corpus", sql("SELECT item_microcat_id, in_corpus, count(*) AS n FROM train GROUP BY ALL", "train"))
def train_in_corpus(spark, sf_dir):
    f = frames(spark, sf_dir)
    return splits.with_corpus_flag(f.train.drop("in_corpus"), f.items).groupBy("item_microcat_id", "in_corpus").agg(F.count(F.lit(1)).alias("n"))


@register("context_groups", sql("SELECT * FROM grp", "grp"))
def context_groups(spark, sf_dir):
    return splits.groups(frames(spark, sf_dir).train)


@register("split_pick_group", sql(f"SELECT {_C} FROM picked", "picked"))
def split_pick_group(spark, sf_dir):
    return splits.pick_groups(splits.groups(frames(spark, sf_dir).train), SEED).select(*splits.CONTEXT)


@register("split_eligibility", sql("SELECT *, n_corp_groups >= 1 AS can_unseen, n_groups >= 2 AND n_corp_groups >= 1 AS can_seen FROM elig", "elig"))
def split_eligibility(spark, sf_dir):
    return splits.eligibility(splits.groups(frames(spark, sf_dir).train))


def _splits(spark, sf_dir):
    f = frames(spark, sf_dir)
    train = keep(f.train)
    items, queries, s = together(lambda: keep(f.items), lambda: keep(queries_of(train)), lambda: splits.build(train, f.items, N_UNSEEN, N_SEEN, SEED))
    return Frames(train, items, queries), s


_COUNT = "SELECT query_norm, search_location_id, count(*) AS n, count(DISTINCT item_id) AS items FROM {} GROUP BY ALL"


def _rest_counts(spark, sf_dir, name):
    return _splits(spark, sf_dir)[1][name].rest.groupBy("query_norm", "search_location_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item_id").alias("items"))


@register("split_rest_ctx", sql(_COUNT.format("rest"), "rest"))
def split_rest_ctx(spark, sf_dir):
    return _rest_counts(spark, sf_dir, "ctx")


@register("split_rest_ql", sql(_COUNT.format("restql"), "restql"))
def split_rest_ql(spark, sf_dir):
    return _rest_counts(spark, sf_dir, "ql")


@register("split_rest_cold", sql(_COUNT.format("restcold"), "restcold"))
def split_rest_cold(spark, sf_dir):
    return _rest_counts(spark, sf_dir, "ctx_cold")


@register("joint_mode", sql("SELECT 'ctx' AS variant, * FROM ctx_q UNION ALL SELECT 'ql', * FROM ql_q UNION ALL SELECT 'ctx_cold', * FROM cold_q", "ctx_q", "ql_q", "cold_q"))
def joint_mode(spark, sf_dir):
    s = _splits(spark, sf_dir)[1]
    out = [v.queries.withColumn("variant", F.lit(n)) for n, v in s.items()]
    return out[0].union(out[1]).union(out[2])


@register("relevance_table", sql("SELECT 'ctx' AS variant, * FROM ctx_rel UNION ALL SELECT 'ql', * FROM ql_rel UNION ALL SELECT 'ctx_cold', * FROM cold_rel", "ctx_rel", "ql_rel", "cold_rel"))
def relevance_table(spark, sf_dir):
    s = _splits(spark, sf_dir)[1]
    out = [v.rel.withColumn("variant", F.lit(n)) for n, v in s.items()]
    return out[0].union(out[1]).union(out[2])


@register("rel_stats", sql("""SELECT round(avg(n), 6) AS mean, median(n)::DOUBLE AS median, round(quantile_cont(n, 0.9), 6) AS p90, max(n) AS max, round(avg((n = 1)::INT), 6) AS share_eq_1, round(avg((n > 50)::INT), 6) AS share_gt_k, round(sum(r) / sum(n), 6) AS in_rest_share
    FROM (SELECT query_id, count(*) AS n, sum(in_rest::INT) AS r FROM ctx_rel GROUP BY 1)""", "ctx_rel"))  # fmt: skip
def rel_stats(spark, sf_dir):
    x = metrics.relevance_stats(_splits(spark, sf_dir)[1]["ctx"].rel)
    return x.select("median", "max", *[r6(c).alias(c) for c in ("mean", "p90", "share_eq_1", "share_gt_k", "in_rest_share")])


@register("split_halves", sql(f"SELECT query_id, cell, CASE WHEN row_number() OVER (PARTITION BY cell ORDER BY {_KEY(['query_id'])}) <= count(*) OVER (PARTITION BY cell) // 2 THEN 'A' ELSE 'B' END AS half FROM ctx_q", "ctx_q"))
def split_halves(spark, sf_dir):
    return splits.halves(_splits(spark, sf_dir)[1]["ctx"].queries, SEED).select("query_id", "cell", "half")


# ---- metrics: the answers are each held-out query's most clicked items of the rest -------------------------------

ALL["ans"] = ("""SELECT query_id, item_id, rank FROM (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, item_id) AS rank FROM
    (SELECT q.query_id, r.item_id, count(*) AS n FROM ctx_q q JOIN rest r ON r.search_location_id = q.search_location_id WHERE r.in_corpus GROUP BY ALL)) WHERE rank <= 50""", ["ctx_q", "rest"])  # fmt: skip
ALL["rec"] = ("""SELECT q.query_id, q.slice, q.cell, q.has_filter, q.search_location_id, coalesce(n_rel, 0) AS n_rel, coalesce(n_rest, 0)::BIGINT AS n_rest, coalesce(n_list, 0) AS n_list, coalesce(hits, 0) AS hits, coalesce(hits_rest, 0) AS hits_rest, hits / n_rel AS recall
    FROM ctx_q q LEFT JOIN (SELECT r.query_id, count(*) AS n_rel, sum(in_rest::INT) AS n_rest, count(a.item_id) AS hits, count(a.item_id) FILTER (in_rest) AS hits_rest FROM ctx_rel r LEFT JOIN ans a USING (query_id, item_id) GROUP BY 1) USING (query_id)
    LEFT JOIN (SELECT query_id, count(*) AS n_list FROM ans GROUP BY 1) USING (query_id)""", ["ctx_q", "ctx_rel", "ans"])  # fmt: skip
ALL["flags"] = ("""SELECT q.*, query_norm IN (SELECT query_norm FROM rest) AS seen, search_query IN (SELECT search_query FROM rest) AS exact, query_norm IN (SELECT query_norm FROM rest WHERE in_corpus) AS mem, trim(search_infm_params_text) <> '' AS filt FROM queries q""", ["queries", "rest"])
ALL["strata"] = ("""SELECT count(*) AS n_queries, avg(seen::INT) AS seen_share_norm, avg(exact::INT) AS seen_share_exact, avg(filt::INT) AS filter_share, avg(filt::INT) FILTER (seen) AS filter_share_seen, avg(filt::INT) FILTER (NOT seen) AS filter_share_unseen, avg(mem::INT) FILTER (seen) AS seen_memory_share FROM flags""", ["flags"])
ALL["cw"] = (" UNION ALL ".join(f"SELECT '{s}_{n}' AS cell, avg(({'' if s == 'seen' else 'NOT '}seen AND {'' if n == 'filter' else 'NOT '}filt)::INT) AS weight FROM flags" for s in ("unseen", "seen") for n in ("filter", "nofilter")), ["flags"])
ALL["toploc"] = ("SELECT search_location_id, count(*) AS n FROM queries GROUP BY 1 ORDER BY n DESC, search_location_id LIMIT 5", ["queries"])
_PARTS = {"all": "true", "unseen": "slice = 'unseen'", "seen": "slice = 'seen'", "filter": "has_filter", "no_filter": "NOT has_filter", "top_loc": "search_location_id IN (SELECT search_location_id FROM toploc)", "other_loc": "search_location_id NOT IN (SELECT search_location_id FROM toploc)"} | {c: f"cell = '{c}'" for c in metrics.CELLS}
ALL["st"] = (" UNION ALL ".join(f"SELECT '{n}' AS name, coalesce(avg(recall), 'nan'::DOUBLE) AS recall, coalesce(CASE WHEN count(*) > 1 THEN stddev_samp(recall) / sqrt(count(*)) END, 'nan'::DOUBLE) AS se, count(*) AS n FROM rec WHERE {c}" for n, c in _PARTS.items()), ["rec", "toploc"])


def _answers(s):
    n = s.queries.select("query_id", "search_location_id").join(s.rest.where("in_corpus").groupBy("search_location_id", "item_id").agg(F.count(F.lit(1)).alias("n")), "search_location_id")
    return pool.top_by_model(n, 50, "n")


def _recall(spark, sf_dir):
    f, s = _splits(spark, sf_dir)
    return f, s["ctx"], metrics.recall(_answers(s["ctx"]), s["ctx"].queries, s["ctx"].rel)


@register("recall_at_k", sql("SELECT * EXCLUDE (recall), round(recall, 6) AS recall FROM rec", "rec"))
def recall_at_k(spark, sf_dir):
    return _recall(spark, sf_dir)[2].withColumn("recall", r6("recall"))


@register("bench_strata", sql("SELECT n_queries, round(seen_share_norm, 6) AS seen_share_norm, round(seen_share_exact, 6) AS seen_share_exact, round(filter_share, 6) AS filter_share, round(filter_share_seen, 6) AS filter_share_seen, round(filter_share_unseen, 6) AS filter_share_unseen, round(seen_memory_share, 6) AS seen_memory_share FROM strata", "strata"))
def bench_strata(spark, sf_dir):
    f, s = _splits(spark, sf_dir)
    x = metrics.bench_strata(f.queries, s["ctx"].rest)
    return x.select("n_queries", *[r6(c).alias(c) for c in x.columns if c != "n_queries"])


@register("cell_weights", sql("SELECT cell, round(weight, 6) AS weight FROM cw", "cw"))
def cell_weights(spark, sf_dir):
    f, s = _splits(spark, sf_dir)
    return metrics.cell_weights(f.queries, s["ctx"].rest).select("cell", r6("weight").alias("weight"))


@register("top_locations", sql("SELECT * FROM toploc", "toploc"))
def top_locations(spark, sf_dir):
    return metrics.top_locations(frames(spark, sf_dir).queries, 5)


def _stats(spark, sf_dir):
    f, s, r = _recall(spark, sf_dir)
    return f, s, metrics.stats(r, metrics.top_locations(f.queries, 5))


@register("recall_slices", sql("SELECT name, round(recall, 6) AS recall, round(se, 6) AS se, n FROM st", "st"))
def recall_slices(spark, sf_dir):
    x = _stats(spark, sf_dir)[2]
    return x.select("name", *[F.when(F.isnan(c), F.col(c)).otherwise(r6(c)).alias(c) for c in ("recall", "se")], "n")


_R = lambda n: f"(SELECT recall FROM st WHERE name = '{n}')"


@register("bench_adj", sql(f"""SELECT round((SELECT sum(weight * recall) FROM cw JOIN st ON cell = name), 6) AS bench_adj, round((1 - seen_share_norm) * {_R('unseen')} + seen_share_norm * {_R('seen')}, 6) AS weighted,
    round(filter_share * {_R('filter')} + (1 - filter_share) * {_R('no_filter')}, 6) AS filter_adj FROM strata""", "strata", "cw", "st"))  # fmt: skip
def bench_adj(spark, sf_dir):
    f, s, st = _stats(spark, sf_dir)
    x = metrics.adjusted(st, metrics.cell_weights(f.queries, s.rest), metrics.bench_strata(f.queries, s.rest))
    return x.select(*[F.when(F.isnan(c), F.col(c)).otherwise(r6(c)).alias(c) for c in ("bench_adj", "weighted", "filter_adj")])


@register("item_micro_recall", sql("""SELECT round(CASE WHEN sum(n_rest) > 0 THEN sum(hits_rest) / sum(n_rest) ELSE 'nan'::DOUBLE END, 6) AS item_in_rest, round(CASE WHEN sum(n_rel - n_rest) > 0 THEN sum(hits - hits_rest) / sum(n_rel - n_rest) ELSE 'nan'::DOUBLE END, 6) AS item_new,
    sum(n_rest)::BIGINT AS n_item_in_rest, sum(n_rel - n_rest)::BIGINT AS n_item_new, round(avg(n_list), 6) AS mean_len, round(avg((n_list < 50)::INT), 6) AS share_short, sum((n_list = 0)::INT)::BIGINT AS n_missing FROM rec""", "rec"))  # fmt: skip
def item_micro_recall(spark, sf_dir):
    x = metrics.item_micro(_recall(spark, sf_dir)[2])
    return x.select(*[F.when(F.isnan(c), F.col(c)).otherwise(r6(c)).alias(c) for c in ("item_in_rest", "item_new")], "n_item_in_rest", "n_item_new", r6("mean_len").alias("mean_len"), r6("share_short").alias("share_short"), "n_missing")


@register("demo_pick", sql("SELECT cell, query_id, hit FROM (SELECT cell, query_id, hits > 0 AS hit, row_number() OVER (PARTITION BY cell, hits > 0 ORDER BY md5('0|' || query_id)) AS r FROM rec) WHERE r <= 2", "rec"))
def demo_pick(spark, sf_dir):
    return pool.demo_pick(_recall(spark, sf_dir)[2], 2)


# the shortened answers stand for other runs
@register("ablation_grid", sql("SELECT k AS run, round(avg(h / n_rel), 6) AS recall, count(*) AS n FROM (SELECT k, q.query_id, q.n_rel, count(r.item_id) AS h FROM rec q CROSS JOIN (SELECT unnest(['top5', 'top20', 'top50']) AS k, unnest([5, 20, 50]) AS m) LEFT JOIN ans a ON a.query_id = q.query_id AND a.rank <= m LEFT JOIN ctx_rel r ON r.query_id = a.query_id AND r.item_id = a.item_id GROUP BY ALL) GROUP BY k", "rec", "ans", "ctx_rel"))
def ablation_grid(spark, sf_dir):
    s = _splits(spark, sf_dir)[1]["ctx"]
    a = _answers(s)
    return tune.ablation_grid({f"top{k}": a.where(F.col("rank") <= k) for k in (5, 20, 50)}, s.queries, s.rel).select("run", r6("recall").alias("recall"), "n")


@register("miss_rank", sql("SELECT query_id, item_id, rank FROM (SELECT query_id, item_id, rank() OVER (PARTITION BY query_id ORDER BY n DESC) AS rank FROM (SELECT q.query_id, r.item_id, count(*) AS n FROM ctx_q q JOIN rest r ON r.search_location_id = q.search_location_id WHERE r.in_corpus GROUP BY ALL)) SEMI JOIN ctx_rel USING (query_id, item_id)", "ctx_q", "rest", "ctx_rel"))
def miss_rank(spark, sf_dir):
    s = _splits(spark, sf_dir)[1]["ctx"]
    n = s.queries.select("query_id", "search_location_id").join(s.rest.where("in_corpus").groupBy("search_location_id", "item_id").agg(F.count(F.lit(1)).cast("double").alias("score")), "search_location_id")
    return ranks(pool.miss_rank(n, s.rel))


# ---- descriptions ------------------------------------------------------------------------------------------------


@register("eda_distincts", sql("SELECT count(DISTINCT search_query) AS n_raw, count(DISTINCT query_norm) AS n_norm, (SELECT count(*) FROM grp) AS n_groups FROM train", "train", "grp"))
def eda_distincts(spark, sf_dir):
    return eda.distincts(frames(spark, sf_dir).train)


@register("eda_seen_memory", sql("SELECT count(*) AS n, sum(seen::INT)::BIGINT AS n_seen, sum(EXISTS (SELECT 1 FROM rest r WHERE r.query_norm = f.query_norm AND r.search_location_id = f.search_location_id)::INT)::BIGINT AS n_seen_loc, sum(mem::INT)::BIGINT AS n_memory FROM flags f", "flags", "rest"))
def eda_seen_memory(spark, sf_dir):
    f, s = _splits(spark, sf_dir)
    return eda.seen_memory(f.queries, s["ctx"].rest)


@register("eda_loc_match", sql("SELECT round(avg((search_location_id = item_location_id)::INT), 6) AS same_loc, round(avg((search_is_delivery_search = 1)::INT), 6) AS delivery, round(avg((search_category = 0)::INT), 6) AS category_0 FROM train", "train"))
def eda_loc_match(spark, sf_dir):
    x = eda.location_match(frames(spark, sf_dir).train)
    return x.select(*[r6(c).alias(c) for c in x.columns])


@register("eda_filter_keys", sql("""SELECT key, count(*) AS n, round(count(*) / (SELECT count(*) FROM train WHERE trim(search_infm_params_text) <> ''), 6) AS share, round(avg(contains(item_infm_params_text, key || ' ' || value)::INT), 6) AS pair_rate, round(avg(contains(item_infm_params_text, value)::INT), 6) AS value_rate
    FROM train JOIN parsed ON params = search_infm_params_text WHERE value <> '' GROUP BY key""", "train", "parsed"))  # fmt: skip
def eda_filter_keys(spark, sf_dir):
    x = eda.filter_keys(frames(spark, sf_dir).train, KEYS)
    return x.select("key", "n", *[r6(c).alias(c) for c in ("share", "pair_rate", "value_rate")])


@register("eda_unknown_prefix", sql("SELECT round(avg((NOT (starts_with(search_infm_params_text, 'Brand') OR starts_with(search_infm_params_text, 'Size')))::INT), 6) AS unknown_share FROM train WHERE trim(search_infm_params_text) <> ''", "train"))
def eda_unknown_prefix(spark, sf_dir):
    return eda.unknown_prefix_share(frames(spark, sf_dir).train, ("Brand", "Size")).select(r6("unknown_share").alias("unknown_share"))


@register("eda_main_mc_share", sql("SELECT round(sum(top) / sum(n), 6) AS micro, round(avg(top / n), 6) AS macro FROM (SELECT query_norm, max(n) AS top, sum(n) AS n FROM (SELECT query_norm, item_microcat_id, count(*) AS n FROM train GROUP BY ALL) GROUP BY 1)", "train"))
def eda_main_mc_share(spark, sf_dir):
    x = eda.main_category_share(frames(spark, sf_dir).train)
    return x.select(r6("micro").alias("micro"), r6("macro").alias("macro"))


ALL["lshare"] = ("""SELECT coalesce(a.k, b.k) AS search_location_id, coalesce(sa, 0) AS share_a, coalesce(sb, 0) AS share_b FROM (SELECT search_location_id AS k, count(*) / (SELECT count(*) FROM train) AS sa FROM train GROUP BY 1) a
    FULL JOIN (SELECT search_location_id AS k, count(*) / (SELECT count(*) FROM queries) AS sb FROM queries GROUP BY 1) b ON a.k = b.k""", ["train", "queries"])  # fmt: skip


@register("eda_top_locations", sql("SELECT search_location_id, round(share_a, 6) AS share_a, round(share_b, 6) AS share_b FROM lshare ORDER BY lshare.share_a DESC, search_location_id LIMIT 10", "lshare"))
def eda_top_locations(spark, sf_dir):
    f = frames(spark, sf_dir)
    return eda.top_locations(f.train, f.queries, 10).select("search_location_id", r6("share_a").alias("share_a"), r6("share_b").alias("share_b"))


ALL["lshare_items"] = ("""SELECT coalesce(sa, 0) AS share_a, coalesce(sb, 0) AS share_b FROM (SELECT search_location_id AS k, count(*) / (SELECT count(*) FROM train) AS sa FROM train GROUP BY 1) a
    FULL JOIN (SELECT item_location_id AS k, count(*) / (SELECT count(*) FROM items) AS sb FROM items GROUP BY 1) b ON a.k = b.k""", ["train", "items"])  # fmt: skip


@register("eda_share_corr", sql("SELECT round(corr(share_a, share_b), 6) AS corr, count(*) AS n FROM lshare_items", "lshare_items"))
def eda_share_corr(spark, sf_dir):
    f = frames(spark, sf_dir)
    return eda.share_correlation(f.train, f.items.withColumnRenamed("item_location_id", "search_location_id")).select(r6("corr").alias("corr"), "n")


@register("eda_multi_context", sql("SELECT round(avg((c > 1)::INT), 6) AS text_share, round(sum(CASE WHEN c > 1 THEN n ELSE 0 END) / sum(n), 6) AS click_share FROM (SELECT query_norm, count(*) AS c, sum(n) AS n FROM grp GROUP BY 1)", "grp"))
def eda_multi_context(spark, sf_dir):
    x = eda.multi_context(frames(spark, sf_dir).train)
    return x.select(r6("text_share").alias("text_share"), r6("click_share").alias("click_share"))


@register("eda_items_per_group", sql(f"SELECT round(avg(n), 6) AS mean, round(quantile_cont(n, 0.9), 6) AS p90, round(avg((n = 1)::INT), 6) AS share_1 FROM (SELECT count(DISTINCT item_id) AS n FROM train GROUP BY {_C})", "train"))
def eda_items_per_group(spark, sf_dir):
    x = eda.items_per_group(frames(spark, sf_dir).train)
    return x.select(*[r6(c).alias(c) for c in ("mean", "p90", "share_1")])
