"""The registered queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, embed_dedup, exact_dedup, html_extract, importance, line_dedup, mixing, quality, sharding, simhash, url_filter, warc, whitening
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = url_filter.filter_urls(pages.drop("html"), url_filter.thin_urls(pages))
    return out.select("page_id", "host", "path", "rule", "verdict", "canonical_url", "listed")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "matched")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings"))
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    return out.select("vec_id", "n", "deviation", "identity_error", each).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error"
    )


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copies(table(spark, sf_dir, "documents"), keep="largest")


QUERIES |= {"op1_url_filter": op1_url_filter, "op2_html_extract": op2_html_extract, "op3_sharding": op3_sharding, "op4_mixing": op4_mixing, "op5_warc": op5_warc, "op6_quality": op6_quality, "op7_embedding_dedup": op7_embedding_dedup, "op8_line_dedup": op8_line_dedup, "op9_decontamination": op9_decontamination, "op10_simhash": op10_simhash, "op11_importance": op11_importance, "op12_whitening": op12_whitening, "op13_exact_dedup": op13_exact_dedup}

_PARTS = r"""
  SELECT page_id, url, length(html) AS html_length, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*') END AS raw,
         CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages
"""
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _rule_sql(what: str) -> str:
    """CASE over the rules, longest first."""
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))
    return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if what == 'rule' else v}'" for v, h, p in rules) + " END"


ORACLE["op1_url_filter"] = rf"""
WITH parts AS ({_PARTS}),
split AS (SELECT page_id, html_length, translate(raw, {_AZ}) AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM parts),
named AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^(www|m|blog)\.', ''), ':[0-9]*$', '')
         || regexp_replace(regexp_replace(path, '(/index)?\.html?$', ''), '/+$', '') END AS canonical_url FROM split),
listed AS (SELECT DISTINCT canonical_url AS u FROM named WHERE html_length < {url_filter.THIN})
SELECT page_id, host, path, {_rule_sql("rule")} AS rule,
       COALESCE({_rule_sql("verdict")}, CASE WHEN u IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, canonical_url, u IS NOT NULL AS listed
FROM named LEFT JOIN listed ON canonical_url = u
"""

ORACLE["op4_mixing"] = r"""
WITH light AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5(COALESCE(doc_id::VARCHAR, 'null') || ':mix0:' || md5(COALESCE(text, ''))), 1, 15) AS key
  FROM documents),
sizes AS (SELECT source, SUM(size)::BIGINT AS source_size FROM light GROUP BY source),
ranked AS (
  SELECT *, 3 * source_size AS cap, [5, 2, 1][((ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM sizes),
filled AS (
  SELECT *, SUM(source_size) OVER ()::BIGINT AS total, SUM(w) OVER ()::BIGINT AS weights,
         COALESCE(SUM(cap) OVER f, 0)::BIGINT AS full_cap, COALESCE(SUM(w) OVER f, 0)::BIGINT AS full_w,
         ROW_NUMBER() OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST) AS place
  FROM ranked WINDOW f AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, (total - full_cap)::DOUBLE / (weights - full_w)::DOUBLE AS level FROM filled),
targets AS (
  SELECT source, source_size, LEAST(cap::DOUBLE, COALESCE((SELECT arg_min(level, place) FROM levels WHERE level * w <= cap) * w, cap::DOUBLE)) AS target
  FROM levels),
ordered AS (
  SELECT l.doc_id, l.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
         COALESCE(SUM(size) OVER (PARTITION BY l.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM light l JOIN targets t ON l.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN (budget // source_size) * size + GREATEST(0, LEAST(size, budget % source_size - before)) ELSE 0 END)::BIGINT AS taken
FROM ordered
"""

# every window of 13 item tokens against every diagonal, by joining single tokens
ORACLE["op9_decontamination"] = rf"""
WITH t AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS toks FROM benchmark),
item AS (SELECT item_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS p FROM t WHERE len(toks) >= {decontam.WINDOW}),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS toks FROM documents),
doc AS (SELECT r, doc_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS q FROM d),
same AS (SELECT r, doc_id, item_id, q - p AS diagonal, p FROM doc JOIN item USING (tok)),
enough AS (SELECT r, item_id, diagonal FROM same GROUP BY ALL HAVING COUNT(*) >= {decontam.MIN_MATCHES}),
counted AS (
  SELECT doc_id, item_id, COUNT(*) OVER (PARTITION BY r, item_id, diagonal ORDER BY p RANGE BETWEEN CURRENT ROW AND {decontam.WINDOW - 1} FOLLOWING) AS n
  FROM same SEMI JOIN enough USING (r, item_id, diagonal))
SELECT doc_id, item_id, MAX(n) AS matched FROM counted WHERE n >= {decontam.MIN_MATCHES} GROUP BY doc_id, item_id
"""

ORACLE["op5_warc"] = f"""
WITH p AS (SELECT page_id, COALESCE(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, MIN(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {warc.MIN_REVISIT} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {warc.MIN_REVISIT} AND page_id <> first THEN first END AS refers_to
FROM f
"""

# all pairs of a label; vectors here have no null or non-finite components. Least ids spread over links until none changes.
ORACLE["op7_embedding_dedup"] = f"""
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= {embed_dedup.THRESHOLD}),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
least AS (SELECT x AS vec_id, MIN(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x AS vec_id, COUNT(*) AS n_links FROM link GROUP BY x)
SELECT vec_id, COALESCE(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN n USING (vec_id)
"""

ORACLE["op8_line_dedup"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
line AS (SELECT r, doc_id, source, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM d),
bad AS (SELECT l FROM line WHERE length(l) >= {line_dedup.MIN_CHARS} GROUP BY l HAVING COUNT(DISTINCT COALESCE('s' || source, 'null')) >= {line_dedup.MIN_SITES}),
marked AS (SELECT line.*, bad.l IS NOT NULL AS gone FROM line LEFT JOIN bad ON line.l = bad.l),
agg AS (SELECT r, COUNT(*)::BIGINT AS n_lines, COUNT(*) FILTER (gone)::BIGINT AS n_removed, COALESCE(string_agg(l, chr(10) ORDER BY p) FILTER (NOT gone), '') AS text FROM marked GROUP BY r)
SELECT doc_id, COALESCE(n_lines, 0) AS n_lines, COALESCE(n_removed, 0) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE agg.text END AS text FROM d LEFT JOIN agg USING (r)
"""

ORACLE["op13_exact_dedup"] = f"""
WITH d AS (SELECT doc_id, translate(COALESCE(text, ''), {_AZ}) AS t FROM documents),
g AS (SELECT t, MAX(doc_id) AS keep_id, COUNT(*)::BIGINT AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""

# CRC-32 by its table of 256 entries, made by the polynomial; only of distinct words
ORACLE["op11_importance"] = rf"""
WITH RECURSIVE bits AS (
  SELECT i AS b, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, {0xEDB88320}) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS steps FROM bits WHERE k = 8),
texts AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
runs AS (SELECT kind, id, regexp_extract_all(translate(COALESCE(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
word AS (SELECT kind, id, unnest(ws) AS w FROM runs),
coded AS (
  SELECT w, xor(list_reduce(list_prepend({0xFFFFFFFF}::BIGINT, list_transform(range(0, strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT)),
                            lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1])), {0xFFFFFFFF}::BIGINT) % {importance.BUCKETS} AS bucket
  FROM (SELECT DISTINCT w FROM word), crc),
counted AS (SELECT bucket, COUNT(*) FILTER (kind = 'd') AS s, COUNT(*) FILTER (kind = 'b') AS t FROM word JOIN coded USING (w) GROUP BY bucket),
total AS (SELECT SUM(s)::DOUBLE AS ss, SUM(t)::DOUBLE AS tt FROM counted),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (ss + {importance.BUCKETS}) / ((s + 1)::DOUBLE * (tt + {importance.BUCKETS}))))::BIGINT AS gain FROM counted, total),
weights AS (SELECT id, floor(SUM(gain)::DOUBLE / COUNT(*))::BIGINT AS weight FROM word JOIN coded USING (w) JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY id),
scored AS (
  SELECT id AS doc_id, len(ws)::BIGINT AS n_features, COALESCE(weight, 0) AS weight,
         COALESCE(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{importance.SEED}:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM runs LEFT JOIN weights USING (id) WHERE kind = 'd'),
places AS (SELECT doc_id, ROW_NUMBER() OVER (ORDER BY score DESC, doc_id) AS rank, COUNT(*) OVER () AS n FROM scored WHERE n_features >= {importance.MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * {importance.PERCENT} // 100 THEN rank END AS rank FROM scored LEFT JOIN places USING (doc_id)
"""
