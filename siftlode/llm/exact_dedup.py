"""Exact deduplication by content hash, with bytes compared.

A text's key is 128 bits of its hash. Rows travel as (id, hash), never as texts: groups are counted by key, ids first,
so that a group of any size is a few partial sums in each task. Texts are read once more, and only those whose key
is shared (a Bloom filter of the shared keys tells most others apart) are grouped by key and bytes; equal
bytes fold within the task that reads them, so that one row a task and text is shuffled however many copies there are. A key
with two texts in it is a collision; rows of such keys are grouped by their bytes instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filter_words, lower_ascii, materialise, own_prefix, part_by_ids, with_groups

#: Bytes of the hash that make a key.
KEY_BYTES = 16


def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def _counted(rows: DataFrame, by: str, largest: bool) -> DataFrame:
    """(by, n, keep, repeats): rows of a group, the id that stays, and how many rows have it. Ids are counted first."""
    ids = rows.groupBy(by, "id").agg(F.count(F.lit(1)).alias("n"))
    best = (F.max if largest else F.min)(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    out = ids.groupBy(by).agg(F.sum("n").alias("n"), best.alias("best"))
    return out.select(by, "n", F.col("best.id").alias("keep"), F.coalesce("best.n", "n").alias("repeats"))


def _grouped(docs: DataFrame, doc_id: str, text: str, keep: str, key_bytes: int) -> DataFrame:
    """One row per row of ``docs``: id, sha, n, keep, repeats."""
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    t = lower_ascii(F.coalesce(F.col(text), F.lit("")))
    whole = docs.select(F.col(doc_id).alias("id"), t.alias("t")).withColumn("sha", content_hash(F.col("t")))
    key = F.substring("sha", 1, key_bytes)
    marks = materialise(whole.select("id", "sha"))
    rows = marks.withColumn("key", key)
    shared = materialise(_counted(rows, "key", keep == "largest").where("n > 1"))
    _, may = part_by_ids(whole.withColumn("key", key).select("key", "t"), "key", shared, "key", filter_words(shared.count()))
    different = may.groupBy("key", "t").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.count(F.lit(1)).alias("texts"))
    collided = materialise(different.where("texts > 1").select("key"))
    if not collided.isEmpty():
        apart = whole.withColumn("key", key).join(collided, "key", "left_semi")
        exact = apart.join(_counted(apart, "t", keep == "largest"), "t").select("id", "sha", "n", "keep", "repeats")
        rows, shared = (x.join(collided, "key", "left_anti") for x in (rows, shared))
    out = with_groups(rows, shared, "key", "n", marks.count(), how="left")
    single = F.col("n").isNull()
    out = out.select("id", "sha", F.coalesce("n", F.lit(1)).alias("n"), F.when(single, F.col("id")).otherwise(F.col("keep")).alias("keep"), F.coalesce("repeats", F.lit(1)).alias("repeats"))
    return out if collided.isEmpty() else out.unionByName(exact)


def copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "largest", key_bytes: int = KEY_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id (the id that stays of the rows with this text), group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; null is the empty text. Of equal texts the ``largest`` or
    the ``smallest`` id stays; a null id only where all ids of the group are null, and keep_id is null then. Rows
    that agree in id and text all count in group_size and share one result, as nothing tells them apart. Other columns, whatever their
    names, are not read. An empty table gives an empty one.
    """
    got = _grouped(docs, doc_id, text, keep, key_bytes)
    return got.select(F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("n").cast("long").alias("group_size"), F.col("id").eqNullSafe(F.col("keep")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "largest", key_bytes: int = KEY_BYTES) -> DataFrame:
    """``docs`` without copies: one row of each text, with all its columns. Rows that repeat id and text count as copies too;
    which of them stays is open. Only rows that share a text are shuffled."""
    p = own_prefix(docs)
    found = materialise(_grouped(docs, doc_id, text, keep, key_bytes).where("n > 1"))
    listed = found.where(F.col("id").eqNullSafe(F.col("keep"))).select(F.col("id").alias(f"{p}id"), F.col("sha").alias(f"{p}kept"), F.col("repeats").alias(f"{p}repeats")).distinct()
    shas = materialise(found.select(F.col("sha").alias(f"{p}shared")).distinct())
    tagged = docs.withColumn(f"{p}sha", content_hash(lower_ascii(F.coalesce(F.col(text), F.lit("")))))
    single, may = part_by_ids(tagged, f"{p}sha", shas, f"{p}shared", filter_words(shas.count()))
    alone = may.join(shas, F.col(f"{p}sha") == F.col(f"{p}shared"), "left_anti")
    best = may.join(listed, (F.col(f"{p}sha") == F.col(f"{p}kept")) & F.col(doc_id).eqNullSafe(F.col(f"{p}id")))
    once, often = best.where(F.col(f"{p}repeats") == 1), best.where(F.col(f"{p}repeats") > 1).dropDuplicates([f"{p}sha"])
    parts = [x.select(*docs.columns) for x in (single, alone, once, often)]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])
