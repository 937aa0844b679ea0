"""Shared helpers: tables, the shared work folder, size checks and text measures."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a side may have to be broadcast; a larger side is shuffled.
BROADCAST_ROWS = 200_000
#: Words of 64 bits in the filter of listed ids, a power of two; it is broadcast and has no more rows than these.
FILTER_WORDS = 1 << 17
#: Groups that ``with_groups`` broadcasts at most.
HOT_GROUPS = 1000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of a file of a table whose size is known.
ROWS_A_FILE = 500_000
#: Setting under which a query's shuffle files are deleted at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share, the session's ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is set if the master is local (tests, a single machine); a cluster
    must name one, as a folder of one machine would lose rows there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(os.environ.get("TMPDIR", "/tmp"), "checkpoints")
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/siftlode-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def clear_work(spark: SparkSession) -> None:
    """Delete all tables of intermediate results that this application has written; results not yet computed need them."""
    folder = work_dir(spark).rpartition("/")[0]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, path: str | None = None, rows: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, which cuts the lineage for good:
    a lost executor costs a reread, never a recomputation. The shuffles behind it leave the disks when it is written.

    Where ``rows`` is known, a bound of its number of rows, the files are as few as it takes to hold so many: for results of
    joins and sums, whose last tasks are light.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    path = path or work_dir(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if the counted ``rows`` are within ``limit``; else leave the join to shuffle."""
    return F.broadcast(df) if rows <= limit else df


def part_by_ids(rows: DataFrame, column: str, ids: DataFrame, listed: str, n_words: int = FILTER_WORDS) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts: those whose ``column`` is surely not among ``ids``, and those where it may be.

    A Bloom filter of bounded size tells them apart, two bits of one word for an id, null being an id like others. Only the
    second part needs an exact join, so that where few ids are listed, few of the wide rows are shuffled. However many are
    listed, no id is missed: the second part grows with the share of bits that are set.
    """
    p = own_prefix(rows)
    bit = lambda n: f"shiftleft(1L, cast(shiftrightunsigned({p}h, {n}) & 63 as int))"
    bits, word = F.expr(f"{bit(0)} | {bit(6)}"), F.shiftrightunsigned(f"{p}h", 64 - (n_words - 1).bit_length())
    hashed = ids.select(F.xxhash64(listed).alias(f"{p}h")).select(word.alias(f"{p}word"), bits.alias(f"{p}bits"))
    filter_ = materialise(hashed.groupBy(f"{p}word").agg(F.bit_or(f"{p}bits").alias(f"{p}set")), rows=n_words)
    asked = rows.withColumn(f"{p}h", F.xxhash64(column)).withColumn(f"{p}at", word).withColumn(f"{p}bits", bits)
    asked = asked.join(F.broadcast(filter_), F.col(f"{p}at") == F.col(f"{p}word"), "left")
    may = F.coalesce(F.col(f"{p}set").bitwiseAND(F.col(f"{p}bits")) == F.col(f"{p}bits"), F.lit(False))
    return asked.where(~may).select(*rows.columns), asked.where(may).select(*rows.columns)


def own_prefix(df: DataFrame) -> str:
    """A prefix of underscores that no column of ``df`` begins with."""
    p = "__"
    while any(c.startswith(p) for c in df.columns):
        p += "_"
    return p


def filter_words(listed: int) -> int:
    """Words of a filter that ``part_by_ids`` fills with ``listed`` ids at up to four a word, between 2 ** 17 and 2 ** 20 (8 MB)."""
    return min(max(FILTER_WORDS, 1 << (max(listed, 1) // 4).bit_length()), 1 << 20)


def with_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int, how: str = "inner", most: int = HOT_GROUPS) -> DataFrame:
    """``rows`` joined with ``groups`` on ``key``, each group's ``size`` being its number of rows, of ``n_rows`` in all.

    Groups with at least 1 / ``most`` of all rows, of which there can be no more than ``most``, are broadcast, so that their rows stay where
    they are; all others are met in a shuffle. Keys are not null.
    """
    least = max(2, -(-n_rows // most))
    hot, rest = groups.where(F.col(size) >= least), groups.where(F.col(size) < least)
    first = rows.join(F.broadcast(hot), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return first.unionByName(others.join(rest, key, how))


def lower_ascii(text: Column) -> Column:
    """Lower case of A to Z only; texts without other letters take the faster way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hex_key(*parts: Column, digits: int = 15) -> Column:
    """A non-negative long from the md5 of the parts, the same in other SQL engines."""
    joined = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, digits), 16, 10).cast("long")


def grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of rows that agree in ``keys``; such rows stand together."""
    rest: list[pa.Table] = []
    key = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        start = 0
        for i, k in enumerate(zip(*(t.column(c).to_pylist() for c in keys), strict=True)):
            if k != key:
                if i > start:
                    rest.append(t.slice(start, i - start))
                if rest:
                    yield pa.concat_tables(rest)
                rest, key, start = [], k, i
        rest.append(t.slice(start))
    if rest:
        yield pa.concat_tables(rest)


def ship(module: str) -> None:
    """Send the functions of ``module`` to Python workers by value: executors need not have this package."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)
