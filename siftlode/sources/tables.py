"""Tables in, answers out, and the checks on both."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.eda import id_check
from .config import config_key

HEX16 = "^[0-9a-f]{16}$"
BASE62_16 = "^[0-9A-Za-z]{16}$"
MOST = 50


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet table, only ``columns`` of it; decimals become doubles, id columns strings."""
    df = spark.read.parquet(path)
    df = df.select(*columns) if columns else df
    casts = {f.name: F.col(f.name).cast("double") for f in df.schema if isinstance(f.dataType, T.DecimalType)}
    casts |= {n: F.col(n).cast("string") for n in ("query_id", "item_id") if n in df.columns}
    return df.withColumns(casts) if casts else df


def describe(tables: Mapping[str, DataFrame], expected: Mapping[str, int]) -> list[str]:
    """What is wrong with the tables train, queries, items: row counts, ids, and columns that should share a type."""
    bad = []
    for name, n in expected.items():
        found = tables[name].count()
        if found != n:
            bad.append(f"{name}: {found} rows, not {n}")
    for name, column, pattern, unique in (("queries", "query_id", BASE62_16, True), ("items", "item_id", HEX16, True), ("train", "item_id", HEX16, False)):
        r = id_check(tables[name], column, pattern).first()
        bad += [f"{name}.{column}: {r[what]} {what}" for what in ("nulls", "bad", *(("repeats",) if unique else ())) if r[what]]
    for a, b, column in (("train", "queries", "search_location_id"), ("train", "items", "item_location_id")):
        if tables[a].schema[column].dataType != tables[b].schema[column].dataType:
            bad.append(f"{column}: types of {a} and {b} differ")
    return bad


def query_set(train: DataFrame, bench: DataFrame, split=None) -> tuple[DataFrame, DataFrame]:
    """(queries, train slice): the benchmark with all clicks, or a split with its rest. What is learnt from clicks takes the
    slice, never the whole."""
    return (bench, train) if split is None else (split.queries, split.rest)


def save_splits(splits: Mapping[str, object], path: str) -> None:
    for name, s in splits.items():
        for part in ("queries", "rel", "rest"):
            getattr(s, part).write.mode("overwrite").parquet(f"{path}/{name}/{part}")


def load_split(spark: SparkSession, path: str, name: str):
    from ..operators.splits import Split

    return Split(*[spark.read.parquet(f"{path}/{name}/{part}") for part in ("queries", "rel", "rest")])


def cached(spark: SparkSession, root: str, kind: str, config: object, build: Callable[[], DataFrame]) -> DataFrame:
    """The artifact made under ``config``, read if it was written whole before, else built and written."""
    path = f"{root}/{kind}-{config_key(config)}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_answers(answers: DataFrame, path: str) -> None:
    """CSV with query_id and answer (ids joined by a space), a header, and line feeds."""
    answers.select("query_id", "answer").write.mode("overwrite").option("header", True).option("lineSep", "\n").csv(path)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("query_id string, answer string").csv(path)


def answer_problems(answers: DataFrame, queries: DataFrame, items: DataFrame, most: int = MOST) -> DataFrame:
    """(rule, n): violations of each rule of an answer table; all 0 if it is fine.

    Rules: one row a query; just the queries asked; ids of 16 characters; 1 to ``most`` ids between single spaces;
    no id twice; ids of hexadecimal digits; ids of the corpus.
    """
    a = answers.select("query_id", "answer")
    toks = F.split(F.coalesce("answer", F.lit("")), " ")
    per = a.select("query_id", toks.alias("t"))
    n = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(True)).cast("long")), F.lit(0))
    rows = per.agg(
        (F.count("query_id") - F.countDistinct("query_id")).alias("repeated_query"), n(F.length("query_id") != 16).alias("query_length"), n(F.exists("t", lambda x: x == "")).alias("spacing"),
        n(F.size("t") > most).alias("too_many"), n(F.size(F.array_distinct("t")) != F.size("t")).alias("repeated_item"), n(F.exists("t", lambda x: (x != "") & ~x.rlike(HEX16))).alias("not_hex"),
    )
    ids = per.select(F.explode("t").alias("item_id")).where("item_id <> ''")
    counts = [
        rows.unpivot([], rows.columns, "rule", "n"),
        a.join(queries.select("query_id"), "query_id", "left_anti").agg(F.lit("unknown_query").alias("rule"), F.count(F.lit(1)).alias("n")),
        queries.select("query_id").join(a, "query_id", "left_anti").agg(F.lit("missing_query").alias("rule"), F.count(F.lit(1)).alias("n")),
        ids.join(items.select("item_id"), "item_id", "left_anti").agg(F.lit("not_in_corpus").alias("rule"), F.count(F.lit(1)).alias("n")),
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out


def validate_answers(answers: DataFrame, queries: DataFrame, items: DataFrame, most: int = MOST) -> dict[str, float]:
    """Statistics of the list lengths, or ValueError with all rules broken."""
    if set(answers.columns) != {"query_id", "answer"}:
        raise ValueError(f"columns are {answers.columns}")
    bad = {r["rule"]: r["n"] for r in answer_problems(answers, queries, items, most).collect() if r["n"]}
    if bad:
        raise ValueError(f"answers break rules: {bad}")
    r = answers.select(F.size(F.split("answer", " ")).alias("n")).agg(F.count(F.lit(1)).alias("rows"), F.avg("n").alias("mean_len"), F.min("n").alias("min_len"), F.max("n").alias("max_len")).first()
    return r.asDict()
