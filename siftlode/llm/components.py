"""Connected components of a link table, wholly distributed.

Each round, every node joins the neighbour (or itself) whose hash of this round is least, links are renamed to the
new names, and links within a name disappear. Hashes are drawn anew each round, so chains shrink by a constant
factor too and the number of rounds is logarithmic. Once so few links are left that one task holds them, it finishes them:
a round is some ten jobs, however few its links, and what the driver keeps of each is memory. Maps of all rounds are written to
the shared folder and composed at the end; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, ship, work_dir

MAX_ROUNDS = 100
#: Links that one task finishes, 8 MB of them.
LAST_LINKS = 500_000

ship(__name__)


def _finished(links: DataFrame) -> DataFrame:
    """(node, name) of the nodes of few ``links`` (u, v): the least node reachable."""
    kind = links.schema["u"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [b.column(c) for c in (0, 1) for b in held] if (held := [b for b in batches if b.num_rows]) else []
        if ends:
            nodes, at = np.unique(pa.concat_arrays(ends).to_numpy(zero_copy_only=False), return_inverse=True)
            name = nodes[forest(len(nodes), *np.split(at, 2))]
            yield pa.RecordBatch.from_arrays([pa.array(x, ends[0].type) for x in (nodes, name)], names=["node", "name"])

    return links.select("u", "v").coalesce(1).mapInArrow(run, T.StructType([T.StructField("node", kind), T.StructField("name", kind)]))


def connected_components(links: DataFrame, u: str = "u", v: str = "v", last_links: int = LAST_LINKS) -> DataFrame:
    """(node, root) of every node that has a link to another node; a component's nodes share one root, a member.

    Links are undirected and may repeat; links of a node to itself and links with a null end are ignored, so nodes
    that have only such links are absent. An empty table gives an empty one.
    """
    spark, base = links.sparkSession, work_dir(links.sparkSession)
    a, b = F.col(u), F.col(v)
    e = materialise(links.where(a != b).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct(), f"{base}/links0")
    size = most = e.count()
    maps: list[DataFrame] = []
    while size:
        n = len(maps)
        if size <= last_links:
            maps.append(materialise(_finished(e), f"{base}/map{n}"))
            break
        if n == MAX_ROUNDS:
            raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(n)).alias("h"), F.col(c).alias("node"))  # noqa: B023, E731
        both = e.select(F.col("u").alias("node"), rank("v").alias("near")).union(e.select(F.col("v").alias("node"), rank("u").alias("near")))
        best = both.groupBy("node").agg(F.min("near").alias("near"))
        m = materialise(best.select("node", F.least(F.col("near"), rank("node"))["node"].alias("name")), f"{base}/map{n}", 2 * size)
        maps.append(m)
        left, right = m.select(F.col("node").alias("u"), F.col("name").alias("nu")), m.select(F.col("node").alias("v"), F.col("name").alias("nv"))
        e = e.join(left, "u").join(right, "v").where("nu <> nv").select(F.least("nu", "nv").alias("u"), F.greatest("nu", "nv").alias("v"))
        e = materialise(e.distinct(), f"{base}/links{n + 1}", size)
        size = e.count()
    if not maps:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = maps[0].select("node", F.col("name").alias("root"))
    if len(maps) == 1:
        return out
    for m in maps[1:]:
        step = m.select(F.col("node").alias("root"), "name")
        out = out.join(step, "root", "left").select("node", F.coalesce("name", "root").alias("root"))
    return materialise(out, f"{base}/roots", 2 * most)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1 with links (a, b): the least node reachable from each."""
    label, before = np.arange(n), None
    while before is None or (label != before).any():
        before = label.copy()
        low = np.minimum(label[a], label[b])
        for x in (label[a], label[b], a, b):  # where the ends' own labels come too, a long chain takes few rounds
            np.minimum.at(label, x, low)
        label = label[label]
    return label
