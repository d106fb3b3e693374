"""Connected components of a distributed edge list, by alternating large and small stars. Nothing reaches the driver but two numbers a round."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, fitted

#: Edges that one task joins.
SHORT = 10_000


def _large_star(e: DataFrame, n: int) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = fitted(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), n)
    return fitted(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), n)


def _small_star(e: DataFrame, n: int) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = fitted(down.groupBy("u").agg(F.min("v").alias("m")), n)
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return fitted(moved.unionByName(least.select("u", F.col("m").alias("v"))), n)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and comp of the nodes of a short edge list."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.setdefault(x, x)) != x:
            above[x] = above[y]
            x = y
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(u), top(v)
            above[max(a, b)] = min(a, b)
    nodes = sorted(above)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], ["node", "comp"])


def components(edges: DataFrame) -> DataFrame:
    """node and comp, the least node that it reaches, for every node of the edges (u, v); loops and repeats don't matter.

    Up to SHORT different edges are joined in one task, which spares some dozen small jobs; more of them by stars, round by round. Both give the same.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if now.count() <= SHORT:
        return cut(now.coalesce(1).mapInArrow(_joined, "node long, comp long"))
    said = None
    while True:
        figures = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if figures["n"] == 0 or figures == said:
            break
        said = figures
        n = figures["n"]
        now = fitted(now, n)
        now = cut(fitted(_small_star(_large_star(now, n), n).distinct(), n))
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return stars.unionByName(stars.select(F.col("comp").alias("node"), "comp").distinct())
