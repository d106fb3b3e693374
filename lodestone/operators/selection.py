"""Slices, shards, permutations, samples and selections of rows."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.permutations import shuffled_place
from lodestone.session import if_small, materialised


def in_ranges(df: DataFrame, order: list[str], part: str = "__part", own: str = "__own") -> DataFrame:
    """df dealt by ranges of the order and sorted, with the number of each row's range and its place in it.

    Materialised: a partition's number is only one as long as nothing plans the partitions anew, which two readers of one
    plan may do in two ways.
    """
    row = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialised(ranged.withColumns({part: F.shiftright(row, 33), own: row.bitwiseAND((1 << 33) - 1)}))


def indexed(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """df with dense places from 0 in the order, in two levels: places within ranges of the order, plus the counts of the ranges before."""
    ranged = in_ranges(df, order)
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))  # a row a partition
    return ranged.join(F.broadcast(starts), "__part").withColumn(name, F.col("__base") + F.col("__own")).drop("__part", "__own", "__base")


def attached(left: DataFrame, right: DataFrame, order_left: list[str], order_right: list[str], take: list[str]) -> DataFrame:
    """left with the columns `take` of right, row by row in the two orders; an error if one has more rows than the other."""
    a, b = indexed(left, order_left, "__place"), indexed(right, order_right, "__place").select("__place", *[F.col(c).alias(f"__r_{c}") for c in take])
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"{n} rows can't be attached to {m}")
    own = [c for c in left.columns if c not in take]
    return a.join(b, "__place").select(*own, *[F.col(f"__r_{c}").alias(c) for c in take])


def view(df: DataFrame, start: int = 0, stop: int | None = None, step: int = 1, idx: str = "idx") -> DataFrame:
    """Rows whose place is start, start + step, ... below stop."""
    keep = (F.col(idx) >= start) & ((F.col(idx) - start) % step == 0)
    return df.where(keep if stop is None else keep & (F.col(idx) < stop))


def shard(df: DataFrame, n: int, i: int, mode: str, total: int | None = None, idx: str = "idx") -> DataFrame:
    """Shard i of n: 'strided', or contiguous blocks of ceil ('ceil') or floor ('floor'; the rest goes to no shard) of total / n rows."""
    if mode == "strided":
        return df.where(F.col(idx) % n == i)
    if total is None or mode not in ("ceil", "floor"):
        raise ValueError("mode is strided, or ceil or floor with the total")
    size = -(-total // n) if mode == "ceil" else total // n
    return df.where((F.col(idx) >= i * size) & (F.col(idx) < (i + 1) * size))


def permutation(n: int, seed: int) -> list[int]:
    """The order in which the standard generator with this seed shuffles n places."""
    places = list(range(n))
    random.Random(seed).shuffle(places)
    return places


def shuffled(df: DataFrame, n: int, seed: int, idx: str = "idx") -> DataFrame:
    """df with `place`, its row's place after the shuffle. For tasks, whose n rows are few; `hash_shuffled` is for corpora."""
    rows = pd.DataFrame({idx: permutation(n, seed), "place": range(n)})
    return df.join(if_small(df.sparkSession.createDataFrame(rows, f"{idx} long, place long"), 16), idx)


def hash_shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """df with `place`, a text to order by, the MD5 of seed and key: the same for the same seed on any cluster and in other engines."""
    return df.withColumn("place", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")))


def permuted(df: DataFrame, n: int, seed: int, idx: str = "idx") -> DataFrame:
    """df, of n rows with dense indices from 0, with `place`: a permutation of the indices as a function of each, so nothing is sorted or moved and nothing passes the driver."""
    return df.withColumn("place", shuffled_place(F.col(idx), n, seed))


def corpus_mixture(tasks: list[DataFrame], seed: int) -> DataFrame:
    """As `mixture`, for corpora: task, local, ... and place, a keyed permutation of all rows. A task given twice comes twice. The driver has the tasks' sizes alone."""
    sizes = [t.count() for t in tasks]
    start = F.element_at(F.array(*[F.lit(sum(sizes[:k])).cast("long") for k in range(len(sizes))]), F.col("task") + 1)
    return sequence(tasks).withColumn("place", shuffled_place(start + F.col("local"), sum(sizes), seed))


def mixture(tasks: list[DataFrame], seed: int = 42) -> DataFrame:
    """The rows (idx, ...) of several tasks, shuffled together: task, local, place. A task given twice comes twice."""
    sizes = [t.count() for t in tasks]
    pairs = [(k, i) for k, n in enumerate(sizes) for i in range(n)]
    random.Random(seed).shuffle(pairs)
    spark = tasks[0].sparkSession
    places = spark.createDataFrame(pd.DataFrame({"task": [p[0] for p in pairs], "local": [p[1] for p in pairs], "place": range(len(pairs))}), "task int, local long, place long")
    rows = None
    for k, t in enumerate(tasks):
        one = t.withColumnRenamed("idx", "local").withColumn("task", F.lit(k))
        rows = one if rows is None else rows.unionByName(one)
    return rows.join(if_small(places, 20), ["task", "local"])


def sequence(tasks: list[DataFrame]) -> DataFrame:
    """The rows (idx, ...) of several tasks one task after the other: task, local."""
    rows = None
    for k, t in enumerate(tasks):
        one = t.withColumnRenamed("idx", "local").withColumn("task", F.lit(k))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def few_shot_places(i: int, n: int, k: int, seed: int = 1234) -> list[int]:
    """For item i of n, k others, as the standard generator with seed + i samples them from the items but i."""
    return [j + (j >= i) for j in random.Random(seed + i).sample(range(n - 1), k)]


def few_shots(items: DataFrame, n: int, k: int, columns: list[str], seed: int = 1234) -> DataFrame:
    """idx and examples, the k sampled others of each item, in order, as structs of the columns. Samples are drawn where the items are."""
    if k > n - 1:
        raise ValueError("there are fewer other items than shots")

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            drawn = [(i, s, j) for i in part["idx"].tolist() for s, j in enumerate(few_shot_places(i, n, k, seed))]
            yield pd.DataFrame(drawn, columns=["idx", "shot", "other"])

    places = items.select(F.col("idx").cast("long").alias("idx")).mapInPandas(draw, "idx long, shot int, other long")
    other = items.select(F.col("idx").alias("other"), F.struct(*columns).alias("e"))
    met = places.join(other, "other").groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("shot", "e"))).alias("x"))
    return met.select("idx", F.col("x.e").alias("examples"))


def greedy_cover(x: np.ndarray, budget: int) -> list[int]:
    """Facility location by lazy greedy: rows whose similarity (the greatest distance less the distance) covers all rows best; the lowest row on ties."""
    import heapq

    square = (x * x).sum(1)
    sim = np.empty((len(x), len(x)), np.float32)
    for a in range(0, len(x), 1024):  # in double precision, a band of rows at a time
        sim[a : a + 1024] = np.sqrt(np.maximum(0, square[a : a + 1024, None] + square[None, :] - 2 * x[a : a + 1024] @ x.T))
    np.fill_diagonal(sim, 0)
    np.subtract(sim.max(initial=0), sim, out=sim)
    best = np.zeros(len(x), np.float32)
    heap = [(-float(np.maximum(sim[i] - best, 0).sum(dtype=np.float64)), i, 0) for i in range(len(x))]
    heapq.heapify(heap)
    out: list[int] = []
    while heap and len(out) < budget:
        gain, i, at = heapq.heappop(heap)
        if at == len(out):
            out.append(i)
            best = np.maximum(best, sim[i])
        else:
            heapq.heappush(heap, (-float(np.maximum(sim[i] - best, 0).sum(dtype=np.float64)), i, len(out)))
    return out


def facility_location(df: DataFrame, idx: str, vector: str, share: float = 0.8, slice_rows: int = 10_000) -> DataFrame:
    """idx, slice and pick (the order of choice) of int(share * n) rows of each slice of `slice_rows` rows in the order of idx, whatever gaps it has; a slice bounds a task's memory at 4 * slice_rows squared bytes."""

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx").reset_index(drop=True)
        x = np.array(part["v"].tolist(), np.float32).astype(np.float64)
        picks = greedy_cover(x, int(share * len(part)))
        return pd.DataFrame({"idx": part["idx"].iloc[picks].to_numpy(), "slice": int(part["slice"].iloc[0]), "pick": range(len(picks))})

    rows = indexed(df.select(F.col(idx).cast("long").alias("idx"), F.col(vector).alias("v")), ["idx"], "place").select("idx", "v", F.floor(F.col("place") / slice_rows).alias("slice"))
    return rows.groupBy("slice").applyInPandas(choose, "idx long, slice long, pick int").withColumnRenamed("idx", idx)
