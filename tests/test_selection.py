"""Exact percentiles and permutations."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions.permutations import shuffled_place
from lodestone.operators import quantiles
from tests.conftest import SF


@pytest.mark.parametrize("seed", [1])
def test_percentile_equals_that_of_sql(spark, seed):
    rng = random.Random(seed)
    values = [rng.choice([None, float("nan"), 1.0, 2.5, 2.5, -0.0, 0.0, rng.gauss(0, 1e9), 10 ** rng.uniform(-300, 300)]) for _ in range(700)]
    df = spark.createDataFrame([(i % 3 if i % 11 else None, v) for i, v in enumerate(values)], "g int, v double").repartition(5).cache()
    for p in (0.0, 0.1, 0.77, 1.0):
        want = df.agg(F.expr(f"percentile(v, {p})")).first()[0]
        got = quantiles.percentile(df, "v", p, most=10)
        assert got == pytest.approx(want, rel=1e-12, nan_ok=True)
    p = 0.37
    want = {r["g"]: r["x"] for r in df.groupBy("g").agg(F.expr(f"percentile(v, {p})").alias("x")).collect()}
    got = {r["g"]: r["x"] for r in quantiles.percentiles_by(df, ["g"], "v", p, "x").collect()}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g], rel=1e-12, nan_ok=True) for g in want)


def test_percentile_of_ties_nothing_and_one(spark):
    ties = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.lit(4.0)).alias("v"))
    assert quantiles.percentile(ties, "v", 0.3, most=10) == 4.0
    empty = ties.where("v > 9")
    assert quantiles.percentile(empty, "v", 0.3) is None
    assert math.isnan(quantiles.percentile(spark.sql("SELECT double('nan') AS v"), "v", 0.5))
    assert [tuple(r) for r in quantiles.percentiles_by(ties.limit(1).withColumn("g", F.lit("a")), ["g"], "v", 0.5, "x").collect()] == [("a", None)]
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    for c in ("l_discount", "l_extendedprice"):
        want = lines.agg(F.expr(f"percentile({c}, 0.661)")).first()[0]
        assert quantiles.percentile(lines, c, 0.661, most=50) == pytest.approx(float(want), rel=1e-12)


def test_permutation_is_a_bijection(spark):
    sizes = [*range(1, 70), 127, 128, 129, 1000, 4096, 10_000]
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").collect()
    for r in rows[::9] + rows[-3:]:
        n = r["n"]
        places = [x["p"] for x in spark.range(n).select(shuffled_place(F.col("id"), n, n + 3).alias("p")).collect()]
        assert sorted(places) == list(range(n))
        if n > 100:
            assert places != [x["p"] for x in spark.range(n).select(shuffled_place(F.col("id"), n, n + 4).alias("p")).collect()]
            assert sum(a == b for a, b in enumerate(places)) < 10 and sum(b == a + 1 for a, b in zip(places, places[1:], strict=False)) < 10
    big = spark.range(300_000).select(shuffled_place(F.col("id"), 300_000, 1).alias("p")).agg(F.count_distinct("p"), F.sum("p"), F.min("p"), F.max("p")).first()
    assert tuple(big) == (300_000, 300_000 * 299_999 // 2, 0, 299_999)
    wide = spark.range(1000).select(shuffled_place(F.col("id") * (1 << 50), 1 << 60, 1).alias("p")).agg(F.count_distinct("p"), F.min("p")).first()
    assert wide[0] == 1000 and wide[1] >= 0
    assert spark.sql("SELECT CAST(NULL AS LONG) AS i UNION ALL SELECT 7L").select(shuffled_place(F.col("i"), 7, 1).alias("p")).where("p IS NULL").count() == 2
