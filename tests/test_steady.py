"""Prices and memberships that no order of rows changes."""

import math

import numpy as np
from pyspark.sql import functions as F

from assay.functions import columns as C
from assay.sources.panels import line_prices, monthly_leaders


def test_sum_is_the_same_in_any_order(spark):
    rng = np.random.default_rng(2)
    x = [round(v, 2) for v in rng.uniform(900, 105000, 150)] + list(rng.uniform(0, 60, 150))
    sums = {spark.createDataFrame([(float(v),) for v in rng.permutation(x)], "x double").coalesce(1).agg(C.steady_sum(F.col("x"))).first()[0] for _ in range(6)}
    assert sums == {math.fsum(x)}


def test_sum_of_odd_values(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan")), (2, 1.0), (3, float("inf")), (3, 2.0), (4, 1e300), (5, None), (5, 2.5)], "g int, x double")
    got = dict(map(tuple, df.groupBy("g").agg(C.steady_sum(F.col("x")).alias("s")).collect()))
    assert got[1] is None and math.isnan(got[2]) and got[3] == math.inf and got[4] == 1e300 and got[5] == 2.5


def test_equal_assets_stay_on_one_side(spark):
    """Assets with the same lines, read in different orders, have one price, and none is above a median that they make."""
    rng = np.random.default_rng(4)
    lines = [(f"2020-01-{6 + 7 * (j % 3):02d}", round(float(rng.uniform(900, 105000)), 2), float(rng.integers(1, 51))) for j in range(60)]
    rows = [(a, *lines[j]) for a in range(6) for j in rng.permutation(60)]
    df = spark.createDataFrame(rows, "k int, d string, l_extendedprice double, l_quantity double").coalesce(1)
    prices = line_prices(df.withColumn("l_shipdate", F.to_timestamp("d")), "week", "k")
    assert prices.select("t", "price").distinct().count() == prices.select("t").distinct().count()
    assert monthly_leaders(prices).count() == 0
