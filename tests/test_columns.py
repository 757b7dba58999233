import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assay.functions import columns as C


@pytest.mark.parametrize("m", [20, 37, 91, 100, 333])
def test_bucket_is_qcut_of_first_ranks(spark, m):
    want = pd.qcut(pd.Series(np.arange(1, m + 1, dtype=float)), 10, labels=False).tolist()
    got = spark.range(1, m + 1).select("id", C.quantile_bucket(F.col("id"), F.lit(m)).alias("b")).orderBy("id").toPandas()["b"].tolist()
    assert got == want


def test_average_rank_and_correlation(spark):
    df = pd.DataFrame({"k": [1] * 6, "a": [3.0, 1.0, 3.0, 2.0, 5.0, 3.0], "b": [1.0, 2.0, 2.0, 7.0, 6.0, 0.0]})
    s = spark.createDataFrame(df).withColumn("ra", C.average_rank("a", ["k"])).withColumn("rb", C.average_rank("b", ["k"]))
    got = s.agg(C.pearson("ra", "rb")).first()[0]
    assert got == pytest.approx(df["a"].rank().corr(df["b"].rank()))
    assert spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)], "a double, b double").agg(C.pearson("a", "b")).first()[0] is None
    assert spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], "a double, b double").agg(C.pearson("a", "b")).first()[0] is None


def test_series_metrics(spark):
    r = np.random.default_rng(1).normal(0.001, 0.01, 300)
    df = spark.createDataFrame([(float(x),) for x in r], "r double")
    got = df.agg(C.sharpe(F.col("r"), 252).alias("s"), C.cagr(F.col("r"), 252).alias("c"), C.tstat(F.col("r")).alias("t")).first()
    assert got["s"] == pytest.approx(r.mean() / r.std(ddof=1) * np.sqrt(252))
    assert got["c"] == pytest.approx(np.prod(1 + r) ** (252 / 300) - 1)
    assert got["t"] == pytest.approx(r.mean() / r.std(ddof=1) * np.sqrt(300))
    flat = spark.createDataFrame([(0.0,)] * 5, "r double").agg(C.sharpe(F.col("r"), 252).alias("s"), C.cagr(F.col("r"), 252).alias("c")).first()
    assert flat["s"] is None and flat["c"] == 0
    assert spark.createDataFrame([(-1.5,)], "r double").agg(C.cagr(F.col("r"), 252)).first()[0] == -1
    assert spark.createDataFrame([], "r double").agg(C.cagr(F.col("r"), 252)).first()[0] is None


def test_clip_and_clean_keep_nulls(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (9.0,), (-9.0,)], "x double")
    assert [r[0] for r in df.select(C.clip(C.clean(F.col("x")), -3, 3)).collect()] == [None, None, 3.0, -3.0]


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(50)
    one = {r[0]: r[1] for r in df.repartition(1).select("id", C.draw_below(97, 5, F.col("id"))).collect()}
    two = {r[0]: r[1] for r in df.repartition(7).select("id", C.draw_below(97, 5, F.col("id"))).collect()}
    assert one == two and all(0 <= v < 97 for v in one.values())


@pytest.mark.parametrize("m", [91, 100, 2571, 3441])
def test_mean_of_a_bucket_is_the_sql_s(spark, m):
    """0.7 as a double falls short of the edges that are ranks: 64 of 91 names, 1800 of 2571."""
    import duckdb

    from assay.operators.metrics import quantile_returns
    from assay.plans import sql

    want = duckdb.sql(f"SELECT {sql.bucket('r', 'n')} AS b, avg(r) AS m FROM (SELECT range + 1 AS r, {m}::BIGINT AS n FROM range({m})) GROUP BY b ORDER BY b").fetchall()
    pairs = spark.range(1, m + 1).select(F.lit("2020-01-31").alias("t"), F.col("id").cast("string").alias("asset"), F.col("id").cast("double").alias("score"), F.col("id").cast("double").alias("fwd"))
    assert [(r["bucket"], r["mean_fwd"]) for r in quantile_returns(pairs).orderBy("bucket").collect()] == want
