"""Price panels out of other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.columns import ratio, steady_sum
from assay.operators.panel import normalised


def read_prices(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Long prices (t, asset, price) from files of any format Spark reads."""
    return normalised(spark.read.format(fmt).options(**options).load(path))


def from_pandas(spark: SparkSession, wide) -> DataFrame:
    """Long prices from a wide pandas frame, dates x assets."""
    flat = wide.rename_axis(index="t", columns="asset").stack(future_stack=True).rename("price").reset_index()
    return normalised(spark.createDataFrame(flat.astype({"asset": str, "price": float})))


def line_prices(lines: DataFrame, unit: str, asset: str) -> DataFrame:
    """Mean price per unit sold, by asset and period: a panel with natural gaps."""
    t = F.to_date(F.date_trunc(unit, F.col("l_shipdate").cast("timestamp")))
    g = lines.select(t.alias("t"), F.col(asset).cast("string").alias("asset"), "l_extendedprice", "l_quantity").groupBy("t", "asset")
    return g.agg((steady_sum(F.col("l_extendedprice")) / steady_sum(F.col("l_quantity"))).alias("price"))


def supplier_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_prices(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "week", "l_suppkey")


def brand_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    return line_prices(lines.join(part, "l_partkey"), "month", "p_brand")


def monthly_leaders(prices: DataFrame) -> DataFrame:
    """Membership snapshots of a panel: on each month's first day, the assets whose mean price of the month before was above that month's median.

    A month's median is of the very means it is held against, added in no order, so equal assets stay on one side and the middle one isn't above itself."""
    m = prices.groupBy(F.to_date(F.add_months(F.date_trunc("month", "t"), 1)).alias("valid_from"), "asset").agg(ratio(steady_sum(F.col("price")), F.count("price")).alias("p"))
    mid = m.groupBy("valid_from").agg(F.median("p").alias("mid"))
    return m.join(mid, "valid_from").where("p > mid").groupBy("valid_from").agg(F.array_sort(F.collect_list("asset")).alias("tickers"))
