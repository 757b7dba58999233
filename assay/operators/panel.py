"""The price panel: long rows (t, asset, price), a calendar of its dates, and the dense grid of both.

Lags go by calendar rows, so everything that looks back or ahead works on the dense grid, where a missing price is null. The grid is dealt out by asset
once, and all windows of an asset then run where its rows are. Dates have one row a day at most, so tables of dates come to the driver and go back as
local tables.
Extra key columns, such as run_id, may lead; every operator then works within each key.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assay.functions.columns import clean, ratio

FIELDS = ("t", "i", "asset", "price", "score", "ret", "vol", "fwd")


def keys_of(df: DataFrame) -> list[str]:
    """Key columns that tell runs apart."""
    return [c for c in df.columns if c not in FIELDS]


def by_asset(df: DataFrame):
    return W.partitionBy(*keys_of(df), "asset").orderBy("t")


def by_date(df: DataFrame):
    return W.partitionBy(*keys_of(df), "t")


def normalised(prices: DataFrame) -> DataFrame:
    """Typed columns, dates without time, NaN prices as null."""
    return prices.select(F.col("t").cast("date").alias("t"), F.col("asset").cast("string").alias("asset"), clean(F.col("price").cast("double")).alias("price"))


def from_wide(frame: DataFrame, date_col: str) -> DataFrame:
    """A wide frame, one column for each asset, as long rows."""
    assets = [c for c in frame.columns if c != date_col]
    cast = frame.select(F.col(date_col).alias("t"), *[F.col(f"`{c}`").cast("double").alias(c) for c in assets])
    return normalised(cast.unpivot(["t"], assets, "asset", "price"))


def to_wide(df: DataFrame, value: str) -> DataFrame:
    """Long rows as one column for each asset: for reports on few assets."""
    return df.groupBy("t").pivot("asset").agg(F.first(value)).orderBy("t")


def local(spark: SparkSession, columns: dict[str, list], **types: pa.DataType) -> DataFrame:
    """A small table that is part of the plan: no job, no shuffle and no scan to read it."""
    return spark.createDataFrame(pa.table({k: pa.array(v, types[k]) for k, v in columns.items()}))


def dates_of(prices: DataFrame) -> list:
    """The panel's dates in order: as many as there are days, whatever the number of rows."""
    return sorted(r["t"] for r in prices.select("t").distinct().collect() if r["t"] is not None)


def calendar(prices: DataFrame, dates: list | None = None) -> DataFrame:
    """(t, i): distinct dates in order, numbered from 0, as a local table."""
    dates = dates_of(prices) if dates is None else dates
    return local(prices.sparkSession, {"t": dates, "i": list(range(len(dates)))}, t=pa.date32(), i=pa.int32())


def densify(prices: DataFrame, dates: list | None = None) -> DataFrame:
    """(t, asset, price) for every date and asset of the panel; of repeated rows of a date and an asset one stays.

    Each row brings the dates from its own up to the asset's next one, and the first row those before it, so one shuffle by asset does it."""
    dates = dates_of(prices) if dates is None else dates
    if not dates:
        return prices.select("t", "asset", "price")
    cal = F.broadcast(calendar(prices, dates))
    w = W.partitionBy("asset").orderBy("i")
    rows = prices.join(cal, "t").select("asset", "i", "price")
    first, after = F.when(F.lag("i").over(w).isNull(), F.lit(0)).otherwise(F.col("i")), F.lead("i", 1, len(dates)).over(w)
    rows = rows.select("asset", "i", "price", first.alias("_a"), after.alias("_b")).where("_b > i")
    rows = rows.select("asset", "price", F.col("i").alias("_i"), F.explode(F.sequence("_a", F.col("_b") - 1)).alias("i"))
    return rows.join(cal, "i").select("t", "asset", F.when(F.col("i") == F.col("_i"), F.col("price")).alias("price"))


def returns(grid: DataFrame, pad_gaps: bool = True) -> DataFrame:
    """grid with ret, the simple return. pad_gaps carries the last price over interior gaps first."""
    w = by_asset(grid)
    if not pad_gaps:
        return grid.withColumn("ret", ratio(F.col("price"), F.lag("price").over(w)) - 1)
    filled = grid.withColumn("_ff", F.last("price", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return filled.withColumn("ret", ratio(F.col("_ff"), F.lag("_ff").over(w)) - 1).drop("_ff")


def rolling_vol(rets: DataFrame, window: int, min_periods: int | None = None, ann: float = 252) -> DataFrame:
    """rets with vol, the annualised deviation of the last `window` returns where at least min_periods of them exist."""
    need = int(window * 0.7) if min_periods is None else min_periods
    w = by_asset(rets).rowsBetween(-(window - 1), 0)
    return rets.withColumn("vol", F.when(F.count("ret").over(w) >= need, F.stddev_samp("ret").over(w) * F.sqrt(F.lit(float(ann)))))


def forward_returns(grid: DataFrame, horizon: int) -> DataFrame:
    """grid with fwd, the return over the next `horizon` calendar rows, gaps not padded."""
    return grid.withColumn("fwd", ratio(F.lead("price", horizon).over(by_asset(grid)), F.col("price")) - 1)


def align(scores: DataFrame, grid: DataFrame) -> DataFrame:
    """Scores on the panel's grid, null where there is none; others go."""
    return grid.select("t", "asset").join(scores.select("t", "asset", "score"), ["t", "asset"], "left")


def hygiene(prices: DataFrame, min_median: float = 5.0, max_move: float = 3.0) -> DataFrame:
    """Prices of assets whose median price is at least min_median and whose largest absolute return is below max_move."""
    rets = returns(densify(prices))
    good = rets.groupBy("asset").agg(F.median("price").alias("m"), F.max(F.abs("ret")).alias("x")).where((F.col("m") >= min_median) & (F.col("x") < max_move))
    return prices.join(good.select("asset"), "asset", "left_semi").select("t", "asset", "price")


def benchmark_returns(prices: DataFrame) -> DataFrame:
    """(t, bench): the equal-weight mean return of all assets, 0 where there is none."""
    return returns(densify(prices)).groupBy("t").agg(F.coalesce(F.avg("ret"), F.lit(0.0)).alias("bench"))
