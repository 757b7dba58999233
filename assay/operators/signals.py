"""Signals: functions from a dense price grid to scores. They work within key columns, so many runs go as one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions.columns import clip, draw_below, ratio

from .panel import by_asset, by_date, keys_of, returns, rolling_vol


def cross_section(df: DataFrame, value: str, bound: float | None = 3.0) -> DataFrame:
    """(keys, t, asset, score): value as a z-score of its date, clipped to +-bound."""
    w = by_date(df.drop(value))
    z = ratio(F.col(value) - F.avg(value).over(w), F.stddev_samp(value).over(w))
    return df.select(*[c for c in keys_of(df) if c != value], "t", "asset", (z if bound is None else clip(z, -bound, bound)).alias("score"))


def momentum(prices: DataFrame, lookback: int = 252, skip: int = 21) -> DataFrame:
    """Return over `lookback` rows ending `skip` rows ago."""
    w = by_asset(prices)
    raw = prices.withColumn("ret", ratio(F.lag("price", skip).over(w), F.lag("price", skip + lookback).over(w)) - 1)
    return cross_section(raw, "ret")


def risk_adjusted_momentum(prices: DataFrame, lookback: int = 252, skip: int = 21, vol_window: int = 126, min_periods: int = 100, ann: float = 252) -> DataFrame:
    """Momentum over the volatility of the last vol_window returns."""
    w = by_asset(prices)
    df = rolling_vol(returns(prices), vol_window, min_periods, ann)
    df = df.withColumn("score", ratio(ratio(F.lag("price", skip).over(w), F.lag("price", skip + lookback).over(w)) - 1, F.col("vol")))
    return cross_section(df.drop("ret", "vol"), "score")


def reversal(prices: DataFrame, lookback: int = 21) -> DataFrame:
    """Against the return of the last rows."""
    w = by_asset(prices)
    return cross_section(prices.withColumn("ret", 1 - ratio(F.col("price"), F.lag("price", lookback).over(w))), "ret")


def leaky(prices: DataFrame, horizon: int = 21) -> DataFrame:
    """A signal that reads the future, for tests of the canary."""
    w = by_asset(prices)
    return cross_section(prices.withColumn("ret", ratio(F.lead("price", horizon).over(w), F.col("price")) - 1), "ret", None)


def noise(prices: DataFrame, seed: int = 0) -> DataFrame:
    """Standard normal scores drawn by keys (Box and Muller), alike under any partitioning."""
    n = 1 << 40
    u = lambda k: (draw_below(n, seed, k, F.col("t").cast("string"), F.col("asset")) + 0.5) / n
    z = F.sqrt(-2 * F.log(u("a"))) * F.cos(F.lit(6.283185307179586) * u("b"))
    return prices.select(*keys_of(prices), "t", "asset", z.alias("score"))


def from_pandas(signal: Callable) -> Callable:
    """Adapter of a signal on a wide pandas frame (dates x assets): each run's panel goes to one task as a whole."""

    def adapted(prices: DataFrame, **kw) -> DataFrame:
        keys = keys_of(prices)
        flat = prices if keys else prices.withColumn("_run", F.lit(0))
        names = keys or ["_run"]
        ddl = ", ".join([f"`{k}` {flat.schema[k].dataType.simpleString()}" for k in names] + ["t date", "asset string", "score double"])

        def one(pdf):
            wide = pdf.pivot(index="t", columns="asset", values="price").sort_index()
            long = signal(wide, **kw).rename_axis(index="t", columns="asset").stack(future_stack=True).rename("score").reset_index()
            for k in names:
                long[k] = pdf[k].iloc[0]
            return long[[*names, "t", "asset", "score"]]

        out = flat.select(*names, "t", "asset", "price").groupBy(*names).applyInPandas(one, ddl)
        return out.withColumn("score", F.when(~F.isnan("score"), F.col("score"))).drop(*([] if keys else ["_run"]))

    return adapted
