"""Metrics of return series, information coefficients and quantile returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assay.functions.columns import average_rank, cagr, exact_bucket, pearson, ratio, sharpe, tstat

from .panel import forward_returns
from .portfolio import eligible


def drawdown_path(days: DataFrame) -> DataFrame:
    """days with equity and drawdown. The peak begins with the first equity, so a loss on the first day is none."""
    w = W.partitionBy("run_id").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    d = days.withColumn("equity", F.product(1 + F.col("ret")).over(w))
    return d.withColumn("drawdown", ratio(F.col("equity"), F.max("equity").over(w)) - 1)


def headline(days: DataFrame, ann: float = 252) -> DataFrame:
    """One row a run: sharpe, cagr, max_drawdown, annual_turnover, years, n_days."""
    n = F.count("ret")
    return drawdown_path(days).groupBy("run_id").agg(
        sharpe(F.col("ret"), ann).alias("sharpe"), cagr(F.col("ret"), ann).alias("cagr"), F.min("drawdown").alias("max_drawdown"),
        ratio(F.sum("turnover"), n / ann).alias("annual_turnover"), (n / ann).alias("years"), n.alias("n_days"),
    )


def sharpes(days: DataFrame, ann: float = 252) -> DataFrame:
    """(run_id, sharpe)."""
    return days.groupBy("run_id").agg(sharpe(F.col("ret"), ann).alias("sharpe"))


def scored_forward(scores: DataFrame, grid: DataFrame, dates: DataFrame, horizon: int, mask: DataFrame | None = None) -> DataFrame:
    """(t, asset, score, fwd) on the given dates, where both are known and the name is eligible. Forward returns start at the signal date."""
    fwd = forward_returns(grid, horizon).join(F.broadcast(dates.select("t")), "t", "left_semi").select("t", "asset", "fwd").where("fwd is not null")
    return eligible(fwd.join(scores.where("score is not null").select("t", "asset", "score"), ["t", "asset"]), mask)


def rank_ic(pairs: DataFrame, min_names: int = 20) -> DataFrame:
    """(t, ic, n): rank correlation of score and forward return for each date of min_names names or more."""
    ranked = pairs.select("t", average_rank("score", ["t"]).alias("a"), average_rank("fwd", ["t"]).alias("b"))
    return ranked.groupBy("t").agg(pearson("a", "b").alias("ic"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_names)


def ic_tstat(ics: DataFrame) -> DataFrame:
    """One row: mean_ic, tstat, n_dates."""
    return ics.agg(F.avg("ic").alias("mean_ic"), tstat(F.col("ic")).alias("tstat"), F.count("ic").alias("n_dates"))


def quantile_returns(pairs: DataFrame, n_q: int = 10) -> DataFrame:
    """(t, bucket, mean_fwd): mean forward return by quantile of score; ties in score go by asset. Dates under 2 n_q names are left out."""
    day = W.partitionBy("t")
    p = pairs.withColumn("cnt", F.count(F.lit(1)).over(day)).where(F.col("cnt") >= 2 * n_q)
    p = p.withColumn("rn", F.row_number().over(day.orderBy("score", "asset")))
    p = p.withColumn("bucket", exact_bucket(F.col("rn"), F.col("cnt"), n_q))
    return p.groupBy("t", "bucket").agg(F.avg("fwd").alias("mean_fwd"))


def bucket_means(quantiles: DataFrame) -> DataFrame:
    """(bucket, mean_fwd): means over dates."""
    return quantiles.groupBy("bucket").agg(F.avg("mean_fwd").alias("mean_fwd"))


def monotonicity(means: DataFrame) -> DataFrame:
    """One row: rho, the rank correlation of bucket and mean, and spread, top minus bottom. A row for each bucket goes in."""
    ranked = means.withColumn("_one", F.lit(1)).withColumn("a", average_rank("mean_fwd", ["_one"])).withColumn("b", average_rank("bucket", ["_one"]))
    return ranked.agg(pearson("a", "b").alias("rho"), (F.max_by("mean_fwd", "bucket") - F.min_by("mean_fwd", "bucket")).alias("spread"))
