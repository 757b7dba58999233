"""From scores to target weights: eligibility, breadth gate, top and bottom quantile, leg weights under a cap."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assay.functions.columns import ratio

from .panel import local


@dataclass(frozen=True)
class Spec:
    """The knobs of a backtest."""

    quantile: float = 0.10
    long_short: bool = True
    weighting: str = "equal"  # or inverse_vol
    max_weight: float = 0.10
    rebalance: str = "ME"
    execution_lag: int = 1
    cost_bps: float = 5.0
    vol_window: int = 63
    min_names: int = 20
    ann: float = 252
    pad_gaps: bool = True
    strict_mask: bool = False

    def __post_init__(self):
        if self.weighting not in ("equal", "inverse_vol"):
            raise ValueError(f"unknown weighting {self.weighting!r}")
        if not 0 < self.quantile <= 1 or self.max_weight <= 0 or self.execution_lag < 0 or self.vol_window < 2:
            raise ValueError("quantile in (0, 1], positive max_weight, execution_lag of 0 or more and vol_window over 1 are needed")

    @classmethod
    def knobs(cls) -> set[str]:
        return {f.name for f in fields(cls)}

    def but(self, **changes) -> "Spec":
        return replace(self, **changes)


#: Knobs that may differ between the runs of one plan, as columns of `runs`.
RUN_KNOBS = ("quantile", "long_short", "weighting", "max_weight")


def run_table(spark, specs: dict[str, Spec]) -> DataFrame:
    """(run_id, knobs): a row for each run."""
    types = {"quantile": pa.float64(), "long_short": pa.bool_(), "weighting": pa.string(), "max_weight": pa.float64()}
    return local(spark, {"run_id": list(specs)} | {k: [getattr(s, k) for s in specs.values()] for k in RUN_KNOBS}, run_id=pa.string(), **types)


def eligible(scores: DataFrame, mask: DataFrame | None, strict: bool = False) -> DataFrame:
    """Scores of eligible names. mask: (t, asset, eligible). A date that the mask lacks is not restricted, unless strict."""
    if mask is None:
        return scores
    allowed = mask.where("eligible").select("t", "asset").distinct().withColumn("_in", F.lit(True))
    joined = scores.join(allowed, ["t", "asset"], "left")
    if strict:
        return joined.where("_in").drop("_in")
    dates = mask.select("t").distinct().withColumn("_dated", F.lit(True))
    return joined.join(dates, "t", "left").where("_in or _dated is null").drop("_in", "_dated")


def selection(scores: DataFrame, runs: DataFrame, min_names: int = 20) -> DataFrame:
    """(run_id, t, asset, side, n_leg, knobs): the names of each leg. scores: (run_id, t, asset, score) on signal dates."""
    day = W.partitionBy("run_id", "t")
    s = scores.where("score is not null").join(F.broadcast(runs), "run_id")  # a row for each run
    s = s.withColumn("cnt", F.count(F.lit(1)).over(day)).where(F.col("cnt") >= min_names)
    s = s.withColumn("rn", F.row_number().over(day.orderBy("score", "asset")))
    s = s.withColumn("n", F.greatest(F.lit(1), F.bround(F.col("cnt") * F.col("quantile"), 0).cast("int")))
    side = F.when(F.col("rn") > F.col("cnt") - F.col("n"), 1).when(F.col("long_short") & (F.col("rn") <= F.col("n")), -1)
    s = s.withColumn("side", side).where("side is not null")
    return s.withColumn("n_leg", F.count(F.lit(1)).over(W.partitionBy("run_id", "t", "side"))).select("run_id", "t", "asset", "side", "n_leg", "weighting", "max_weight")


def _water_fill(w, cap):
    """Fifty rounds at most of dealing what is over the cap to the others by their weights, then a clip; what stays over is not dealt."""

    def step(acc, _):
        over = F.aggregate(acc, F.lit(0.0), lambda s, x: s + F.when(x > cap, x - cap).otherwise(0.0))
        room = F.aggregate(acc, F.lit(0.0), lambda s, x: s + F.when(x > cap, 0.0).otherwise(x))
        return F.when(over > 0, F.transform(acc, lambda x: F.when(x > cap, cap).otherwise(F.when(room > 0, x + over * ratio(x, room)).otherwise(x)))).otherwise(acc)

    filled = F.aggregate(F.sequence(F.lit(1), F.lit(50)), w, step)
    return F.transform(filled, lambda x: F.least(x, cap))


def leg_weights(legs: DataFrame, vol: DataFrame | None) -> DataFrame:
    """(run_id, t, asset, w0): signed weights. vol: (t, asset, vol) at signal dates, needed for inverse_vol.

    A leg holds a quantile of one date's names, so gathering it for the water fill is bounded by the cross-section."""
    equal = legs.where("weighting = 'equal'").select("run_id", "t", "asset", (F.least(1.0 / F.col("n_leg"), F.col("max_weight")) * F.col("side")).alias("w0"))
    if vol is None:
        return equal
    leg = W.partitionBy("run_id", "t", "side")
    v = legs.where("weighting = 'inverse_vol'").join(vol.select("t", "asset", "vol"), ["t", "asset"], "left").withColumn("vol", F.nullif(F.col("vol"), F.lit(0.0)))
    v = v.withColumn("vol", F.coalesce("vol", F.median("vol").over(leg), F.lit(1.0)))
    g = v.groupBy("run_id", "t", "side", "max_weight").agg(F.array_sort(F.collect_list(F.struct("asset", (1 / F.col("vol")).alias("x")))).alias("m"))
    total = F.aggregate("m.x", F.lit(0.0), lambda s, x: s + x)
    g = g.withColumn("w", F.transform("m.x", lambda x: x / total)).withColumn("w", _water_fill(F.col("w"), F.col("max_weight")))
    filled = g.select("run_id", "t", "side", F.explode(F.arrays_zip(F.col("m.asset").alias("asset"), F.col("w").alias("w"))).alias("z"))
    return equal.union(filled.select("run_id", "t", F.col("z.asset").alias("asset"), (F.col("z.w") * F.col("side")).alias("w0")))


def targets(scores: DataFrame, runs: DataFrame, sched: DataFrame, vol: DataFrame | None, mask: DataFrame | None, spec: Spec) -> DataFrame:
    """(run_id, period, asset, w0). A date under the breadth gate has no rows: the book is sold off."""
    dated = scores.join(F.broadcast(sched.select(F.col("t_signal").alias("t"), "period")), "t")  # a table of dates
    legs = selection(eligible(dated.drop("period"), mask, spec.strict_mask), runs, spec.min_names)
    w = leg_weights(legs, vol)
    return w.join(F.broadcast(sched.select(F.col("t_signal").alias("t"), "period")), "t").where("w0 <> 0").select("run_id", "period", "asset", "w0")
