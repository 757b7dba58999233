"""The portfolio simulator, without a loop over days.

Between executions a book is bought and held. With target weights w0 and growth G of each asset since the execution,

    V(t) = 1 + sum w0 (G(t) - 1)      gross(t) = V(t) / V(t - 1) - 1      w(t) = w0 G(t) / V(t)

and turnover at the next execution is the sum of |new w0 - w(t)|. G depends on period, asset and date, not on the run: it is computed once and joined to
the small targets of any number of runs. Costs do not touch weights, so every cost level shares one run.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assay.functions.columns import ratio

from .panel import calendar, dates_of, densify, local, returns, rolling_vol
from .portfolio import Spec, run_table, targets
from .schedule import schedule, settled


@dataclass
class Market:
    """What all runs on one panel share. growth: (period, asset, t, i, g) from each execution to the next one, both included."""

    prices: DataFrame
    grid: DataFrame
    calendar: DataFrame
    schedule: DataFrame
    vol: DataFrame
    growth: DataFrame
    spec: Spec

    def persist(self) -> "Market":
        """The grid alone: volatility and growth are windows on it as it lies."""
        self.grid.persist()
        return self

    def unpersist(self) -> None:
        self.grid.unpersist()


def market(prices: DataFrame, spec: Spec) -> Market:
    """Grid, volatility and growth come out of one shuffle by asset; calendar and schedule are local tables."""
    dates = dates_of(prices)
    grid, cal = densify(prices, dates), calendar(prices, dates)
    sched, periods = settled(schedule(cal, spec.rebalance, spec.execution_lag))
    rets = returns(grid, spec.pad_gaps)
    vol = rolling_vol(rets, spec.vol_window, ann=spec.ann)
    vol = vol.join(F.broadcast(sched.select(F.col("t_signal").alias("t"))), "t", "left_semi").select("t", "asset", "vol")
    # an execution day ends one period and begins the next: it is a row of both
    held = [(dates[i], i, r["period"], r["i_exec"]) for r in periods for i in range(r["i_exec"], len(dates) if r["i_next"] is None else r["i_next"] + 1)]
    held = dict(zip(("t", "i", "period", "i_exec"), zip(*held))) if held else {c: [] for c in ("t", "i", "period", "i_exec")}
    held = local(prices.sparkSession, held, t=pa.date32(), i=pa.int32(), period=pa.int32(), i_exec=pa.int32())
    moves = rets.select("t", "asset", "ret").join(F.broadcast(held), "t")
    factor = F.when(F.col("i") == F.col("i_exec"), F.lit(1.0)).otherwise(1 + F.coalesce("ret", F.lit(0.0)))
    w = W.partitionBy("period", "asset").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    growth = moves.select("period", "asset", "t", "i", F.product(factor).over(w).alias("g"))
    return Market(prices, grid, cal, sched, vol, growth, spec)


def daily(m: Market, w: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, t, gross, turnover, n_positions) from each run's first held date on; every date, at 0, for a run that never holds.

    w: targets (run_id, period, asset, w0); runs: has every run_id."""
    ends = F.broadcast(m.schedule.select("period", "i_exec", "i_next"))
    none = F.lit(None).cast("double")
    # one shuffle by (run, period) serves the books' values, their drifted weights and counts, and the returns from day to day: a
    # period's book has no more rows than a cross-section has names, times the period's days
    held = w.join(m.growth.select("period", "asset", "i", "g"), ["period", "asset"]).join(ends, "period").repartition("run_id", "period")
    value = 1 + F.sum(F.col("w0") * (F.col("g") - 1)).over(W.partitionBy("run_id", "period", "i"))
    held = held.withColumn("v", value).withColumn("wt", ratio(F.col("w0") * F.col("g"), F.col("v")))
    book = held.groupBy("run_id", "period", "i", "i_next").agg(F.max("v").alias("v"), F.count_if(F.abs("wt") > 1e-9).alias("n"))
    before = F.lag("v").over(W.partitionBy("run_id", "period").orderBy("i"))
    book = book.withColumn("gross", ratio(F.col("v"), before) - 1)
    # on an execution day the return is the old book's and the count the new one's
    open_ = F.col("i_next").isNull() | (F.col("i") < F.col("i_next"))
    days_of = book.select("run_id", "i", "gross", none.alias("turnover"), F.when(open_, F.col("n")).alias("n_positions"), F.lit(False).alias("bought"))
    # growth is 1 on the execution day, so the rows of that day are the new targets, and those of the next one what is left of them then
    buys = F.when(F.col("i") == F.col("i_exec"), F.struct("period", F.col("w0").alias("x"), F.lit(True).alias("bought")))
    sells = F.when(F.col("i") == F.col("i_next"), F.struct((F.col("period") + 1).alias("period"), (-F.col("wt")).alias("x"), F.lit(False).alias("bought")))
    orders = held.where("i = i_exec or i = i_next").select("run_id", "asset", F.inline(F.array_compact(F.array(buys, sells)))).repartition("run_id", "period")
    traded = orders.groupBy("run_id", "period", "asset").agg(F.sum("x").alias("x"), F.max("bought").alias("bought"))
    traded = traded.groupBy("run_id", "period").agg(F.sum(F.abs("x")).alias("turnover"), F.max("bought").alias("bought")).join(ends, "period")
    traded = traded.select("run_id", F.col("i_exec").alias("i"), none.alias("gross"), "turnover", F.lit(None).cast("long").alias("n_positions"), "bought")
    return settle(m, days_of.unionByName(traded), runs)


def settle(m: Market, moves: DataFrame, runs: DataFrame) -> DataFrame:
    """daily() of what happened: moves (run_id, i, gross, turnover, n_positions, bought), in any number of rows for a run and a date, null where a row does not tell."""
    zero, no = F.lit(0.0), F.lit(0).cast("long")
    # each run has each date: tables of runs and of dates
    every = runs.select("run_id").crossJoin(F.broadcast(m.calendar)).select("run_id", "i", zero.alias("gross"), zero.alias("turnover"), no.alias("n_positions"), F.lit(False).alias("bought"))
    # a run's days are as many as the calendar has, so all of them meet in one place, in order
    moved = moves.unionByName(every).groupBy("run_id", "i").agg(F.sum("gross").alias("gross"), F.sum("turnover").alias("turnover"), F.max("n_positions").alias("n_positions"), F.max("bought").alias("bought"))
    live = F.min(F.when(F.col("bought"), F.col("i"))).over(W.partitionBy("run_id"))
    out = moved.withColumn("live", live).where("live is null or i >= live").join(F.broadcast(m.calendar), "i")
    return out.select("run_id", "t", "gross", "turnover", "n_positions")


def net(days: DataFrame, cost_bps) -> DataFrame:
    """days with ret, the return after costs of cost_bps (number or column) a side."""
    bps = F.col(cost_bps) if isinstance(cost_bps, str) else F.lit(float(cost_bps))
    return days.withColumn("ret", F.col("gross") - F.col("turnover") * bps / 1e4)


def costed(days: DataFrame, specs: dict[str, Spec]) -> DataFrame:
    """days with ret, each run's costs taken off."""
    costs = {s.cost_bps for s in specs.values()}
    if len(costs) == 1:
        return net(days, costs.pop())
    c = local(days.sparkSession, {"run_id": list(specs), "cost_bps": [float(s.cost_bps) for s in specs.values()]}, run_id=pa.string(), cost_bps=pa.float64())
    return net(days.join(F.broadcast(c), "run_id"), "cost_bps").drop("cost_bps")


def settled_days(days: DataFrame) -> DataFrame:
    """One run's days as a local table, for what reads them several times: as many rows as the calendar has dates."""
    types = {"t": pa.date32(), "gross": pa.float64(), "turnover": pa.float64(), "n_positions": pa.int64(), "ret": pa.float64()}
    rows = days.select("run_id", *types).collect()
    columns = {"run_id": [r["run_id"] for r in rows]} | {c: [r[c] for r in rows] for c in types}
    return local(days.sparkSession, columns, run_id=pa.string(), **types)


@dataclass
class Result:
    """One or more runs: daily has ret, turnover and n_positions; weights has the targets by execution date."""

    daily: DataFrame
    weights: DataFrame
    market: Market

    def weights_wide(self, run_id: str = "base") -> DataFrame:
        """One run's targets as execution dates x assets, 0 where nothing is held: for panels whose assets fit a row."""
        w = self.weights.where(F.col("run_id") == run_id)
        return w.groupBy("t_exec").pivot("asset").agg(F.first("w")).na.fill(0.0).orderBy("t_exec")


def run_many(m: Market, scores: DataFrame, specs: dict[str, Spec], mask: DataFrame | None = None) -> Result:
    """All runs in one plan. scores: (run_id, t, asset, score). The specs' rebalance, execution_lag, vol_window and gates are the market's."""
    runs = run_table(scores.sparkSession, specs)
    need_vol = any(s.weighting == "inverse_vol" for s in specs.values())
    w = targets(scores, runs, m.schedule, m.vol if need_vol else None, mask, m.spec)
    d = costed(daily(m, w, runs), specs)
    weights = w.join(F.broadcast(m.schedule.select("period", "t_exec")), "period").select("run_id", "t_exec", "asset", F.col("w0").alias("w"))
    return Result(d, weights, m)


def run(prices: DataFrame, scores: DataFrame, spec: Spec | None = None, mask: DataFrame | None = None, m: Market | None = None) -> Result:
    """One backtest of scores (t, asset, score), as run_id `base`."""
    spec = spec or Spec()
    m = m or market(prices, spec)
    return run_many(m, scores.select(F.lit("base").alias("run_id"), "t", "asset", "score"), {"base": spec}, mask)
