"""The attacks: each measures what would differ if a result were false, and returns a Finding. A docstring's first line says what is measured.

Trials of an attack (shuffles, sub-universes, parameter settings, cost levels) are runs of one plan, told apart by run_id. Nothing loops over
trials but the evaluation of a signal for each distinct setting of its own arguments.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions.columns import finite
from assay.report import Demand, Finding

from . import metrics as M
from .panel import densify, local
from .portfolio import Spec, run_table
from .resample import block_paths, path_sharpes, subuniverses
from .shuffles import held_days, shuffled_moves
from .simulate import Market, market, net, settle

SIZES = (20, 50, 100, 250, 500)
LEVELS = (0, 5, 10, 20, 30, 50, 75, 100)


def _num(x) -> float:
    return math.nan if x is None else float(x)


def on_signal_dates(m: Market, scores: DataFrame) -> DataFrame:
    """Only scores of signal dates matter to the engine."""
    return on_dates(scores, [r["t_signal"] for r in m.schedule.collect()])


def on_dates(scores: DataFrame, dates: list) -> DataFrame:
    """Scores of these dates. As values, dates reach below the cross-section of a signal, so other dates' rows are not dealt out."""
    return scores.where(F.col("t").isin(dates))


def canary_sharpes(m: Market, scores: DataFrame, spec: Spec, mask: DataFrame | None = None, shift_days: int = 42) -> DataFrame:
    """(run_id honest | shifted, sharpe): shifted scores come from shift_days rows ahead."""
    dates = [r["t"] for r in m.calendar.orderBy("i").collect()]
    at = {t: i + shift_days for i, t in enumerate(dates)}
    signal = [r["t_signal"] for r in m.schedule.collect() if 0 <= at[r["t_signal"]] < len(dates)]
    later = local(scores.sparkSession, {"t": [dates[at[t]] for t in signal], "t_signal": signal}, t=pa.date32(), t_signal=pa.date32())
    ahead = on_dates(scores, [dates[at[t]] for t in signal]).join(F.broadcast(later), "t").select(F.lit(1).alias("sig"), F.col("t_signal").alias("t"), "asset", "score")
    both = on_signal_dates(m, scores).select(F.lit(0).alias("sig"), "t", "asset", "score").unionByName(ahead)
    return M.sharpes(held_days(m, both, {"honest": (0, spec), "shifted": (1, spec)}, mask), spec.ann)


def lookahead_canary(m: Market, scores: DataFrame, spec: Spec, mask=None, shift_days: int = 42) -> Finding:
    """Sharpe gained by scores moved back in time; one that sees the future already gains little."""
    s = {r["run_id"]: _num(r["sharpe"]) for r in canary_sharpes(m, scores, spec, mask, shift_days).collect()}
    return Finding("Look-ahead canary", {"gain": s["shifted"] - s["honest"], **s}, Demand("gain", "above", 0.5))


def permutation_sharpes(m: Market, scores: DataFrame, spec: Spec, mask=None, n: int = 200, seed: int = 0, zero_cost: bool = True) -> DataFrame:
    """(run_id, sharpe) of the real scores (`real`) and of n shuffles (`p0`, ...)."""
    s = spec.but(cost_bps=0.0) if zero_cost else spec
    base = on_signal_dates(m, scores.select("t", "asset", "score"))
    runs = run_table(scores.sparkSession, {"real": s} | {f"p{k}": s for k in range(n)})
    return M.sharpes(net(settle(m, shuffled_moves(m, base, s, mask, n, seed), runs), s.cost_bps), spec.ann)


def permutation_summary(sharpes: DataFrame) -> DataFrame:
    """One row: real, p, null_mean, null_sd, n_null. p is the share of finite null Sharpes at or above the real one; null if either is missing."""
    real, own = F.col("run_id") == "real", F.col("sharpe")
    # a list of one number a run, so that the runs are read, and held, once
    one = sharpes.agg(F.max(F.when(real, own)).alias("real"), F.collect_list(F.when(~real & finite(own), own)).alias("null"))
    j = one.select("real", F.explode_outer("null").alias("sharpe"))
    p = F.avg(F.when(F.col("real").isNotNull(), (F.col("sharpe") >= F.col("real")).cast("int")))
    return j.agg(F.first("real").alias("real"), p.alias("p"), F.avg("sharpe").alias("null_mean"), F.stddev_samp("sharpe").alias("null_sd"), F.count("sharpe").alias("n_null"))


def permutation_null(m: Market, scores: DataFrame, spec: Spec, mask=None, n: int = 200, seed: int = 0, max_p: float = 0.05, zero_cost: bool = True) -> Finding:
    """Share of shuffles of each date's scores whose Sharpe is no less; costless, as shuffled books trade more."""
    r = permutation_summary(permutation_sharpes(m, scores, spec, mask, n, seed, zero_cost)).first()
    return Finding("Permutation null", {c: _num(r[c]) for c in ("p", "real", "null_mean", "null_sd")} | {"shuffles": n}, Demand("p", "at most", max_p))


def breadth_sharpes(prices: DataFrame, signal: Callable, spec: Spec, sizes=SIZES, draws: int = 8, seed: int = 0, mask=None, m: Market | None = None) -> DataFrame:
    """(run_id, size, sharpe): the signal evaluated anew on each sub-universe, as its scores depend on the cross-section."""
    m = m or market(prices, spec)
    assets = prices.select("asset").distinct()
    total = assets.count()
    sizes = [s for s in sizes if s <= total]
    if not sizes:
        return prices.sparkSession.createDataFrame([], "run_id string, size int, sharpe double")
    sub = subuniverses(assets, sizes, draws, seed)
    scores = on_signal_dates(m, signal(m.grid.join(sub.select("run_id", "asset"), "asset").select("run_id", "t", "asset", "price")))
    ids = [f"{s}_{d}" for s in sizes for d in range(draws)]
    scores = scores.withColumn("sig", F.array_position(F.array(*[F.lit(x) for x in ids]), F.col("run_id")) - 1)
    drawn = replace(m, growth=m.growth.join(sub.select("asset").distinct(), "asset", "left_semi"))  # no other names are held
    out = M.sharpes(held_days(drawn, scores, {x: (k, spec) for k, x in enumerate(ids)}, mask), spec.ann)
    return out.select("run_id", F.split("run_id", "_")[0].cast("int").alias("size"), "sharpe")


def breadth_medians(sharpes: DataFrame) -> DataFrame:
    return sharpes.groupBy("size").agg(F.median("sharpe").alias("median_sharpe"))


def breadth_curve(prices: DataFrame, signal: Callable, spec: Spec, sizes=SIZES, draws: int = 8, seed: int = 0, mask=None, m: Market | None = None) -> Finding:
    """Median Sharpe on random parts of the universe: above zero for all sizes of 100 names or more."""
    table = breadth_medians(breadth_sharpes(prices, signal, spec, sizes, draws, seed, mask, m)).orderBy("size")
    med = [(r["size"], _num(r["median_sharpe"])) for r in table.collect()]
    if not med:
        return Finding("Breadth", remark="fewer names than any of the sizes", otherwise=True)
    broad = [v for s, v in med if s >= 100 and not math.isnan(v)]
    measures = {"least_of_broad": min(broad, default=math.nan)} | {f"of_{s}": v for s, v in med}
    return Finding("Breadth", measures, Demand("least_of_broad", "above", 0), f"of_{med[-1][0]}", table)


def grid_configs(grid: dict) -> list[dict]:
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def grid_sharpes(prices: DataFrame, signal: Callable, spec: Spec, grid: dict, mask=None, m: Market | None = None) -> DataFrame:
    """(run_id, knobs of the grid, sharpe). Knobs of the spec change it; the others are arguments of the signal. m: a market of the prices, for settings that share its spec."""
    spark, configs = prices.sparkSession, grid_configs(grid)
    known = Spec.knobs()
    plans: dict[Spec, list] = {}
    for n, c in enumerate(configs):
        s = spec.but(**{k: v for k, v in c.items() if k in known})
        shared = spec.but(rebalance=s.rebalance, execution_lag=s.execution_lag, vol_window=s.vol_window, min_names=s.min_names, ann=s.ann, pad_gaps=s.pad_gaps, strict_mask=s.strict_mask)
        plans.setdefault(shared, []).append((f"c{n}", s, {k: v for k, v in c.items() if k not in known}))
    parts = []
    for shared, runs in plans.items():
        on = m if m is not None and m.spec == shared else market(prices, shared)
        signals = sorted({tuple(sorted(args.items())) for _, _, args in runs})
        scores = None
        for k, args in enumerate(signals):
            one = on_signal_dates(on, signal(on.grid, **dict(args))).select(F.lit(k).alias("sig"), "t", "asset", "score")
            scores = one if scores is None else scores.unionByName(one)
        held = {r: (signals.index(tuple(sorted(args.items()))), s) for r, s, args in runs}
        parts.append(M.sharpes(held_days(on, scores, held, mask), shared.ann))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    table = spark.createDataFrame(pa.Table.from_pylist([{"run_id": f"c{n}", **c} for n, c in enumerate(configs)]))
    return F.broadcast(table).join(out, "run_id")


def plateau_summary(sharpes: DataFrame) -> DataFrame:
    """One row: n, share_positive (a missing Sharpe isn't positive), median and p05."""
    positive = F.avg(F.when(F.col("sharpe") > 0, 1).otherwise(0))
    return sharpes.agg(F.count(F.lit(1)).alias("n"), positive.alias("share_positive"), F.median("sharpe").alias("median"), F.percentile("sharpe", F.lit(0.05)).alias("p05"))


def parameter_plateau(prices: DataFrame, signal: Callable, spec: Spec, grid: dict, mask=None, min_positive: float = 0.80, m: Market | None = None) -> Finding:
    """Share of settings of the knobs whose Sharpe is above zero."""
    if not grid or not all(grid.values()):
        return Finding("Parameter plateau", {"settings": 0})
    table = grid_sharpes(prices, signal, spec, grid, mask, m)
    r = plateau_summary(table).first()
    measures = {"share_positive": _num(r["share_positive"]), "settings": r["n"], "median": _num(r["median"]), "p05": _num(r["p05"])}
    return Finding("Parameter plateau", measures, Demand("share_positive", "at least", min_positive), table=table.drop("run_id"))


def cost_levels(gross_days: DataFrame, levels=LEVELS, ann: float = 252) -> DataFrame:
    """(bps, sharpe, cagr) of one run at each cost level: the run itself is shared. gross_days: days with gross and turnover."""
    table = gross_days.sparkSession.createDataFrame([(float(x),) for x in levels], "bps double")
    d = net(gross_days.crossJoin(F.broadcast(table)), "bps")  # a row a level
    from assay.functions.columns import cagr, sharpe

    return d.groupBy("bps").agg(sharpe(F.col("ret"), ann).alias("sharpe"), cagr(F.col("ret"), ann).alias("cagr"))


def cost_curve(gross_days: DataFrame, spec: Spec, levels=LEVELS, min_breakeven: float = 20.0) -> Finding:
    """The cost a side, in basis points, that turnover times it would make equal to the gross growth of a year."""
    table = cost_levels(gross_days, levels, spec.ann).orderBy("bps")
    gross = _num(table.first()["cagr"])
    r = gross_days.agg(F.sum("turnover").alias("x"), F.count(F.lit(1)).alias("n")).first()
    turn = _num(r["x"]) / (r["n"] / spec.ann) if r["n"] else math.nan
    even = gross / turn * 1e4 if math.isfinite(gross) and turn > 0 else math.nan
    return Finding("Cost sensitivity", {"breakeven_bps": even, "gross_cagr": gross, "annual_turnover": turn}, Demand("breakeven_bps", "at least", min_breakeven), table=table)


def bootstrap_quantiles(days: DataFrame, n: int = 2000, block: int = 21, seed: int = 0, ann: float = 252) -> DataFrame:
    """One row: p05, p50, p95 of the Sharpes of n moving-block resamples."""
    s = path_sharpes(block_paths(days, n, block, seed), ann).where(finite(F.col("sharpe")))
    q = s.agg(F.percentile("sharpe", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q"))
    return q.select(F.col("q")[0].alias("p05"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p95"))


def block_bootstrap(days: DataFrame, n: int = 2000, block: int = 21, seed: int = 0, ann: float = 252) -> Finding:
    """The 5th percentile of the Sharpes of resampled blocks of days."""
    if (have := days.where("ret is not null").count()) < 4 * block:
        return Finding("Bootstrap", {"days": have}, remark=f"too short for blocks of {block}")
    r = bootstrap_quantiles(days, n, block, seed, ann).first()
    return Finding("Bootstrap", {c: _num(r[c]) for c in ("p05", "p50", "p95")}, Demand("p05", "above", 0))


def decile_monotonicity(pairs: DataFrame, require: bool = True) -> Finding:
    """Rank correlation of a decile's number with the mean return of its names."""
    means = M.bucket_means(M.quantile_returns(pairs, 10))
    r = M.monotonicity(means).first()
    if r["spread"] is None:
        return Finding("Decile monotonicity", {"dates": 0}, remark="too few scored names on every date")
    return Finding("Decile monotonicity", {"rho": _num(r["rho"]), "spread": r["spread"]}, Demand("rho", "above", 0.6) if require else None, "rho", means.orderBy("bucket"), otherwise=True)


def ic_significance(pairs: DataFrame, least: float) -> Finding:
    """t of the mean rank correlation of scores with the returns that follow, over all names of all dates."""
    r = M.ic_tstat(M.rank_ic(pairs)).first()
    t = _num(r["tstat"])
    return Finding("Signal IC t-stat", {"t": t if math.isfinite(t) else math.nan, "mean_ic": _num(r["mean_ic"]), "dates": r["n_dates"]}, Demand("t", "in size at least", least))


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("densify",)]
