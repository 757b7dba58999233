"""The registered queries of the engine, each with its SQL. They run on the weekly supplier panel, whole."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.operators import attacks as A
from assay.operators import metrics as M
from assay.operators import portfolio as P
from assay.operators import resample as R
from assay.operators import signals as S
from assay.operators import walkforward as WF
from assay.operators.panel import benchmark_returns, calendar, densify, forward_returns, hygiene, returns, rolling_vol
from assay.operators.schedule import rebalance_dates, schedule
from assay.operators.simulate import market, net, run, settled_days
from assay.operators.universe import Universe
from assay.session import kept
from assay.sources.panels import brand_months, monthly_leaders, supplier_weeks

from . import sql as Q

WEEKLY = P.Spec(ann=Q.ANN, vol_window=Q.VOL)
# The operators' own defaults, so that a query is the whole attack; a block is four weeks, as the operator's is 21 days.
TRIALS, SIZES, DRAWS, SEED = 200, A.SIZES, 8, 0
PATHS, BLOCK = 2000, 4
GRID = {"lookback": [26, 52], "skip": [0, 4], "quantile": [0.1, 0.2]}
WF_ARGS = {"train_years": 2.0, "test_years": 1.0, "step_years": 1.0}
WF_DAYS = 40


def signal(prices: DataFrame, lookback: int = Q.LOOKBACK, skip: int = Q.SKIP) -> DataFrame:
    return S.momentum(prices, lookback, skip)


def rnd(df: DataFrame, *cols: str) -> DataFrame:
    """Doubles to six places, without a negative zero: engines add in different orders."""
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in cols})


_PANELS: dict[str, DataFrame] = {}


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly supplier panel, aggregated once and kept as files."""
    key = f"{spark.sparkContext.applicationId} {sf_dir}"
    if key not in _PANELS:
        _PANELS[key] = kept(supplier_weeks(spark, sf_dir))
    return _PANELS[key]


class Panel:
    """What a query starts from, lazily but for the calendar."""

    def __init__(self, spark: SparkSession, sf_dir: str, spec: P.Spec = WEEKLY):
        self.spark, self.spec = spark, spec
        self.prices = weekly(spark, sf_dir)
        self.market = market(self.prices, spec)
        self.scores = signal(self.market.grid)

    def base(self, mask: DataFrame | None = None):
        return run(self.prices, self.scores, self.spec, mask, self.market)

    def days(self, mask: DataFrame | None = None):
        return settled_days(self.base(mask).daily)

    def pairs(self):
        return M.scored_forward(self.scores, self.market.grid, rebalance_dates(self.market.calendar), Q.HORIZON)

    def dated(self):
        return A.on_signal_dates(self.market, self.scores.select(F.lit("base").alias("run_id"), "t", "asset", "score"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headline line of a study on the smallest tables: brands by month."""
    spec = P.Spec(ann=12, vol_window=6, min_names=10)
    prices = brand_months(spark, sf_dir)
    m = market(prices, spec)
    return M.headline(run(prices, S.momentum(m.grid, 12, 1), spec, None, m).daily, spec.ann)


def panel_weekly(spark, d):
    return supplier_weeks(spark, d).withColumn("price", F.round("price", 8) + F.lit(0.0))


def simple_returns(spark, d):
    return rnd(returns(densify(weekly(spark, d))).select("t", "asset", "ret"), "ret")


def forward_returns_(spark, d):
    return rnd(forward_returns(densify(weekly(spark, d)), Q.HORIZON).select("t", "asset", "fwd"), "fwd")


def rolling_vol_(spark, d):
    return rnd(rolling_vol(returns(densify(weekly(spark, d))), Q.VOL, ann=Q.ANN).select("t", "asset", "vol"), "vol")


def momentum_zscore(spark, d):
    return rnd(signal(densify(weekly(spark, d))), "score")


def risk_adj_momentum(spark, d):
    return rnd(S.risk_adjusted_momentum(densify(weekly(spark, d)), Q.LOOKBACK, Q.SKIP, 26, 20, Q.ANN), "score")


def noise_scores(spark, d):
    return rnd(S.noise(densify(weekly(spark, d)), 7), "score")


def rebalance_dates_(spark, d):
    return rebalance_dates(calendar(weekly(spark, d)))


def exec_schedule(spark, d):
    s = schedule(calendar(weekly(spark, d)))
    return s.select(F.col("period").cast("long").alias("period"), "t_signal", "t_exec", F.col("i_exec").cast("long").alias("i_exec"), "t_next")


def selection_legs(spark, d):
    p = Panel(spark, d)
    legs = P.selection(p.dated(), P.run_table(spark, {"base": WEEKLY}))
    return legs.select("t", "asset", F.col("side").cast("long").alias("side"), F.col("n_leg").cast("long").alias("n_leg"))


def equal_weights(spark, d):
    return rnd(Panel(spark, d).base().weights.select("t_exec", "asset", "w"), "w")


def inverse_vol_weights(spark, d):
    p = Panel(spark, d, WEEKLY.but(weighting="inverse_vol", quantile=0.15))
    return rnd(p.base().weights.select("t_exec", "asset", "w"), "w")


def daily_backtest(spark, d):
    return rnd(Panel(spark, d).base().daily.select("t", "gross", "turnover", "n_positions", "ret"), "gross", "turnover", "ret")


def headline_metrics(spark, d):
    return rnd(M.headline(Panel(spark, d).days(), Q.ANN), "sharpe", "cagr", "max_drawdown", "annual_turnover", "years")


def drawdown_path(spark, d):
    return rnd(M.drawdown_path(Panel(spark, d).days()).select("t", "equity", "drawdown"), "equity", "drawdown")


def lookahead_canary(spark, d):
    p = Panel(spark, d)
    return rnd(A.canary_sharpes(p.market, p.scores, WEEKLY, None, 8), "sharpe")


def perm_assignment(spark, d):
    p = Panel(spark, d)
    return rnd(R.shuffled(A.on_signal_dates(p.market, p.scores), TRIALS, SEED), "score")


def perm_sharpes(spark, d):
    p = Panel(spark, d)
    return rnd(A.permutation_sharpes(p.market, p.scores, WEEKLY, None, TRIALS, SEED), "sharpe")


def perm_pvalue(spark, d):
    p = Panel(spark, d)
    return rnd(A.permutation_summary(A.permutation_sharpes(p.market, p.scores, WEEKLY, None, TRIALS, SEED)), "real", "p", "null_mean", "null_sd")


def subuniverse_draws(spark, d):
    assets = weekly(spark, d).select("asset").distinct()
    total = assets.count()
    return R.subuniverses(assets, [s for s in SIZES if s <= total], DRAWS, SEED)


def breadth_sharpes(spark, d):
    p = Panel(spark, d)
    return rnd(A.breadth_sharpes(p.prices, signal, WEEKLY, SIZES, DRAWS, SEED, m=p.market), "sharpe")


def breadth_medians(spark, d):
    p = Panel(spark, d)
    return rnd(A.breadth_medians(A.breadth_sharpes(p.prices, signal, WEEKLY, SIZES, DRAWS, SEED, m=p.market)), "median_sharpe")


def param_grid_sharpes(spark, d):
    g = A.grid_sharpes(weekly(spark, d), signal, WEEKLY, GRID)
    return rnd(g.select(F.col("lookback").cast("long").alias("lookback"), F.col("skip").cast("long").alias("skip"), "quantile", "sharpe"), "sharpe")


def plateau_summary(spark, d):
    return rnd(A.plateau_summary(A.grid_sharpes(weekly(spark, d), signal, WEEKLY, GRID)), "share_positive", "median", "p05")


def cost_curve(spark, d):
    return rnd(A.cost_levels(Panel(spark, d).days(), ann=Q.ANN), "sharpe", "cagr")


def cost_breakeven(spark, d):
    days = Panel(spark, d).days()
    h = M.headline(net(days, 0), Q.ANN)
    return rnd(h.select((F.col("cagr") / F.col("annual_turnover") * 1e4).alias("breakeven_bps"), "annual_turnover", F.col("cagr").alias("gross")), "breakeven_bps", "annual_turnover", "gross")


def bootstrap_quantiles(spark, d):
    return rnd(A.bootstrap_quantiles(Panel(spark, d).days(), PATHS, BLOCK, SEED, Q.ANN), "p05", "p50", "p95")


def decile_returns(spark, d):
    return rnd(M.quantile_returns(Panel(spark, d).pairs()), "mean_fwd")


def decile_monotonicity(spark, d):
    return rnd(M.monotonicity(M.bucket_means(M.quantile_returns(Panel(spark, d).pairs()))), "rho", "spread")


def rank_ic(spark, d):
    return rnd(M.rank_ic(Panel(spark, d).pairs()), "ic")


def ic_tstat(spark, d):
    return rnd(M.ic_tstat(M.rank_ic(Panel(spark, d).pairs())), "mean_ic", "tstat")


def _walk(mode: str, long_short: bool = True):
    def q(spark, d):
        p = Panel(spark, d, WEEKLY.but(long_short=long_short))
        days = p.days()
        w = WF.live_windows(days, mode=mode, **WF_ARGS)
        return rnd(WF.window_table(days, WF.benchmark(p.prices, p.spec), w, WF_DAYS, Q.ANN), "is_edge", "oos_edge", "retained", "oos_t")

    return q


def _walk_long_only(spark, d):
    """Against the equal-weight mean, whose growth over a window of this panel is astronomic: edges to nine digits of their own."""
    p = Panel(spark, d, WEEKLY.but(long_short=False))
    days = p.days()
    w = WF.live_windows(days, mode="rolling", **WF_ARGS)
    t = rnd(WF.window_table(days, WF.benchmark(p.prices, p.spec), w, WF_DAYS, Q.ANN), "retained", "oos_t")
    return t.withColumns({c: F.format_string("%.6e", F.col(c)) for c in ("is_edge", "oos_edge")})


def _universe(spark, d):
    prices = weekly(spark, d)
    return prices, Universe(monthly_leaders(prices))


def universe_members(spark, d):
    _, u = _universe(spark, d)
    return u.members_on("1998-06-30")


def universe_tickers(spark, d):
    _, u = _universe(spark, d)
    return u.tickers()


def universe_mask(spark, d):
    prices, u = _universe(spark, d)
    return u.mask(prices.select("t"), prices.select("asset"))


def universe_coverage(spark, d):
    prices, u = _universe(spark, d)
    return u.coverage(prices.select("asset"))


def masked_backtest(spark, d):
    p = Panel(spark, d)
    u = Universe(monthly_leaders(p.prices))
    days = p.base(u.mask(p.prices.select("t"), p.prices.select("asset"))).daily
    return rnd(days.select("t", "gross", "turnover", "n_positions", "ret"), "gross", "turnover", "ret")


def hygiene_filter(spark, d):
    return hygiene(weekly(spark, d), 2050.0, 80.0).withColumn("price", F.round("price", 8) + F.lit(0.0))


def benchmark_returns_(spark, d):
    return rnd(benchmark_returns(weekly(spark, d)), "bench")


CASES = [(0.10, 0.08), (0.10, 0.05), (0.10, 0.02), (0.10, -0.03), (-0.02, 0.09), (0.0, 0.09), (None, 0.05), (0.10, None), (0.10, 0.0)]


def verdict_table(spark, d):
    df = spark.createDataFrame(CASES, "is_edge double, oos_edge double")
    return df.withColumn("verdict", WF.classified(F.col("is_edge"), F.col("oos_edge")))


def walkforward_summary(spark, d):
    p = Panel(spark, d)
    days = p.days()
    w = WF.live_windows(days, mode="rolling", **WF_ARGS)
    return rnd(WF.summary(WF.window_table(days, None, w, WF_DAYS, Q.ANN)), "median_retained", "median_oos")


STUDY_LIMITS = {"min_sharpe": 0.5, "min_ic_tstat": 2.0, "max_turnover": 30, "min_years": 5}


def study_findings(spark, d):
    """The findings of a whole study as rows, without their texts. The criteria are a small file of the driver's own."""
    import json
    import tempfile
    from pathlib import Path

    from assay.study import Study

    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder) / "criteria.json"
        path.write_text(json.dumps({"hypothesis": "prices go on as they went", "kill_criteria": STUDY_LIMITS}))
        s = Study("weekly momentum", weekly(spark, d), signal, path, WEEKLY, horizon=Q.HORIZON, canary_shift=8, bootstrap=(PATHS, BLOCK), breadth=(SIZES, DRAWS),
                  walk_forward={"mode": "single", "min_days": WF_DAYS, **WF_ARGS}, param_grid=GRID)
        return s.run(permutations=TRIALS, verbose=False).to_frame(spark).select("attack", "passed", (F.round("value", 6) + F.lit(0.0)).alias("value"))


def _study_sql(of: dict[str, str]) -> str:
    """What each attack's own query finds, held against the study's limits."""
    broad = "coalesce(min(median_sharpe) FILTER (size >= 100) > 0, false)"
    rows = [
        ("Minimum Sharpe", f"sharpe >= {STUDY_LIMITS['min_sharpe']}", "sharpe", "headline_metrics"), ("Turnover ceiling", f"annual_turnover <= {STUDY_LIMITS['max_turnover']}", "annual_turnover", "headline_metrics"),
        ("Cost sensitivity", "breakeven_bps >= 20", "breakeven_bps", "cost_breakeven"), ("Bootstrap", "p05 > 0", "p05", "bootstrap_quantiles"),
        ("Walk-forward", "min(verdict) = 'PRESERVED' AND max(verdict) = 'PRESERVED'", "median(oos_edge)", "walkforward_single"), ("Decile monotonicity", "rho > 0.6", "rho", "decile_monotonicity"),
        ("Signal IC t-stat", f"abs(tstat) >= {STUDY_LIMITS['min_ic_tstat']}", "tstat", "ic_tstat"),
        ("Look-ahead canary", "max(sharpe) FILTER (run_id = 'shifted') - max(sharpe) FILTER (run_id = 'honest') > 0.5", "max(sharpe) FILTER (run_id = 'shifted') - max(sharpe) FILTER (run_id = 'honest')", "lookahead_canary"),
        ("Parameter plateau", "share_positive >= 0.8", "share_positive", "plateau_summary"), ("Breadth", broad, "max_by(median_sharpe, size)", "breadth_medians"), ("Permutation null", "p <= 0.05", "p", "perm_pvalue"),
    ]
    return "\nUNION ALL ".join(f"SELECT '{name}' AS attack, coalesce({passed}, false) AS passed, {Q.rounded(value)} AS value FROM ({Q.finer(of[query])})" for name, passed, value, query in rows)


def queries() -> dict:
    return {
        "panel_weekly": panel_weekly, "simple_returns": simple_returns, "forward_returns": forward_returns_, "rolling_vol": rolling_vol_, "momentum_zscore": momentum_zscore,
        "risk_adj_momentum": risk_adj_momentum, "noise_scores": noise_scores, "rebalance_dates": rebalance_dates_, "exec_schedule": exec_schedule, "selection_legs": selection_legs, "equal_weights": equal_weights,
        "inverse_vol_weights": inverse_vol_weights, "daily_backtest": daily_backtest, "headline_metrics": headline_metrics, "drawdown_path": drawdown_path, "lookahead_canary": lookahead_canary,
        "perm_assignment": perm_assignment, "perm_sharpes": perm_sharpes, "perm_pvalue": perm_pvalue, "subuniverse_draws": subuniverse_draws, "breadth_sharpes": breadth_sharpes,
        "breadth_medians": breadth_medians, "param_grid_sharpes": param_grid_sharpes, "plateau_summary": plateau_summary, "cost_curve": cost_curve, "cost_breakeven": cost_breakeven,
        "bootstrap_quantiles": bootstrap_quantiles, "decile_returns": decile_returns, "decile_monotonicity": decile_monotonicity, "rank_ic": rank_ic, "ic_tstat": ic_tstat,
        "walkforward_single": _walk("single"), "walkforward_anchored": _walk("anchored"), "walkforward_rolling": _walk("rolling"), "walkforward_long_only": _walk_long_only, "walkforward_summary": walkforward_summary,
        "universe_members": universe_members, "universe_tickers": universe_tickers, "universe_mask": universe_mask, "universe_coverage": universe_coverage, "masked_backtest": masked_backtest,
        "hygiene_filter": hygiene_filter, "benchmark_returns": benchmark_returns_, "verdict_table": verdict_table, "study_findings": study_findings,
    }


# ---------------------------------------------------------------- SQL
def _walk_sql(mode: str, long_short: bool = True, final: str | None = None) -> str:
    """Windows in SQL: their arithmetic on the first and last date of the run."""
    days = lambda y: round(y * 365.25)
    tr, te, st = days(WF_ARGS["train_years"]), days(WF_ARGS["test_years"]), days(WF_ARGS["step_years"])
    if mode == "single":
        win = f"""SELECT 'split-1' AS "window", s AS a, CASE WHEN s + {tr} < e THEN s + {tr} ELSE s + CAST(floor((e - s) / 2) AS INTEGER) END AS b, CASE WHEN s + {tr} < e THEN s + {tr} ELSE s + CAST(ceil((e - s) / 2) AS INTEGER) END AS c, e AS d FROM ends"""
    else:
        moving = f"s + CAST(k * {st} AS INTEGER)" if mode == "rolling" else "s"
        win = f"""SELECT 'w' || (k + 1) AS "window", {moving} AS a, s + CAST({tr} + k * {st} AS INTEGER) AS b, s + CAST({tr} + k * {st} AS INTEGER) AS c, s + CAST({tr + te} + k * {st} AS INTEGER) AS d FROM ends CROSS JOIN range(0, 50) r(k) WHERE s + CAST({tr + te} + k * {st} AS INTEGER) <= e"""
    bench = "SELECT t, coalesce(avg(ret), 0) AS bench FROM rets GROUP BY t" if not long_short else "SELECT t, 0.0 AS bench FROM cal"
    picks = Q.ONE.replace("true AS long_short", f"{str(long_short).lower()} AS long_short")
    grow = lambda c: f"CASE WHEN product(1 + {c}) > 0 THEN pow(product(1 + {c}), {Q.ANN}.0 / count(*)) - 1 ELSE -1 END"
    final = final or """SELECT "window", train, test, {is_edge}, {oos_edge}, {retained}, {oos_t}, verdict FROM judged"""
    shown = {c: f"{Q.rounded(c)} AS {c}" for c in ("is_edge", "oos_edge", "retained", "oos_t")}
    return Q.query(
        final.format(**shown),
        picks=(["scores"], picks),
        ends=(["base"], "SELECT min(t) AS s, max(t) AS e FROM base"),
        win=(["ends"], win),
        bench=(["rets"], bench),
        d=(["base", "bench"], "SELECT b.t, b.ret, x.bench, b.ret - x.bench AS excess FROM base b JOIN bench x ON x.t = b.t"),
        sides=(["win", "d"], f"""SELECT "window", part, count(*) AS n, {grow("ret")} - ({grow("bench")}) AS edge, coalesce(avg(excess) / nullif(stddev_samp(excess), 0) * sqrt(count(*)), 0) AS tstat,
                strftime(any_value(wa), '%Y-%m') || '→' || strftime(any_value(wb), '%Y-%m') AS span
            FROM (SELECT "window", 'train' AS part, a AS wa, b AS wb FROM win UNION ALL SELECT "window", 'test', c, d FROM win) w JOIN d ON d.t BETWEEN wa AND wb GROUP BY "window", part HAVING count(*) >= {WF_DAYS}"""),
        joined=(["sides"], """SELECT r."window", r.span AS train, s.span AS test, r.edge AS is_edge, s.edge AS oos_edge, CASE WHEN r.edge > 0 THEN s.edge / r.edge END AS retained, s.tstat AS oos_t
            FROM sides r JOIN sides s ON r."window" = s."window" AND r.part = 'train' AND s.part = 'test'"""),
        judged=(["joined"], "SELECT *, CASE WHEN is_edge IS NULL OR is_edge <= 0 THEN 'NO_TRAIN_EDGE' WHEN oos_edge IS NULL OR oos_edge < 0 THEN 'SIGN_FLIP' WHEN oos_edge >= 0.5 * is_edge THEN 'PRESERVED' ELSE 'DEGRADED' END AS verdict FROM joined"),
    )


def oracle_sql() -> dict[str, str]:
    r, q = Q.rounded, Q.query
    sharpe_of = lambda source: f"SELECT run_id, {Q.SHARPE} AS sharpe FROM {source} GROUP BY run_id"
    gross = "SELECT run_id, t, gross AS ret FROM daily"
    # shuffles
    slots = "SELECT s.t, s.asset, s.score, row_number() OVER (PARTITION BY s.t ORDER BY s.asset) AS slot FROM scores s JOIN sched d ON d.t_signal = s.t WHERE s.score IS NOT NULL"
    pulled = f"SELECT k, t, asset, row_number() OVER (PARTITION BY k, t ORDER BY md5(concat_ws('|', {SEED} + k, t, asset)), asset) AS slot FROM slots CROSS JOIN range(0, {TRIALS}) z(k)"
    shuffled = "SELECT 'p' || p.k AS run_id, p.t, p.asset, s.score FROM pulled p JOIN slots s ON s.t = p.t AND s.slot = p.slot"
    perm = {
        "slots": (["scores", "sched"], slots), "pulled": (["slots"], pulled), "shuffled": (["pulled"], shuffled),
        "picks": (["shuffled"], "SELECT run_id, t, asset, score, 0.1 AS quantile, 0.1 AS max_weight, true AS long_short FROM shuffled UNION ALL SELECT 'real', t, asset, score, 0.1, 0.1, true FROM scores"),
        "free": (["daily"], gross), "sh": (["free"], sharpe_of("free")),
    }
    # sub-universes
    trials = " UNION ALL ".join(f"SELECT CAST({s} AS INTEGER) AS size, {k} AS draw" for s in SIZES for k in range(DRAWS))
    drawn = f"SELECT size || '_' || draw AS run_id, size, asset FROM (SELECT *, row_number() OVER (PARTITION BY size, draw ORDER BY md5(concat_ws('|', {SEED}, size, draw, asset)), asset) AS rn FROM assets CROSS JOIN ({trials}) WHERE size <= (SELECT count(*) FROM assets)) WHERE rn <= size"
    z = "SELECT run_id, t, asset, CASE WHEN z IS NOT NULL THEN least(greatest(z, -3.0), 3.0) END AS score FROM (SELECT run_id, t, asset, (raw - avg(raw) OVER (PARTITION BY run_id, t)) / nullif(stddev_samp(raw) OVER (PARTITION BY run_id, t), 0) AS z FROM raws)"
    knobs = "0.1 AS quantile, 0.1 AS max_weight, true AS long_short"
    breadth = {
        "drawn": (["assets"], drawn),
        "raws": (["grid", "drawn"], f"SELECT run_id, t, asset, lag(price, {Q.SKIP}) OVER w / lag(price, {Q.SKIP + Q.LOOKBACK}) OVER w - 1 AS raw FROM grid JOIN drawn USING (asset) WINDOW w AS (PARTITION BY run_id, asset ORDER BY i)"),
        "sub": (["raws"], z), "picks": (["sub"], f"SELECT run_id, t, asset, score, {knobs} FROM sub"), "runs": (["drawn"], "SELECT DISTINCT run_id FROM drawn"),
        "sh": (["base"], f"SELECT run_id, CAST(split_part(run_id, '_', 1) AS INTEGER) AS size, {Q.SHARPE} AS sharpe FROM base GROUP BY run_id"),
    }
    # grid
    raws = " UNION ALL ".join(f"SELECT '{a}_{b}' AS run_id, t, asset, lag(price, {b}) OVER (PARTITION BY asset ORDER BY i) / lag(price, {a + b}) OVER (PARTITION BY asset ORDER BY i) - 1 AS raw FROM grid" for a in GRID["lookback"] for b in GRID["skip"])
    quantiles = ", ".join(f"({x})" for x in GRID["quantile"])
    plateau = {
        "raws": (["grid"], raws), "sub": (["raws"], z), "picks": (["sub"], f"SELECT run_id || '_' || quantile AS run_id, t, asset, score, quantile, 0.1 AS max_weight, true AS long_short FROM sub CROSS JOIN (VALUES {quantiles}) v(quantile)"),
        "sh": (["base"], f"SELECT CAST(split_part(run_id, '_', 1) AS BIGINT) AS lookback, CAST(split_part(run_id, '_', 2) AS BIGINT) AS skip, CAST(split_part(run_id, '_', 3) AS DOUBLE) AS quantile, {Q.SHARPE} AS sharpe FROM base GROUP BY run_id"),
    }
    # membership
    monthly = "SELECT CAST(date_trunc('month', t) + INTERVAL 1 MONTH AS DATE) AS valid_from, asset, avg(price) AS p FROM prices GROUP BY ALL"
    members = {"monthly": (["prices"], monthly), "members": (["monthly"], "SELECT m.valid_from, m.asset FROM monthly m JOIN (SELECT valid_from, median(p) AS mid FROM monthly GROUP BY valid_from) h ON h.valid_from = m.valid_from WHERE m.p > h.mid")}
    mask = members | {
        "snaps": (["members"], "SELECT DISTINCT valid_from FROM members"), "stamped": (["snaps", "cal"], "SELECT c.t, s.valid_from FROM cal c ASOF LEFT JOIN snaps s ON c.t >= s.valid_from"),
        "mask": (["stamped", "assets"], "SELECT c.t, a.asset, m.asset IS NOT NULL AS eligible FROM stamped c CROSS JOIN assets a LEFT JOIN members m ON m.valid_from = c.valid_from AND m.asset = a.asset"),
    }
    day = f"SELECT t, {r('gross')} AS gross, {r('turnover')} AS turnover, n_positions, {r('gross - turnover * 5.0 / 1e4')} AS ret FROM daily"
    equity = "SELECT run_id, t, turnover, ret, product(1 + ret) OVER (PARTITION BY run_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM base"
    fall = "SELECT *, equity / max(equity) OVER (PARTITION BY run_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS drawdown FROM eq"
    ranked = f"SELECT t, asset, {Q.average_rank('score', 't')} AS a, {Q.average_rank('fwd', 't')} AS b FROM pairs"
    ics = f"SELECT t, {Q.correlation('a', 'b')} AS ic, count(*) AS n FROM rk GROUP BY t HAVING count(*) >= 20"
    numbered = "SELECT *, count(*) OVER (PARTITION BY t) AS cnt, row_number() OVER (PARTITION BY t ORDER BY score, asset) AS rn FROM pairs"
    dec = {"numbered": (["pairs"], numbered), "dec": (["numbered"], f"SELECT t, {Q.bucket('rn', 'cnt')} AS bucket, avg(fwd) AS mean_fwd FROM numbered WHERE cnt >= 20 GROUP BY ALL")}
    levels = ", ".join(f"({float(x)})" for x in A.LEVELS)
    nblocks = f"CAST(ceil((SELECT count(*) FROM base) / {BLOCK}.0) AS BIGINT)"
    # water fill: fifty rounds, day by day and leg by leg
    fill = {
        "picks": (["scores"], Q.ONE.replace("0.1 AS quantile", "0.15 AS quantile")),
        "v": (["legs", "vols", "sched"], "SELECT l.*, nullif(v.vol, 0) AS vol FROM legs l JOIN sched d ON d.t_signal = l.t LEFT JOIN vols v ON v.t = l.t AND v.asset = l.asset"),
        "inv": (["v"], "SELECT t, asset, side, max_weight AS cap, 1 / coalesce(vol, median(vol) OVER (PARTITION BY t, side), 1.0) AS x FROM v"),
        "start": (["inv"], "SELECT t, asset, side, cap, x / sum(x) OVER (PARTITION BY t, side) AS w FROM inv"),
        "book": (["start"], """SELECT 0 AS step, t, asset, side, cap, w FROM start UNION ALL
            SELECT step + 1, t, asset, side, cap, CASE WHEN over = 0 THEN w WHEN w > cap THEN cap WHEN room > 0 THEN w + over * w / room ELSE w END
            FROM (SELECT *, sum(CASE WHEN w > cap THEN w - cap ELSE 0 END) OVER (PARTITION BY t, side) AS over, sum(CASE WHEN w > cap THEN 0 ELSE w END) OVER (PARTITION BY t, side) AS room FROM book) WHERE step < 50"""),
    }
    cases = ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in c) + ")" for c in CASES)
    day0 = date(1998, 6, 30).isoformat()
    out = {
        "panel_weekly": q("SELECT t, asset, round(price, 8) + 0.0 AS price FROM prices", "prices"),
        "simple_returns": q(f"SELECT t, asset, {r('ret')} AS ret FROM rets", "rets"),
        "forward_returns": q(f"SELECT t, asset, {r('fwd')} AS fwd FROM fwds", "fwds"),
        "rolling_vol": q(f"SELECT t, asset, {r('vol')} AS vol FROM vols", "vols"),
        "momentum_zscore": q(f"SELECT t, asset, {r('score')} AS score FROM scores", "scores"),
        "risk_adj_momentum": q(f"SELECT t, asset, {r('CASE WHEN z IS NOT NULL THEN least(greatest(z, -3.0), 3.0) END')} AS score FROM zs",
            v26=(["rets"], f"SELECT *, CASE WHEN count(ret) OVER w >= 20 THEN stddev_samp(ret) OVER w * sqrt({Q.ANN}) END AS vol FROM rets WINDOW w AS (PARTITION BY asset ORDER BY i ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)"),
            adj=(["v26"], f"SELECT t, asset, (lag(price, {Q.SKIP}) OVER w / lag(price, {Q.SKIP + Q.LOOKBACK}) OVER w - 1) / nullif(vol, 0) AS raw FROM v26 WINDOW w AS (PARTITION BY asset ORDER BY i)"),
            zs=(["adj"], "SELECT t, asset, (raw - avg(raw) OVER (PARTITION BY t)) / nullif(stddev_samp(raw) OVER (PARTITION BY t), 0) AS z FROM adj")),
        "noise_scores": q(f"SELECT t, asset, {r('sqrt(-2 * ln((a + 0.5) / 1099511627776)) * cos(6.283185307179586 * (b + 0.5) / 1099511627776)')} AS score FROM u",
            u=(["grid"], "SELECT t, asset, " + ", ".join(f"CAST('0x' || substr(md5(concat_ws('|', 7, '{x}', t, asset)), 1, 15) AS BIGINT) % 1099511627776 AS {x}" for x in "ab") + " FROM grid")),
        "rebalance_dates": q("SELECT t FROM reb", "reb"),
        "exec_schedule": q("SELECT period, t_signal, t_exec, i_exec, t_next FROM sched", "sched"),
        "selection_legs": q("SELECT z.t, z.asset, CAST(z.side AS BIGINT) AS side, z.n_leg FROM sized z JOIN sched d ON d.t_signal = z.t", "sized", "sched"),
        "equal_weights": q(f"SELECT c.t AS t_exec, g.asset, {r('g.w')} AS w FROM tgt g JOIN cal c ON c.i = g.i", "tgt"),
        "inverse_vol_weights": q(f"SELECT d.t_exec, b.asset, {r('least(b.w, b.cap) * b.side')} AS w FROM book b JOIN sched d ON d.t_signal = b.t WHERE b.step = 50", "sched", **fill),
        "daily_backtest": q(day, "daily"),
        "headline_metrics": q(f"SELECT run_id, {r(Q.SHARPE)} AS sharpe, {r(Q.CAGR)} AS cagr, {r('min(drawdown)')} AS max_drawdown, {r(f'sum(turnover) / (count(ret) / {Q.ANN}.0)')} AS annual_turnover, {r(f'count(ret) / {Q.ANN}.0')} AS years, count(ret) AS n_days FROM dd GROUP BY run_id", eq=(["base"], equity), dd=(["eq"], fall)),
        "drawdown_path": q(f"SELECT t, {r('equity')} AS equity, {r('drawdown')} AS drawdown FROM dd", eq=(["base"], equity), dd=(["eq"], fall)),
        "lookahead_canary": q(f"SELECT run_id, {r('sharpe')} AS sharpe FROM sh",
            picks=(["scores"], f"SELECT 'honest' AS run_id, t, asset, score, {knobs} FROM scores UNION ALL SELECT 'shifted', t, asset, lead(score, 8) OVER (PARTITION BY asset ORDER BY i), 0.1, 0.1, true FROM scores"), sh=(["base"], sharpe_of("base"))),
        "perm_assignment": q(f"SELECT run_id, t, asset, {r('score')} AS score FROM shuffled", **{k: perm[k] for k in ("slots", "pulled", "shuffled")}),
        "perm_sharpes": q(f"SELECT run_id, {r('sharpe')} AS sharpe FROM sh", **perm),
        "perm_pvalue": q(f"SELECT any_value(r.sharpe) AS real_, {r('avg(CAST(n.sharpe >= r.sharpe AS INTEGER))')} AS p, {r('avg(n.sharpe)')} AS null_mean, {r('stddev_samp(n.sharpe)')} AS null_sd, count(n.sharpe) AS n_null FROM sh n CROSS JOIN (SELECT sharpe FROM sh WHERE run_id = 'real') r WHERE n.run_id <> 'real' AND n.sharpe IS NOT NULL", **perm).replace("any_value(r.sharpe) AS real_", f"{r('any_value(r.sharpe)')} AS \"real\""),
        "subuniverse_draws": q("SELECT run_id, size, asset FROM drawn", drawn=breadth["drawn"]),
        "breadth_sharpes": q(f"SELECT run_id, size, {r('sharpe')} AS sharpe FROM sh", **breadth),
        "breadth_medians": q(f"SELECT size, {r('median(sharpe)')} AS median_sharpe FROM sh GROUP BY size", **breadth),
        "param_grid_sharpes": q(f"SELECT lookback, skip, quantile, {r('sharpe')} AS sharpe FROM sh", **plateau),
        "plateau_summary": q(f"SELECT count(*) AS n, {r('avg(CASE WHEN sharpe > 0 THEN 1 ELSE 0 END)')} AS share_positive, {r('median(sharpe)')} AS median, {r('quantile_cont(sharpe, 0.05)')} AS p05 FROM sh", **plateau),
        "cost_curve": q(f"SELECT bps, {r(Q.SHARPE)} AS sharpe, {r(Q.CAGR)} AS cagr FROM costs GROUP BY bps", costs=(["daily"], f"SELECT CAST(bps AS DOUBLE) AS bps, gross - turnover * bps / 1e4 AS ret FROM daily CROSS JOIN (VALUES {levels}) v(bps)")),
        "cost_breakeven": q(f"SELECT {r('gross / turn * 1e4')} AS breakeven_bps, {r('turn')} AS annual_turnover, {r('gross')} AS gross FROM x", free=(["daily"], "SELECT gross AS ret, turnover FROM daily"), x=(["free"], f"SELECT {Q.CAGR} AS gross, sum(turnover) / (count(*) / {Q.ANN}.0) AS turn FROM free")),
        "bootstrap_quantiles": q(f"SELECT {r('quantile_cont(sharpe, 0.05)')} AS p05, {r('quantile_cont(sharpe, 0.5)')} AS p50, {r('quantile_cont(sharpe, 0.95)')} AS p95 FROM sh",
            x=(["base"], "SELECT ret, row_number() OVER (ORDER BY t) - 1 AS idx FROM base"),
            starts=(["x"], f"SELECT path, b, CAST('0x' || substr(md5(concat_ws('|', {SEED}, path, b)), 1, 15) AS BIGINT) % ((SELECT count(*) FROM x) - {BLOCK}) AS start FROM range(0, {PATHS}) p(path) CROSS JOIN (SELECT unnest(range(0, {nblocks})) AS b)"),
            cells=(["starts"], f"SELECT path, b * {BLOCK} + o AS pos, start + o AS idx FROM starts CROSS JOIN range(0, {BLOCK}) z(o)"),
            sh=(["cells"], f"SELECT path, {Q.SHARPE} AS sharpe FROM cells JOIN x USING (idx) WHERE pos < (SELECT count(*) FROM x) GROUP BY path")),
        "decile_returns": q(f"SELECT t, bucket, {r('mean_fwd')} AS mean_fwd FROM dec", **dec),
        "decile_monotonicity": q(f"SELECT {r(Q.correlation('a', 'b'))} AS rho, {r('max_by(m, bucket) - min_by(m, bucket)')} AS spread FROM mrk", **dec, means=(["dec"], "SELECT bucket, avg(mean_fwd) AS m FROM dec GROUP BY bucket"),
            mrk=(["means"], "SELECT bucket, m, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0 AS a, CAST(bucket AS DOUBLE) AS b FROM means")),
        "rank_ic": q(f"SELECT t, {r('ic')} AS ic, n FROM ics", rk=(["pairs"], ranked), ics=(["rk"], ics)),
        "ic_tstat": q(f"SELECT {r('avg(ic)')} AS mean_ic, {r('avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(ic))')} AS tstat, count(ic) AS n_dates FROM ics", rk=(["pairs"], ranked), ics=(["rk"], ics)),
        "walkforward_single": _walk_sql("single"), "walkforward_anchored": _walk_sql("anchored"), "walkforward_rolling": _walk_sql("rolling"), "walkforward_long_only": _walk_sql("rolling", False, """SELECT "window", train, test, printf('%.6e', is_edge) AS is_edge, printf('%.6e', oos_edge) AS oos_edge, {retained}, {oos_t}, verdict FROM judged"""),
        "walkforward_summary": _walk_sql("rolling", final=f"SELECT min_by(verdict, CASE verdict WHEN 'SIGN_FLIP' THEN 1 WHEN 'NO_TRAIN_EDGE' THEN 2 WHEN 'DEGRADED' THEN 3 ELSE 4 END) AS verdict, count(*) AS n, {r('median(retained)')} AS median_retained, CAST(count(*) FILTER (abs(oos_t) >= 2) AS BIGINT) AS n_significant, {r('median(oos_edge)')} AS median_oos FROM judged"),
        "universe_members": q(f"SELECT asset AS ticker FROM members WHERE valid_from = (SELECT max(valid_from) FROM members WHERE valid_from <= DATE '{day0}')", **members),
        "universe_tickers": q("SELECT DISTINCT asset AS ticker FROM members", **members),
        "universe_mask": q("SELECT t, asset, eligible FROM mask", **mask),
        "universe_coverage": q("SELECT count(*) FILTER (asset IN (SELECT asset FROM assets)) AS have, count(*) AS want FROM (SELECT DISTINCT asset FROM members)", "assets", **members),
        "masked_backtest": q(day, "daily", **mask, picks=(["scores", "mask"], Q.ONE + " JOIN mask m ON m.t = s.t AND m.asset = s.asset AND m.eligible"), runs=([], "SELECT 'base' AS run_id")),
        "hygiene_filter": q("SELECT p.t, p.asset, round(p.price, 8) + 0.0 AS price FROM prices p JOIN (SELECT asset FROM rets GROUP BY asset HAVING median(price) >= 2050 AND max(abs(ret)) < 80) g ON g.asset = p.asset", "rets"),
        "benchmark_returns": q(f"SELECT t, {r('coalesce(avg(ret), 0)')} AS bench FROM rets GROUP BY t", "rets"),
        "verdict_table": f"SELECT CAST(is_edge AS DOUBLE) AS is_edge, CAST(oos_edge AS DOUBLE) AS oos_edge, CASE WHEN is_edge IS NULL OR is_edge <= 0 THEN 'NO_TRAIN_EDGE' WHEN oos_edge IS NULL OR oos_edge < 0 THEN 'SIGN_FLIP' WHEN oos_edge >= 0.5 * is_edge THEN 'PRESERVED' ELSE 'DEGRADED' END AS verdict FROM (VALUES {cases}) v(is_edge, oos_edge)",
    }
    return out | {"study_findings": _study_sql(out)}
