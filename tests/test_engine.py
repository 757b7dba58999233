"""The closed-form simulator against a day-by-day recursion, and its edge cases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assay.operators import metrics as M
from assay.operators import panel as PN
from assay.operators import signals as S
from assay.operators.portfolio import Spec
from assay.operators.schedule import rebalance_dates, schedule
from assay.operators.simulate import market, net, run, run_many
from assay.sources.panels import from_pandas

SPEC = Spec(vol_window=20, quantile=0.15, max_weight=0.12, cost_bps=7.5)


def gappy(n_days=160, n=30, seed=3):
    rng = np.random.default_rng(seed)
    t = pd.bdate_range("2020-01-01", periods=n_days)
    p = pd.DataFrame(50 * np.exp(np.cumsum(rng.normal(0, 0.02, (n_days, n)), axis=0)), t, [f"A{i:02d}" for i in range(n)])
    return p.mask(rng.random(p.shape) < 0.05)


def leg(names, vol, spec):
    if spec.weighting == "equal":
        x = pd.Series(1.0, names)
    else:
        v = vol[names].replace(0, np.nan)
        x = 1 / v.fillna(v.median() if v.notna().any() else 1.0)
    x, cap = x / x.sum(), spec.max_weight
    for _ in range(50):
        over = x > cap
        if not over.any():
            break
        excess, room = (x[over] - cap).sum(), ~over
        x[over] = cap
        if not room.any() or x[room].sum() <= 0:
            break
        x[room] += excess * x[room] / x[room].sum()
    return x.clip(upper=cap)


def day_by_day(P, scores, spec, allowed=None):
    R = P.ffill().pct_change(fill_method=None)
    V = R.rolling(spec.vol_window, min_periods=int(0.7 * spec.vol_window)).std() * np.sqrt(252)
    ends = P.index.to_series().groupby(P.index.to_period("M")).max()
    at = {P.index[i + spec.execution_lag]: d for d in ends if (i := P.index.get_loc(d)) + spec.execution_lag < len(P)}
    w, live, out = pd.Series(0.0, P.columns), False, []
    for d in P.index:
        day = 0.0
        if live:
            r = R.loc[d].fillna(0)
            day = float((w * r).sum())
            w = w * (1 + r) / (1 + day)
        turn = 0.0
        if d in at:
            s = scores.loc[at[d]].dropna()
            if allowed is not None and at[d] in allowed:
                s = s[[a for a in s.index if a in allowed[at[d]]]]
            tgt = pd.Series(0.0, P.columns)
            if len(s) >= spec.min_names:
                n = max(1, round(len(s) * spec.quantile))
                names = sorted(s.index, key=lambda a: (s[a], a))
                long = names[-n:]
                tgt[long] += leg(long, V.loc[at[d]], spec)
                if spec.long_short and (short := [a for a in names[:n] if a not in long]):
                    tgt[short] -= leg(short, V.loc[at[d]], spec)
            turn = float((tgt - w).abs().sum())
            w, day = tgt, day - turn * spec.cost_bps / 1e4
            live = live or bool((tgt != 0).any())
        if live:
            out.append((d, day, turn, int((w.abs() > 1e-9).sum())))
    return pd.DataFrame(out, columns=["t", "ret", "turnover", "n"]).set_index("t")


@pytest.fixture(scope="module")
def world(spark):
    wide = gappy()
    prices = from_pandas(spark, wide).cache()
    scores = S.noise(PN.densify(prices), 7).cache()
    s = scores.toPandas().pivot(index="t", columns="asset", values="score")
    s.index = pd.to_datetime(s.index)
    return wide, prices, scores, s


@pytest.mark.parametrize("spec", [SPEC, SPEC.but(weighting="inverse_vol"), SPEC.but(long_short=False, execution_lag=3), SPEC.but(quantile=0.6)])
def test_matches_recursion(world, spec):
    wide, prices, scores, s = world
    got = run(prices, scores, spec).daily.toPandas().set_index("t").sort_index()
    got.index = pd.to_datetime(got.index)
    want = day_by_day(wide, s, spec)
    assert list(got.index) == list(want.index)
    assert np.allclose(got["ret"], want["ret"], atol=1e-10) and np.allclose(got["turnover"], want["turnover"], atol=1e-10)
    assert (got["n_positions"] == want["n"]).all()


def test_liquidates_below_the_gate_and_masks(spark, world):
    wide, prices, scores, s = world
    ends = [d for d in wide.index.to_series().groupby(wide.index.to_period("M")).max()]
    few = {ends[2]: set(list(wide.columns)[:5]), ends[3]: set(list(wide.columns)[:25])}  # other dates are not in the mask
    mask = spark.createDataFrame([(d.date(), a, a in few[d]) for d in few for a in wide.columns], "t date, asset string, eligible boolean")
    got = run(prices, scores, SPEC, mask).daily.toPandas().set_index("t").sort_index()
    want = day_by_day(wide, s, SPEC, few)
    assert np.allclose(got["ret"], want["ret"], atol=1e-10) and (got["n_positions"].to_numpy() == want["n"].to_numpy()).all()
    assert (got["n_positions"] == 0).any()
    strict = run(prices, scores, SPEC.but(strict_mask=True), mask).daily
    assert strict.agg(F.count_if(F.col("n_positions") > 0)).first()[0] < (got["n_positions"] > 0).sum()


def test_never_live_keeps_all_days_at_zero(world):
    wide, prices, scores, _ = world
    days = run(prices, scores, SPEC.but(min_names=99)).daily
    h = M.headline(days).first()
    assert h["n_days"] == len(wide) and h["sharpe"] is None and h["cagr"] == 0 and h["annual_turnover"] == 0


def test_trials_do_not_touch_each_other(spark, world):
    _, prices, scores, _ = world
    m = market(prices, SPEC)
    both = scores.select(F.lit("a").alias("run_id"), "t", "asset", "score").union(scores.select(F.lit("b"), "t", "asset", -F.col("score")))
    r = run_many(m, both, {"a": SPEC, "b": SPEC.but(quantile=0.3, max_weight=0.05)}).daily.where("run_id = 'a'").select("t", "ret")
    alone = run(prices, scores, SPEC).daily.select("t", "ret")
    x, y = (z.toPandas().set_index("t").sort_index()["ret"] for z in (r, alone))
    assert np.allclose(x, y, atol=1e-12)


def test_costs_only_lower_returns(world):
    _, prices, scores, _ = world
    d = run(prices, scores, SPEC).daily.drop("ret")
    free, dear = M.headline(net(d, 0)).first(), M.headline(net(d, 100)).first()
    assert dear["cagr"] < free["cagr"] and dear["annual_turnover"] == free["annual_turnover"]


def test_weights_respect_the_cap(world):
    _, prices, scores, _ = world
    w = run(prices, scores, SPEC.but(weighting="inverse_vol", max_weight=0.05)).weights
    assert w.agg(F.max(F.abs("w"))).first()[0] <= 0.05 + 1e-12


def test_returns_padding_and_vol(spark):
    wide = pd.DataFrame({"x": [np.nan, 10, np.nan, 12], "y": [1.0, 2, 4, 4]}, pd.to_datetime(["2020-01-01", "2020-01-02", "2020-01-03", "2020-01-06"]))
    g = PN.densify(from_pandas(spark, wide))
    got = {(str(r["t"]), r["asset"]): r["ret"] for r in PN.returns(g).collect()}
    assert got["2020-01-03", "x"] == 0 and got["2020-01-06", "x"] == pytest.approx(0.2) and got["2020-01-02", "x"] is None
    raw = {(str(r["t"]), r["asset"]): r["ret"] for r in PN.returns(g, pad_gaps=False).collect()}
    assert raw["2020-01-06", "x"] is None
    v = {str(r["t"]): r["vol"] for r in PN.rolling_vol(PN.returns(g), 3, 2).where("asset = 'y'").collect()}
    assert v["2020-01-02"] is None and v["2020-01-03"] == pytest.approx(0.0) and v["2020-01-06"] == pytest.approx(np.std([1, 1, 0], ddof=1) * np.sqrt(252))


def test_schedule(spark):
    t = pd.bdate_range("2021-01-04", "2021-03-10")
    cal = PN.calendar(from_pandas(spark, pd.DataFrame({"a": 1.0}, t)))
    assert [str(r[0]) for r in rebalance_dates(cal).orderBy("t").collect()] == ["2021-01-29", "2021-02-26", "2021-03-10"]
    s = [(str(r["t_signal"]), str(r["t_exec"])) for r in schedule(cal, "ME", 1).orderBy("period").collect()]
    assert s == [("2021-01-29", "2021-02-01"), ("2021-02-26", "2021-03-01")]
    assert rebalance_dates(cal, "W").count() == 10 and rebalance_dates(cal, "QE").count() == 1 and rebalance_dates(cal, "D").count() == len(t)
    with pytest.raises(ValueError):
        rebalance_dates(cal, "fortnight")


def test_pandas_signal_adapter(spark, world):
    _, prices, _, _ = world
    g = PN.densify(prices)

    def wide_momentum(px, lookback=20):
        raw = px / px.shift(lookback) - 1
        return raw.sub(raw.mean(axis=1), axis=0).div(raw.std(axis=1), axis=0).clip(-3, 3)

    a = S.from_pandas(wide_momentum)(g, lookback=10).where("score is not null").toPandas().set_index(["t", "asset"])["score"].sort_index()
    b = S.momentum(g, 10, 0).where("score is not null").toPandas().set_index(["t", "asset"])["score"].sort_index()
    assert len(a) == len(b) and np.allclose(a, b)


def test_wide_round_trip_and_bad_spec(spark):
    wide = spark.createDataFrame([("2020-01-01", 1.0, None), ("2020-01-02", 2.0, float("nan"))], "d string, a double, b double")
    long = PN.from_wide(wide, "d")
    assert long.where("price is null").count() == 2 and PN.to_wide(long, "price").count() == 2
    for bad in ({"weighting": "other"}, {"quantile": 0.0}, {"execution_lag": -1}):
        with pytest.raises(ValueError):
            Spec(**bad)
