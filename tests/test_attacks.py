"""Known answers: a planted drift survives, noise is killed, a leak is caught."""

import math

import pytest
from pyspark.sql import functions as F

from assay.operators import attacks as A
from assay.operators import metrics as M
from assay.operators import resample as R
from assay.operators import signals as S
from assay.operators import walkforward as WF
from assay.operators.panel import benchmark_returns, densify
from assay.operators.portfolio import Spec
from assay.operators.schedule import rebalance_dates
from assay.operators.simulate import market, run

SPEC = Spec(cost_bps=2.0)


def momentum(px, lookback=60, skip=5):
    return S.momentum(px, lookback, skip)


@pytest.fixture(scope="module")
def planted(spark):
    prices = R.normal_panel(spark, 500, 60, seed=11).cache()
    m = market(prices, SPEC).persist()
    scores = momentum(m.grid).cache()
    noise = S.noise(m.grid, 99).cache()
    return prices, m, scores, noise


def test_canary(planted):
    _, m, scores, noise = planted
    assert A.lookahead_canary(m, S.noise(m.grid, 5), SPEC).passed is False  # noise from the future is noise
    leak = S.leaky(m.grid, 21)
    r = A.canary_sharpes(m, leak, SPEC).collect()
    assert {x["run_id"] for x in r} == {"honest", "shifted"}
    assert not A.lookahead_canary(m, leak, SPEC).passed


def test_permutation(planted):
    _, m, scores, noise = planted
    good = A.permutation_null(m, scores, SPEC, n=12)
    assert good.passed and good.value == 0
    assert not A.permutation_null(m, noise, SPEC, n=12).passed


def test_shuffle_keeps_each_date_s_scores(planted):
    _, m, scores, _ = planted
    dated = A.on_signal_dates(m, scores)
    s = R.shuffled(dated, 2)
    want = dated.where("score is not null").groupBy("t").agg(F.sort_array(F.collect_list("score")).alias("s")).collect()
    for k in ("p0", "p1"):
        got = s.where(F.col("run_id") == k).groupBy("t").agg(F.sort_array(F.collect_list("score")).alias("s")).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_undefined_real_sharpe_fails(planted):
    _, m, scores, _ = planted
    f = A.permutation_null(m, scores.withColumn("score", F.lit(None).cast("double")), SPEC, n=3)
    assert not f.passed and math.isnan(f.value)


def test_deciles_and_ic(planted):
    _, m, scores, noise = planted
    dates = rebalance_dates(m.calendar)
    pairs = M.scored_forward(scores, m.grid, dates, 21)
    assert A.decile_monotonicity(pairs).passed
    t = M.ic_tstat(M.rank_ic(pairs)).first()
    assert t["tstat"] > 2 and t["mean_ic"] > 0
    empty = A.decile_monotonicity(pairs.where("false"))
    assert not empty.passed and "too few" in empty.detail


def test_costs_bootstrap_breadth_plateau(planted):
    prices, m, scores, noise = planted
    days = run(prices, scores, SPEC, None, m).daily.cache()
    c = A.cost_curve(days, SPEC)
    assert c.passed and c.table.count() == 8
    assert not A.cost_curve(run(prices, noise, SPEC, None, m).daily, SPEC).passed
    assert A.block_bootstrap(days, n=60).passed
    short = A.block_bootstrap(days.orderBy("t").limit(40))
    assert not short.passed and "too short" in short.detail
    b = A.breadth_curve(prices, momentum, SPEC, sizes=(20, 40, 500), draws=2, m=m)
    assert [r["size"] for r in b.table.collect()] == [20, 40] and not b.passed  # no size of 100 or more
    assert A.breadth_curve(prices, momentum, SPEC, sizes=(500,), m=m).passed
    p = A.parameter_plateau(prices, momentum, SPEC, {"lookback": [40, 60], "quantile": [0.1, 0.2]})
    assert p.passed and p.value == 1 and p.table.count() == 4
    assert not A.parameter_plateau(prices, momentum, SPEC, {}).passed


def test_subuniverses_are_samples_without_replacement(planted):
    prices, *_ = planted
    s = R.subuniverses(prices.select("asset").distinct(), (5, 10), 3)
    assert {(r["run_id"], r["n"], r["d"]) for r in s.groupBy("run_id").agg(F.count("*").alias("n"), F.countDistinct("asset").alias("d")).collect()} == {(f"{k}_{j}", k, k) for k in (5, 10) for j in range(3)}


def test_walk_forward(planted):
    prices, m, scores, noise = planted
    days = run(prices, scores, SPEC, None, m).daily.cache()
    f = WF.walk_forward(days, prices, SPEC, train_years=0.8, min_days=60)
    assert f.passed and f.table.count() == 1
    few = WF.walk_forward(days.limit(30), prices, SPEC)
    assert not few.passed and "two sides" in few.detail
    none = WF.walk_forward(days, prices, SPEC, mode="rolling", min_days=60)
    assert not none.passed and "no window" in none.detail
    b = benchmark_returns(prices)
    assert b.count() == 500 and b.orderBy("t").first()["bench"] == 0


def test_windows():
    from datetime import date

    a, b = date(2012, 1, 2), date(2018, 11, 1)
    (w,) = WF.make_windows(a, b, "single", 3)
    assert w.train == (a, w.test[0]) and w.test[1] == b and (w.test[0] - a).days == 1096
    anchored = WF.make_windows(a, b, "anchored", 2, 1)
    assert len(anchored) == 4 and {w.train[0] for w in anchored} == {a} and all(w.train[1] == w.test[0] for w in anchored)
    rolling = WF.make_windows(a, b, "rolling", 2, 1, 1)
    assert [w.train[0] for w in rolling] == sorted({w.train[0] for w in rolling}) and len(rolling) == 4
    (mid,) = WF.make_windows(a, date(2012, 1, 5), "single", 9)
    assert mid.train[1] == date(2012, 1, 3) and mid.test[0] == date(2012, 1, 4)  # a middle at noon is on neither side
    (cut,) = WF.make_windows(a, b, "single", split="2015-06-01")
    assert cut.train[1] == date(2015, 6, 1)
    assert cut.span("train").startswith("2012-01")


@pytest.mark.parametrize("i,o,want", [(0.1, 0.08, "PRESERVED"), (0.1, 0.05, "PRESERVED"), (0.1, 0.02, "DEGRADED"), (0.1, -0.03, "SIGN_FLIP"), (-0.02, 0.09, "NO_TRAIN_EDGE"), (0.0, 0.09, "NO_TRAIN_EDGE"), (math.nan, 0.05, "NO_TRAIN_EDGE"), (0.1, math.nan, "SIGN_FLIP"), (0.1, 0.0, "DEGRADED")])
def test_classify(spark, i, o, want):
    assert WF.classify(i, o) == want
    assert spark.createDataFrame([(i, o)], "i double, o double").select(WF.classified(F.col("i"), F.col("o"))).first()[0] == want


def test_grid_is_dense(planted):
    prices, *_ = planted
    thin = prices.where("asset <> 'S001' or t > '2015-06-01'")
    assert densify(thin).count() == 500 * 60
