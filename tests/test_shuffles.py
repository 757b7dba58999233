"""Shuffled books made in their tasks are the books of shuffled rows, and no shuffle's rows are dealt out."""

import glob
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.operators import attacks as A
from assay.operators import metrics as M
from assay.operators import resample as R
from assay.operators import signals as S
from assay.operators.portfolio import Spec
from assay.operators.shuffles import AT_ONCE, Draws, held_days
from assay.operators.simulate import market, run_many
from assay.plans import catalogue
from assay.session import kept

SPEC = Spec(cost_bps=4.0, vol_window=20, quantile=0.15, max_weight=0.12)


@pytest.mark.parametrize("n, longest", [(7, 5), (AT_ONCE + 900, 30), (900, 60)])
def test_draws_are_md5(n, longest):
    rng = np.random.default_rng(n)
    names = sorted({"".join(rng.choice(list("abcé09"), rng.integers(1, longest))) for _ in range(n)}, key=str.encode) + [None]
    draws = Draws(names)
    for prefix in (b"7|2020-01-31", b"123|2020-01-31"):
        full = [hashlib.md5(prefix + (b"" if x is None else b"|" + x.encode())).digest() for x in names]
        high, low = draws.digests(prefix)
        assert [int(h).to_bytes(8) + int(x).to_bytes(8) for h, x in zip(high, low)] == full
        assert draws.order(prefix).tolist() == sorted(range(len(full)), key=lambda j: full[j])


@pytest.fixture(scope="module")
def world(spark):
    prices = R.normal_panel(spark, 300, 60, seed=5).where("not (asset = 'S003' and t > '2015-06-01' and t < '2015-09-01')").cache()
    m = market(prices, SPEC).persist()
    late = F.col("t") > "2015-12-15"  # too few names at the end, so books are sold off
    odd = F.when(F.col("asset") == "S007", F.lit(float("nan"))).when(F.col("asset") == "S009", F.round("score", 0)).when(late & (F.col("asset") > "S011"), None).otherwise(F.col("score"))
    return m, S.momentum(m.grid, 30, 3).withColumn("score", odd).cache()


def plain(m, scores, spec, mask, n, seed):
    base = A.on_signal_dates(m, scores)
    every = base.select(F.lit("real").alias("run_id"), "t", "asset", "score").unionByName(R.shuffled(base, n, seed))
    return M.sharpes(run_many(m, every, {"real": spec} | {f"p{k}": spec for k in range(n)}, mask).daily, spec.ann)


@pytest.mark.parametrize("changes, masked", [({}, False), ({"weighting": "inverse_vol", "quantile": 0.6}, False), ({"long_short": False}, True), ({"min_names": 99}, False)])
def test_same_as_shuffled_rows(world, changes, masked):
    m, scores = world
    spec = SPEC.but(**changes)
    m = type(m)(m.prices, m.grid, m.calendar, m.schedule, m.vol, m.growth, spec)
    mask = scores.select("t", "asset", (F.crc32(F.concat("t", "asset")) % 4 != 0).alias("eligible")).where("t < '2015-10-01'") if masked else None
    got, want = (dict(map(tuple, f(m, scores, spec, mask, 11, 3).collect())) for f in (lambda *x: A.permutation_sharpes(*x, zero_cost=False), plain))
    assert set(got) == set(want) == {"real"} | {f"p{k}" for k in range(11)}
    for k, v in want.items():
        assert got[k] is None if v is None else got[k] == pytest.approx(v, abs=1e-9), k


def dealt(spark, job) -> int:
    """Rows that a job writes into shuffles."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)
    rows = lambda: sum(store.stageData(i, False, None, False, none).apply(0).shuffleWriteRecords() for i in range(sc._jsc.sc().dagScheduler().nextStageId()) if store.stageData(i, False, None, False, none).size())
    before = rows()
    job()
    return rows() - before


def test_rows_dealt_out_do_not_grow_with_the_shuffles(spark, world):
    m, scores = world
    few, many = (dealt(spark, lambda: A.permutation_sharpes(m, scores, SPEC, n=n).collect()) for n in (2, 42))
    days = m.calendar.count()
    assert many - few <= 40 * 8 * days  # of a shuffle only days are, in a few exchanges; 60 names a date before


def shuffle_files(spark) -> set:
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in dirs for f in glob.glob(f"{d}/**/shuffle_*", recursive=True)}


def test_the_weekly_panel_holds_no_shuffle(spark):
    catalogue._PANELS.clear()
    before = shuffle_files(spark)
    for _ in range(2):
        catalogue.weekly(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    assert shuffle_files(spark) <= before


def test_a_kept_frame_is_the_frame(spark):
    rows = spark.range(5000).groupBy((F.col("id") % 50).alias("k")).agg(F.sum("id").alias("s"), F.max(F.lit(None).cast("date")).alias("t"))
    df = kept(rows)
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, rows.collect())) and df.schema.simpleString() == rows.schema.simpleString()
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_runs_of_many_signals_and_knobs_are_those_of_run_many(world):
    m, scores = world
    other = S.reversal(m.grid, 9)
    specs = {"a": SPEC, "b": SPEC.but(quantile=0.3, cost_bps=9.0), "c": SPEC.but(long_short=False), "d": SPEC.but(weighting="inverse_vol", quantile=0.6)}
    sig = {"a": 0, "b": 1, "c": 1, "d": 0}
    of = [A.on_signal_dates(m, x).select("t", "asset", "score") for x in (scores, other)]
    both = of[0].withColumn("sig", F.lit(0)).unionByName(of[1].withColumn("sig", F.lit(1)))
    rows = [of[k].select(F.lit(run).alias("run_id"), "t", "asset", "score") for run, k in sig.items()]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
    columns = ("run_id", "t", "gross", "turnover", "n_positions", "ret")
    got, want = ({r[:2]: r[2:] for r in map(tuple, d.select(*columns).collect())} for d in (held_days(m, both, {k: (sig[k], s) for k, s in specs.items()}, None), run_many(m, every, specs).daily))
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9), k


def test_rows_dealt_out_do_not_grow_with_the_settings(spark, world):
    m, _ = world
    signal = lambda prices, lookback: S.momentum(prices, lookback, 3)
    few, many = (dealt(spark, lambda q=q: A.grid_sharpes(m.prices, signal, SPEC, {"lookback": [20, 30], "quantile": q}, m=m).collect()) for q in ([0.1], [0.1, 0.2, 0.3, 0.4, 0.5, 0.6]))
    assert many - few <= 10 * 8 * m.calendar.count()
