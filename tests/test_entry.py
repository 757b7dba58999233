"""The driver's contract: queries against their SQL, and without the training-data subpackage."""

import subprocess
import sys

import pytest

from compare import ROOT, rows

CHEAP = ["panel_weekly", "simple_returns", "rolling_vol", "momentum_zscore", "exec_schedule", "selection_legs", "daily_backtest", "perm_assignment", "decile_returns", "rank_ic", "universe_mask", "inverse_vol_weights", "bootstrap_quantiles", "verdict_table", "benchmark_returns", "hygiene_filter", "universe_coverage", "walkforward_long_only"]


@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_sql(spark, sf, duck, name):
    from assay.plans import catalogue

    got = catalogue.queries()[name](spark, sf).toPandas()
    want = duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    from assay.plans import catalogue

    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_entry_without_the_subpackage():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == 'assay.llm' or name.startswith('assay.llm.') or name == 'corpus_pipeline':
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
q = e.queries()
assert 'daily_backtest' in q and not any(k.startswith('op') or k == 'pipeline' for k in q), q
e.oracle_sql()
"""
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0


def test_library_does_not_import_the_subpackage():
    found = [p for p in (ROOT / "assay").rglob("*.py") if "llm" not in p.relative_to(ROOT / "assay").parts and "assay.llm" in p.read_text()]
    assert not found


def test_entry_smoke(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() == 1 and "sharpe" in df.columns
