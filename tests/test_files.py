"""Universe, pre-registration, report, HTML, study and command line."""

import gzip
import json
import math

import pytest
from pyspark.sql import functions as F

from assay import cli
from assay.operators import resample as R
from assay.operators import signals as S
from assay.operators.portfolio import Spec
from assay.operators.universe import Universe
from assay.prereg import LIMITS, Criteria, canonical_hash, coerce, diff, parse_yaml, registered, starting_file
from assay.report import Demand, Finding, Report
from assay.sources.membership import read_membership, sp500
from assay.study import ATTACKS, Attack, Study


@pytest.fixture
def universe(spark):
    rows = [("2020-01-10", ["a", "b", ""]), ("2020-02-01", ["b", "c"]), ("2020-03-01", ["c"])]
    return Universe(spark.createDataFrame(rows, "valid_from string, tickers array<string>"))


def test_universe(spark, universe):
    assert [r[0] for r in universe.tickers().collect()] == ["a", "b", "c"]
    members = lambda d: {r[0] for r in universe.members_on(d).collect()}
    assert members("2020-01-09") == set() and members("2020-01-10") == {"a", "b", ""} and members("2020-02-20") == {"b", "c"} and members("2021-01-01") == {"c"}
    dates = spark.createDataFrame([("2020-01-01",), ("2020-01-31",), ("2020-02-01",)], "t string")
    assets = spark.createDataFrame([("a",), ("b",), ("z",)], "asset string")
    m = {(str(r["t"]), r["asset"]): r["eligible"] for r in universe.mask(dates, assets).collect()}
    assert len(m) == 9 and m["2020-01-31", "a"] and not m["2020-02-01", "a"] and m["2020-02-01", "b"] and not any(v for (t, a), v in m.items() if a == "z" or t == "2020-01-01")
    assert tuple(universe.coverage(assets).first()) == (2, 3)


def test_membership_file(spark, tmp_path):
    path = tmp_path / "members.csv.gz"
    with gzip.open(path, "wt") as f:
        f.write('date,tickers\n2020-01-01,"A,B"\n2020-02-01,"B"\n2020-02-01,"B,C"\n')
    u = sp500(spark, str(path))
    assert {r[0] for r in u.members_on("2020-02-05").collect()} == {"B", "C"}  # the last row of a date holds
    with pytest.raises(FileNotFoundError):
        read_membership(spark, str(tmp_path / "none.csv"))


def test_yaml_and_scalars():
    text = "# c\nhypothesis: >\n  one line\n  and more\nkill_criteria:\n  min_sharpe: 0.5 # x\n  flag: yes\n  none:\nname: 'q'\n"
    assert parse_yaml(text) == {"hypothesis": "one line and more", "kill_criteria": {"min_sharpe": 0.5, "flag": True, "none": None}, "name": "q"}
    assert [coerce(x) for x in ("", "3", "3.5", "No", "TRUE", '"s"')] == [None, 3, 3.5, False, True, "s"]
    limits = parse_yaml(starting_file())["kill_criteria"]
    assert limits["min_ic_tstat"] == 2.0 and limits["require_monotonic_deciles"] is True and limits.keys() == LIMITS.keys()


def test_journal_only_grows(tmp_path):
    c = tmp_path / "criteria.yaml"
    with pytest.raises(FileNotFoundError):
        registered(c)
    c.write_text("kill_criteria:\n  min_sharpe: 0.5\n  min_years: 5\n")
    first = registered(c)
    assert not first.amended and str(first).startswith("SEALED") and first.limit("min_sharpe") == 0.5 and first.limit("other", 7) == 7 and first.hypothesis == "(none stated)"
    c.write_text("kill_criteria:\n  min_years: 5\n  min_sharpe: 0.5\n")
    assert not registered(c).amended
    c.write_text("kill_criteria:\n  min_years: 5\n  min_sharpe: 0.4\n")
    for _ in range(2):
        again = registered(c)
        assert again.amended and again.changes == ["kill_criteria.min_sharpe: 0.5 -> 0.4"]
    c.write_text("kill_criteria:\n")
    assert registered(c).limit("min_sharpe", 1) == 1
    lines = [json.loads(x) for x in (tmp_path / "criteria.lock.json").read_text().splitlines()]
    assert lines[0]["criteria"]["kill_criteria"]["min_sharpe"] == 0.5 and len(lines) == 3
    assert canonical_hash({"a": 1, "b": 2}) == canonical_hash({"b": 2, "a": 1}) and len(canonical_hash({})) == 16
    assert diff({"a": 1, "k": {"x": 1}}, {"b": 2, "k": {"x": 1}}) == ["a: 1 -> None", "b: None -> 2"]


def test_journal_of_one_object_is_read(tmp_path):
    c = tmp_path / "criteria.json"
    c.write_text('{"kill_criteria": {"min_sharpe": 0.4}}')
    old, now = {"kill_criteria": {"min_sharpe": 0.5}}, {"kill_criteria": {"min_sharpe": 0.4}}
    lock = {"digest": canonical_hash(old), "criteria": old, "amendments": [{"digest": canonical_hash(now), "criteria": now, "diff": []}]}
    (tmp_path / "criteria.lock.json").write_text(json.dumps(lock, indent=2))
    assert registered(c).amended and registered(c).changes == ["kill_criteria.min_sharpe: 0.5 -> 0.4"]
    c.write_text('{"kill_criteria": {"min_sharpe": 0.5}}')
    assert not registered(c).amended


SEALED, AMENDED = Criteria({"hypothesis": "h"}), Criteria({}, ["x"], True)


def test_finding():
    d = Demand("p", "at most", 0.05)
    assert Finding("a", {"p": 0.01, "n": 3}, d).passed and not Finding("a", {"p": 0.2}, d).passed and not Finding("a", {"p": math.nan}, d).passed and not Finding("a", {}, d).passed
    assert Finding("a", {"t": -3.0}, Demand("t", "in size at least", 2)).passed
    f = Finding("a", {"p": 0.01, "m": 2.0}, d, "m")
    assert f.value == 2.0 and f.detail == "p 0.01, m 2" and str(d) == "p at most 0.05"
    assert math.isnan(Finding("a", {"worst": "x"}, Demand("worst", "equal to", "x")).value) and not Finding("a", remark="short").passed and Finding("a", otherwise=True).passed


def test_report(spark, tmp_path):
    table = spark.range(20).withColumn("v", F.lit(1.23456))
    bad = Finding("Two", {"x": math.nan}, Demand("x", "above", 0))
    good = Finding("One", {"x": 1.0}, Demand("x", "above", 0), table=table)
    r = Report("n <b>", SEALED, {"sharpe": 1.0}, [good, bad], ["short sample"])
    text = str(r)
    assert "ok   One" in text and "FAIL Two  x undefined  [x above 0]" in text and "note: short sample" in text and "KILLED (1/2)" in text and "sharpe 1" in text
    page = r.to_html(tmp_path / "r.html")
    assert "n &lt;b&gt;" in page and "6 more rows" in page and "1.235" in page and (tmp_path / "r.html").read_text() == page
    frame = r.to_frame(spark).orderBy("attack")
    assert frame.columns == ["attack", "passed", "detail", "value"] and [x["value"] for x in frame.collect()] == [1.0, None]
    assert Report("n", SEALED, findings=[good]).survived and Report("n", SEALED, findings=[good]).verdict == "SURVIVED"
    assert Report("n", AMENDED, findings=[good]).verdict == "SURVIVED by amended criteria" and not Report("n", AMENDED, findings=[good]).survived
    assert Report("n", AMENDED, findings=[bad]).verdict == "KILLED by amended criteria"


def test_study_kills_noise_and_spares_drift(spark, tmp_path):
    prices = R.normal_panel(spark, 420, 110, seed=4, drift=0.003).cache()
    crit = tmp_path / "criteria.yaml"
    crit.write_text("hypothesis: drift\nkill_criteria:\n  min_sharpe: 0.5\n  min_ic_tstat: 2\n  max_turnover: 60\n  min_years: 5\n")
    kw = dict(spec=Spec(cost_bps=2.0), bootstrap=(60, 21), breadth=((20, 100), 2), walk_forward={"train_years": 0.6, "min_days": 60})
    good = Study("drift", prices, lambda px, lookback=40: S.momentum(px, lookback, 2), crit, param_grid={"lookback": [30, 40]}, **kw).run(8, False)
    assert good.survived, str(good)
    assert len(good.findings) == 11 and len(good.warnings) == 1
    assert [f.name for f in good.findings] == [a.name for a in ATTACKS]

    def many_days(case):
        """Days of the run."""
        return Finding("Days", {"days": case.days.count()}, Demand("days", "at least", 10_000))

    only = Attack("No positions", many_days, lambda c: Finding("No positions", {"n": 0}, Demand("n", "at least", 0)), stated="no_such_limit")
    bad = Study("noise", prices, lambda px: S.noise(px, 8), crit, attacks=[many_days, only], **kw).run(8, False)
    assert not bad.survived and bad.verdict == "KILLED"
    assert bad.findings[-1].name == "Days" and not bad.findings[-1].passed and 300 < bad.findings[-1].value < 420  # an attack of one's own


def test_cli(spark, tmp_path, capsys):
    assert cli.main(["init", str(tmp_path)]) == 0 and (tmp_path / "criteria.yaml").exists()
    (tmp_path / "criteria.yaml").write_text("kill_criteria:\n  min_sharpe: 99\n")
    assert cli.main(["init", str(tmp_path)]) == 0 and "99" in (tmp_path / "criteria.yaml").read_text()
    assert cli.main(["attacks"]) == 0 and "Walk-forward" in capsys.readouterr().out
    assert cli.main(["run", str(tmp_path / "no.py")]) == 2
    (tmp_path / "bad.py").write_text("x = 1\n")
    assert cli.main(["run", str(tmp_path / "bad.py")]) == 2
    (tmp_path / "ok.py").write_text(
        "from assay.operators import resample as R, signals as S\nfrom assay.session import local_session\nfrom assay.study import Study\n"
        f"def build():\n    px = R.normal_panel(local_session(), 200, 30, 1)\n    return Study('s', px, lambda p: S.momentum(p, 20, 1), {str(tmp_path / 'criteria.yaml')!r}, walk_forward=None, bootstrap=(20, 21), breadth=((20,), 1))\n"
    )
    assert cli.main(["run", str(tmp_path / "ok.py"), "--permutations", "3", "--quiet", "--out", str(tmp_path / "o.html")]) == 1
    assert (tmp_path / "o.html").exists() and "KILLED" in capsys.readouterr().out
