"""Registered queries do the operators' whole job."""

import inspect

from assay.operators import attacks as A
from assay.plans import catalogue
from assay.study import Study


def default(f, name):
    return inspect.signature(f).parameters[name].default


def test_sizes_are_the_operators_own():
    assert catalogue.TRIALS == default(A.permutation_sharpes, "n") == default(Study.run, "permutations")
    assert (catalogue.SIZES, catalogue.DRAWS) == (default(A.breadth_sharpes, "sizes"), default(A.breadth_sharpes, "draws")) == default(Study.__init__, "breadth")
    assert catalogue.PATHS == default(A.bootstrap_quantiles, "n")


def test_study_runs_at_full_size(spark, sf, monkeypatch):
    seen = {}

    class Seen(Study):
        def __init__(self, *args, **kwargs):
            seen.update(kwargs)
            super().__init__(*args, **kwargs)

        def run(self, permutations=200, verbose=True):
            seen["permutations"] = permutations
            return self

        def to_frame(self, spark):
            return spark.createDataFrame([], "attack string, passed boolean, value double")

    monkeypatch.setattr("assay.study.Study", Seen)
    catalogue.study_findings(spark, sf)
    assert seen["breadth"] == default(Study.__init__, "breadth") and seen["bootstrap"][0] == 2000 and seen["permutations"] == 200


def test_sub_universes_have_every_size_that_fits(spark, sf):
    n = {}
    for r in catalogue.subuniverse_draws(spark, sf).groupBy("run_id", "size").count().collect():
        assert r["count"] == r["size"]
        n[r["size"]] = n.get(r["size"], 0) + 1
    assert n == {20: 8, 50: 8, 100: 8}  # the panel has 100 names
