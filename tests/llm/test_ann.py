import numpy as np
import pytest

from assay.llm import ann as A


def frame(spark, ids, x):
    return spark.createDataFrame([(None if i is None else int(i), None if v is None else [None if c is None else float(c) for c in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")


def brute(ids, x, k, every=20):
    out = {}
    for q in range(len(ids)):
        if ids[q] % every == 0:
            s = (x * x[q]).sum(axis=1)
            o = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
            out[int(ids[q])] = [int(ids[i]) for i in o]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def test_chi_square():
    assert A.chi_square_quantile(0.95, 2) == pytest.approx(5.991, abs=1e-3) and A.chi_square_quantile(0.95, 10) == pytest.approx(18.307, abs=1e-3)


def test_recall_on_test_vectors(spark, sf):
    r = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([a["vec_id"] for a in r]), np.array([a["embedding"] for a in r], float)
    want, got = brute(ids, x, 20), found(A.op4_ann(spark, sf))
    assert want.keys() == got.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len(set(want[q]) & set(got[q])) / 20 for q in want]) >= 0.9


def test_many_cells_salts_and_copies(spark):
    """Clusters of unequal length, and a vector that a third of the rows share: small cells, so that all rounds and salts are used."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(8, 12))[rng.integers(0, 8, 900)] * 2 + rng.normal(size=(900, 12)) * 0.3
    x[::3] = x[0] * 3
    ids = np.arange(900)
    want, got = brute(ids, x, 5), found(A.nearest(frame(spark, ids, x), k=5, cell_rows=40))
    assert want.keys() == got.keys()
    assert np.mean([len(set(want[q]) & set(got[q])) / 5 for q in want]) >= 0.9
    assert got[0] == [3, 6, 9, 12, 15]  # ties go to the smaller id


def test_recall_over_many_cells_of_the_test_vectors(spark):
    """Sixteen cells or so, brute force for every query."""
    r = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id")
    rows = r.collect()
    ids, x = np.array([a["vec_id"] for a in rows]), np.array([a["embedding"] for a in rows], float)
    want, got = brute(ids, x, 20), found(A.nearest(r, cell_rows=128))
    assert want.keys() == got.keys()
    recall = [len(set(want[q]) & set(got[q])) / 20 for q in want]
    assert np.mean(recall) >= 0.98 and min(recall) >= 0.9


def test_rounds_stop_and_copies_are_one(monkeypatch):
    """On well parted clusters few leaves are read; copies are given by id whatever their number."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20, 16))[rng.integers(0, 20, 4000)] * 8 + rng.normal(size=(4000, 16)) * 0.05
    x[100:200] = x[100]
    w = A.directions(16)
    span = (x * x).sum(axis=1).max()
    p = x @ w[:16] + np.sqrt(np.maximum(0, span - (x * x).sum(axis=1)))[:, None] * w[16]
    shard = A.Shard(np.arange(4000), x, p)
    q = np.array([100, 7])
    got = shard.search(q, x[q], x[q] @ w[:16], span, 10, np.full(2, np.inf))
    score = np.sort(x @ x[100])[::-1]
    assert got[0][0][0] >= score[20] and len(shard.vectors) == 3901
    same = [i for i, s in zip(got[0][1], got[0][0]) if 100 <= i < 200]
    assert same == sorted(same) and 100 not in got[0][1]


def test_odd_rows(spark):
    ids = [0, 20, 40, 60, 80, 100, None, 1, 2, 2, 120]
    x = [[1, 0], [0, 1], None, [0, 0], [float("nan"), 1], [1, None], [1, 1], [3, 4], [1, 1], [1, 1], [1, 2, 3]]
    odd = frame(spark, ids, x)
    for name in ("cell", "salt", "salts", "x", "p", "pq", "bound", "block", "v", "score", "rank", "query_id"):
        odd = odd.selectExpr("*", f"'z' as {name}")
    got = found(A.nearest(odd, k=20))
    assert got == {0: [1, 2, 2, 20], 20: [1, 2, 2, 0]}
    assert A.nearest(frame(spark, ids, x).where("false")).count() == 0
    r = A.nearest(frame(spark, ids, x), k=1).where("query_id = 0").first()
    assert r["score"] == 3.0 and r["rank"] == 1
