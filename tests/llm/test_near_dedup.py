import itertools

import numpy as np
import pytest

from assay.llm import near_dedup as N
from assay.llm.common import word_hashes


def sets_of(texts):
    words, at = word_hashes(texts)
    return [N.shingle_set(words[at[i] : at[i + 1]]) for i in range(len(texts))]


def brute(docs):
    """Least id of each document's component of pairs of similarity 0.8 or more; every pair is tried."""
    s = sets_of([t for _, t in docs])
    up = {i: i for i, _ in docs}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (i, a), (j, b) in itertools.combinations(zip([d for d, _ in docs], s), 2):
        if len(a[0]) and len(b[0]) and N.weighted_jaccard(a, b) >= N.SIMILARITY:
            x, y = root(i), root(j)
            up[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in docs}


def test_signature_agreement_is_weighted_jaccard():
    rng = np.random.default_rng(0)
    h = rng.integers(1, 2**63, 700).astype(np.uint64)
    got, want = [], []
    for k in range(40):
        a = (np.sort(h[:600]), rng.integers(1, 4, 600))
        b = (np.sort(h[k * 2 : 600 + k * 2]), rng.integers(1, 4, 600))
        s = N.dart_signatures([a, b])
        got.append((s[0] == s[1]).mean())
        want.append(N.weighted_jaccard(a, b))
    assert abs(np.mean(got) - np.mean(want)) < 0.02 and np.abs(np.array(got) - want).max() < 0.16
    assert (N.dart_signatures([a, a])[0] == N.dart_signatures([b, a])[1]).all()  # no matter what else is in the batch
    assert (N.dart_signatures([(np.zeros(0, np.uint64), np.zeros(0, int))]) == 0).all()


@pytest.fixture(scope="module")
def group():
    """Many edits of one text, few of them similar to each other, with others about."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 4000, 120)]
    docs = []
    for i in range(150):
        t = list(base)
        for p in rng.integers(0, 120, rng.integers(0, 6)):
            t[p] = f"e{rng.integers(0, 9999)}"
        docs.append((i, " ".join(t)))
    docs += [(200 + i, " ".join(f"u{x}" for x in rng.integers(0, 10**6, 90))) for i in range(40)]
    return docs + [(300, docs[3][1]), (301, docs[3][1].upper()), (302, "same words"), (303, "same words")]


@pytest.mark.parametrize("rounds,rows,columns", [(2, 512, 2048), (0, 16, 32)])
def test_equals_all_pairs(spark, group, monkeypatch, rounds, rows, columns):
    monkeypatch.setattr(N, "STAR_ROUNDS", rounds)
    monkeypatch.setattr(N, "ROWS", rows)
    monkeypatch.setattr(N, "COLUMNS", columns)
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(spark.createDataFrame(group, "doc_id long, text string")).collect()}
    assert got == brute(group)


def test_equals_all_pairs_on_test_table(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["class_id"] for r in N.op5_near_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == brute(docs)


def test_odd_rows(spark, odd_docs, no_docs):
    got = sorted(map(tuple, N.near_duplicates(odd_docs).select("doc_id", "class_id").collect()), key=str)
    assert len(got) == odd_docs.count()
    assert got.count((1, 1)) == 2 and (None, 1) in got and (None, None) in got and {(i, i) for i in (2, 3, 4, 5, 6, 7)} <= set(got)
    kept = N.keep_one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r[0] for r in kept.where("doc_id is not null").select("doc_id").collect()) == [1, 2, 3, 4, 5, 6, 7]
    assert N.near_duplicates(no_docs).count() == 0 and N.keep_one_of_each(no_docs).count() == 0
