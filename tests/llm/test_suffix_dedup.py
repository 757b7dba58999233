import time
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from assay.llm import suffix_dedup as S


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[p : p + length] for b in data for p in range(len(b) - length + 1))
    out = []
    for b in data:
        hit = np.zeros(len(b) + 1, int)
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                hit[p : p + length] = 1
        kept = bytes(x for x, h in zip(b, hit) if not h)
        out.append((len(b), int(hit.sum()), int((np.diff(np.concatenate([[0], hit])) == 1).sum()), sha256(kept).hexdigest()))
    return out


def texts(seed, alphabet):
    rng = np.random.default_rng(seed)
    base = "".join(rng.choice(list(alphabet), 400))
    out = ["".join(rng.choice(list(alphabet), rng.integers(0, 300))) for _ in range(60)]
    for _ in range(30):
        a = rng.integers(0, 350)
        out.append("".join(rng.choice(list(alphabet), 30)) + base[a : a + rng.integers(10, 120)] + "".join(rng.choice(list(alphabet), 30)))
    return out + [base, base, "ab" * 90, "a" * 100, None, "", "é" * 70]


@pytest.mark.parametrize("seed,alphabet,hot,hot_key", [(0, "abcdefgh ", 20_000, 5_000), (1, "ab", 20_000, 2), (2, "abcdé", 1, 5_000), (3, "abcd", 1, 1)])
def test_equals_brute_force(spark, monkeypatch, seed, alphabet, hot, hot_key):
    monkeypatch.setattr(S, "HOT_KEY", hot_key)
    t = texts(seed, alphabet)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(t)], "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in S.suffix_dedup(df, length=30, context=8, hot_group=hot).collect()}
    assert [got[i] for i in range(len(t))] == brute(t, 30)


def test_radix_passes_order_to_the_last_digit():
    """Against counting windows; the last digit is shorter than the others."""
    rng = np.random.default_rng(3)
    b = rng.integers(97, 99, 4000).astype(np.uint8)
    at = np.arange(len(b) - 17 + 1)
    group = (at % 2).astype(np.uint64)
    kept = S.radix_passes(group, at, S.prefix_hashes(b), 17, 5)
    count = Counter((int(g), b[p : p + 17].tobytes()) for g, p in zip(group, at))
    assert kept.tolist() == [p for g, p in zip(group, at) if count[int(g), b[p : p + 17].tobytes()] > 1]


def test_equal_rows_cost_what_rows_with_own_ids_cost(spark):
    """Rows equal in id and text, against the same texts under ids of their own."""
    rng = np.random.default_rng(5)
    text = "".join(rng.choice(list("abcdefgh "), 20_000))
    took = []
    for ids in ([7] * 400, list(range(400))):
        df = spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string")
        start = time.perf_counter()
        got = S.suffix_dedup(df).collect()
        took.append(time.perf_counter() - start)
        assert len(got) == 400 and {tuple(r)[1:] for r in got} == {(20_000, 20_000, 1, sha256(b"").hexdigest())}
    assert took[0] < 2 * took[1] + 5


def test_slices_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(7)
    part = bytes(rng.integers(97, 101, 3000).astype(np.uint8))
    whole = S.records(b"x" * 100 + part, 50, 10)
    monkeypatch.setattr(S, "SLICE", 512)
    cut = S.records(b"x" * 100 + part, 50, 10)
    windows = lambda r: [(p, a, c) for lo, hi, a, c in zip(*r[:4]) for p in range(lo, hi + 1)]
    assert windows(whole) == windows(cut)


def test_odd_rows(spark, odd_docs, no_docs):
    got = sorted((tuple(r) for r in S.suffix_dedup(odd_docs, length=30, context=8).collect()), key=str)
    assert len(got) == odd_docs.count()
    t = [r["text"] for r in odd_docs.collect()]
    assert sorted(r[1:] for r in got) == sorted(brute([x for x in t], 30))
    assert S.suffix_dedup(no_docs).count() == 0


def test_test_table(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet").orderBy("doc_id").collect()
    got = {r[0]: tuple(r)[1:] for r in S.op7_suffix_dedup(spark, path).collect()}
    assert [got[d["doc_id"]] for d in docs] == brute([d["text"] for d in docs], 200)
