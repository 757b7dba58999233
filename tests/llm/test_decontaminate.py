import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assay.llm import decontaminate as D
from assay.llm.common import word_hashes


def plain_tiles(a, b, least=D.MIN_MATCH):
    """Greedy string tiling by trying every pair of positions: number of tiled words of a."""
    used_a, used_b, total = [False] * len(a), [False] * len(b), 0
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not used_a[i + n] and not used_b[j + n]:
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = (n, i, j)
        if best is None:
            return total
        n, i, j = best
        used_a[i : i + n], used_b[j : j + n] = [True] * n, [True] * n
        total += n


@pytest.mark.parametrize("seed", range(6))
def test_tiles_equal_plain_version(seed):
    rng = np.random.default_rng(seed)
    item = [f"w{x}" for x in rng.integers(0, 12 if seed % 2 else 200, 40)]
    doc = [f"z{x}" for x in range(10)] + item[25:] + ["gap"] * 3 + item[:18] + [f"w{x}" for x in rng.integers(0, 200, 20)] + item[5:15]
    index = D.seed_index([(7, " ".join(item))])
    words, _ = word_hashes([" ".join(doc)])
    got = D.coverages(words, index)
    assert got.get(0, 0) == pytest.approx(plain_tiles(item, doc) / len(item))


@given(st.lists(st.integers(0, 2), max_size=30), st.lists(st.integers(0, 2), max_size=30))
@settings(max_examples=150, deadline=None)
def test_few_different_words(a, b):
    """Many equal seeds, many ties."""
    item, doc = [f"w{x}" for x in a], [f"w{x}" for x in b]
    words, _ = word_hashes([" ".join(doc)])
    got = D.coverages(words, D.seed_index([(0, " ".join(item))])).get(0, 0)
    want = plain_tiles(item, doc) / len(item) if len(item) >= 5 else float(0 < len(item) and item == doc)
    assert got == pytest.approx(want)


def test_running_hashes_depend_on_the_words_alone():
    words, _ = word_hashes(["a b c d e a b c d e x a b c"])
    h = D.Running(words).hashes(np.arange(12), 3)
    assert h[0] == h[5] == h[11] and len(set(h.tolist())) == 8


def test_repeated_words_cost_no_product():
    index = D.seed_index([(0, "word " * 1000)])
    words, _ = word_hashes(["word " * 20_000])
    start = time.perf_counter()
    assert D.coverages(words, index) == {0: 1.0}
    assert time.perf_counter() - start < 1


def test_short_items_are_met_whole(spark):
    bench = spark.createDataFrame([(0, "two words"), (1, "Three short words")], "item_id long, text string")
    d = spark.createDataFrame([(1, "Two words!"), (2, "here are two words"), (3, "three short words"), (4, "words")], "doc_id long, text string")
    assert {r["doc_id"]: r["items"] for r in D.contamination(d, bench).collect()} == {1: "0", 2: "", 3: "1", 4: ""}


def test_reordered_passages_are_caught_and_clean_ones_left(spark):
    item = " ".join(f"alpha{i}" for i in range(30))
    w = item.split()
    docs = [(1, "before " + item + " after"), (2, " ".join(w[15:] + ["and", "then"] + w[:15])), (3, " ".join(w[:9])), (4, "nothing of it here at all, as one can see")]
    bench = spark.createDataFrame([(0, item), (1, "too short"), (2, None), (None, "")], "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["contaminated"], r["items"]) for r in D.contamination(d, bench).collect()}
    assert got == {1: (True, "0"), 2: (True, "0"), 3: (False, ""), 4: (False, "")}
    assert sorted(r[0] for r in D.keep_uncontaminated(d, bench).select("doc_id").collect()) == [3, 4]


def test_blocks_of_the_benchmark_change_nothing(spark, sf, monkeypatch):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    docs = docs.where("doc_id < 200").union(docs.where("doc_id < 20"))
    one = sorted(map(tuple, D.contamination(docs, bench).collect()))
    monkeypatch.setattr(D, "BLOCK_CHARS", 3000)
    assert sorted(map(tuple, D.contamination(docs, bench).collect())) == one
    assert D.keep_uncontaminated(docs, bench).count() == sum(not r[1] for r in one)


def test_whole_items_are_found_in_the_test_table(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet").collect(), spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    got = {r["doc_id"]: r["contaminated"] for r in D.op9_decontaminate(spark, sf).collect()}
    holds = {d["doc_id"] for d in docs if any(b["text"] in d["text"] for b in bench)}
    assert holds and all(got[i] for i in holds) and len(got) == len(docs)


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(None, "The cat sat on the mat and it was happy there"), (5, "word " * 20)], "item_id long, text string")
    got = [tuple(r) for r in D.contamination(odd_docs, bench).select("doc_id", "contaminated").collect()]
    assert len(got) == odd_docs.count() and sorted({i for i, c in got if c}, key=str) == [1, 4, None] and got.count((1, True)) == 2
    assert D.contamination(no_docs, bench).count() == 0 and D.contamination(odd_docs, bench.where("false")).where("contaminated").count() == 0
    kept = D.keep_uncontaminated(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.count() == 6
