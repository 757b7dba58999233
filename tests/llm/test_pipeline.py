"""The pipeline's stages, each against a plain version on its own input."""

import re

import corpus_pipeline as C
from assay.llm import pii
from assay.llm import sentencepiece_viterbi as S
from test_near_dedup import brute as classes

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    junk = spark.createDataFrame([(10**6, "12 34 !!", "en", "s", 8), (10**6 + 1, None, "en", "s", None), (10**6 + 2, "tail " + bench[0] + " tail", "en", "s", 9)], docs.schema)
    docs = docs.unionByName(junk)
    for i, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, SF).cache()
        before, after = {r["doc_id"]: r for r in docs.collect()}, {r["doc_id"]: r for r in out.collect()}
        if i < 4:
            assert out.columns == docs.columns
        if name == "language_id":
            assert set(after) == {k for k, r in before.items() if r["text"] and any(map(str.isalpha, r["text"]))}
            assert all(after[k]["text"] == before[k]["text"] for k in after)
        elif name == "near_dedup":
            c = classes(sorted((k, r["text"]) for k, r in before.items()))
            assert set(after) == {k for k, v in c.items() if k == v}
        elif name == "decontamination":
            gone = set(before) - set(after)
            assert {k for k, r in before.items() if any(b in r["text"] for b in bench)} <= gone and 10**6 + 2 in gone
            words = lambda t: re.findall(r"\w+", t.lower())
            items = [words(b) for b in bench]
            for k in gone:  # each has most of an item's runs of five words
                own = words(before[k]["text"])
                runs = {tuple(own[j : j + 5]) for j in range(len(own))}
                assert max(sum(tuple(b[j : j + 5]) in runs for j in range(len(b) - 4)) / max(1, len(b) - 4) for b in items) > 0.3
        elif name == "pii":
            assert set(after) == set(before)
            for k, r in before.items():
                spans = pii.all_spans(r["text"])[1]
                assert (after[k]["text"] == r["text"]) == (not spans) and pii.base_spans(after[k]["text"]) == []
        else:
            v = S.vocabulary(S.load_model(spark))
            assert all(r["exact"] and S.decode(v, r["ids"]) == before[k]["text"] for k, r in after.items()) and set(after) == set(before)
        docs = out


def test_run(spark):
    assert C.run(spark, SF).count() > 0 and len(C.STAGES) == 5 and C.ORACLE_SQL is None
