import itertools

import numpy as np
from pyspark.sql import functions as F

from assay.llm import language_id as L


def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 8, 20):
        c = L.codewords(n)
        least = min(int((a != b).sum()) for a, b in itertools.combinations(c, 2))
        assert least >= (2 ** (n - 2) if n <= 7 else 3 * np.ceil(np.log2(n)))
        assert all(0 < c[:, j].sum() < n for j in range(c.shape[1]))


def test_decoding_corrects_a_wrong_bit():
    m = L.LanguageModel(list("abcd"), L.codewords(4), np.zeros((1, 7)), np.ones(7), 8.0)
    clear = (m.codes[2] * 2.0 - 1) * 0.5
    assert m.decode(clear)[0] == 2
    clear[0] *= -1
    assert m.decode(clear)[0] == 2
    _, p, lead = m.decode(np.zeros(7))
    assert p == 0.25 and lead < L.AMBIGUOUS


def test_held_out_accuracy(spark, sf):
    got = L.op1_language_id(spark, sf)
    j = got.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = j.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("acc"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r["acc"] > 0.98 and 0 <= r["lo"] and r["hi"] <= 1
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_odd_rows(odd_docs, no_docs):
    docs = odd_docs.withColumn("held_out", L.held_out())
    model = L.fit(docs.where(~F.col("held_out")))
    got = [tuple(r) for r in L.predict(docs, model).select("doc_id", "lang_pred", "score").collect()]
    assert len(got) == docs.count()
    assert {x[1] for x in got if x[0] in (2, 3, 5)} == {"und"} and dict((x[0], x[1]) for x in got)[6] == "fr" and dict((x[0], x[1]) for x in got)[4] == "en"
    kept = L.keep_identified(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == 6 and kept.where("lang is null").count() == 0
    assert L.keep_identified(no_docs).count() == 0


def plain_predictions(rows):
    """doc_id -> (language, score) with counts in dictionaries and every sum in a loop; rows: (doc_id, text, lang)."""
    import math
    import re
    import zlib
    from collections import Counter

    def grams(text):
        b = re.sub(rb" +", b" ", b" " + bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in text.lower().encode()) + b" ")
        return [((int.from_bytes(b[i : i + n], "little") * 2654435761 + n * 40503) % 2**32 * 2246822519 % 2**32) >> 16 for n in (2, 3, 4) for i in range(len(b) - n + 1)]

    learned = {}
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2 and text is not None and lang is not None:
            learned.setdefault(lang, Counter()).update(grams(text))
    langs = sorted(learned)
    size = {x: sum(learned[x].values()) for x in langs}
    seen = set().union(*learned.values())
    bits = []
    for split in range(1, 2 ** (len(langs) - 1)):
        ones = [x for j, x in enumerate(langs) if j and split >> (j - 1) & 1]
        zeros = [x for x in langs if x not in ones]
        mean = lambda side, g: sum(learned[x][g] / size[x] for x in side) / len(side)
        w = {g: math.log(mean(ones, g) + 1e-6) - math.log(mean(zeros, g) + 1e-6) for g in seen}
        margin = {x: sum(learned[x][g] / size[x] * w[g] for g in learned[x]) for x in langs}
        bits.append((set(ones), w, max(1e-3, min([margin[x] for x in ones] + [-margin[x] for x in zeros]))))
    level = sum(t for _, _, t in bits) / len(bits)
    out = {}
    for i, text, _ in rows:
        if text is None or not any(c.isalpha() for c in text):
            out[i] = ("und", 0.0)
            continue
        g = grams(text)
        m = [sum(w.get(x, 0.0) for x in g) / len(g) for _, w, _ in bits]
        loss = [sum(math.log1p(math.exp((-1 if x in ones else 1) * v * 8)) * t / level for (ones, _, t), v in zip(bits, m)) for x in langs]
        p = [math.exp(min(loss) - y) for y in loss]
        out[i] = (langs[loss.index(min(loss))], max(p) / sum(p))
    return out


def test_query_equals_a_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    want = plain_predictions(rows)
    got = {r["doc_id"]: r for r in L.op1_language_id(spark, sf).collect()}
    assert set(got) == set(want)
    for i, (lang, p) in want.items():
        assert got[i]["lang_pred"] == lang and abs(got[i]["score"] - p) < 1e-4
