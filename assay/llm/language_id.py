"""Language ID: error-correcting output codes.

Each language has a codeword of bits. For each bit a binary character n-gram classifier tells the languages with a 1 from
those with a 0; its weights are the smoothed log-odds of hashed n-grams in the labelled sample. A text's bit margins are
the mean weights of its n-grams. Loss-weighted decoding sums, for each codeword, a logistic loss of the margins, weighted
by how well each bit did on its own sample, and takes the codeword with the least loss; texts whose two nearest codewords
are too close are flagged ambiguous.

The model is fitted on at most `sample_rows` labelled rows, picked by a hash of the id; everything is scored.

Defined results: null text or text without a letter gives `und` with score 0 and is not ambiguous; an untrainable table (no
labelled text) gives `und` for all; null ids are scored, and are not held out; repeated rows each give their own row;
long texts are read whole; extra columns are not read. A single learned language is predicted for every text with letters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, id_mod, mix, table

UND = "und"
BITS_HASHED = 16
ORDERS = (2, 3, 4)
SAMPLE_ROWS = 8000
#: A margin between the two nearest codewords' probabilities below this is called ambiguous.
AMBIGUOUS = 0.1
_SPACE = bytes(c if chr(c).isalpha() and c < 128 or c >= 128 else 32 for c in range(256))


def codewords(n: int) -> np.ndarray:
    """n rows of bits. All splits of the languages for up to 7 (distance 2**(n-2)); beyond, hashed bits, 15 log2 n of them."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 7:
        splits = np.arange(1, 1 << (n - 1))
        return np.array([[0 if i == 0 else (s >> (i - 1)) & 1 for s in splits] for i in range(n)], np.int8)
    bits = 15 * int(np.ceil(np.log2(n)))
    words = mix(np.arange(1, n * bits + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(n, bits)
    order = np.argsort(words, axis=0)
    out = np.zeros((n, bits), np.int8)
    np.put_along_axis(out, order[: n // 2], 1, axis=0)  # balanced columns, so no bit is constant
    return out


def grams(text: str) -> np.ndarray:
    """Hashed n-grams of the UTF-8 bytes of the lower-cased letters, other characters being one space."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_SPACE) + b" ", np.uint8)
    space = b == 32
    b = b[~(space & np.concatenate([[False], space[:-1]]))].astype(np.uint32)
    out, key = [], b
    for n in range(2, max(ORDERS) + 1):
        if len(b) < n:
            break
        key = key[:-1] | (b[n - 1 :] << np.uint32(8 * (n - 1)))
        if n in ORDERS:
            out.append((key * np.uint32(2654435761) + np.uint32(n * 40503)) * np.uint32(2246822519) >> np.uint32(32 - BITS_HASHED))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    languages: list[str]
    codes: np.ndarray  # languages x bits
    weights: np.ndarray  # n-gram buckets x bits
    bit_weight: np.ndarray  # how far each bit can be trusted
    scale: float

    def margins(self, text: str) -> np.ndarray:
        g = grams(text)
        return self.weights[g].sum(axis=0, dtype=np.float64) / max(1, len(g)) if len(g) else np.zeros(self.codes.shape[1])

    def decode(self, margins: np.ndarray) -> tuple[int, float, float]:
        """The nearest codeword, its probability, and its lead over the second."""
        signs = self.codes * 2.0 - 1
        loss = (np.logaddexp(0, -signs * margins * self.scale) * self.bit_weight).sum(axis=1)
        p = np.exp(-(loss - loss.min()))
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        return int(order[0]), float(p[order[0]]), float(p[order[0]] - p[order[1]]) if len(order) > 1 else 1.0

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.languages or not has_letter(text):
            return UND, 0.0, False
        best, p, lead = self.decode(self.margins(text))
        return self.languages[best], p, lead < AMBIGUOUS


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on at most about sample_rows of the labelled rows, spread evenly over languages as they stand."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros((0, 1)), np.zeros((1, 1)), np.ones(1), 1.0)
    share = sample_rows / len(languages)
    keep = F.lit(False)
    for lang in languages:
        limit = min(1 << 32, int(share / counts[lang] * (1 << 32)))
        keep = keep | ((F.col(lang_col) == lang) & (F.xxhash64(id_col, text_col).bitwiseAND(0xFFFFFFFF) < limit))
    size = 1 << BITS_HASHED
    index = {x: i for i, x in enumerate(languages)}

    def count(batches):
        total, seen = np.zeros((len(languages), size), np.int64), False
        for batch in batches:
            for t, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[index[lang]] += np.bincount(grams(t), minlength=size)
                seen = True
        if seen:
            import pyarrow as pa

            yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i4").tobytes()], pa.binary())], names=["counts"])

    # the sample is bounded, so eight tasks hold it, and the driver gets eight tables of fixed size at most
    parts = rows.where(keep).select(text_col, lang_col).repartition(8).mapInArrow(count, "counts binary").collect()
    counts = np.zeros((len(languages), size))
    for p in parts:
        counts += np.frombuffer(p[0], "<i4").reshape(len(languages), size)
    return from_counts(languages, counts)


def from_counts(languages: list[str], counts: np.ndarray) -> LanguageModel:
    """Bit classifiers from n-gram counts of each language. Languages weigh alike, however many texts they have."""
    codes = codewords(len(languages))
    share = counts / np.maximum(1, counts.sum(axis=1, keepdims=True))
    smooth = 1e-6
    weights = np.zeros((counts.shape[1], codes.shape[1]))
    trust = np.ones(codes.shape[1])
    for j in range(codes.shape[1]):
        one = codes[:, j] == 1
        if one.all() or not one.any():
            continue
        weights[:, j] = np.log(share[one].mean(axis=0) + smooth) - np.log(share[~one].mean(axis=0) + smooth)
        # the bit's expected margin on the languages it knows: small where both sides look alike
        trust[j] = max(1e-3, np.minimum((share[one] @ weights[:, j]).min(), -(share[~one] @ weights[:, j]).max()))
    trust = trust / trust.mean()
    return LanguageModel(languages, codes, weights.astype(np.float32), trust, 8.0)


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "held_out")) -> DataFrame:
    """The kept columns with lang_pred, score and ambiguous for every row."""
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: buckets x bits

    def run(batch):
        got = [shared.value.predict(t) for t in batch.column("__text").to_pylist()]
        yield {c: batch.column(c) for c in keep} | {"lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "ambiguous": [g[2] for g in got]}

    return arrow_map(docs.select(*keep, docs[text_col].alias("__text")), run, f"{kept}, lang_pred string, score double, ambiguous boolean")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(id_mod(id_col, 4) == 2, F.lit(False))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    docs = docs.withColumn("held_out", held_out())
    return predict(docs, fit(docs.where(~F.col("held_out"))))


def keep_identified(docs: DataFrame) -> DataFrame:
    """Pipeline stage: documents whose language is und go; the others stay as they are, a null lang becoming the predicted one."""
    model = fit(docs.where(~held_out()))
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        import pyarrow as pa

        got = [shared.value.predict(t)[0] for t in batch.column("text").to_pylist()]
        cols = {c: batch.column(c) for c in names}
        cols["lang"] = [g if x is None else x for g, x in zip(got, cols["lang"].to_pylist())]
        mask = pa.array([g != UND or not shared.value.languages and has_letter(t) for g, t in zip(got, batch.column("text").to_pylist())])
        yield {c: (v if isinstance(v, pa.Array) else pa.array(v, pa.string())).filter(mask) for c, v in cols.items()}

    return arrow_map(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
