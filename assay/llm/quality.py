"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Terms of a text are hashed words, character-shape n-grams (lower, upper, digit, white space; other signs as themselves) and
how often its words and lines repeat. Term weights are square roots of shares times inverse document frequencies; a truncated
singular value decomposition of the labelled sample's term matrix gives the latent space. The sample's unit vectors, with their
labels, go to every task; every document's cosines with all of them are computed exactly, block by block, and its
NEIGHBOURS nearest vote with weights that grow with similarity.

The labelled sample has at most about `sample_rows` rows, picked by a hash of the id; everything is scored.

Defined results: null and empty texts have one term of their own, so they are nearest to empty labelled texts, and get the sample's mean label
if there are none; without any usable label every score is 0.5; of several labels of an id the mean counts; null ids are scored and are not
held out; repeated rows each give their own row; texts are read whole; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, id_mod, portions, table, word_hashes

SAMPLE_ROWS = 4000
DIMENSIONS = 64
NEIGHBOURS = 25
WORD_TERMS, PAIR_TERMS, TRIPLE_TERMS, LEVELS = 2048, 4096, 4096, 16
N_TERMS = WORD_TERMS + PAIR_TERMS + TRIPLE_TERMS + 64 + 2 * LEVELS + 1
EMPTY_TERM = N_TERMS - 1

# shape of a byte: 0 lower or beyond ASCII, 1 upper, 2 digit, 3 white space, 4 and on other signs
_SHAPE = np.zeros(256, np.uint8)
_SHAPE[65:91], _SHAPE[48:58], _SHAPE[[9, 10, 11, 12, 13, 32]] = 1, 2, 3
_SIGNS = [c for c in range(33, 127) if not chr(c).isalnum()]
_SHAPE[_SIGNS] = np.arange(4, 4 + len(_SIGNS))
_SHAPE[10] = 4 + len(_SIGNS)


def term_weights(texts: list[str | None]) -> np.ndarray:
    """texts x N_TERMS, square roots of term shares, float32."""
    out = np.zeros((len(texts), N_TERMS), np.float32)
    words, at = word_hashes(texts)
    for i, t in enumerate(texts):
        if not t:
            out[i, EMPTY_TERM] = 1
            continue
        row, o = out[i], 0
        w = words[at[i] : at[i + 1]]
        row[o : o + WORD_TERMS] = np.sqrt(np.bincount((w >> np.uint64(20)).astype(np.int64) & (WORD_TERMS - 1), minlength=WORD_TERMS) / max(1, len(w)))
        o += WORD_TERMS
        s = _SHAPE[np.frombuffer(t.encode("utf-8", "replace"), np.uint8)].astype(np.int64)
        two = s[:-1] * 64 + s[1:]
        row[o : o + PAIR_TERMS] = np.sqrt(np.bincount(two, minlength=PAIR_TERMS) / max(1, len(two)))
        o += PAIR_TERMS
        three = (two[:-1] * 64 + s[2:]) * 2654435761 >> 7 & (TRIPLE_TERMS - 1)
        row[o : o + TRIPLE_TERMS] = np.sqrt(np.bincount(three, minlength=TRIPLE_TERMS) / max(1, len(three)))
        o += TRIPLE_TERMS
        row[o : o + 64] = np.sqrt(np.bincount(s, minlength=64) / len(s))
        o += 64
        repeated = 1 - len(np.unique(w)) / max(1, len(w))
        row[o + min(LEVELS - 1, int(repeated * LEVELS))] = 0.5
        o += LEVELS
        lines = [x for x in t.split("\n") if x]
        row[o + min(LEVELS - 1, int((1 - len(set(lines)) / max(1, len(lines))) * LEVELS))] = 0.5
    return out


@dataclass
class QualityModel:
    idf: np.ndarray
    projection: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # labelled rows x dimensions, unit length
    labels: np.ndarray
    prior: float

    def latent(self, texts: list[str | None]) -> np.ndarray:
        v = (term_weights(texts) * self.idf) @ self.projection
        n = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, n, out=np.zeros_like(v), where=n > 1e-9)

    def scores(self, texts: list[str | None], block: int = 1024) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), self.prior)
        v, best, best_y = self.latent(texts), None, None
        for lo in range(0, len(self.vectors), block):
            c = v @ self.vectors[lo : lo + block].T
            y = np.broadcast_to(self.labels[lo : lo + block], c.shape)
            if best is not None:
                c, y = np.concatenate([best, c], axis=1), np.concatenate([best_y, y], axis=1)
            if c.shape[1] > NEIGHBOURS:
                top = np.argpartition(-c, NEIGHBOURS - 1, axis=1)[:, :NEIGHBOURS]
                c, y = np.take_along_axis(c, top, axis=1), np.take_along_axis(y, top, axis=1)
            best, best_y = c, y
        weight = np.maximum(best.astype(np.float64), 0) ** 8
        total = weight.sum(axis=1)
        # a vote of little weight is drawn to the prior
        return np.clip(((weight * best_y).sum(axis=1) + 0.05 * self.prior) / (total + 0.05), 0, 1)


def fit_rows(texts: list[str | None], labels: np.ndarray, dimensions: int = DIMENSIONS) -> QualityModel:
    if not len(texts):
        return QualityModel(np.ones(N_TERMS, np.float32), np.zeros((N_TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    x = np.concatenate([term_weights(texts[lo : lo + 256]) for lo in range(0, len(texts), 256)])
    df = (x > 0).sum(axis=0)
    idf = (np.log((1 + len(x)) / (1 + df)) + 0.5).astype(np.float32)
    x *= idf
    d = min(dimensions, len(x))
    # right singular vectors from a randomised range: two power steps over the sample's own matrix
    q = np.random.default_rng(1).standard_normal((N_TERMS, min(d + 16, len(x)))).astype(np.float32)
    for _ in range(3):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, spread, vt = np.linalg.svd(x @ q, full_matrices=False)
    # a sample of repeated rows spans fewer directions; one that it has no spread in would be arbitrary
    projection = (q @ vt[:d][spread[:d] > 1e-4 * spread[0]].T).astype(np.float32)
    v = x @ projection
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    return QualityModel(idf, projection, v, np.asarray(labels, np.float64), float(np.mean(labels)))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """docs: doc_id and text of the rows that may be learned from. Reads at most about sample_rows labelled texts to the driver."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    n = known.count()
    if not n:
        return fit_rows([], np.zeros(0))
    hashed = F.xxhash64("doc_id", F.lit(5)).bitwiseAND(0xFFFFFFFF)
    limit = min(1 << 32, int(sample_rows / n * (1 << 32)))
    # the sample is bounded, so its ids may be broadcast
    rows = docs.select("doc_id", "text").where(hashed < limit).join(F.broadcast(known.where(hashed < limit)), "doc_id").select("doc_id", "text", "quality").orderBy("doc_id", "text").collect()
    return fit_rows([r["text"] for r in rows], np.array([r["quality"] for r in rows], np.float64))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(id_mod(id_col, 3) == 1, F.lit(False))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample and the number of terms

    def run(batch):
        for lo, part in portions(batch.column("text").to_pylist()):
            s = shared.value.scores(part)
            yield {"doc_id": batch.column("doc_id").slice(lo, len(part)), "held_out": batch.column("held_out").slice(lo, len(part)), "score": s, "predicted": (s >= 0.5).astype(np.int32)}

    return arrow_map(docs, run, "doc_id long, held_out boolean, score double, predicted int")


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out())
    model = fit(docs.where(~F.col("held_out")).select("doc_id", "text"), table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, model)
