"""MinHash near-dedup: DartMinHash signatures and banded joining.

A document is the multiset of its shingles of five words. Every unit of a shingle's weight is a cell, and a Poisson process
throws darts into the cell; a dart has a coordinate and a rank, both hashed, so all documents with the cell see the same
darts. Of each coordinate the earliest dart is kept. Ranks come in doubling ranges, and a document reads on only until all coordinates have one:
about k ln k darts in all. Two documents agree in a coordinate with the probability of their weighted Jaccard similarity.

Exact copies (equal words) are first folded to one representative. Signatures of representatives are banded; each bucket links its members to its
least member (a star, never all pairs). What is not surely similar or dissimilar by signature is verified on the texts. Two more rounds of stars
have other centres, for members outside their bucket's main component. What is still outside is compared with all members of the bucket, in blocks of
bounded size. So no link that banding finds is lost, whatever the size of a bucket.

With 32 bands of 5 of 160 coordinates, a pair of similarity 0.8 shares no bucket with probability 3e-6. A pair under 0.8 agrees in the HIGH share of
coordinates, and so is taken for similar unread, with probability 5e-8 at most (2e-11 at 0.75).

Defined results: null and empty texts, and texts without any word, are copies of nothing but texts equal to them character by
character (null and empty ones: of nothing); rows with equal doc_id share a class; rows with null doc_id have a null
class unless a text equal to theirs has an id; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, hinted, mix, portions, powers, scratch_dir, shingle_hashes, table, word_hashes, written
from .graph import components

WORDS = 5
SIMILARITY = 0.8
K = 160
BANDS = 32
#: Signatures agreeing in less than LOW of their coordinates are dissimilar and from HIGH on similar, both by over 4 standard deviations.
LOW, HIGH = 0.66, 0.95
#: Rounds of stars with new centres, before all that is left is compared.
STAR_ROUNDS = 2
#: Members of a bucket that meet in one task, outsiders and all, and their shingles: what comes first bounds.
ROWS, COLUMNS = 384, 1024
ROW_CELLS, COLUMN_CELLS = 500_000, 2_000_000
FIRST_RANGE = -7  # ranks below 2**-7 are the first range


@lru_cache(maxsize=64)
def _poisson(length: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ... darts in a range of ranks."""
    p, total, out, n = np.exp(-length), 0.0, [], 0
    while n <= length or p > 1e-17:
        total += p
        out.append(total)
        n += 1
        p *= length / n
    return np.array(out)


def dart_signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int = K) -> np.ndarray:
    """k coordinates of 16 bits for each (element hashes, integer weights); an empty set has zeros."""
    n = len(sets)
    least = np.full(n * k, np.iinfo(np.uint64).max, np.uint64)
    counts = np.array([int(w.sum()) for _, w in sets], np.int64)
    cells = []
    for h, w in sets:
        copy = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
        cells.append(mix(np.repeat(h, w) + copy.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    cell = np.concatenate(cells) if cells else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(n), counts)
    low, step = 0.0, 0
    while len(cell):
        high = 2.0 ** (FIRST_RANGE + step)
        cdf = _poisson(high - low)
        u = (mix(cell ^ np.uint64(0xA5A5_0000 + 2 * step + 1)) >> np.uint64(11)) * 2.0**-53
        hit = np.flatnonzero(u >= cdf[0])
        number = np.searchsorted(cdf, u[hit], "right")
        darts = np.repeat(hit, number)
        nth = np.arange(len(darts)) - np.repeat(np.cumsum(number) - number, number)
        d = mix(cell[darts] + np.uint64(0xD1342543DE82EF95) * (nth.astype(np.uint64) + np.uint64(1000 * step + 1)))
        where = doc[darts] * k + ((d & np.uint64(0xFFFFFFFF)) % np.uint64(k)).astype(np.int64)
        rank = (np.uint64(step) << np.uint64(56)) | ((d >> np.uint64(32)) << np.uint64(24)) | (d & np.uint64(0xFFFFFF))
        np.minimum.at(least, where, rank)
        unfilled = (least.reshape(n, k) == np.iinfo(np.uint64).max).any(axis=1)
        keep = unfilled[doc]
        cell, doc = cell[keep], doc[keep]
        low, step = high, step + 1
    sig = (mix(least) >> np.uint64(48)).astype(np.uint16).reshape(n, k)
    sig[counts == 0] = 0
    return sig


def shingle_set(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingle_hashes(words, WORDS), return_counts=True)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of least weights over sum of greatest."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum()
    return float(least / (a[1].sum() + b[1].sum() - least))


def fingerprint(words: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a sequence."""
    up = powers(len(words))[0]
    both = np.array([(mix(words + np.uint64(k)) * up).sum(dtype=np.uint64) + np.uint64(len(words)) for k in (1, 2)], np.uint64)
    return tuple(mix(both).view(np.int64).tolist())


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, a 128-bit fingerprint of the words (null for null and empty texts), and the signature (null without words)."""

    def run(batch):
        for lo, part in portions(batch.column("text").to_pylist()):
            words, at = word_hashes(part)
            one, two, sets, has = [], [], [], []
            for i, t in enumerate(part):
                w = words[at[i] : at[i + 1]]
                if len(w):
                    f = fingerprint(w)
                elif t:
                    f = fingerprint(np.frombuffer(t.encode("utf-8", "replace"), np.uint8).astype(np.uint64) + np.uint64(7))
                else:
                    f = None
                one.append(None if f is None else f[0])
                two.append(None if f is None else f[1])
                has.append(len(w) > 0)
                sets.append(shingle_set(w) if len(w) else (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            sig = dart_signatures(sets)
            yield {"doc_id": batch.column("doc_id").slice(lo, len(part)), "f1": one, "f2": two, "sig": [s.tobytes() if h else None for s, h in zip(sig, has)]}

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, f1 long, f2 long, sig binary")


def band_rows(nodes: DataFrame) -> DataFrame:
    """(band, key, node) of every band of every signature."""

    def run(batch):
        ids = np.asarray(batch.column("node"))
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(len(ids), BANDS, K // BANDS).astype(np.uint64)
        key = np.zeros((len(ids), BANDS), np.uint64)
        for r in range(sig.shape[2]):
            key = mix(key + sig[:, :, r] + np.uint64(r + 1))
        yield {"band": np.tile(np.arange(BANDS, dtype=np.int32), len(ids)), "key": key.ravel().view(np.int64), "node": np.repeat(ids, BANDS)}

    return arrow_map(nodes.select("node", "sig"), run, "band int, key long, node long")


def estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs (a, b) with est, the share of coordinates in which their signatures agree."""
    a = nodes.select(F.col("node").alias("a"), F.col("sig").alias("sa"))
    b = nodes.select(F.col("node").alias("b"), F.col("sig").alias("sb"))

    def run(batch):
        n = batch.num_rows
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(n, K) for c in ("sa", "sb"))
        yield {"a": batch.column("a"), "b": batch.column("b"), "est": (x == y).mean(axis=1)}

    return arrow_map(pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb"), run, "a long, b long, est double")


def verified(scored: DataFrame, docs: DataFrame, path: str) -> DataFrame:
    """Of pairs (a, b, est) those that are similar: sure ones by signature, the others by their texts. docs: doc_id, text."""
    scored = written(scored.where(F.col("est") >= LOW), f"{path}/scored")
    unsure = scored.where(F.col("est") < HIGH)
    need = unsure.select(F.col("a").alias("doc_id")).union(unsure.select("b")).distinct()
    # rows of equal id share a class: any one text of theirs stands for the id
    texts = docs.select("doc_id", "text").join(hinted(written(need, f"{path}/need")), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
    texts = written(texts, f"{path}/texts")

    def run(batch):
        a, b = batch.column("ta").to_pylist(), batch.column("tb").to_pylist()
        kept = []
        for x, y in zip(a, b):
            words, at = word_hashes([x, y])
            kept.append(weighted_jaccard(shingle_set(words[: at[1]]), shingle_set(words[at[1] :])) >= SIMILARITY if at[1] and at[2] > at[1] else False)
        import pyarrow as pa

        mask = pa.array(kept)
        yield {"a": batch.column("a").filter(mask), "b": batch.column("b").filter(mask)}

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    exact = arrow_map(unsure.join(left, "a").join(right, "b").select("a", "b", "ta", "tb"), run, "a long, b long")
    return written(scored.where(F.col("est") >= HIGH).select("a", "b").union(exact), f"{path}/links")


def mixed_buckets(members: DataFrame, label: DataFrame, path: str) -> DataFrame:
    """Rows (band, key, node, comp, main) of the buckets that hold several components; main is the component with most members there."""
    placed = members.join(label, "node", "left").select("band", "key", "node", F.coalesce("label", "node").alias("comp"))
    parts = written(placed.groupBy("band", "key", "comp").agg(F.count("*").alias("c")), f"{path}/parts")
    main = parts.groupBy("band", "key").agg(F.max_by("comp", F.struct("c", -F.col("comp"))).alias("main"), F.count("*").alias("z")).where("z > 1")
    return written(placed.join(main.select("band", "key", "main"), ["band", "key"]), f"{path}/mixed")


def shingle_cells(texts: DataFrame) -> DataFrame:
    """(node, n, cells): per text the hashes of its shingles in order, repeated ones told apart, as bytes. texts: node, text."""

    def run(batch):
        for lo, part in portions(batch.column("text").to_pylist()):
            words, at = word_hashes(part)
            cells = []
            for i in range(len(part)):
                h, w = shingle_set(words[at[i] : at[i + 1]]) if at[i + 1] > at[i] else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                copy = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
                cells.append(np.sort(mix(np.repeat(h, w) + copy.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))
            yield {"node": batch.column("node").slice(lo, len(part)), "n": [len(c) for c in cells], "cells": [c.tobytes() for c in cells]}

    return arrow_map(texts, run, "node long, n long, cells binary")


def exact_links(mixed: DataFrame, docs: DataFrame, path: str) -> DataFrame:
    """Links that join components, from all pairs of a bucket's members outside its main component with all its members.

    Each text is hashed once. Outsiders go in blocks, members in chunks, both bounded in rows and in shingles (a longer text is one of its own); a task has
    one of each, takes all their similarities at once as matrix products, and returns what joins components: fewer links than it has members."""
    out = F.col("comp") != F.col("main")
    need = written(mixed.select(F.col("node").alias("doc_id")).distinct(), f"{path}/exact_need")
    texts = docs.join(hinted(need), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text")).withColumnRenamed("doc_id", "node")
    cells = written(shingle_cells(texts.select("node", "text")), f"{path}/cells")
    mixed = mixed.join(cells.select("node", F.col("n").alias("own")), "node")
    size = mixed.groupBy("band", "key").agg(F.count("*").alias("n"), F.count_if(out).alias("m"), F.sum("own").alias("w"), F.sum(F.when(out, F.col("own")).otherwise(0)).alias("v"))
    parts = lambda rows, most, held, cells_: F.greatest(F.lit(1), F.ceil(F.col(rows) / most), F.ceil(F.col(held) / cells_)).cast("int")
    size = size.select("band", "key", parts("m", ROWS, "v", ROW_CELLS).alias("blocks"), parts("n", COLUMNS, "w", COLUMN_CELLS).alias("chunks"))
    m = mixed.join(size, ["band", "key"])
    pick = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = m.where(out).select("band", "key", "node", "comp", F.lit(True).alias("row"), pick("blocks", 1).alias("block"), every("chunks").alias("chunk"))
    cols = m.select("band", "key", "node", "comp", F.lit(False).alias("row"), every("blocks").alias("block"), pick("chunks", 2).alias("chunk"))

    def link(pdf):
        import pandas as pd

        rows, cols = pdf[pdf["row"]], pdf[~pdf["row"]]
        sets, comps, at = {n: np.frombuffer(c, np.uint64) for n, c in zip(pdf["node"], pdf["cells"])}, dict(zip(pdf["node"], pdf["comp"])), {}
        a, b = rows["node"].tolist(), cols["node"].tolist()
        known, both = np.unique(np.concatenate(list(sets.values())), return_counts=True)
        known = known[both > 1]  # what one text alone has is in no intersection
        inter = np.zeros((len(a), len(b)), np.float32)
        for lo in range(0, len(known), 8192):
            part = known[lo : lo + 8192]

            def matrix(nodes):
                x = np.zeros((len(nodes), len(part)), np.float32)
                for i, node in enumerate(nodes):
                    k = np.minimum(np.searchsorted(part, sets[node]), len(part) - 1)
                    x[i, k[part[k] == sets[node]]] = 1
                return x

            inter += matrix(a) @ matrix(b).T
        na, nb = (np.array([len(sets[x]) for x in z], np.float64) for z in (a, b))
        near = inter >= SIMILARITY * (na[:, None] + nb[None, :] - inter)
        found = []

        def root(c):
            while at.get(c, c) != c:
                c = at[c]
            return c

        for i, j in zip(*np.nonzero(near)):
            x, y = root(comps[a[i]]), root(comps[b[j]])
            if x != y and a[i] != b[j]:
                at[max(x, y)] = min(x, y)
                found.append((a[i], b[j]))
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return rows.unionByName(cols).join(cells.select("node", "cells"), "node").groupBy("band", "key", "block", "chunk").applyInPandas(link, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, text_id (least id of the texts with equal words), class_id (least id of its near-duplicate class)."""
    spark = docs.sparkSession
    path = scratch_dir(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    seen = written(signatures(docs), f"{path}/seen")
    own = F.when(F.col("f1").isNull(), F.col("doc_id"))  # null and empty texts fold with nothing
    folded = seen.where("f1 is not null").groupBy("f1", "f2").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "sig"))).alias("m"))
    folded = written(folded.select("f1", "f2", F.col("m.doc_id").alias("node"), F.col("m.sig").alias("sig")), f"{path}/folded")
    nodes = folded.where("node is not null and sig is not null").select("node", "sig")
    rows = band_rows(nodes)
    # written before it is joined: Spark splits a large key only where both sides come from a shuffle of their own
    buckets = written(rows.groupBy("band", "key").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1"), f"{path}/buckets")
    members = written(rows.join(buckets, ["band", "key"]), f"{path}/members")
    # signatures are needed once per id: an id with several texts is one node, whichever text stands for it
    nodes = nodes.join(hinted(written(members.select("node").distinct(), f"{path}/near")), "node", "left_semi").groupBy("node").agg(F.min("sig").alias("sig"))
    nodes = written(nodes, f"{path}/nodes")
    stars = members.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    links = verified(estimated(stars, nodes), docs, f"{path}/stars0")
    label = components(links, f"{path}/first")
    mixed = mixed_buckets(members, label, f"{path}/mixed0")
    for step in range(1, STAR_ROUNDS + 1):
        if not mixed.limit(1).count():
            break
        # another member of the main component is the centre now, for those that are outside it
        centre = mixed.where("comp = main").groupBy("band", "key").agg(F.min_by("node", F.xxhash64("node", "band", F.lit(step))).alias("a"))
        stars = mixed.where("comp <> main").join(centre, ["band", "key"]).select("a", F.col("node").alias("b")).distinct()
        more = verified(estimated(stars, nodes), docs, f"{path}/stars{step}")
        links = written(links.union(more), f"{path}/links{step}")
        label = components(links, f"{path}/round{step}")
        mixed = mixed_buckets(members, label, f"{path}/mixed{step}")
    if mixed.limit(1).count():
        links = written(links.union(exact_links(mixed, docs, path)), f"{path}/links")
        label = components(links, f"{path}/second")
    named = folded.select("f1", "f2", F.col("node").alias("text_id")).join(label.withColumnRenamed("node", "text_id"), "text_id", "left")
    named = named.select("f1", "f2", "text_id", F.coalesce("label", "text_id").alias("class_id"))
    out = seen.select("doc_id", "f1", "f2").join(named, ["f1", "f2"], "left")
    return out.select("doc_id", F.coalesce("text_id", own).alias("text_id"), F.coalesce("class_id", own).alias("class_id"))


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """Pipeline stage: of each near-duplicate class the document with the least id stays, whole; of rows with equal id one stays.

    Rows with null id stay unless a text equal to theirs has an id."""
    found = written(near_duplicates(docs), f"{scratch_dir(docs.sparkSession)}/classes")
    drop = found.where("doc_id <> class_id").select("doc_id").distinct()
    kept = docs.join(hinted(drop), "doc_id", "left_anti")
    if found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        known = kept.where("doc_id is not null").dropDuplicates(["doc_id"])
        kept = known.unionByName(kept.where("doc_id is null"))
    return kept.select(docs.columns)
