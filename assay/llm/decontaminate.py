"""Benchmark decontamination: greedy string tiling.

Words of a document that begin five words also found in a benchmark item are joined to it as seeds, by a running Karp-Rabin hash. Only
words under a seed can be tiled. The longest match of words that no tile covers yet is marked as a tile again and again (ties: the earlier place in the item,
then in the document), until no match of five free words is left: a length that some match has is found by halving, comparing the running hashes of all free
stretches of that length, and all its matches are marked before shorter ones. So repeated words cost no more than others: pairs of places are
never listed. An item whose words are tiled to COVERAGE or more contaminates the document, in whatever order its passages stand there.

The benchmark is counted before it is broadcast; over BLOCK_CHARS characters it goes in blocks, each of which meets all documents.

Defined results: null and empty texts are clean; an item of fewer than five words is met whole, by a document of just these words, as ordinary
phrases would match it anywhere else; null and empty items, and items without a word, take no part; items with null id take part under a null
name; repeated items count once for each id; a null doc_id stays null; an empty
benchmark leaves all documents clean; repeated documents each give their own row; extra columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, mix, portions, powers, table, word_hashes

MIN_MATCH = 5
COVERAGE = 0.5
BLOCK_CHARS = 32_000_000


class Running:
    """Karp-Rabin hashes of a sequence of words: the hash of any stretch from that of the one before it, by one word less and one more."""

    def __init__(self, words: np.ndarray):
        self.up, self.down = powers(len(words) + 1)
        self.prefix = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * self.up[: len(words)], out=self.prefix[1:])

    def hashes(self, start: np.ndarray, length: int) -> np.ndarray:
        return mix((self.prefix[start + length] - self.prefix[start]) * self.down[start])


def seeds_of(words: np.ndarray) -> np.ndarray:
    """Hashes of all MIN_MATCH consecutive words; of all words together, if there are fewer."""
    k = min(MIN_MATCH, len(words))
    return Running(words).hashes(np.arange(len(words) - k + 1), k) if k else words


@dataclass
class SeedIndex:
    """Sorted distinct (seed hash, item) pairs, and the items' ids and words."""

    hashes: np.ndarray
    item: np.ndarray
    ids: list
    words: list


def seed_index(items: list[tuple[object, str | None]]) -> SeedIndex:
    words, edge = word_hashes([t for _, t in items])
    h, item, ids, own = [], [], [], []
    for i, (name, _) in enumerate(items):
        w = words[edge[i] : edge[i + 1]]
        if len(w):
            s = np.unique(seeds_of(w))
            h.append(s)
            item.append(np.full(len(s), len(ids)))
            ids.append(name)
            own.append(w)
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    hashes, item = cat(h, np.uint64), cat(item, np.int64)
    order = np.argsort(hashes, kind="stable")
    return SeedIndex(hashes[order], item[order], ids, own)


def shared_seeds(seeds: np.ndarray, index: SeedIndex) -> dict[int, np.ndarray]:
    """The distinct seeds that a document shares with each item."""
    if not len(index.hashes) or not len(seeds):
        return {}
    lo = np.searchsorted(index.hashes, seeds, "left")
    hit = np.unique(seeds[index.hashes[np.minimum(lo, len(index.hashes) - 1)] == seeds])
    if not len(hit):
        return {}
    lo = np.searchsorted(index.hashes, hit, "left")
    n = np.searchsorted(index.hashes, hit, "right") - lo
    k = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    item, seed = index.item[k], np.repeat(hit, n)
    order = np.argsort(item, kind="stable")
    item, seed = item[order], seed[order]
    first = np.flatnonzero(np.concatenate([[True], np.diff(item) != 0]))
    return dict(zip(item[first].tolist(), np.split(seed, first[1:])))


def under(seeds: np.ndarray, shared: np.ndarray, n: int) -> np.ndarray:
    """Which of n words are under a shared seed."""
    cover = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(np.isin(seeds, shared))
    np.add.at(cover, at, 1)
    np.add.at(cover, np.minimum(at + MIN_MATCH, n), -1)
    return np.cumsum(cover[:n]) > 0


def around(words: np.ndarray, shared: np.ndarray, seeds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The words under shared seeds, each run of them with the word behind it, which keeps it from the next run; and which of these are under seeds."""
    cover = under(seeds_of(words) if seeds is None else seeds, shared, len(words))
    kept = cover.copy()
    kept[1:] |= cover[:-1]
    return words[kept], cover[kept]


def free_run(free: np.ndarray) -> np.ndarray:
    """How many free words stand from each place on."""
    n = len(free)
    taken = np.where(free, n, np.arange(n))
    return np.minimum.accumulate(taken[::-1])[::-1] - np.arange(n)


def tile(item: np.ndarray, doc: np.ndarray, item_free: np.ndarray, doc_free: np.ndarray) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, start in the item, start in the document), longest first. Words that are not free at first are never tiled."""
    a, b, tiles = Running(item), Running(doc), []
    item_free, doc_free = item_free.copy(), doc_free.copy()
    most = len(item)

    def places(length: int):
        p, q = np.flatnonzero(item_run >= length), np.flatnonzero(doc_run >= length)
        x, y = a.hashes(p, length), b.hashes(q, length)
        both = np.intersect1d(x, y)
        return p[np.isin(x, both)], x[np.isin(x, both)], q[np.isin(y, both)], y[np.isin(y, both)]

    while True:
        item_run, doc_run = free_run(item_free), free_run(doc_free)
        tried, low, high = False, MIN_MATCH - 1, min(most, int(item_run.max(initial=0)), int(doc_run.max(initial=0)))
        while low < high:  # the greatest length that some match has; a copy in one piece has the first one tried
            middle = (low + high + 1) // 2 if tried else high
            tried = True
            low, high = (middle, high) if len(places(middle)[0]) else (low, middle - 1)
        if low < MIN_MATCH:
            return tiles
        most = low
        p, x, q, y = places(low)
        order = np.argsort(y, kind="stable")
        q, y = q[order], y[order]
        left, right = np.searchsorted(y, x, "left"), np.searchsorted(y, x, "right")
        following: dict[int, int] = {}  # by seed, the first place in the document that may still be free
        for place, lo, hi in zip(p.tolist(), left.tolist(), right.tolist()):
            if not item_free[place : place + low].all():
                continue
            k = following.get(lo, lo)
            while k < hi and not doc_free[q[k] : q[k] + low].all():
                k += 1
            following[lo] = k
            if k < hi:
                tiles.append((low, place, int(q[k])))
                item_free[place : place + low] = False
                doc_free[q[k] : q[k] + low] = False


def coverages(words: np.ndarray, index: SeedIndex) -> dict[int, float]:
    """Tiled share of each item that shares a seed with a document's words."""
    seeds = seeds_of(words)
    out = {}
    for i, shared in shared_seeds(seeds, index).items():
        item = index.words[i]
        if len(item) < MIN_MATCH:
            if len(words) == len(item):
                out[i] = 1.0  # a seed of fewer than five words is all there is of both
            continue
        if len(words) < MIN_MATCH:
            continue
        (a, here), (b, there) = around(item, shared), around(words, shared, seeds)
        out[i] = sum(n for n, _, _ in tile(a, b, here, there)) / len(item)
    return out


def _in_block(docs: DataFrame, items: list, coverage: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(seed_index(items))

    def run(batch):
        index = shared.value
        for lo, part in portions(batch.column("text").to_pylist()):
            words, edge = word_hashes(part)
            most, names = [], []
            for i in range(len(part)):
                w = words[edge[i] : edge[i + 1]]
                got = coverages(w, index) if len(w) else {}
                most.append(max(got.values(), default=0.0))
                names.append(sorted({str(index.ids[k]) for k, c in got.items() if c >= coverage}))
            kept = {c: batch.column(c).slice(lo, len(part)) for c in ("doc_id", "row_key")}
            yield kept | {"coverage": most, "items": names}

    return arrow_map(docs, run, "doc_id long, row_key long, coverage double, items array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, contaminated, coverage (the greatest tiled share of an item), n_items and items (ids of contaminating items, joined by commas)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    bench = benchmark.select("item_id", "text")
    size = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_CHARS))
    if blocks == 1:
        out = _in_block(docs, [tuple(r) for r in bench.collect()], coverage)
    else:
        parts = [_in_block(docs, [tuple(r) for r in bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()], coverage) for b in range(blocks)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        # rows equal in id and text have equal results: one of them stands for all, and then each comes back
        n = docs.groupBy("doc_id", "row_key").agg(F.count("*").alias("n"))
        out = out.groupBy("doc_id", "row_key").agg(F.max("coverage").alias("coverage"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        out = out.join(n, (out.doc_id.eqNullSafe(n.doc_id)) & (out.row_key == n.row_key)).select(out.doc_id, "coverage", "items", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return out.select("doc_id", (F.size("items") > 0).alias("contaminated"), "coverage", F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("items"))


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Pipeline stage: contaminated documents go, the others stay as they are. One pass over docs for each block of the benchmark."""
    bench = benchmark.select("item_id", "text")
    size = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_CHARS))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    for b in range(blocks):
        items = [tuple(r) for r in (bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)).collect()]
        shared = docs.sparkSession.sparkContext.broadcast(seed_index(items))

        def run(batch, shared=shared):
            import pyarrow as pa

            clean = []
            for _, part in portions(batch.column("text").to_pylist()):
                words, edge = word_hashes(part)
                for i in range(len(edge) - 1):
                    w = words[edge[i] : edge[i + 1]]
                    got = coverages(w, shared.value) if len(w) else {}
                    clean.append(max(got.values(), default=0.0) < coverage)
            mask = pa.array(clean)
            yield {c: batch.column(c).filter(mask) for c in batch.schema.names}

        docs = arrow_map(docs, run, schema)
    return docs
