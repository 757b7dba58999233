"""Approximate nearest neighbours by largest inner product: low-dimensional stable projections indexed by kd-tree.

A vector x gets one more component, sqrt(M*M - x.x) with M the greatest length, and a query the component 0: then the largest inner product is the
least Euclidean distance, D*D = q.q + M*M - 2 q.x. All are projected to DIMENSIONS Gaussian (2-stable) directions, where the squared
distance of two points is D*D times a chi-square variable. Projected points lie in a kd-tree; the leaves come in order of
their projected distance to the query, and their points are verified by exact inner product, until the next leaf is so far that a
true neighbour nearer than the k-th one found so far would, with probability CONFIDENCE, have come before it. Queries go together: in each round a leaf meets
all queries that still ask for it.

The top of the tree is split on a bounded sample and deals all rows to cells of about CELL_ROWS rows, MAX_CELLS at most; a cell that ties or copies overfill is
salted into shards. First each query searches a shard of its own cell, which bounds its k-th distance; then it goes to just those
shards whose boxes pass the chi-square test with that bound. Shards and their queries meet by a cogroup, so no task holds more than a
shard and its queries' vectors, and no two full tables are paired.

Defined results: rows with null id take no part, nor do vectors that are null, zero, hold null or non-finite components, or have
another length than most vectors; a repeated id is one candidate per row, and as queries its rows are one (the least vector);
a query's own id is no candidate; with fewer than k candidates all are returned; an empty table gives no rows; extra columns are not
read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, scratch_dir, table, written

DIMENSIONS = 10
CONFIDENCE = 0.97
NEIGHBOURS = 20
CELL_ROWS = 8192
SAMPLE_ROWS = 50_000
LEAF_ROWS = 64
QUERY_BLOCK = 4096
#: Cells at most, whose boxes the driver holds; of more rows, cells get larger and are salted into more shards.
MAX_CELLS = 16_384


@lru_cache(maxsize=16)
def chi_square_quantile(p: float, m: int) -> float:
    """The p-quantile of a chi-square variable with an even number m of degrees of freedom."""
    def below(x):
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))

    lo, hi = 0.0, 100.0 + 10 * m
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def directions(dim: int, m: int = DIMENSIONS) -> np.ndarray:
    return np.random.default_rng(20).standard_normal((dim + 1, m))


class Split:
    """A kd-tree down to a number of cells, each split at the median of its widest direction."""

    def __init__(self, points: np.ndarray, cells: int):
        self.nodes: list = []  # (direction, value, left, right) or a cell number
        self.cells = 0
        self._build(points, max(1, cells))

    def _build(self, points: np.ndarray, cells: int) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        if cells > 1 and len(points) > 1:
            d = int(np.argmax(np.ptp(points, axis=0)))
            v = float(np.quantile(points[:, d], (cells // 2) / cells))
            left = points[:, d] < v
            if left.any() and not left.all():
                lower = self._build(points[left], cells // 2)
                upper = self._build(points[~left], cells - cells // 2)
                self.nodes[at] = (d, v, lower, upper)
                return at
        self.nodes[at] = self.cells
        self.cells += 1
        return at

    def cell(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int32)
        todo = [(0, np.arange(len(points)))]
        while todo:
            n, rows = todo.pop()
            if isinstance(self.nodes[n], tuple):
                d, v, lower, upper = self.nodes[n]
                left = points[rows, d] < v
                todo += [(lower, rows[left]), (upper, rows[~left])]
            else:
                out[rows] = self.nodes[n]
        return out


def box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of a point to boxes."""
    gap = np.maximum(0, np.maximum(low - q, q - high))
    return (gap * gap).sum(axis=1)


class Leaves:
    """The kd-tree's leaves over the projected points of a shard."""

    def __init__(self, points: np.ndarray):
        order, done = [np.arange(len(points))], []
        while order:
            rows = order.pop()
            if len(rows) <= LEAF_ROWS:
                done.append(rows)
                continue
            p = points[rows]
            d = int(np.argmax(np.ptp(p, axis=0)))
            half = len(rows) // 2
            part = np.argpartition(p[:, d], half)
            order += [rows[part[:half]], rows[part[half:]]]
        self.rows = done
        self.low = np.array([points[r].min(axis=0) for r in done])
        self.high = np.array([points[r].max(axis=0) for r in done])

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distances of points (rows) to the leaves' boxes (columns)."""
        out = np.zeros((len(q), len(self.rows)))
        for d in range(q.shape[1]):
            gap = np.maximum(0, np.maximum(self.low[None, :, d] - q[:, d, None], q[:, d, None] - self.high[None, :, d]))
            out += gap * gap
        return out


class Shard:
    """Rows that are searched together. Equal vectors are one, with their ids in order, so that copies neither cost time nor make ties."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, points: np.ndarray):
        raw = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel()
        _, first, inverse = np.unique(raw, return_index=True, return_inverse=True)
        order = np.lexsort((ids, inverse))
        self.ids = np.split(ids[order], np.cumsum(np.bincount(inverse))[:-1])
        self.vectors, self.leaves = vectors[first], Leaves(points[first])
        self.only = np.array([i[0] if i[0] == i[-1] else -1 for i in self.ids]), np.array([i[0] == i[-1] for i in self.ids])

    def search(self, q_ids, q, q_projected, span: float, k: int, bound: np.ndarray, confidence: float = CONFIDENCE) -> list[tuple[np.ndarray, np.ndarray]]:
        """(scores, ids) of the k best for each query, best first; bound: squared distances that the k-th neighbours don't exceed, or inf.

        Leaves go in rounds of 1, 2, 4, ... by their projected distance to each query; a round takes, leaf by leaf, all queries whose stopping test does
        not hold yet as one matrix product, and the test has the k-th distance that was found before the round."""
        stop, n, width = chi_square_quantile(confidence, q_projected.shape[1]), len(q), k + 8
        qq = (q * q).sum(axis=1) + span
        near = self.leaves.distances(q_projected)
        order = np.argsort(near, axis=1, kind="stable")
        kth = bound.astype(float).copy()
        best, which = np.full((n, width), -np.inf), np.full((n, width), -1, np.int64)
        at, step = 0, 1
        while at < order.shape[1]:
            part = order[:, at : at + step]
            who, column = np.nonzero(np.take_along_axis(near, part, axis=1) < (kth * stop)[:, None])
            if not len(who):
                break
            leaf = part[who, column]
            turn = np.argsort(leaf, kind="stable")
            who, leaf = who[turn], leaf[turn]
            for own in np.split(np.arange(len(who)), np.flatnonzero(np.diff(leaf)) + 1):
                rows, asking = self.leaves.rows[leaf[own[0]]], who[own]
                s = q[asking] @ self.vectors[rows].T
                s[self.only[1][rows][None, :] & (self.only[0][rows][None, :] == q_ids[asking][:, None])] = -np.inf  # a query's own row is no candidate
                hit = s.max(axis=1) > best[asking, -1]
                if not hit.any():
                    continue
                asking, s = asking[hit], s[hit]
                both = np.concatenate([best[asking], s], axis=1)
                names = np.concatenate([which[asking], np.broadcast_to(rows, s.shape)], axis=1)
                top = np.argpartition(-both, width - 1, axis=1)[:, :width]
                both, names = np.take_along_axis(both, top, axis=1), np.take_along_axis(names, top, axis=1)
                least = np.argmin(both, axis=1)
                for x in (both, names):  # the least stands last
                    i = np.arange(len(x))
                    x[i, least], x[i, -1] = x[i, -1].copy(), x[i, least].copy()
                best[asking], which[asking] = both, names
            found = -np.partition(-best, k - 1, axis=1)[:, k - 1]
            kth = np.where(np.isfinite(found), np.minimum(kth, qq - 2 * found + 1e-9), kth)
            at, step = at + step, step * 2
        out = []
        for i in range(n):
            rows = which[i][np.isfinite(best[i])]
            exact = [math.fsum((self.vectors[r] * q[i]).tolist()) for r in rows]
            own = [self.ids[r][self.ids[r] != q_ids[i]][: k] for r in rows]
            score, ids = np.repeat(exact, [len(x) for x in own]), np.concatenate(own) if own else np.zeros(0, np.int64)
            top = np.lexsort((ids, -score))[:k]
            out.append((score[top], ids[top]))
        return out


def usable(embeddings: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(vec_id, x: little-endian doubles, norm2) of the rows that take part, and their dimension."""
    v = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.where(sound)
    sizes = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return v, 0
    return v.where(F.size("v") == sizes[0]["d"]), int(sizes[0]["d"])


OUT = "query_id long, vec_id long, score double"


def _stack(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f8").reshape(len(column), -1)


def nearest(embeddings: DataFrame, k: int = NEIGHBOURS, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", cell_rows: int = CELL_ROWS, m: int = DIMENSIONS, confidence: float = CONFIDENCE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by `every`."""
    spark = embeddings.sparkSession
    path = scratch_dir(spark)
    v, dim = usable(embeddings, id_col, vec_col)
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n, span = v.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()
    span = float(span) * (1 + 1e-12)
    w = directions(dim, m)

    def project(batch):
        x = np.asarray(batch.column("v").combine_chunks().flatten() if hasattr(batch.column("v"), "combine_chunks") else batch.column("v").flatten()).reshape(batch.num_rows, dim)
        lift = np.sqrt(np.maximum(0, span - (x * x).sum(axis=1)))
        base = x @ w[:dim]
        yield {"vec_id": batch.column("vec_id"), "x": [r.astype("<f8").tobytes() for r in x], "p": [r.astype("<f8").tobytes() for r in base + lift[:, None] * w[dim]], "pq": [r.astype("<f8").tobytes() for r in base]}

    rows = written(arrow_map(v, project, "vec_id long, x binary, p binary, pq binary"), f"{path}/rows")
    share = min(1.0, SAMPLE_ROWS / n)
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("p").collect()  # about SAMPLE_ROWS rows at most
    split = Split(_stack([r[0] for r in sample]) if sample else np.zeros((0, m)), min(MAX_CELLS, math.ceil(n / cell_rows)))

    def dealt(batch):
        yield {c: batch.column(c) for c in ("vec_id", "x", "p")} | {"cell": split.cell(_stack(batch.column("p").to_pylist()))}

    base = arrow_map(rows.select("vec_id", "x", "p"), dealt, "vec_id long, x binary, p binary, cell int")

    def boxes(batch):
        p, c = _stack(batch.column("p").to_pylist()), np.asarray(batch.column("cell"))
        for cell in np.unique(c):
            own = p[c == cell]
            yield {"cell": [int(cell)], "n": [len(own)], "low": [own.min(axis=0)], "high": [own.max(axis=0)]}

    parts = arrow_map(base, boxes, "cell int, n long, low array<double>, high array<double>")
    least, most = [F.min(F.col("low")[i]) for i in range(m)], [F.max(F.col("high")[i]) for i in range(m)]
    found = parts.groupBy("cell").agg(F.sum("n").alias("n"), F.array(*least).alias("low"), F.array(*most).alias("high")).orderBy("cell").collect()  # a row a cell
    cell_id = np.array([r["cell"] for r in found])
    low, high = np.array([r["low"] for r in found]), np.array([r["high"] for r in found])
    salts = np.array([math.ceil(r["n"] / (2 * cell_rows)) for r in found])
    salted = spark.createDataFrame([(int(c), int(z)) for c, z in zip(cell_id, salts) if z > 1], "cell int, salts int")  # some of the cells
    base = base.join(F.broadcast(salted), "cell", "left").withColumn("salt", F.pmod(F.xxhash64("vec_id", "x"), F.coalesce("salts", F.lit(1)).cast("long")).cast("int")).drop("salts")
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("x", "pq")).alias("q")).select(F.col("vec_id").alias("query_id"), F.col("q.x").alias("qx"), F.col("q.pq").alias("qp"))
    stop = chi_square_quantile(confidence, m)

    def home(batch):
        q = _stack(batch.column("qp").to_pylist())
        at = [int(np.argmin(box_distance(x, low, high))) for x in q]
        ids = np.asarray(batch.column("query_id"))
        yield {c: batch.column(c) for c in ("query_id", "qx", "qp")} | {"cell": cell_id[at], "salt": [int(i // every % salts[a]) for i, a in zip(ids, at)], "bound": np.full(len(at), np.inf)}

    asked = "query_id long, qx binary, qp binary, cell int, salt int, bound double"

    def searched(shards, pdf):
        import pandas as pd

        if not len(shards) or not len(pdf):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        shard = Shard(shards["vec_id"].to_numpy(), _stack(list(shards["x"])), _stack(list(shards["p"])))
        ids, q, p, bound = pdf["query_id"].to_numpy(), _stack(list(pdf["qx"])), _stack(list(pdf["qp"])), pdf["bound"].to_numpy()
        out = []
        for at in range(0, len(ids), 512):
            part = slice(at, at + 512)
            out += [(np.full(len(s), i), n, s) for i, (s, n) in zip(ids[part], shard.search(ids[part], q[part], p[part], span, k, bound[part], confidence))]
        a, b, c = (np.concatenate(z) for z in zip(*out))
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": c})

    def meet(questions, name):
        # queries of one shard go in blocks, so a group holds a shard and at most a block of them on average
        block = F.pmod(F.xxhash64("query_id"), F.lit(max(1, math.ceil(n / every / QUERY_BLOCK)))).cast("int")
        questions = written(questions.withColumn("block", block), f"{path}/{name}")
        used = written(questions.select("cell", "salt", "block").distinct(), f"{path}/{name}_shards")
        shards = base.join(used, ["cell", "salt"])
        return shards.groupBy("cell", "salt", "block").cogroup(questions.groupBy("cell", "salt", "block")).applyInPandas(searched, OUT)

    first = written(meet(arrow_map(queries, home, asked), "asked"), f"{path}/first")
    kth = first.groupBy("query_id").agg(F.count("*").alias("c"), F.min("score").alias("s"))
    bounded = queries.join(kth, "query_id", "left").select("query_id", "qx", "qp", F.when(F.col("c") >= k, F.col("s")).alias("s"))

    def spread(batch):
        ids, x, p = np.asarray(batch.column("query_id")), batch.column("qx").to_pylist(), batch.column("qp").to_pylist()
        for i, (qx, qp, s) in enumerate(zip(x, p, batch.column("s").to_pylist())):
            q = np.frombuffer(qx, "<f8")
            bound = np.inf if s is None else float((q * q).sum()) + span - 2 * s + 1e-9
            go = np.flatnonzero(box_distance(np.frombuffer(qp, "<f8"), low, high) < bound * stop)
            cells = np.repeat(cell_id[go], salts[go])
            salt = np.concatenate([np.arange(z) for z in salts[go]]) if len(go) else np.zeros(0, np.int64)
            yield {"query_id": np.full(len(cells), ids[i]), "qx": [qx] * len(cells), "qp": [qp] * len(cells), "cell": cells, "salt": salt, "bound": np.full(len(cells), bound)}

    second = meet(arrow_map(bounded, spread, asked), "spread")
    # a shard of the first round is searched again, so the second alone has all
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return second.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
