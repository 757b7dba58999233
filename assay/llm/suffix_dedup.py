"""Suffix-array dedup: depth-limited radix sort.

Suffixes are ordered by their first LENGTH bytes only, most significant digit first; a digit is a stretch of CONTEXT bytes, read as its hash. After each pass
a suffix that is alone in its group is dropped; what still shares its group after the last digit is exactly the set of suffixes whose first LENGTH
bytes start more than once. The bytes that these windows cover are removed.

Not every suffix is dealt out by itself. Each window has a minimizer, the position in it whose next CONTEXT bytes hash least (leftmost of equals);
equal windows have it at the same offset. Neighbouring windows with one minimizer form a record, about 80 of them. The first pass takes records, by
the digit at the minimizer: a record alone there holds no repeated window. Records whose whole stretches are equal repeat all their windows and go on as
one. The suffixes of what is left then are ordered digit by digit, from the group of their record and their offset to the minimizer on.

Counts are partial sums before a shuffle. Rows of keys that more than HOT_KEY rows share meet them by broadcast, counted first, so that such rows
stay where they are; the others meet by a shuffle. Groups of up to HOT_GROUP records are ordered in the task that has them, larger ones by a shuffle for
each digit. Rows equal in id and text are read once, however many they are.

Defined results: null text is empty; texts shorter than LENGTH bytes keep all; null ids stay null; rows equal in id and text are repetitions of each
other, each with its own row; an empty table gives no rows; long texts are read in slices, whole; extra columns are not read.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _arrow_schema, arrow_map, hinted, mix, prefix_hashes, scratch_dir, span_hash, table, to_batch, written

LENGTH = 200
CONTEXT = 40
SLICE = 1 << 19
HOT_GROUP = 5_000
HOT_KEY = 2_000
KEYS = ["key", "key2"]  # 128 bits of a row's id and text
_LOW = np.uint64((1 << 20) - 1)


def sliding_argmin(keys: np.ndarray, w: int) -> np.ndarray:
    """Of each w consecutive keys the least one: least of block suffix and block prefix."""
    n = len(keys)
    pad = -n % w
    blocks = np.concatenate([keys, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    prefix = np.minimum.accumulate(blocks, axis=1).ravel()
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[: n - w + 1], prefix[w - 1 : n])


def records(data: bytes, length: int = LENGTH, context: int = CONTEXT):
    """Arrays (first window, last window, minimizer, context hash, stretch hash) of the records of a text's bytes."""
    out = [[], [], [], [], []]
    n = len(data) - length + 1  # windows
    for at in range(0, max(n, 0), SLICE):
        b = np.frombuffer(data, np.uint8, count=min(len(data) - at, SLICE + length - 1), offset=at)
        prefix = prefix_hashes(b)
        start = np.arange(len(b) - context + 1)
        h = span_hash(prefix, start, start + context)
        least = sliding_argmin((h & ~_LOW) | start.astype(np.uint64), length - context + 1) & _LOW
        lo = np.concatenate([[0], np.flatnonzero(np.diff(least)) + 1])
        hi = np.concatenate([lo[1:] - 1, [len(least) - 1]])
        a = least[lo].astype(np.int64)
        r = mix(span_hash(prefix, lo, hi + length) + (a - lo).astype(np.uint64))
        for x, v in zip(out, (lo + at, hi + at, a + at, h[a].view(np.int64), r.view(np.int64))):
            x.append(v)
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]


RECORD = "key long, key2 long, lo int, hi int, a int, c long, r long"


def all_records(docs: DataFrame, length: int, context: int) -> DataFrame:
    """The records of every text. docs: key, key2, text."""

    def run(batch):
        for lo in range(0, batch.num_rows, 256):
            part, parts = batch.slice(lo, 256), []
            for k, k2, t in zip(*(part.column(x).to_pylist() for x in (*KEYS, "text"))):
                if t and len(t) * 4 >= length:
                    r = records(t.encode("utf-8", "replace"), length, context)
                    if len(r[0]):
                        parts.append([np.full(len(r[0]), k), np.full(len(r[0]), k2), *r])
            if parts:
                yield dict(zip((*KEYS, "lo", "hi", "a", "c", "r"), map(np.concatenate, zip(*parts))))

    return arrow_map(docs, run, RECORD)


def suffixes(c, lo, hi, a, stretch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of records: the record's number, the start in its text, the group before the first digit, the place among the joined stretches, and hashes of those."""
    sizes = np.array([len(s) for s in stretch])
    prefix = prefix_hashes(np.frombuffer(b"".join(stretch), np.uint8))
    n = hi - lo + 1
    which = np.repeat(np.arange(len(lo)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = lo[which] + step
    return which, start, mix(c.view(np.uint64)[which] + (a[which] - start).astype(np.uint64)), (np.cumsum(sizes) - sizes)[which] + step, prefix


def radix_passes(group: np.ndarray, at: np.ndarray, prefix: np.ndarray, length: int, digit: int) -> np.ndarray:
    """The suffixes that share their first `length` bytes with another of their group, by passes over one digit after the other."""
    alive, group = np.arange(len(at)), group.copy()
    for depth in range(0, length, digit):
        s = at[alive] + depth
        value = mix(group + mix(span_hash(prefix, s, s + min(digit, length - depth))))
        order = np.argsort(value)
        first = np.concatenate([[True], np.diff(value[order]) != 0])
        run = np.cumsum(first) - 1
        kept = np.bincount(run)[run] > 1
        alive, group = alive[order[kept]], value[order[kept]]
        if not len(alive):
            break
    return np.sort(alive)


def _runs(key, key2, which, start, length):
    """Maximal runs of consecutive windows of one record, as byte intervals."""
    begin = np.concatenate([[True], (np.diff(which) != 0) | (np.diff(start) != 1)])
    first = np.flatnonzero(begin)
    last = np.concatenate([first[1:] - 1, [len(which) - 1]])
    return {"key": key[which[first]], "key2": key2[which[first]], "s": start[first], "e": start[last] + length}


CONTEXTS = "c long, n long, key long, key2 long, lo int, hi int, a int, z long, stretch binary"
INTERVAL = "key long, key2 long, s int, e int"


def _in_groups(contexts: DataFrame, length: int, digit: int) -> DataFrame:
    """Repeated windows of records that no other record equals; context groups lie whole in the tasks."""
    schema = _arrow_schema(INTERVAL)
    dealt = contexts.repartition("c").sortWithinPartitions("c")

    def found(cols) -> pa.RecordBatch | None:
        c, n, key, key2, lo, hi, a = (np.asarray(cols[x], np.int64) for x in ("c", "n", *KEYS, "lo", "hi", "a"))
        which, start, group, at, prefix = suffixes(c, lo, hi, a, cols["stretch"])
        hit = radix_passes(group, at, prefix, length, digit)
        hit = hit[n[which[hit]] == 1]
        return to_batch(_runs(key, key2, which[hit], start[hit], length), schema) if len(hit) else None

    def run(batches):
        held: dict[str, list] = {}
        for batch in batches:
            for name in batch.schema.names:
                held.setdefault(name, []).extend(batch.column(name).to_pylist())
            c = held["c"]
            cut = len(c)
            while cut and c[cut - 1] == c[-1]:  # the last group may go on in the next batch
                cut -= 1
            if cut >= 2048:
                if (out := found({k: v[:cut] for k, v in held.items()})) is not None:
                    yield out
                held = {k: v[cut:] for k, v in held.items()}
        if held and held["c"] and (out := found(held)) is not None:
            yield out

    return dealt.mapInArrow(run, INTERVAL)


def _by_digits(contexts: DataFrame, length: int, digit: int, path: str) -> DataFrame:
    """The same for groups of any size: suffixes are dealt out one by one, and each pass counts and drops by one digit."""
    depths = range(0, length, digit)

    def dealt(batch):
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            c, n, key, key2, lo_, hi, a = (np.asarray(part.column(x)).astype(np.int64) for x in ("c", "n", *KEYS, "lo", "hi", "a"))
            which, start, group, at, prefix = suffixes(c, lo_, hi, a, part.column("stretch").to_pylist())
            digits = {f"d{i}": span_hash(prefix, at + d, at + min(d + digit, length)).view(np.int64) for i, d in enumerate(depths)}
            yield {"g": group.view(np.int64), "own": n[which] == 1, "key": key[which], "key2": key2[which], "s": start} | digits

    names = [f"d{i}" for i in range(len(depths))]
    rows = written(arrow_map(contexts, dealt, "g long, own boolean, key long, key2 long, s int, " + ", ".join(f"{d} long" for d in names)), f"{path}/suffixes")
    for d in names:
        groups = written(rows.groupBy("g", d).agg(F.count("*").alias("z")).where("z > 1"), f"{path}/groups_{d}")
        rows = sharing(rows, groups, ["g", d]).withColumn("g", F.xxhash64("g", d)).drop(d)
        rows = written(rows, f"{path}/after_{d}")
    return rows.where("own").select(*KEYS, "s", (F.col("s") + length).alias("e"))


def sharing(rows: DataFrame, counted: DataFrame, cols: list[str]) -> DataFrame:
    """Rows whose key is among counted (cols, z), a written table: keys of many rows by broadcast, if they are few enough, the others by a shuffle."""
    rest = counted.where(F.col("z") <= HOT_KEY).select(cols)
    if not (hot := counted.where(F.col("z") > HOT_KEY).select(cols)).limit(1).count():
        return rows.join(rest, cols, "left_semi")
    hot = hinted(hot)
    return rows.join(hot, cols, "left_semi").unionByName(rows.join(hot, cols, "left_anti").join(rest, cols, "left_semi"))


def repeated_intervals(docs: DataFrame, path: str, length: int = LENGTH, context: int = CONTEXT, hot_group: int = HOT_GROUP) -> tuple[DataFrame, DataFrame]:
    """(key, key2, s, e): byte intervals, overlapping, whose union is what repeated windows cover, of texts that are in one row; and
    (key, key2) of the texts with windows that are in several rows, all of which are repeated. docs: key, key2, text."""
    first = written(all_records(docs, length, context), f"{path}/records")
    # every text with a window has a record that begins at 0
    twice = written(first.where("lo = 0").groupBy(KEYS).agg(F.count("*").alias("z")).where("z > 1").select(KEYS), f"{path}/twice")
    if twice.limit(1).count():
        known = hinted(twice)
        once = first.join(known, KEYS, "left_semi").dropDuplicates([*KEYS, "lo"])
        first = written(first.join(known, KEYS, "left_anti").unionByName(once), f"{path}/distinct")
    # counts are written before they are joined: Spark splits a large key only where both sides come from a shuffle of their own
    shared = written(first.groupBy("c").agg(F.count("*").alias("z")).where("z > 1"), f"{path}/shared")
    second = written(sharing(first, shared, ["c"]), f"{path}/second")
    groups = second.groupBy("c", "r").agg(F.count("*").alias("n"), F.min(F.struct(*KEYS, "lo", "hi", "a")).alias("m"))
    groups = written(groups.select("c", "r", "n", "m.*"), f"{path}/groups")
    whole = sharing(second, groups.where("n > 1").select("c", "r", F.col("n").alias("z")), ["c", "r"]).select(*KEYS, F.col("lo").alias("s"), (F.col("hi") + length).alias("e"))
    several = written(groups.groupBy("c").agg(F.count("*").alias("z")).where("z > 1"), f"{path}/several")
    third = written(groups.join(several, "c").select("c", "n", *KEYS, "lo", "hi", "a", "z"), f"{path}/third")
    asked = third.groupBy(KEYS).agg(F.collect_list(F.struct("c", "n", "lo", "hi", "a", "z")).alias("asked"))  # no more than the text has records
    texts = docs.join(hinted(written(third.select(KEYS).distinct(), f"{path}/asked")), KEYS, "left_semi")
    if twice.limit(1).count():
        known = hinted(twice)
        texts = texts.join(known, KEYS, "left_anti").unionByName(texts.join(known, KEYS, "left_semi").dropDuplicates(KEYS))

    def cut(batch):
        for at in range(0, batch.num_rows, 256):
            rows = []
            for k, k2, t, asked_ in zip(*(batch.column(x).slice(at, 256).to_pylist() for x in (*KEYS, "text", "asked"))):
                data = t.encode("utf-8", "replace")
                rows += [(x["c"], x["n"], k, k2, x["lo"], x["hi"], x["a"], x["z"], data[x["lo"] : x["hi"] + length]) for x in asked_]
            if rows:
                yield dict(zip(("c", "n", *KEYS, "lo", "hi", "a", "z", "stretch"), map(list, zip(*rows))))

    contexts = arrow_map(texts.join(asked, KEYS).select(*KEYS, "text", "asked"), cut, CONTEXTS)
    if third.where(F.col("z") > hot_group).limit(1).count():
        contexts = written(contexts, f"{path}/contexts")
        few = _in_groups(contexts.where(F.col("z") <= hot_group), length, context).union(_by_digits(contexts.where(F.col("z") > hot_group), length, context, path))
    else:
        few = _in_groups(contexts, length, context)
    return written(whole.union(few), f"{path}/intervals"), twice


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _kept(batch, spans):
    out = []
    for k, t, iv in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), spans):
        data = (t or "").encode("utf-8", "replace")
        runs = []
        for s, e in sorted(iv):
            if runs and s <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], e)
            else:
                runs.append([s, e])
        at, h = 0, sha256()
        for s, e in runs:
            h.update(data[at:s])
            at = e
        h.update(data[at:])
        out.append((k, len(data), sum(e - s for s, e in runs), len(runs), h.hexdigest()))
    return dict(zip(("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), map(list, zip(*out))))


def suffix_dedup(docs: DataFrame, length: int = LENGTH, context: int = CONTEXT, hot_group: int = HOT_GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans and kept_sha256."""
    path = scratch_dir(docs.sparkSession)
    keys = F.xxhash64(id_col, text_col).alias("key"), F.xxhash64(F.lit(length), text_col, id_col).alias("key2")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *keys)
    found, twice = repeated_intervals(docs.select(*KEYS, "text"), path, length, context, hot_group)
    found = found.join(hinted(twice), KEYS, "left_anti")  # of these nothing is left anyway
    touched = hinted(written(found.select(KEYS).distinct(), f"{path}/touched"))

    def uncut(batch):
        gone = batch.column("gone").to_pylist()
        yield _kept(batch, [[(0, len((t or "").encode("utf-8", "replace")))] if g else () for g, t in zip(gone, batch.column("text").to_pylist())])

    rest = docs.join(touched, KEYS, "left_anti").join(hinted(twice).withColumn("gone", F.lit(True)), KEYS, "left").select("doc_id", "text", F.coalesce("gone", F.lit(False)).alias("gone"))
    spans = found.groupBy(KEYS).agg(F.collect_list(F.struct("s", "e")).alias("spans"))  # no more than the text has windows
    hit = docs.join(touched, KEYS, "left_semi").join(spans, KEYS).select("doc_id", "text", "spans")

    def cut(batch):
        yield _kept(batch, [[(x["s"], x["e"]) for x in row] for row in batch.column("spans").to_pylist()])

    return arrow_map(rest, uncut, OUT).union(arrow_map(hit, cut, OUT))


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))
