"""What the operators of this subpackage share: tables, scratch tables, Arrow maps and byte hashes."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used by a local master without a folder of its own, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/assay"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, removed when the driver ends. Only a local master may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_CHECKPOINTS
    path = f"{base.rstrip('/')}/assay-{uuid.uuid4().hex}"
    sc = spark.sparkContext

    def remove() -> None:
        try:
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone already; the folder is scratch
            pass

    atexit.register(remove)
    return path


def written(df: DataFrame, path: str) -> DataFrame:
    """df written to a shared table and reread: lineage ends there, and lost executors take nothing with them."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes of an Arrow batch, at most: texts are long, and a batch is held in the JVM and in Python at once. A longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = "1000", "16m"


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def portions(texts: list[str | None], rows: int = 256, chars: int = 1_000_000) -> Iterator[tuple[int, list[str | None]]]:
    """Successive stretches of texts with the place of the first: of so many rows and characters at most, or of one longer text."""
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > lo and (i - lo >= rows or size + n > chars):
            yield lo, texts[lo:i]
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, texts[lo:]


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """df.mapInArrow of a function from a batch to dicts of columns, cast to schema (DDL)."""
    out = _arrow_schema(schema)
    bounded_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                for cols in fn(batch):
                    yield to_batch(cols, out)

    return df.mapInArrow(run, schema)


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def to_batch(cols: dict, schema: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for field in schema:
        v = cols[field.name]
        if isinstance(v, pa.ChunkedArray):
            v = v.combine_chunks()
        if not isinstance(v, pa.Array):
            v = pa.array(v, type=field.type)
        arrays.append(v if v.type == field.type else v.cast(field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def id_mod(col: str, n: int):
    """crc32 of an id as text, modulo n; null ids give null."""
    return F.crc32(F.col(col).cast("string")) % n


# ---------------------------------------------------------------- hashes of bytes and words
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


#: A random-looking 64-bit value for each byte.
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        m = 1 << (n - 1).bit_length()
        for k, b in enumerate((_BASE, _INV)):
            steps = np.full(m, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def prefix_hashes(b: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash of the bytes: span_hash() reads any span off them."""
    p = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[b] * powers(len(b))[0], out=p[1:])
    return p


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from start to end, wherever they stand; their length counts."""
    inv = powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64))


#: Word characters in UTF-8: ASCII letters and digits, and every byte of a character beyond ASCII.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, one after the other, and where each text's begin.

    A word is a run of ASCII letters, digits and characters beyond ASCII. Null and empty texts have no words."""
    parts = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    b = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)
    ends = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)
    flag = WORD_BYTE[b].view(np.int8)
    step = np.diff(flag)
    start, stop = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
    hashes = span_hash(prefix_hashes(b), start, stop)
    return hashes, np.concatenate([[0], np.searchsorted(start, ends, "right")])


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words; of all words together, if there are fewer than k."""
    n = len(words)
    if n == 0:
        return words
    if n < k:
        k = n
    h = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        h = (h ^ words[j : n - k + 1 + j]) * _M1 + np.uint64(j + k)
        h ^= h >> np.uint64(29)
    return mix(h)


#: Rows of 8-byte ids that may be broadcast: 16 MB of them.
BROADCAST_IDS = 1_000_000


def hinted(ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """ids marked for broadcast if they are counted to be at most limit rows; beyond, Spark's own choice of join holds."""
    return F.broadcast(ids) if ids.limit(limit + 1).count() <= limit else ids
