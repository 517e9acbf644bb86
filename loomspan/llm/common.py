"""Shared pieces of the training-data operators: input, staging in the shared folder, words as 64-bit hashes."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Folders staged by this process, for :func:`release`.
_staged: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (tests, one machine) one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
    return folder


def staged(df: DataFrame, name: str, keep: bool = False, **options) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back. ``keep``: release() leaves it.

    A lost executor costs only the unfinished stage; what is staged is read again from the shared store.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    if not keep:
        _staged.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete what was staged so far. Only for callers whose results have already been written elsewhere."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _staged:
        path = jvm.org.apache.hadoop.fs.Path(_staged.pop())
        path.getFileSystem(conf).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session to ``BATCH_BYTES`` (Spark's own bound is 64 MB, held by executor and worker at once).

    The session keeps the bound, as Spark reads it when a query runs; no result depends on it, and rows a batch stay as set.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(key))) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def slices(batches, rows: int = 1000):
    """The batches in slices of at most ``rows`` rows. Spark bounds a batch by bytes; this bounds what a task makes of it at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def runs_of(batches, *keys: str):
    """The consecutive rows of equal ``keys`` (numbers), one table a run, across batches."""
    held, now = [], None
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1 if batch.num_rows else []
        for a, b in zip([0, *new], [*new, batch.num_rows], strict=True):
            key = tuple(c[a] for c in columns) if b > a else now
            if key != now and held:
                yield pa.Table.from_batches(held)
                held = []
            now = key
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


# --- words -----------------------------------------------------------------------------------------------------------

#: Byte tables: a separator becomes a blank. ALNUM lower-cases A-Z and keeps digits, letters and all bytes from 0x80 on;
#: PLAIN keeps everything but ASCII white space.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
PLAIN = bytes(32 if b == 32 or 9 <= b <= 13 else b for b in range(256))

_B = 0x9E3779B97F4A7C15 | 1
_BINV = pow(_B, -1, 1 << 64)
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> None:
    """Grow the tables of the multiplier's powers, and of its inverse's, to n entries."""
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 2 * len(_pow))
        with np.errstate(over="ignore"):
            step = np.full(size, _B, np.uint64)
            back = np.full(size, _BINV, np.uint64)
            step[0] = back[0] = 1
            _pow, _inv = np.cumprod(step, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def run_hashes(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of each run values[start:start+length]; equal runs have equal hashes wherever they lie."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    _powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _pow[: len(values)], out=total[1:], dtype=np.uint64)
    return mix((total[starts + lengths] - total[starts]) * _inv[starts] + lengths.astype(np.uint64))


def words(data: bytes, how: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, byte starts and byte ends of the words of ``data`` (UTF-8) under one of the byte tables."""
    raw = np.frombuffer(data.translate(how), np.uint8)
    gap = np.concatenate(([True], raw == 32, [True]))
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edge[::2], edge[1::2]
    return run_hashes(raw.astype(np.uint64) + np.uint64(1), starts, ends - starts), starts, ends


def chunks(rows, size: int = 1 << 20):
    """Group (key, bytes) rows into lists of about ``size`` bytes; one longer text is a list of its own."""
    held, n = [], 0
    for row in rows:
        if held and n + len(row[-1]) > size:
            yield held
            held, n = [], 0
        held.append(row)
        n += len(row[-1])
    if held:
        yield held


def chunk_words(texts: list[bytes], how: bytes):
    """Words of several texts at once: hashes, byte starts, byte ends, each text's first word (len(texts)+1 entries)."""
    joined = b" ".join(texts)
    offset = np.cumsum([0] + [len(t) + 1 for t in texts])
    h, s, e = words(joined, how)
    return h, s, e, np.searchsorted(s, offset), joined
