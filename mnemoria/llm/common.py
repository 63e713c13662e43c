"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Words of a text as long; null counts as an empty text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def shared(spark: SparkSession) -> None:
    """Make checkpoint() usable: the cluster names its shared folder in spark.checkpoint.dir; only where
    that is unset a temporary folder serves on one machine, and a cluster is an error."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-"))


#: Bytes of a batch between Spark and Python: the largest of a few batches is what each task holds on either side.
ARROW_BYTES = 2 << 20


def small_batches(df: DataFrame) -> None:
    """From now on texts go to Python in batches of ARROW_BYTES, or less where the session says so. By default a batch has up
    to 10,000 texts or 64 MB, of which several stand at a time in Spark and in each worker."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    text = (conf.get(name, None) or "64m").lower().rstrip("b")
    size = int(text.rstrip("kmg")) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(text[-1:], 1)
    if size <= 0 or size > ARROW_BYTES:
        conf.set(name, str(ARROW_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and drop its lineage. Spark removes the files when df is no longer used where
    spark.cleaner.referenceTracking.cleanCheckpoints is set; elsewhere they stay until the folder is cleared."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder. Unlike a checkpoint it has its own size as statistics: sizes of joins are
    products of their inputs', so tables that a loop joins again and again need it."""
    spark = df.sparkSession
    shared(spark)
    path = f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    got = spark.read.schema(df.schema).parquet(path)
    got.stored_at = path
    return got


def forget(df: DataFrame | None) -> None:
    """Remove a table of stored(), when nothing that is still to be computed reads it."""
    path = getattr(df, "stored_at", None)
    if path is not None:
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column end to end, and the n+1 offsets of its values (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (splitmix64's constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def give_back() -> None:
    """Return freed memory to the machine: workers wait for later tasks beside the executor, which needs it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def text_batches(batches, column: str, most: int = 1 << 18):
    """Split Arrow batches so that each holds about `most` bytes of text (one longer text stands alone). The arrays of an
    operator take some hundred bytes for each, and a worker keeps what its largest batch took."""
    for b in batches:
        give_back()
        if not b.num_rows:
            continue
        _, off = flat(b.column(b.schema.get_field_index(column)))
        start = 0
        while start < b.num_rows:
            end = max(start + 1, int(np.searchsorted(off, off[start] + most, "right")) - 1)
            yield b.slice(start, end - start)
            start = end
    give_back()


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Powers that a worker keeps; those of longer texts are made for them alone.
KEPT_POWERS = 1 << 19


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n; kept for later batches."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        m = 1 << max(16, int(n - 1).bit_length())
        up, down = np.full(m, base, np.uint64), np.full(m, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = (np.cumprod(up, out=up), np.cumprod(down, out=down))
        if m <= KEPT_POWERS:
            _POWERS[base] = have
    return have


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """64-bit hashes of buf[start:end] for all spans: differences of one polynomial prefix sum modulo 2^64 (base odd)."""
    up, down = _powers(base, len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    terms = sums[1:]  # summed in place, as a long text's arrays are what a worker needs most
    terms += buf
    terms += np.uint64(1)
    terms *= up[: len(buf)]
    np.cumsum(terms, out=terms)
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


#: Odd bases of the polynomial hashes.
BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts c: the owner of each of sum(c) items, and its place within the owner."""
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return owner, np.arange(len(owner)) - first[owner]


def planes(x: np.ndarray, width: int) -> bytes:
    """The lowest bytes of 64-bit words, place by place, so that equal high bytes compress."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(b: bytes, width: int) -> np.ndarray:
    rows = np.frombuffer(b, np.uint8).reshape(width, -1)
    out = np.zeros((rows.shape[1], 8), np.uint8)
    out[:, :width] = rows.T
    return out.reshape(-1).view("<i8")
