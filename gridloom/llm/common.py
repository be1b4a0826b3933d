"""Helpers shared by the text operators: Arrow buffers, vectorised hashing, lineage cuts."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at a time; a longer text is handled alone.
CHUNK_BYTES = 1 << 20

_M = (1 << 64) - 1


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc32_mod(id_col: str, mod: int) -> Column:
    """crc32 of the id written as text, modulo `mod`; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(mod))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: What a Python worker keeps of the operator that it last worked for.
_HELD: dict[str, dict] = {}


def worker_cache(operator: str) -> dict:
    """What this worker keeps of an operator from task to task. Workers are reused by all stages of a
    session, so what another operator has left goes first, and its memory back to the system."""
    if operator not in _HELD:
        _HELD.clear()
        _POWERS.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # not this C library
            pass
        _HELD[operator] = {}
    return _HELD[operator]


def chunks(lengths: np.ndarray, most: int = CHUNK_BYTES):
    """Row ranges of about `most` bytes each; at least one row each."""
    ends = np.cumsum(lengths)
    lo, n = 0, len(lengths)
    while lo < n:
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield lo, min(hi, n)
        lo = hi


def strings(column: pa.Array) -> list[str]:
    """Texts of an Arrow column, null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def sub_batches(batch: pa.RecordBatch, text: int, most: int = CHUNK_BYTES):
    """Slices of a batch that hold about `most` bytes of its text column each."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    for lo, hi in chunks(size, most):
        yield batch.slice(lo, hi - lo)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the n+1 offsets; null as the empty text. Of a binary column, its bytes."""
    column = column.cast(pa.large_binary()).fill_null(b"") if pa.types.is_binary(column.type) else column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers that spreads every bit (two multiply-shift rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}
#: Powers that a worker keeps; more, for a long text, are made anew.
KEPT_POWERS = 1 << 21


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, or those of its inverse."""
    key = "inv" if inverse else "fwd"
    if len(_POWERS.get(key, ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        base = _BASE_INV if inverse else _BASE
        out = np.ones(size, np.uint64)
        filled, step = 1, base
        while filled < size:
            out[filled : 2 * filled] = out[:filled] * np.uint64(step)
            filled, step = 2 * filled, step * step & _M
        if size > KEPT_POWERS:
            return out[:n]
        _POWERS[key] = out
    return _POWERS[key][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n+1 running sums of table[byte] * base**i modulo 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), equal for equal bytes wherever they stand."""
    if not len(start):
        return np.zeros(0, np.uint64)
    inv = powers(len(prefix), inverse=True)
    return mix64((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the maximal runs of bytes other than 20, 09-0D hex."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < len(data)]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    back = cut[cut > 0] - 1
    last[back] = inside[back]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the session's checkpoint folder. Where neither is
    set, a temporary one of a local session; on a cluster, whose machines would each write to their own, a RuntimeError."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named and not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or os.path.join(tempfile.gettempdir(), "gridloom-checkpoints")


#: Whether the shuffle files of a written table go when it is written, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stashed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder; unlike a checkpoint it is read by column. What was shuffled for it goes."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/stash-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if was is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out.stash = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete stashed tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stash)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Ids that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def bounded(df: DataFrame, rows: int = BROADCAST_IDS) -> DataFrame:
    """`df` (a few bytes a row, cheap to count) with a broadcast hint if it has at most `rows` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node of the edges (u, v).

    Alternates large-star and small-star until the edges no longer change; every step is a shuffle by
    node with partial minima, so no component is gathered anywhere.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    was = state(e)
    while was[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        e = checkpointed(small.where("u != v").distinct())
        now = state(e)
        if now == was:
            break
        was = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
