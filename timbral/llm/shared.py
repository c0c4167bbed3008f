"""Helpers that the training-data operators share.

Spark deals out the work; inside a task these helpers turn an Arrow text column
into numpy arrays (bytes, words, shingle hashes) without a Python loop over
words.  Hashes are 64-bit; equal inputs give equal hashes in every process.
"""

from __future__ import annotations

import atexit
import functools
import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: One 64-bit value for each byte; LOWER maps A-Z to the values of a-z.
BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))
LOWER_VALUES = BYTE_VALUES.copy()
LOWER_VALUES[65:91] = BYTE_VALUES[97:123]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


@functools.lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        x = np.full(size, base, U64)
        x[0] = 1
        return np.cumprod(x)

    return run(_BASE), run(_BASE_INVERSE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n and those of the inverse, modulo 2**64 (sizes are rounded up so that few are ever made)."""
    return _powers(max(1 << 21, 1 << (n + 1).bit_length()))


def prefix_hash(data: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """Sums of value * base**position; span_hash reads the hash of any span from them."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(values[data] * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other, and n + 1 offsets. A null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.cast(pa.large_binary()).combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.large_binary())
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, values = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(table: pa.RecordBatch | pa.Table, column: str, budget: int) -> Iterator[pa.RecordBatch | pa.Table]:
    """Parts of whole rows with about budget bytes of text each (one row at least)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(table.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
    part = np.cumsum(sizes) // budget
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(sizes)] if len(sizes) else [0]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield table.slice(a, b - a)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document number of each maximal run of bytes other than white space; runs end with their document."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def shingle_hashes(word: np.ndarray, doc: np.ndarray, width: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each run of width words. short: a document of fewer words gives all its words as one shingle."""
    h = mix(word + U64(width))
    n = len(word) - width + 1
    out, own = np.zeros(0, U64), np.zeros(0, np.int64)
    if n > 0:
        out = h[:n].copy()
        for j in range(1, width):
            out = mix(out * U64(_BASE) + h[j : j + n])
        same = doc[:n] == doc[width - 1 :]
        out, own = out[same], doc[:n][same]
    if short and len(word):
        ids, first, count = np.unique(doc, return_index=True, return_counts=True)
        few = count < width
        extra = []
        for a, c in zip(first[few], count[few], strict=True):
            x = h[a : a + 1].copy()
            for j in range(1, c):
                x = mix(x * U64(_BASE) + h[a + j : a + j + 1])
            extra.append(x ^ U64(c))
        if extra:
            out, own = np.concatenate([out, *extra]), np.concatenate([own, ids[few]])
            order = np.argsort(own, kind="stable")
            out, own = out[order], own[order]
    return out, own


# -- packed arrays: what tasks hand to each other through Spark's shuffle


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length as one compressed value; byte planes are kept apart, which is where integers compress."""
    n = len(arrays[0])
    out = [np.int64(n).tobytes()]
    for a in arrays:
        a = np.ascontiguousarray(a)
        out.append(a.view(np.uint8).reshape(n, -1).T.tobytes() if a.ndim == 1 else a.tobytes())
    return zstandard.compress(b"".join(out), 1)


def unpack(blob: bytes, *dtypes: str) -> list[np.ndarray]:
    """The reverse of pack(); a dtype such as 84u1 is a row of 84 bytes."""
    raw = zstandard.decompress(blob)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for kind in dtypes:
        d = np.dtype(kind)
        part = np.frombuffer(raw, np.uint8, n * d.itemsize, at)
        at += n * d.itemsize
        if d.shape:
            out.append(part.reshape(n, -1))
        else:
            out.append(np.ascontiguousarray(part.reshape(d.itemsize, n).T).view(d).reshape(n))
    return out


# -- Spark


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a new one on a single machine, and an error on a cluster."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        own = spark.conf.get("spark.checkpoint.dir", None)
        if not own and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(own or tempfile.mkdtemp(prefix="timbral-"))
    return context._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, from which any executor can read it again."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that shared_folder() holds."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is written there goes when the program ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def clean() -> None:
        if spark.sparkContext._jsc is not None:
            remove(spark, path)

    atexit.register(clean)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df as a compressed table in the shared folder; for what is large."""
    path = new_folder(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_size(docs: DataFrame, column: str = "text") -> int:
    """Bytes of text in all rows: one map-side sum."""
    return int(docs.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0)


def spread(total: int, each: int, least: int) -> int:
    """How many groups of about each bytes hold total bytes."""
    return max(least, math.ceil(total / each), 1)
