"""Helpers of the text operators: checkpoints, word hashes over Arrow batches, sums of count arrays, packed blocks of text.

The NumPy helpers work on one block of whole documents at a time (about a megabyte, or one longer document), inside
tasks whose rows Spark has partitioned.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
BLOCK_BYTES = 1 << 20
#: Odd multipliers of the hashes.
M1, M2, M3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: Separators between words: space and the five ASCII controls from tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LANE = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], dtype=np.uint64)


def checkpoints(spark: SparkSession) -> None:
    """Use the shared folder of spark.checkpoint.dir for checkpoints; a folder of its own only where that is unset."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Checkpointed copy of the frame."""
    checkpoints(df.sparkSession)
    return df.checkpoint()


def tasks(spark: SparkSession, mb: float, each: float = 64.0) -> int:
    """Partitions for an exchange of so many MB: the session's number, or more if a share would pass `each` MB."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(mb / each) + 1)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values."""
    h = h ^ (h >> U(32))
    h *= M2
    h ^= h >> U(29)
    h *= M3
    h ^= h >> U(32)
    return h


def stir(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Hash of a sequence that ends with `more`, from the hash of the rest."""
    h = h * M1 + more
    h ^= h >> U(31)
    h *= M2
    h ^= h >> U(30)
    return h


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def blocks(texts: list[bytes], size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about `size` bytes."""
    start = total = 0
    for i, x in enumerate(texts):
        total += len(x) + 1
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the documents with a line feed after each and 16 zero bytes at the end; where each document starts (n + 1)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=at[1:])
    return np.frombuffer(b"\n".join([*texts, bytes(16)]), np.uint8), at


def hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes; buf has 8 bytes to spare at its end."""
    lanes = np.ndarray(len(buf) - 7, dtype="<u8", buffer=buf.data if buf.flags.c_contiguous else buf.tobytes(), strides=(1,))
    n = end - start
    h = n.astype(np.uint64) * M3
    todo, at, left = None, start, n
    while True:
        value = lanes[at] & _LANE[np.minimum(left, 8)]
        if todo is None:
            h = stir(h, value)
            todo = np.flatnonzero(n > 8)
        else:
            h[todo] = stir(h[todo], value)
            todo = todo[left > 8]
        if not len(todo):
            return mix(h)
        at = at[left > 8] + 8
        left = left[left > 8] - 8


def words(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of the joined documents, and where each document's words start (n + 1)."""
    gap = SPACE[buf[: at[-1]]]
    gap = np.concatenate(([True], gap))
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[::2], edge[1::2]
    return start, end, np.searchsorted(start, at)


def shingles(h: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words in each document and where each document's runs start (n + 1).

    A document with fewer words has one run, all of them; one without words has none.
    """
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    out = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=out[1:])
    src = np.repeat(first[:-1] - out[:-1], count) + np.arange(out[-1])
    padded = np.concatenate((h, np.zeros(size, np.uint64)))
    s = padded[src]
    room = np.repeat(first[1:], count) - src
    for j in range(1, size):
        s = np.where(room > j, stir(s, padded[src + j]), s) if (n[n > 0] < size).any() else stir(s, padded[src + j])
    return mix(s), out


def segment_of(first: np.ndarray) -> np.ndarray:
    """For each element the segment it is in; first: where segments start (n + 1)."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def add_at(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over segments, 0 for empty ones."""
    out = np.zeros((len(first) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(values, first[:-1][full], axis=0)
    return out


def sum_arrays(rows: DataFrame, count: Callable[[Iterable[pa.RecordBatch]], np.ndarray], length: int, slices: int = 16) -> np.ndarray:
    """Sum over all tasks of what `count` makes of a task's rows, an int64 array of `length`.

    The arrays are cut into slices, each slice is added up where it arrives, row by row; the driver gets one array.
    """

    def sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = count(batches)
        if total.any():
            cut_up = np.array_split(total, slices)
            yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([c.tobytes() for c in cut_up], pa.binary())], ["slice", "counts"])

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v = np.frombuffer(x.as_py(), np.int64)
                sums[k] = sums[k] + v if k in sums else v
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([c.tobytes() for c in sums.values()], pa.binary())], ["slice", "counts"])

    shape = "slice int, counts binary"
    sums = rows.mapInArrow(sliced, shape).repartition("slice").mapInArrow(added, shape).collect()
    out = [np.zeros(len(c), np.int64) for c in np.array_split(np.zeros(length), slices)]
    for r in sums:
        out[r["slice"]] = out[r["slice"]] + np.frombuffer(bytes(r["counts"]), np.int64)
    return np.concatenate(out)


def multipliers(n: int, seed: int = 7) -> np.ndarray:
    """Fixed random odd 64-bit numbers."""
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * U(2) + U(1)


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns that the operators read, whatever else the frame has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
