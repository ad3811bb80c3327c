"""Batches of documents as single rows, and questions from batches to an index that is spread by key.

Many operators need to know of each of millions of keys in a document (suffixes, chunks, words) whether and where the
corpus has it again. A row for each key would cost far more than the key. Here a batch of documents is one row; it asks
each bucket of the key space once, with the distinct keys it has there, and gets one reply. A key that a third of all
documents hold is asked for once by each batch, so no bucket grows with the number of its copies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.llm import base

BATCH_BYTES = 4 << 20
NO_ID = -(1 << 63)


@dataclass
class Batch:
    """Documents of a batch. A null doc_id is NO_ID; a null text is empty."""

    number: int
    doc_ids: np.ndarray
    texts: list[bytes]


def pack(docs: DataFrame, size: int = BATCH_BYTES, keep: bool = True) -> DataFrame:
    """Rows (batch, n_bytes, doc_ids, ends, body): whole documents of about `size` bytes together, compressed.

    They are dealt out by batch, and Spark knows it: joins by batch move no body again. They are checkpointed if keep,
    for use in several queries; without, one query that uses them twice computes and moves them once, which saves the
    copy but takes documents that come in the same order each time, as from files (ask checks the replies' lengths).
    """
    shape = "n_bytes long, doc_ids binary, ends binary, body binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=6)

        def row(ids: list[int], texts: list[bytes]) -> pa.RecordBatch:
            ends = np.cumsum([len(x) for x in texts])
            values = [[int(ends[-1])], [np.array(ids, np.int64).tobytes()], [ends.astype(np.int64).tobytes()], [small.compress(b"".join(texts))]]
            return pa.RecordBatch.from_arrays([pa.array(values[0], pa.int64()), *(pa.array(v, pa.binary()) for v in values[1:])], ["n_bytes", "doc_ids", "ends", "body"])

        ids: list[int] = []
        texts: list[bytes] = []
        total = 0
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), base.texts_of(b.column(1)), strict=True):
                ids.append(NO_ID if i is None else i)
                texts.append(x)
                total += len(x) + 1
                if total >= size:
                    yield row(ids, texts)
                    ids, texts, total = [], [], 0
        if ids:
            yield row(ids, texts)

    rows = base.id_and_text(docs)
    n = base.tasks(docs.sparkSession, (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 1e6)
    dealt = rows.mapInArrow(run, shape).withColumn("batch", F.monotonically_increasing_id()).repartition(n, "batch")
    return base.cut(dealt) if keep else dealt


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """The rows one by one: a row can be megabytes, and Arrow brings many at a time."""
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def opened(row: dict) -> Batch:
    ends = np.frombuffer(row["ends"], np.int64).tolist()
    body = zstandard.ZstdDecompressor().decompress(row["body"])
    return Batch(row["batch"], np.frombuffer(row["doc_ids"], np.int64), [body[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)])


def megabytes(rows: DataFrame) -> float:
    """Text in all batches, or in all documents that are not packed yet."""
    size = F.sum("n_bytes") if "n_bytes" in rows.columns and "body" in rows.columns else F.sum(F.octet_length(F.col("text").cast("string")))
    return (rows.agg(size).first()[0] or 0) / 1e6


def ask(packed: DataFrame, keys: Callable[[Batch, dict], tuple[np.ndarray | list[bytes], np.ndarray]], answer: Callable[[list[tuple[int, np.ndarray]]], list[bytes]], buckets: int, extra: tuple[str, ...] = (), bodies: bool = True, planes: int = 0) -> DataFrame:
    """`packed` with a column `replies`, of (bucket, reply) pairs.

    keys: of a batch, what it asks (an array of fixed-size records, or words, which go with line feeds between them) and
    a hash of each record's key; the records with equal hash modulo the number of buckets go to one bucket, in their order. answer: for what all batches ask of a
    bucket, (batch, records) in any order, the reply to each. extra: columns that `keys` needs besides the batch; bodies: whether it needs the batch.
    planes: size of records that travel with the bytes of equal place together, compressed; sorted ones lose a part.
    """

    def asked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=3)
        for row in rows_of(batches):
            records, h = keys(opened(row) if bodies else None, row)
            bucket = (h >> base.U(20)) % base.U(buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(cuts))
            if isinstance(records, list):
                parts = [small.compress(b"\n".join([records[i] for i in order[cuts[k] : cuts[k + 1]]])) for k in full]
            else:
                raw, item = records[order].tobytes(), records.dtype.itemsize
                parts = [raw[cuts[k] * item : cuts[k + 1] * item] for k in full]
                if planes:
                    parts = [small.compress(np.frombuffer(x, np.uint8).reshape(-1, planes).T.tobytes()) for x in parts]
            if len(full):
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([row["batch"]] * len(full), pa.int64()), pa.array(parts, pa.binary())], ["bucket", "batch", "records"])

    def replied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = zstandard.ZstdDecompressor()
        by_bucket: dict[int, list[tuple[int, bytes]]] = {}
        for b in batches:
            for k, n, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                by_bucket.setdefault(k, []).append((n, x))
        for k in list(by_bucket):
            got = by_bucket.pop(k)
            if planes:
                got = [(n, np.frombuffer(wide.decompress(x), np.uint8).reshape(planes, -1).T.tobytes()) for n, x in got]
            replies = answer(got)
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in got], pa.int64()), pa.array([k] * len(got), pa.int32()), pa.array(replies, pa.binary())], ["batch", "bucket", "reply"])

    questions = packed.select("batch", *(("n_bytes", "doc_ids", "ends", "body") if bodies else ()), *extra).mapInArrow(asked, "bucket int, batch long, records binary")
    replies = questions.repartition(buckets, "bucket").mapInArrow(replied, "batch long, bucket int, reply binary")
    gathered = replies.groupBy("batch").agg(F.collect_list(F.struct("bucket", "reply")).alias("replies"))
    return packed.join(gathered, "batch", "left")


def slots(h: np.ndarray, buckets: int, replies: list[dict] | None) -> Iterator[tuple[np.ndarray, bytes]]:
    """For each reply to a batch, the indices of the records it answers (see ask)."""
    bucket = (h >> base.U(20)) % base.U(buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
    for r in replies or ():
        yield order[cuts[r["bucket"]] : cuts[r["bucket"] + 1]], r["reply"]
