"""Token ids in fixed-width bit-packed files.

A file is a folder of Parquet rows, each a block of whole documents: every id takes the fewest bits that hold the
vocabulary, and offsets say where each document starts in its block and each block in its part. So a document's ids can
be read by itself, and a block is unpacked by a few NumPy operations. Parts are ranges of ascending doc_id.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycast.llm import base, packed

BLOCK_IDS = 1 << 19
_FORMAT = "part int, block int, width int, ids_before long, n_ids long, doc_ids array<long>, doc_ends array<long>, payload binary"
#: Bytes that are no white space and start no white-space character (those start with C2, E1, E2 or E3).
_OPEN = np.zeros(256, bool)
_OPEN[[*range(0x21, 0x7F), *range(0xC3, 0xE0), *range(0xE4, 0xF5)]] = True
#: ASCII letters 1; marks that neither an added token nor a contraction has 2.
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[[ord(c) for c in "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"]] = 2
#: A piece without white space but for one space before it.
_PLAIN = re.compile(rb" ?[\x21-\x7e\xc3-\xdf\x80-\xbf]+")


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids below 2 ** width, each in `width` bits, lowest bit first."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if width % 8 == 0:
        return raw[:, : width // 8].tobytes()
    return np.packbits(np.unpackbits(raw, axis=1, bitorder="little")[:, :width].ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, width: int, start: int, end: int) -> np.ndarray:
    """Ids start to end of a packed block; only the bytes that hold them are touched."""
    low = start * width // 8
    raw = np.frombuffer(payload, np.uint8)[low : -(-end * width // 8)]
    out = np.zeros((end - start, 4), np.uint8)
    if width % 8 == 0:
        out[:, : width // 8] = raw.reshape(-1, width // 8)
    else:
        bits = np.unpackbits(raw, bitorder="little")[start * width - low * 8 :][: (end - start) * width]
        out[:] = np.packbits(np.pad(bits.reshape(-1, width), ((0, 0), (0, 32 - width))), axis=1, bitorder="little")
    return out.view("<u4").ravel()


class Pieces:
    """Encodes texts piece by piece, each distinct piece once as long as the table of pieces holds.

    A text is cut before single spaces that stand between two characters of which neither is white space, and between
    letters and marks. The tokenizer splits there as well, and nothing it does on one side looks at the other. The table
    knows pieces by a 64-bit hash; it is emptied when it is full, which only costs time.
    """

    def __init__(self, tokenizer: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_str(tokenizer), most
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else None
        self.clear()

    def clear(self) -> None:
        self.known, self.low, self.n, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def ids_of(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many each has. Plain pieces go to the tokenizer many at once, with line feeds between them."""
        plain = np.array([_PLAIN.fullmatch(p) is not None for p in pieces]) if self.feed is not None else np.zeros(len(pieces), bool)
        easy, hard = np.flatnonzero(plain), np.flatnonzero(~plain)
        n = np.zeros(len(pieces), np.int64)
        texts = [b"\n".join([pieces[k] for k in easy[i : i + 1000]]).decode() + "\n" for i in range(0, len(easy), 1000)]
        runs = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        run = np.concatenate([np.zeros(0, np.uint32), *runs])
        ends = np.flatnonzero(run == self.feed) if len(easy) else np.zeros(0, np.int64)
        n[easy] = np.diff(ends, prepend=-1) - 1
        others = [x.ids for x in self.tokenizer.encode_batch_fast([pieces[k].decode() for k in hard], add_special_tokens=False)]
        n[hard] = [len(x) for x in others]
        low, out = np.cumsum(n) - n, np.zeros(n.sum(), np.uint32)
        out[_spread(low[easy], n[easy])] = run[run != self.feed] if len(easy) else run
        out[_spread(low[hard], n[hard])] = np.fromiter((i for x in others for i in x), np.uint32)
        return out, n

    def places(self, h: np.ndarray, start: np.ndarray, stop: np.ndarray, raw: bytes) -> np.ndarray:
        """Numbers in the table of the pieces with distinct hashes h, in ascending order, after those it lacks were encoded."""
        at = np.searchsorted(self.known, h)
        new = np.ones(len(h), bool)
        if len(self.known):
            new = self.known[np.minimum(at, len(self.known) - 1)] != h
        if len(self.known) + new.sum() > self.most and len(self.known):
            self.clear()
            new[:] = True
        if new.any():
            pool, n = self.ids_of([raw[a:b] for a, b in zip(start[new].tolist(), stop[new].tolist(), strict=True)])
            into = np.searchsorted(self.known, h[new])
            low = len(self.pool) + np.cumsum(n) - n
            self.known, self.low, self.n = (np.insert(x, into, y) for x, y in ((self.known, h[new]), (self.low, low), (self.n, n)))
            self.pool = np.concatenate((self.pool, pool))
        return np.searchsorted(self.known, h)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        buf, at = base.joined(texts)
        body = buf[: at[-1]]
        full = np.flatnonzero(np.diff(at) > 1)
        if not len(full):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        gap = np.flatnonzero(body == 32)
        gap = gap[(gap > 1) & (gap < len(body) - 1)]
        before, lead = body[gap - 1], body[gap - 2]
        wide = (before >= 0x80) & (lead >= 0xC3) & (lead <= 0xDF)
        gap = gap[_OPEN[body[gap + 1]] & (wide | (before > 0x20) & (before < 0x7F))]
        kind = _KIND[body]
        turn = np.flatnonzero((kind[1:] + kind[:-1] == 3) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
        mark = np.zeros(at[-1] + 1, bool)
        mark[gap] = mark[turn] = mark[at[:-1][full]] = True
        start = np.flatnonzero(mark)
        first = np.searchsorted(start, at)
        stop = np.append(start[1:], at[-1])
        stop[first[1:][full] - 1] = at[1:][full] - 1
        h = base.hashes(buf, start, stop)
        order = np.argsort(h)
        new = np.ones(len(h), bool)
        new[1:] = h[order[1:]] != h[order[:-1]]
        one = order[new]
        place = np.empty(len(h), np.int64)
        place[order] = self.places(h[one], start[one], stop[one], body.tobytes())[np.cumsum(new) - 1]
        n = self.n[place]
        out = np.concatenate(([0], np.cumsum(n)))
        return self.pool[_spread(self.low[place], n)], out[first[1:]] - out[first[:-1]]


def shared_pieces(kept: dict) -> Pieces:
    """The table of pieces of a Python worker. ``kept`` is a broadcast value, which outlives a task: the worker's next tasks
    find the pieces they have in common with earlier ones."""
    if "pieces" not in kept:
        kept["pieces"] = Pieces(kept["tokenizer"])
    return kept["pieces"]


def _spread(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each low on, n of them."""
    out = np.concatenate(([0], np.cumsum(n)))
    return np.repeat(low - out[:-1], n) + np.arange(out[-1])


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Write the ids of all rows to `path` in ascending order of doc_id (null first), equal ids by a hash of the text.

    tokenizer: the JSON text of a tokenizers file. Each document gets end_id after its ids; null counts as empty text.
    """
    import json

    spark = docs.sparkSession
    parsed = json.loads(tokenizer)
    top = max([*parsed["model"]["vocab"].values(), *(t["id"] for t in parsed["added_tokens"]), end_id])
    width, sent = max(1, int(top).bit_length()), spark.sparkContext.broadcast({"tokenizer": tokenizer})
    rows = base.id_and_text(docs)
    mb = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 1e6

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before, pieces = TaskContext.get().partitionId(), 0, 0, shared_pieces(sent.value)
        for b in batches:
            texts, doc_ids = base.texts_of(b.column(1)), b.column(0).to_pylist()
            for i, j in base.blocks(texts):
                ids, n = pieces.encode(texts[i:j])
                ends = np.cumsum(n + 1)
                ids = np.insert(ids, np.cumsum(n), end_id)
                cuts = [0, *(np.flatnonzero(np.diff(ends // BLOCK_IDS)) + 1).tolist(), len(ends)]
                for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                    low = int(ends[a - 1]) if a else 0
                    n_ids = int(ends[z - 1]) - low
                    yield pa.RecordBatch.from_pylist([{"part": part, "block": block, "width": width, "ids_before": before, "n_ids": n_ids, "doc_ids": doc_ids[i + a : i + z], "doc_ends": (ends[a:z] - low).tolist(), "payload": pack(ids[low : low + n_ids], width)}], shape)
                    block, before = block + 1, before + n_ids

    shape = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("width", pa.int32()), ("ids_before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_ends", pa.list_(pa.int64())), ("payload", pa.binary())])
    dealt = rows.withColumn("text_hash", F.xxhash64("text")).repartitionByRange(base.tasks(spark, mb), "doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash", "text")
    dealt.mapInArrow(run, _FORMAT).write.mode("overwrite").parquet(path)


def part_starts(files: DataFrame) -> DataFrame:
    """part and the number of ids in all parts before it; the driver gets one sum for each part of about 64 MB of text."""
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    starts, total = [], 0
    for r in sums:
        starts.append((r["part"], total))
        total += r["n"]
    return files.sparkSession.createDataFrame(starts, "part int, part_start long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document in the files at `path`."""
    files = spark.read.schema(_FORMAT).parquet(path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in packed.rows_of(batches):
            ids, ends = unpack(r["payload"], r["width"], 0, r["n_ids"]), np.array(r["doc_ends"], np.int64)
            low = np.concatenate(([0], ends[:-1]))
            crc = [zlib.crc32(ids[i:j].tobytes()) for i, j in zip(low, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r["part"]] * len(ends), pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(r["ids_before"] + low), pa.array(ends - low), pa.array(crc, pa.int64())], ["part", "doc_id", "start", "n_tokens", "ids_crc32"])

    unpacked = files.mapInArrow(run, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    starts = F.broadcast(part_starts(files))
    return unpacked.join(starts, "part").select("doc_id", (F.col("start") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def ids_of(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of the named documents: Spark reads the blocks that hold them, and only their bits are unpacked."""
    wanted = set(doc_ids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in packed.rows_of(batches):
            low = [0, *r["doc_ends"]]
            found = [k for k, d in enumerate(r["doc_ids"]) if d in wanted]
            yield pa.RecordBatch.from_arrays([pa.array([r["doc_ids"][k] for k in found], pa.int64()), pa.array([unpack(r["payload"], r["width"], low[k], low[k + 1]).tolist() for k in found], pa.list_(pa.int64()))], ["doc_id", "ids"])

    held = spark.read.schema(_FORMAT).parquet(path).where(F.arrays_overlap("doc_ids", F.array(*(F.lit(d).cast("long") for d in doc_ids))))
    return held.mapInArrow(run, "doc_id long, ids array<long>")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name beside the checkpoints."""
    base.checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
