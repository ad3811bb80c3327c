"""Exact removal of long repeated substrings with a logarithmic family of suffix arrays.

Of the suffixes of a text only some are kept: in every window of `length` bytes the one whose first 64 bytes have the
least hash (the leftmost of equal ones). Equal windows keep the same suffix, so no repeat is missed. A batch's suffix
array holds its kept suffixes in the order of their hash: any fixed order finds equal prefixes, and this one spreads
over buckets evenly however common a beginning is. In each bucket batches come in one after the other; each is merged
into the levels of the index, where two levels of like size are merged into one, so an entry moves a logarithmic number
of times. Merging scans both arrays side by side and notes for each suffix whether it came again, and whether the bytes
around it, over all windows that kept it, were the same.

Suffixes that came again with the same surroundings have all their windows repeated. For those that came again with
other surroundings, a second family finds the surroundings that came again. What is left, at the ends of repeats, is
asked for window by window in a third, where one batch speaks for each surroundings that came again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tallycast.llm import base, packed

GRAM = 64
SEGMENT = 1 << 20
_PLACE = base.U((1 << 24) - 1)
_SUFFIX = np.dtype([("a", "<u8"), ("b", "<u8"), ("state", "u1")])
_RUN = np.dtype([("first", "<u4"), ("n", "<u4"), ("around", "<u8")])
#: States of a suffix: seen once, seen again with the same surroundings, with other surroundings.
ONCE, SAME, OTHER = 0, 1, 2


class Levels:
    """A family of sorted arrays of (a, b, state), each at least as large again as the next."""

    def __init__(self, whole_key: bool):
        self.whole_key, self.levels = whole_key, []

    def add(self, batch: np.ndarray) -> None:
        while self.levels and len(self.levels[-1]) < 2 * len(batch):
            batch = self.merged(self.levels.pop(), batch)
        self.levels.append(batch)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Both arrays in order, equal keys as one; a key is `a`, or `a` and `b` if whole_key."""
        both = np.concatenate((left, right))
        both = both[np.argsort(both["a"], kind="stable")]
        return self.united(both)

    def united(self, rows: np.ndarray) -> np.ndarray:
        """Rows sorted by `a` with those of equal keys united."""
        if self.whole_key and (rows["a"][1:] == rows["a"][:-1]).any():
            rows = rows[np.lexsort((rows["b"], rows["a"]))]
        new = np.ones(len(rows), bool)
        new[1:] = rows["a"][1:] != rows["a"][:-1]
        if self.whole_key:
            new[1:] |= rows["b"][1:] != rows["b"][:-1]
        if new.all():
            return rows
        first = np.flatnonzero(new)
        out = rows[first].copy()
        several = np.diff(np.append(first, len(rows))) > 1
        state = np.maximum.reduceat(rows["state"], first)
        other = np.minimum.reduceat(rows["b"], first) != np.maximum.reduceat(rows["b"], first)
        out["state"] = np.where(several, np.maximum(np.where(other, OTHER, SAME), state), state)
        return out

    def found(self, rows: np.ndarray) -> np.ndarray:
        """The index's entries for the keys of rows, all of which are in it."""
        while len(self.levels) > 1:
            self.levels.append(self.merged(self.levels.pop(), self.levels.pop()))
        top = self.levels[0]
        at = np.searchsorted(top["a"], rows["a"])
        if self.whole_key:
            wrong = np.flatnonzero(top["b"][at] != rows["b"])
            while len(wrong):  # equal a, other b
                at[wrong] += 1
                wrong = wrong[top["b"][at[wrong]] != rows["b"][wrong]]
        return top[at]


def _answer(whole_key: bool, spoken_for: bool = False):
    """Two bits for each entry: its state, or if spoken_for whether it came again and whether the asker speaks for it."""

    def answer(asked: list[tuple[int, bytes]]) -> list[bytes]:
        index = Levels(whole_key)
        for _, x in asked:
            index.add(np.frombuffer(x, _SUFFIX))
        out = []
        for _, x in asked:
            rows = np.frombuffer(x, _SUFFIX)
            top = index.found(rows)
            bits = (top["state"] > ONCE, top["b"] == rows["b"]) if spoken_for else (top["state"] == SAME, top["state"] == OTHER)
            out.append(np.packbits(np.stack(bits, 1).ravel()).tobytes())
        return out

    return answer


def _bits(replies: list[dict] | None, array: np.ndarray, buckets: int) -> np.ndarray:
    """The two bits that a batch has got for each entry of its array."""
    out = np.zeros((len(array), 2), np.uint8)
    for slot, reply in packed.slots(array["a"], buckets, replies):
        out[slot] = np.unpackbits(np.frombuffer(reply, np.uint8), count=2 * len(slot)).reshape(-1, 2)
    return out


def _doubled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of 2 k bytes from those of k bytes, at each place but the last k."""
    out = h[:-k] * base.M1
    out += h[k:]
    out ^= out >> base.U(29)
    out *= base.M2
    return out


def _windows(buf: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At each place where a window of `length` bytes starts: two hashes of it; and the hash of 64 bytes at each place that has them."""
    h = base.multipliers(256, 5)[buf]
    k = 1
    while k < GRAM:
        h, k = _doubled(h, k), 2 * k
    gram = h
    while 2 * k <= length:
        h, k = _doubled(h, k), 2 * k
    n = len(buf) - length + 1
    a = base.stir(h[:n], h[length - k : length - k + n])
    b = base.stir(gram[:n], gram[length - GRAM : length - GRAM + n])
    for shift in range(GRAM, length - GRAM, GRAM):
        b = base.stir(b, gram[shift : shift + n])
    return a, b, gram


def _segments(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of about a megabyte, the places where a window starts there, and the places in the joined batch (no separators) of all."""
    at, bufs, places, total = 0, [], [], 0
    for x in texts:
        for low in range(0, max(len(x) - length + 1, 0), SEGMENT):
            part = x[low : low + SEGMENT + length - 1]
            bufs.append(part)
            places.append((total, len(part) - length + 1, at + low))
            total += len(part)
            if total >= SEGMENT:
                yield _laid(bufs, places)
                bufs, places, total = [], [], 0
        at += len(x)
    if bufs:
        yield _laid(bufs, places)


def _laid(bufs: list[bytes], places: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own, n, batch = (np.array(x, np.int64) for x in zip(*places, strict=True))
    first = np.concatenate(([0], np.cumsum(n)))
    step = np.arange(first[-1])
    starts = np.repeat(own - first[:-1], n) + step
    return np.frombuffer(b"".join(bufs), np.uint8), starts, np.repeat(batch - first[:-1], n) + step


def _runs(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of neighbouring windows that keep one suffix: hash of the suffix, hash of all bytes of the run, place of the first window in the batch, number of windows."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    for buf, starts, places in _segments(texts, length):
        a, _, gram = _windows(buf, length)
        least = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
        done, want = 1, length - GRAM + 1
        while done < want:
            step = min(done, want - done)
            least = np.minimum(least[:-step], least[step:])
            done += step
        kept = (least[starts] & _PLACE).astype(np.int64)
        new = np.ones(len(kept), bool)
        new[1:] = (kept[1:] != kept[:-1]) | (places[1:] != places[:-1] + 1)
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(kept)))
        out[0].append(base.mix(gram[kept[first]]))
        out[1].append(base.stir(base.stir(a[starts[first]], a[starts[first + n - 1]]), n.astype(np.uint64)))
        out[2].append(places[first])
        out[3].append(n)
    return tuple(np.concatenate([np.zeros(0, t), *x]) for x, t in zip(out, (np.uint64, np.uint64, np.int64, np.int64), strict=True))


def _sorted(a: np.ndarray, b: np.ndarray, whole_key: bool) -> np.ndarray:
    """The suffix array of a batch: its entries in order, equal ones united."""
    rows = np.zeros(len(a), _SUFFIX)
    rows["a"], rows["b"] = a, b
    return Levels(whole_key).united(rows[np.argsort(a, kind="stable")]) if len(a) else rows


def _doubtful(text: bytes, first: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place and both hashes of each window of the runs that start at `first` with n windows."""
    out: list[list[np.ndarray]] = [[], [], []]
    body = np.frombuffer(text, np.uint8)
    size = n + length - 1
    at = np.concatenate(([0], np.cumsum(size)))
    cuts = np.unique(np.searchsorted(at, np.arange(0, at[-1] + SEGMENT, SEGMENT)).clip(0, len(n)))
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        m, s = n[i:j], size[i:j]
        low = at[i:j] - at[i]
        buf = body[np.repeat(first[i:j] - low, s) + np.arange(s.sum())]
        many = np.concatenate(([0], np.cumsum(m)))
        step = np.arange(many[-1])
        starts = np.repeat(low - many[:-1], m) + step
        a, b, _ = _windows(buf, length)
        out[0].append(np.repeat(first[i:j] - many[:-1], m) + step)
        out[1].append(base.mix(a[starts]))
        out[2].append(b[starts])
    return tuple(np.concatenate([np.zeros(0, t), *x]) for x, t in zip(out, (np.int64, np.uint64, np.uint64), strict=True))


COLUMNS = {
    "doc_id": (pa.int64(), "long"), "n_bytes": (pa.int64(), "long"), "n_removed": (pa.int64(), "long"), "n_spans": (pa.int64(), "long"),
    "kept_sha256": (pa.string(), "string"), "spans": (pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "array<struct<start:long,end:long>>"),
    "kept": (pa.binary(), "binary"),
}


def repeats(docs: DataFrame, length: int = 200, columns: Iterable[str] = tuple(COLUMNS)) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start and end in bytes), kept (binary) of each row, or
    those of them in `columns`; what is not asked for is not built.

    Removed is every byte under a string of `length` bytes (128 or more) that also starts anywhere else in the rows,
    the same text included; overlapping strings count, and strings are judged on the input. Matches never cross
    documents. Null counts as empty text and keeps a null doc_id. Repeated rows are copies of each other.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} at least")
    rows = packed.pack(docs)
    n_parts, spark = rows.rdd.getNumPartitions(), docs.sparkSession
    buckets = base.tasks(spark, packed.megabytes(rows), 100)

    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=3)
        for row in packed.rows_of(batches):
            key, around, first, n = _runs(packed.opened(row).texts, length)
            spans = small.compress(np.diff(first, prepend=0).astype("<u4").tobytes() + n.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([row["batch"]], pa.int64()), pa.array([key.tobytes() + around.tobytes()], pa.binary()), pa.array([spans], pa.binary())], ["batch", "hashes", "spans"])

    def suffixes(_: None, row: dict) -> tuple[np.ndarray, np.ndarray]:
        array = _sorted(*np.frombuffer(row["hashes"], np.uint64).reshape(2, -1), False)
        return array, array["a"]

    def judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = zstandard.ZstdDecompressor()
        for row in packed.rows_of(batches):
            key, around = np.frombuffer(row["hashes"], np.uint64).reshape(2, -1)
            first, n = np.frombuffer(wide.decompress(row["spans"]), "<u4").reshape(2, -1)
            first = np.cumsum(first, dtype=np.int64)
            array = _sorted(key, around, False)
            bits = _bits(row["replies"], array, buckets)[np.searchsorted(array["a"], key)] > 0
            runs = np.rec.fromarrays([first, n, around], dtype=_RUN)
            yield pa.RecordBatch.from_arrays([pa.array([row["batch"]], pa.int64()), *(pa.array([runs[bits[:, k]].tobytes()], pa.binary()) for k in (0, 1))], ["batch", "sure", "other"])

    def around(_: None, row: dict) -> tuple[np.ndarray, np.ndarray]:
        other = np.frombuffer(row["other"], _RUN)
        array = _sorted(other["around"], np.full(len(other), row["batch"], np.uint64), False)
        return array, array["a"]

    def divided(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in packed.rows_of(batches):
            other = np.frombuffer(row["other"], _RUN)
            array, _ = around(None, row)
            at = np.searchsorted(array["a"], other["around"])
            again, speaks = _bits(row["replies"], array, buckets)[at].T > 0
            one = np.zeros(len(other), bool)
            one[np.unique(at, return_index=True)[1]] = True
            sure = row["sure"] + other[again].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([row["batch"]], pa.int64()), pa.array([sure], pa.binary()), pa.array([other[~again | (speaks & one)].tobytes()], pa.binary())], ["batch", "sure", "doubt"])

    def windows(batch: packed.Batch, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        doubt = np.frombuffer(row["doubt"], _RUN)
        place, a, b = _doubtful(b"".join(batch.texts), doubt["first"].astype(np.int64), doubt["n"].astype(np.int64), length)
        return place, a, b, _sorted(a, b, True)

    def doubtful(batch: packed.Batch, row: dict) -> tuple[np.ndarray, np.ndarray]:
        array = windows(batch, row)[-1]
        return array, array["a"]

    def removed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in packed.rows_of(batches):
            batch = packed.opened(row)
            text = b"".join(batch.texts)
            place, a, c, array = windows(batch, row)
            again = array.copy()
            again["state"] = _bits(row["replies"], array, buckets).any(1)
            index = Levels(True)
            index.add(again)
            asked = np.zeros(len(a), _SUFFIX)
            asked["a"], asked["b"] = a, c
            hit = place[index.found(asked)["state"] > 0] if len(a) else place
            sure = np.frombuffer(row["sure"], _RUN)
            first, n = sure["first"].astype(np.int64), sure["n"].astype(np.int64)
            edge = np.zeros(len(text) + 1, np.int32)
            np.add.at(edge, np.concatenate((first, hit)), 1)
            np.add.at(edge, np.concatenate((first + n - 1 + length, hit + length)), -1)
            gone = np.cumsum(edge[:-1]) > 0
            out, low = [], 0
            for doc, x in zip(batch.doc_ids.tolist(), batch.texts, strict=True):
                own = gone[low : low + len(x)]
                turn = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0])))).tolist()
                spans = list(zip(turn[::2], turn[1::2], strict=True))
                left = b"".join(x[i:j] for i, j in zip([0, *turn[1::2]], [*turn[::2], len(x)], strict=True))
                low += len(x)
                row_out = {"doc_id": None if doc == packed.NO_ID else doc, "n_bytes": len(x), "n_removed": len(x) - len(left), "n_spans": len(spans), "kept_sha256": hashlib.sha256(left).hexdigest(), "kept": left}
                if "spans" in shape.names:
                    row_out["spans"] = [{"start": i, "end": j} for i, j in spans]
                out.append(row_out)
            yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in out], f.type) for f in shape], schema=shape)

    shape = pa.schema([(c, COLUMNS[c][0]) for c in COLUMNS if c in set(columns)])
    # Runs are computed and moved once: questions and replies read one exchange.
    runs = rows.mapInArrow(kept, "batch long, hashes binary, spans binary").repartition(n_parts, "batch")
    known = packed.ask(runs, suffixes, _answer(False), buckets, ("hashes", "spans"), bodies=False, planes=_SUFFIX.itemsize)
    known = base.cut(known.mapInArrow(judged, "batch long, sure binary, other binary").repartition(n_parts, "batch"))
    known = packed.ask(known, around, _answer(False, True), buckets, ("other",), bodies=False, planes=_SUFFIX.itemsize)
    known = base.cut(known.mapInArrow(divided, "batch long, sure binary, doubt binary").repartition(n_parts, "batch"))
    found = packed.ask(rows.join(known, "batch"), doubtful, _answer(True), buckets, ("doubt",), planes=_SUFFIX.itemsize)
    return found.mapInArrow(removed, ", ".join(f"{c} {COLUMNS[c][1]}" for c in shape.names))
