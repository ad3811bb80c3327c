"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are put into classes by their number of shingles. For each class a document is cut into overlapping windows
twice as long as the class's largest item, so that an item and a window that contains it are of like size and their
MinHash values agree often enough, however long the document. One equal value makes a candidate; candidates are then
verified by exact containment of the item's shingles in the whole document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.llm import base

#: MinHash functions; a window holding a whole item misses it with a chance of 0.75 ** 64 = 1e-8 (0.875 ** 64 = 2e-4 for
#: an item of one shingle, or one whose shingles lie in two halves far apart).
FUNCTIONS = 64
#: Shingles in the smallest windows' steps.
STEP = 4
#: Items that are sent to all tasks at a time (about 1 KB each); more are searched for in blocks of so many.
ITEMS_AT_ONCE = 20_000


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    """Distinct word 5-gram hashes of each text, sorted."""
    buf, at = base.joined(texts)
    start, end, first = base.words(base.LOWER[buf], at)
    s, out = base.shingles(base.hashes(base.LOWER[buf], start, end), first)
    return [np.unique(s[a:b]) for a, b in zip(out[:-1], out[1:], strict=True)]


def _class_of(n: int) -> int:
    """Exponent of the step (in units of STEP) that holds n shingles."""
    return max(0, int(np.ceil(np.log2(n / STEP))))


class _Items:
    """MinHash values of the items by class and function, each sorted with the items that have it."""

    def __init__(self, ids: list[int], texts: list[bytes]):
        found = [(i, s) for i, s in zip(ids, _sets(texts), strict=True) if len(s)]
        self.ids, self.sets = [i for i, _ in found], [s for _, s in found]
        factors = base.multipliers(FUNCTIONS)
        self.classes: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        of = np.array([_class_of(len(s)) for s in self.sets])
        for c in sorted(set(of.tolist())):
            members = np.flatnonzero(of == c)
            values = np.array([[(self.sets[m] * f).min() for m in members] for f in factors])
            order = np.argsort(values, axis=1, kind="stable")
            self.classes[c] = [(v[o], members[o]) for v, o in zip(values, order, strict=True)]


def _candidates(s: np.ndarray, out: np.ndarray, items: _Items) -> np.ndarray:
    """Distinct (document, item number) pairs of which a window and the item share a MinHash value."""
    docs = len(out) - 1
    pairs: list[np.ndarray] = []
    n = -(-np.diff(out) // STEP)
    first = np.concatenate(([0], np.cumsum(n)))
    if not first[-1]:
        return np.zeros(0, np.int64)
    seg = base.segment_of(first)
    cuts = out[seg] + (np.arange(first[-1]) - first[seg]) * STEP
    for k, factor in enumerate(base.multipliers(FUNCTIONS)):
        low, low_first, low_seg, level = np.minimum.reduceat(s * factor, cuts), first, seg, 0
        for c, by_function in items.classes.items():
            while level < c:  # two neighbouring steps of a document make one of the next level
                m = -(-np.diff(low_first) // 2)
                up = np.concatenate(([0], np.cumsum(m)))
                up_seg = base.segment_of(up)
                left = low_first[up_seg] + 2 * (np.arange(up[-1]) - up[up_seg])
                right = np.minimum(left + 1, low_first[up_seg + 1] - 1)
                low, low_first, low_seg, level = np.minimum(low[left], low[right]), up, up_seg, level + 1
            # A window is two steps. Its value is that of one of them, so the steps' own values are what can match.
            values, members = by_function[k]
            a = np.searchsorted(values, low, "left")
            hit = np.flatnonzero(values[np.minimum(a, len(values) - 1)] == low)
            if not len(hit):
                continue
            beside = np.minimum(hit + 1, low_first[low_seg[hit] + 1] - 1), np.maximum(hit - 1, low_first[low_seg[hit]])
            hit = hit[(low[hit] <= low[beside[0]]) | (low[hit] <= low[beside[1]])]
            a, b = a[hit], np.searchsorted(values, low[hit], "right")
            many = b - a
            doc = np.repeat(low_seg[hit], many)
            src = np.repeat(a - np.concatenate(([0], np.cumsum(many)))[:-1], many) + np.arange(many.sum())
            pairs.append(doc * len(items.ids) + members[src])
    return np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)


def search(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment of each document that holds `least` of an item's shingles or more.

    Shingles are distinct runs of five lower-case words (a shorter text is one run); containment is of the item's
    shingles in the whole document's. Null and empty texts hold nothing and are in nothing. Repeated rows of a document
    give repeated results, items with equal text one result each, repeated rows of an item one.
    """
    shape = "doc_id long, item_id long, n_shared long, n_item long, containment double"
    out = None
    for part in _parts(_listed(benchmark)):
        items = _Items([r[0] for r in part], [r[1].encode() for r in part])
        found = base.id_and_text(docs).where("text is not null").mapInArrow(_searcher(items, least), shape)
        out = found if out is None else out.unionAll(found)
    return docs.sparkSession.createDataFrame([], shape) if out is None else out


def _listed(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()


def _parts(listed: DataFrame) -> Iterator[list]:
    """The items in blocks of at most ITEMS_AT_ONCE, dealt out by hash."""
    n = -(-listed.count() // (ITEMS_AT_ONCE // 2))
    for k in range(n):
        yield listed.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()


def _held(texts: list[bytes], items: _Items, least: float) -> Iterator[tuple[int, int, int]]:
    """Document, item number and number of shared shingles of every verified pair."""
    for i, j in base.blocks(texts) if items.ids else ():
        buf, at = base.joined(texts[i:j])
        buf = base.LOWER[buf]
        start, end, first = base.words(buf, at)
        s, out = base.shingles(base.hashes(buf, start, end), first)
        last, own = -1, None
        for doc, item in zip(*(x.tolist() for x in np.divmod(_candidates(s, out, items), len(items.ids))), strict=True):
            if doc != last:
                last, own = doc, np.unique(s[out[doc] : out[doc + 1]])
            want = items.sets[item]
            shared = int((own[np.minimum(np.searchsorted(own, want), len(own) - 1)] == want).sum())
            if shared >= least * len(want):
                yield i + doc, item, shared


def _searcher(items: _Items, least: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(_held(base.texts_of(b.column(1)), items, least))
            doc, item, shared = zip(*found, strict=True) if found else ((), (), ())
            size = [len(items.sets[k]) for k in item]
            ids = pa.array([items.ids[k] for k in item], pa.int64())
            share = pa.array([n / m for n, m in zip(shared, size, strict=True)], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc, pa.int64())), ids, pa.array(shared, pa.int64()), pa.array(size, pa.int64()), share], ["doc_id", "item_id", "n_shared", "n_item", "containment"])

    return run


def stage(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows whose text holds no item, with their columns; rows are judged where they are read, without a join."""
    at = docs.columns.index("text")

    def kept(items: _Items):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                clean[[i for i, _, _ in _held(base.texts_of(b.column(at)), items, least)]] = False
                yield b.filter(pa.array(clean))

        return run

    for part in _parts(_listed(benchmark)):
        docs = docs.mapInArrow(kept(_Items([r[0] for r in part], [r[1].encode() for r in part])), docs.schema)
    return docs
