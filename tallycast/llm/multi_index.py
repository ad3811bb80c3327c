"""Nearest neighbours by inner product through an inverted multi-index.

Vectors are cut into two halves, each half has its own centroids, and an entry stands in the cell of its two nearest
ones. A query walks the pairs of centroids in the order of their summed nearness, with a heap, and the entries of the
cells it visits are ranked again by the inner product of the whole vectors.

The walk has two parts. The first visits cells until they hold FIRST times k entries; the k-th best of those is a floor
that the true neighbours cannot be under. The second goes on until the cells that are left can be expected to hold
fewer than `miss` times k entries over that floor: of each half the centroids know how far their members spread along
each axis, and the tail of a normal distribution bounds how many of a cell's entries reach the floor. So the number of
cells follows from the data and the recall that is asked for; there is no cap on cells, entries or candidates.

Entries are dealt out by the first half's centroid, rows with more than CHUNK entries in several chunks, so that a
vector that a third of all rows repeat is spread like any other; queries go to the chunks they visit and never meet in
one group. Only the model goes through the driver: the centroids of a sample of at most SAMPLE rows and the number of
entries of each cell, MOST * MOST numbers at most.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallycast.llm import base

#: Rows that the centroids are fitted on (fewer if those would pass SAMPLE_BYTES).
SAMPLE, SAMPLE_BYTES = 16_384, 1 << 25
#: Entries a cell holds on average, and the most centroids of a half.
PER_CELL, MOST = 50, 1024
CHUNK, FIRST, MISS = 4096, 20, 0.02
_QUERIES = 256
_RESULT = "query long, query_id long, row long, vec_id long, score double"
_MOVED = "shard long, kind int, row long, vec_id long, vector binary, cells binary, least double"
_MOVED_ARROW = pa.schema([("shard", pa.int64()), ("kind", pa.int32()), ("row", pa.int64()), ("vec_id", pa.int64()), ("vector", pa.binary()), ("cells", pa.binary()), ("least", pa.float64())])


@dataclass
class Half:
    """Centroids of one half and the variance of their members along each axis."""

    low: int
    high: int
    centroids: np.ndarray
    spread: np.ndarray

    def nearest(self, x: np.ndarray) -> np.ndarray:
        x = x[:, self.low : self.high]
        return np.argmin((self.centroids**2).sum(1) - 2 * (x @ self.centroids.T), axis=1)

    def moments(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and variance of the inner product of a query with the members of each centroid."""
        q = q[self.low : self.high]
        return self.centroids @ q, self.spread @ (q * q)


def _half(x: np.ndarray, low: int, high: int, k: int) -> Half:
    """Lloyd's algorithm on the sample's columns low to high."""
    x = x[:, low:high]
    own = Half(0, high - low, x[np.random.default_rng(11).choice(len(x), min(k, len(x)), replace=False)], np.zeros((0, high - low)))
    for _ in range(12):
        at = own.nearest(x)
        n = np.bincount(at, minlength=len(own.centroids))
        total = np.zeros_like(own.centroids)
        np.add.at(total, at, x)
        own.centroids = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], own.centroids)
    at = own.nearest(x)
    square = np.zeros_like(own.centroids)
    np.add.at(square, at, (x - own.centroids[at]) ** 2)
    n = np.bincount(at, minlength=len(own.centroids))
    # A centroid of few members says little of its spread: it is drawn towards that of all.
    spread = (square + 4 * (square.sum(0) / max(len(x), 1))) / (n[:, None] + 4.0)
    return Half(low, high, own.centroids, spread)


def walk(near: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, int]]:
    """Pairs of centroids by descending sum of the two nearnesses."""
    a, b = (np.argsort(-x, kind="stable") for x in near)
    x, y = near[0][a].tolist(), near[1][b].tolist()
    a, b = a.tolist(), b.tolist()
    heap, reached = [(-(x[0] + y[0]), 0, 0)], [0] * (len(a) + 1)
    while heap:
        _, i, j = heapq.heappop(heap)
        yield a[i], b[j]
        reached[i] = j + 1
        if i + 1 < len(a) and reached[i + 1] == j:
            heapq.heappush(heap, (-(x[i + 1] + y[j]), i + 1, j))
        if j + 1 < len(b) and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))


def _visits(q: np.ndarray, halves: tuple[Half, Half], counts: np.ndarray, first: int, least: float | None, missed: float) -> list[tuple[int, int]]:
    """Cells with entries that a query visits: until they hold `first` entries; or with a floor, those that come after."""
    (m1, v1), (m2, v2) = (h.moments(q) for h in halves)
    hits = None
    if least is not None:
        x = (least - m1[:, None] - m2) / np.sqrt(v1[:, None] + v2 + 1e-300)
        tail = 0.5 * np.exp(-0.5 * np.square(np.minimum(np.abs(x), 38)))
        hits = counts * np.where(x > 0, tail, 1 - tail)
        left = hits.sum()
    out: list[tuple[int, int]] = []
    seen = 0
    for i, j in walk((m1, m2)):
        n = int(counts[i, j])
        early = seen < first
        seen += n
        if hits is None:
            if not early:
                break
            if n:
                out.append((i, j))
            continue
        if not early and left < missed:
            break
        left -= hits[i, j]
        if n and not early:
            out.append((i, j))
    return out


def _vectors(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def _unpacked(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _scored(k: int, kind: str):
    """Stream of entries and queries, ordered by shard, to the best entries of each query in each shard."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, index = None, [], None
        for batch in batches:
            shards, kinds = (batch.column(c).to_numpy() for c in (0, 1))
            edges = np.flatnonzero((shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(shards)], strict=True):
                if a == b:
                    continue
                if shards[a] != shard:
                    shard, parts, index = int(shards[a]), [], None
                piece = batch.slice(a, b - a)
                if kinds[a] == 0:
                    parts.append((piece.column(2).to_numpy(), piece.column(3).to_numpy(), _unpacked(piece.column(4), kind), _unpacked(piece.column(5), "<u2")[:, 0]))
                elif parts:
                    index = index or _ordered(parts)
                    for s in range(0, b - a, _QUERIES):
                        yield from _best(piece.slice(s, _QUERIES), index, k, kind)

    return run


def _ordered(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rows, ids, vectors, cells = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((rows, ids, cells))
    return rows[order], ids[order], vectors[order].astype(np.float64), cells[order], np.argsort(rows[order])


def _best(piece: pa.RecordBatch, index: tuple, k: int, kind: str) -> Iterator[pa.RecordBatch]:
    rows, ids, e, cells, by_row = index
    own, own_id, least = (piece.column(c).to_numpy(zero_copy_only=False) for c in (2, 3, 6))
    q = _unpacked(piece.column(4), kind).astype(np.float64)
    visited = [np.frombuffer(x, "<u2") for x in piece.column(5).to_pylist()]
    who, cell = np.repeat(np.arange(len(q)), [len(x) for x in visited]), np.concatenate(visited)
    order = np.argsort(cell, kind="stable")
    who, cell = who[order], cell[order]
    found = np.full((len(q), len(e)), -np.inf)
    edges = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        low, high = np.searchsorted(cells, cell[a]), np.searchsorted(cells, cell[a], "right")
        if low < high:
            found[who[a:b], low:high] = q[who[a:b]] @ e[low:high].T
    at = np.searchsorted(rows, own, sorter=by_row)
    here = np.flatnonzero(at < len(rows))
    here = here[rows[by_row[at[here]]] == own[here]]
    found[here, by_row[at[here]]] = -np.inf
    # The matrix product rounds as its blocks fall, so it only selects; what is left is summed up in one order for all.
    slack = 1e-14 * q.shape[1] * np.sqrt((q * q).sum(1)) * np.sqrt((e * e).sum(1).max())
    floor = np.where(np.isnan(least), -np.inf, least)
    if len(e) > k:
        floor = np.maximum(floor, np.partition(found, len(e) - k, axis=1)[:, len(e) - k])
    i, j = np.nonzero((found >= (floor - slack)[:, None]) & (found > -np.inf))
    score = np.concatenate([np.zeros(0), *((q[i[s : s + 65536]] * e[j[s : s + 65536]]).sum(1) for s in range(0, len(i), 65536))])
    order = np.lexsort((rows[j], ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    keep = (rank < k) & ~(score < least[i])
    i, j, score = i[keep], j[keep], score[keep]
    if len(i):
        yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(own_id[i]), pa.array(rows[j]), pa.array(ids[j]), pa.array(score)], ["query", "query_id", "row", "vec_id", "score"])


def search(vectors: DataFrame, k: int = 20, every: int = 20, miss: float = MISS) -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score: the k nearest found of each row whose vec_id is divisible by `every`.

    vectors: vec_id and embedding (an array of numbers). Candidates are all rows but the query's own; score is the inner
    product in double precision; ties go to the smaller vec_id. Rows without vec_id or vector, and vectors that are zero
    or hold a null, an infinity or a NaN, take no part; shorter vectors count as filled up with zeros. A repeated vec_id
    is a row of its own each time, as query and as candidate, so its queries' ranks repeat. An empty table has no results.
    miss: the share of the k neighbours that the walk may be expected to leave out.
    """
    spark, x = vectors.sparkSession, F.col("embedding")
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), (x if kind == "<f4" else x.cast("array<double>")).alias("x"))
    usable = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.coalesce(usable, F.lit(False)))
    n, d = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    zero = F.lit(0.0).cast("float" if kind == "<f4" else "double")
    rows = rows.select("vec_id", F.concat("x", F.array_repeat(zero, d - F.size("x"))).alias("x"))
    size = min(SAMPLE, max(256, SAMPLE_BYTES // (8 * d)))
    sample = rows.orderBy(F.xxhash64("vec_id", "x"), "vec_id").limit(size).select("x").toArrow()["x"].combine_chunks()
    sample = sample.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)
    halves_k = min(MOST, max(1, math.isqrt(n // PER_CELL)))
    halves = (_half(sample, 0, d // 2, halves_k), _half(sample, d // 2, d, halves_k))
    shape = tuple(len(h.centroids) for h in halves)
    model = spark.sparkContext.broadcast([(h.low, h.high, h.centroids, h.spread) for h in halves])

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = (Half(*h) for h in model.value)
        for b in batches:
            if b.num_rows:
                v = _vectors(b, "x")
                wide = v.astype(np.float64)
                raw = v.astype(kind).tobytes()
                step = len(raw) // b.num_rows
                packed = pa.array([raw[s : s + step] for s in range(0, len(raw), step)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("row")), b.column(b.schema.get_field_index("vec_id")), pa.array(one.nearest(wide).astype(np.int32)), pa.array(two.nearest(wide).astype(np.int32)), packed], ["row", "vec_id", "i", "j", "vector"])

    entries = base.cut(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(placed, "row long, vec_id long, i int, j int, vector binary"))

    def counted(batches: Iterable[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(shape[0] * shape[1], np.int64)
        for b in batches:
            total += np.bincount(b.column(0).to_numpy().astype(np.int64) * shape[1] + b.column(1).to_numpy(), minlength=len(total))
        return total

    counts = base.sum_arrays(entries.select("i", "j"), counted, shape[0] * shape[1]).reshape(shape)
    chunks = np.maximum(1, -(-counts.sum(1) // CHUNK))
    known = spark.sparkContext.broadcast((counts, chunks, np.concatenate(([0], np.cumsum(chunks)))))

    def dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, n_chunks, start = known.value
        for b in batches:
            row, i, j = (b.column(c).to_numpy() for c in (0, 2, 3))
            shard = start[i] + (base.mix(row.astype(np.uint64) * base.M1) % n_chunks[i].astype(np.uint64)).astype(np.int64)
            cell = j.astype("<u2").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(np.zeros(len(row), np.int32)), b.column(0), b.column(1), b.column(4), pa.array([cell[s : s + 2] for s in range(0, len(cell), 2)], pa.binary()), pa.nulls(len(row), pa.float64())], schema=_MOVED_ARROW)

    def asked(later: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            per_cell, n_chunks, start = known.value
            own = tuple(Half(*h) for h in model.value)
            for b in batches:
                for s in range(0, b.num_rows, 64):
                    out: list[tuple] = []
                    for r in b.slice(s, 64).to_pylist():
                        least = (-np.inf if r["least"] is None else r["least"]) if later else None
                        by_i: dict[int, list[int]] = {}
                        for i, j in _visits(np.frombuffer(r["vector"], kind).astype(np.float64), own, per_cell, FIRST * k, least, miss * k):
                            by_i.setdefault(i, []).append(j)
                        for i, js in by_i.items():
                            cells = np.array(js, "<u2").tobytes()
                            out += [(int(start[i]) + c, 1, r["row"], r["vec_id"], r["vector"], cells, r["least"]) for c in range(int(n_chunks[i]))]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), _MOVED_ARROW, strict=True)], schema=_MOVED_ARROW)

        return run

    shards = int(chunks.sum())
    queries = entries.where(F.col("vec_id") % every == 0).select("row", "vec_id", "vector").repartition(base.tasks(spark, n / every * d * 8 / 1e6, 16), "row")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")

    def found(asking: DataFrame, later: bool) -> DataFrame:
        moved = entries.mapInArrow(dealt, _MOVED).unionByName(asking.mapInArrow(asked(later), _MOVED))
        together = moved.repartition(min(shards, base.tasks(spark, n * d * 8 / 1e6)), "shard").sortWithinPartitions("shard", "kind")
        return together.mapInArrow(_scored(k, kind), _RESULT)

    first = found(queries.withColumn("least", F.lit(None).cast("double")), False)
    first = base.cut(first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"))
    floors = first.groupBy("query").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    rest = queries.join(floors.withColumnRenamed("query", "row"), "row", "left")
    both = first.unionByName(found(rest, True)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return both.select("query_id", "rank", "vec_id", "score")
