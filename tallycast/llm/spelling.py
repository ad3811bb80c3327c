"""Spelling variants: words of a corpus that are one edit apart, each led to its most frequent form.

Words are scanned as sorted lists. A row of the edit matrix against a prefix is kept for all words that share the prefix
(adjacent words share it up to their longest common prefix, LCP), only the band of three cells around the diagonal is
kept, and a range of words whose shared prefix is already over one edit is skipped as a whole. The scan goes down one
code point at a time for all query words of a block together, in NumPy.

A list is not the whole vocabulary. Of two words one edit apart, the shorter of length L, the edit's place (the length
of their common prefix) lies in one window of [0, L]; they share what stands before the window and what stands after it.
So words meet by (L, window, prefix, suffix), first with two windows, the halves of the word. A list with more than
LIMIT words is not scanned; its words come again with the window halved, down to windows of one place, whose lists the
alphabet bounds. A pair counts in the window that holds its edit only, so it is found once from each side.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.llm import base

MIN_LENGTH, MIN_COUNT, FACTOR = 5, 3, 2
#: Words in a list, rows that are scanned together, and query words times list words that are scanned together.
LIMIT, BLOCK, WIDE = 4096, 100_000, 1 << 21
#: Of the runs one in PART loses a code point.
PART = 97
_TEXT_BLOCK = 4 << 20
_LONG = 64

_POLY = np.uint32(0xEDB88320)
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & np.uint32(1), (_CRC >> np.uint32(1)) ^ _POLY, _CRC >> np.uint32(1))
_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True


def _crcs(buf: np.ndarray, start: np.ndarray, n: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each span of bytes, carried on from `before`."""
    order = np.argsort(-n, kind="stable")
    at, state, left = start[order], ~before[order], n[order]
    alive = len(order)
    for step in range(int(min(left[0], _LONG)) if alive else 0):
        alive = int(np.searchsorted(-left, -step, "left"))
        s = state[:alive]
        state[:alive] = _CRC[(s ^ buf[at[:alive] + step]) & np.uint32(255)] ^ (s >> np.uint32(8))
    out = np.empty(len(n), np.uint32)
    out[order] = ~state
    for k in np.flatnonzero(n > _LONG).tolist():
        out[k] = zlib.crc32(buf[start[k] : start[k] + n[k]].tobytes(), int(before[k]))
    return out


def _runs(ids: list[int | None], texts: list[bytes], min_length: int) -> tuple[list[bytes], np.ndarray]:
    """Distinct words of some documents and how often each occurs."""
    buf, at = base.joined(texts)
    lead = np.zeros(len(buf), bool)
    lead[:-1] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80)
    member = _ASCII[buf] | lead
    member[1:] |= lead[:-1]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], member[: at[-1]]))))
    start, end = edge[::2], edge[1::2]
    doc = np.searchsorted(at, start, "right") - 1
    buf = base.LOWER[buf]
    before = np.array([zlib.crc32(b":" if i is None else b"%d:" % i) for i in ids], np.uint32)
    crc = _crcs(buf, start, end - start, before[doc])
    wide = np.concatenate(([0], np.cumsum(lead)))
    points = end - start - (wide[end] - wide[start])
    changed = crc % PART == 0
    plain = np.flatnonzero(~changed & (points >= min_length))
    h = base.hashes(buf, start[plain], end[plain])
    _, first, n = np.unique(h, return_index=True, return_counts=True)
    first, raw = plain[first], buf.tobytes()
    words = [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
    cut: dict[bytes, int] = {}
    for k in np.flatnonzero(changed & (points > min_length)).tolist():
        run = raw[start[k] : end[k]].decode()
        p = int(crc[k]) % len(run)
        word = (run[:p] + run[p + 1 :]).encode()
        cut[word] = cut.get(word, 0) + 1
    return words + list(cut), np.concatenate((n, np.fromiter(cut.values(), np.int64, len(cut))))


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: words of at least min_length code points and min_count occurrences over all documents.

    Runs are maximal sequences of A-Z, a-z and U+00C0 to U+00FF; only A-Z are lower-cased. Of the runs whose crc32 (of
    doc_id, a colon and the run) 97 divides, the code point at crc32 modulo the length is left out. A null text has no
    runs, a null doc_id is written as nothing.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), base.texts_of(b.column(1))
            for i, j in base.blocks(texts, _TEXT_BLOCK):
                words, n = _runs(ids[i:j], texts[i:j], min_length)
                if words:
                    yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["word", "n"])

    found = base.id_and_text(docs).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class _Lists:
    """Sorted lists of words: code points, common prefixes with the word before (-1 where a list starts)."""

    def __init__(self, words: list[str], groups: np.ndarray, low: np.ndarray):
        self.n = np.array([len(w) for w in words], np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.n)))
        self.codes = np.frombuffer("".join(words).encode("utf-32-le") + bytes(4), np.uint32).astype(np.int64)
        lcp = np.full(len(words), -1, np.int64)
        same = np.flatnonzero(groups[1:] == groups[:-1]) + 1
        lcp[same] = 0
        depth = 0
        while len(same):
            both = (self.n[same] > depth) & (self.n[same - 1] > depth)
            same = same[both]
            same = same[self.codes[self.at[same] + depth] == self.codes[self.at[same - 1] + depth]]
            depth += 1
            lcp[same] = depth
        lcp[lcp < low] = -1  # words of two lists whose keys have one hash
        self.lcp = lcp

    def point(self, word: np.ndarray, place: np.ndarray | int) -> np.ndarray:
        """Code point of a word at a place, -1 beyond its end or before its start."""
        inside = (place >= 0) & (place < self.n[word])
        return np.where(inside, self.codes[np.where(inside, self.at[word] + place, 0)], -1)


def _scan(lists: _Lists, shorter: np.ndarray, low: np.ndarray, high: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, word) of one edit whose place is in the window low to high; queries and words are rows of the lists.

    State of a query at a prefix of length p: distances of the prefix to the query's first p - 1, p and p + 1 code points.
    """
    starts = np.flatnonzero(lists.lcp < 0)
    list_of = np.searchsorted(starts, queries, "right") - 1
    ends = np.append(starts[1:], len(lists.n))
    waiting = np.argsort(low[queries], kind="stable")
    depths = low[queries][waiting]
    empty = np.zeros(0, np.int64)
    q, a, b, cells, exact = empty, empty, empty, np.zeros((3, 0), np.int64), np.zeros(0, bool)
    pairs: list[tuple[np.ndarray, np.ndarray]] = [(empty, empty)]
    taken, p = 0, int(depths[0]) if len(depths) else 0
    while len(q) or taken < len(waiting):
        if not len(q):
            p = int(depths[taken])
        upto = int(np.searchsorted(depths, p, "right"))
        if upto > taken:
            new = waiting[taken:upto]
            taken = upto
            q = np.concatenate((q, queries[new]))
            a, b = np.concatenate((a, starts[list_of[new]])), np.concatenate((b, ends[list_of[new]]))
            fresh = np.ones((3, len(new)), np.int64)
            fresh[1] = 0
            if p == 0:
                fresh[0] = 2
            cells = np.concatenate((cells, fresh), axis=1)
            exact = np.concatenate((exact, np.ones(len(new), bool)))
        # Words that end here.
        done = lists.n[a] == p
        off = lists.n[q] - p
        hit = np.flatnonzero(done & (np.abs(off) <= 1))
        hit = hit[cells[off[hit] + 1, hit] == 1]
        place_ok = ~exact[hit] | (high[q[hit]] == shorter[q[hit]])
        hit = hit[place_ok & (np.minimum(lists.n[q[hit]], p) == shorter[q[hit]])]
        pairs.append((q[hit], a[hit]))
        # Ranges of words by the next code point.
        a = a + done
        edge = lists.lcp <= p
        where = np.append(np.flatnonzero(edge), len(edge))
        rank = np.concatenate(([0], np.cumsum(edge)))
        n = np.where(a < b, rank[b] - rank[np.minimum(a, len(edge))], 0)
        parent = np.repeat(np.arange(len(q)), n)
        child = np.arange(len(parent)) - np.repeat(np.cumsum(n) - n, n) + rank[a[parent]]
        q, a, b, old, was = q[parent], where[child], where[child + 1], cells[:, parent], exact[parent]
        c = lists.codes[lists.at[a] + p]
        differs = [(lists.point(q, p + k) != c).astype(np.int64) for k in (-1, 0, 1)]
        before = np.minimum(old[1] + 1, old[0] + differs[0])
        same = np.minimum(np.minimum(old[1] + differs[1], old[2] + 1), before + 1)
        after = np.minimum(old[2] + differs[2], same + 1)
        exact = was & (differs[1] == 0)
        last = high[q] == shorter[q]
        inside = np.where(exact, (p + 1 < high[q]) | last, ~was | (p < high[q]) | last)
        keep = np.flatnonzero(inside & (np.minimum(np.minimum(before, same), after) <= 1))
        q, a, b, exact = q[keep], a[keep], b[keep], exact[keep]
        cells = np.minimum(np.stack((before[keep], same[keep], after[keep])), 2)
        p += 1
    return tuple(np.concatenate(x) for x in zip(*pairs, strict=True))


def _near(rows: pa.Table) -> pa.RecordBatch | None:
    """word, n_near, form, form_n of each word of some whole lists: its near words there, the most frequent of them."""
    shorter, low, high, groups, n = (rows.column(c).to_numpy() for c in ("shorter", "low", "high", "g", "n"))
    words = rows.column("word").to_pylist()
    lists = _Lists(words, groups, low)
    sizes = np.diff(np.append(np.flatnonzero(lists.lcp < 0), len(words)))
    size = np.repeat(sizes, sizes)
    todo = np.flatnonzero(size > 1)
    cuts = np.searchsorted(np.cumsum(size[todo]), np.arange(WIDE, size[todo].sum() + WIDE, WIDE)) + 1
    found = [_scan(lists, shorter, low, high, part) for part in np.split(todo, cuts[:-1]) if len(part)]
    if not found:
        return None
    q, w = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(q):
        return None
    order = np.lexsort((w, -n[w], q))
    q, w = q[order], w[order]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
    near = np.diff(np.append(first, len(q)))
    values = [pa.array([words[i] for i in q[first].tolist()]), pa.array(near), pa.array([words[i] for i in w[first].tolist()]), pa.array(n[w[first]])]
    return pa.RecordBatch.from_arrays(values, ["word", "n_near", "form", "form_n"])


def _scanned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole lists, some BLOCK rows at a time; rows come by list and word."""
    held: list[pa.RecordBatch] = []
    total = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            total += b.num_rows
        if total >= BLOCK:
            rows = pa.Table.from_batches(held)
            g = rows.column("g").to_numpy()
            edges = np.flatnonzero(g[1:] != g[:-1])
            if len(edges):
                cut = int(edges[-1]) + 1
                if (out := _near(rows.slice(0, cut))) is not None:
                    yield out
                held = rows.slice(cut).to_batches()
                total = rows.num_rows - cut
    if total and (out := _near(pa.Table.from_batches(held))) is not None:
        yield out


def near_words(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """word, n_near, form, form_n of the words that have a near word: how many, and the most frequent (ties: the smallest).

    words: distinct word, n. Two words are near if one inserted, deleted or replaced code point makes one the other.
    """
    spark, length = words.sparkSession, F.length("word")
    rows = words.count()
    tasks = base.tasks(spark, rows * 4 * 60 / 1e6, 8)
    shorter = words.withColumn("shorter", F.explode(F.array(length, length - 1))).where("shorter > 0")
    half = F.floor(F.col("shorter") / 2).cast("int")
    windows = F.array(F.struct(F.lit(0).alias("low"), half.alias("high")), F.struct(half.alias("low"), F.col("shorter").alias("high")))
    todo = shorter.withColumn("w", F.explode(windows)).where("w.low < w.high").select("word", "n", "shorter", "w.low", "w.high")
    found = None
    while todo is not None:
        key = F.xxhash64("shorter", "low", "high", F.expr("substring(word, 1, low)"), F.expr("substring(word, length(word) - (shorter - high) + 1)"))
        todo = todo.withColumn("g", key)
        # Counts meet by key after they are summed in each task; few keys are large.
        large = base.cut(todo.where("high - low > 1").groupBy("g").count().where(F.col("count") > limit).select("g"))
        split = None
        if large.limit(1).count():
            mid = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
            halves = F.array(F.struct("low", mid.alias("high")), F.struct(mid.alias("low"), "high"))
            split = base.cut(todo.join(large, "g", "left_semi").where("high - low > 1").withColumn("w", F.explode(halves)).select("word", "n", "shorter", "w.low", "w.high"))
            todo = todo.where("high - low = 1").unionByName(todo.where("high - low > 1").join(large, "g", "left_anti"))
        lists = todo.repartition(tasks, "g").sortWithinPartitions("shorter", "g", "word")
        part = lists.mapInArrow(_scanned, "word string, n_near long, form string, form_n long")
        found = part if found is None else found.unionByName(part)
        todo = split
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    summed = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return summed.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def _roots(forms: DataFrame, longest: int) -> DataFrame:
    """word, root of words with a form (word, form): chains of up to `longest` forms, twice as far each time."""
    ends = base.cut(forms.select("word", F.col("form").alias("root")))
    for _ in range(max(0, math.ceil(math.log2(max(1, longest))))):
        onward = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ends = base.cut(ends.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return ends


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, factor: int = FACTOR) -> DataFrame:
    """word, n, n_near, form, form_n, root of each word of the vocabulary (see vocabulary and near_words).

    form is the most frequent near word if it occurs at least `factor` times as often, else null, and form_n then too;
    root follows forms to the last, and is the word itself without one. n_near is 0 where nothing is near. Documents that
    repeat count each time. No documents, or none with words that are frequent enough, give no rows. factor is 2 or more,
    so that each form of a chain occurs twice as often as the one before, and chains end.
    """
    if factor < 2:
        raise ValueError("factor is 2 or more")
    words = base.cut(vocabulary(docs, min_length, min_count))
    most = words.agg(F.max("n")).first()[0] or 0
    near = near_words(words)
    known = words.join(near, "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))
    leads = F.col("form_n") >= factor * F.col("n")
    known = known.withColumns({"form": F.when(leads, F.col("form")), "form_n": F.when(leads, F.col("form_n"))})
    known = base.cut(known.select("word", "n", "n_near", "form", "form_n"))
    roots = _roots(known.where("form IS NOT NULL"), int(math.log(max(most, 1), factor)) + 1)
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
