"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of each document; a chunk ends where the hash is the least among its neighbours. Where
chunks end depends only on some 80 bytes around, so an insertion moves the borders near it and no others. Chunks are
compared by digest, and a run of chunks that an earlier place of the corpus has already is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallycast.llm import base, packed

#: Bytes on either side among which a border has the least hash: chunks have 25 bytes at least, 49 on average.
RADIUS = 24
#: Bytes that the gear hash remembers, and the longest chunk.
WINDOW, LONGEST = 32, 4096
#: Least length of a run of repeated chunks that is removed.
LEAST_RUN = 100
_RECORD = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("ord", "<u4")])
_REPLY = np.dtype([("at", "<u4"), ("doc", "<i8"), ("own", "u1")])


def _gear() -> np.ndarray:
    table = np.random.default_rng(11).integers(0, 2**63, 256, dtype=np.uint64) * base.U(2)
    table[0] = 0
    return table


def _least(h: np.ndarray, n: int) -> np.ndarray:
    """Minimum of h[i : i + n] at each i; h is padded by the largest value."""
    done, m = 1, h
    while done < n:
        step = min(done, n - done)
        m = np.minimum(m[:-step], m[step:])
        done += step
    return m


def borders(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every chunk in the joined documents (see base.joined), and where each document's chunks start (n + 1)."""
    n = np.array([len(x) for x in texts], np.int64)
    wide = np.frombuffer((bytes(64)).join([b"", *texts, b""]), np.uint8)
    at = np.concatenate(([0], np.cumsum(n + 64)))[:-1] + 64
    h = _gear()[wide]
    k = 1
    while k < WINDOW:
        h[k:] += h[:-k] << base.U(k)
        k *= 2
    h = base.mix(h)
    inside = np.zeros(len(wide) + 1, np.int8)
    np.add.at(inside, at, 1)
    np.add.at(inside, at + n, -1)
    h[np.cumsum(inside[:-1]) == 0] = base.U(2**64 - 1)
    pad = np.full(RADIUS, 2**64 - 1, np.uint64)
    left = _least(np.concatenate((pad, h)), RADIUS)[: len(h)]
    right = _least(np.concatenate((h[1:], pad)), RADIUS)[: len(h)]
    cut = np.flatnonzero((h < left) & (h <= right)) + 1
    doc = np.searchsorted(at, cut, "right") - 1
    cut = cut[(cut > at[doc]) & (cut < (at + n)[doc])]
    full = np.flatnonzero(n)
    start = np.union1d(cut, at[full])
    end = np.append(start[1:], 0)
    first = np.searchsorted(start, np.append(at, len(wide)))
    end[first[1:][full] - 1] = (at + n)[full]
    long = -(-(end - start) // LONGEST)
    if (long > 1).any():
        base_at = np.concatenate(([0], np.cumsum(long)))
        src = np.repeat(np.arange(len(start)), long)
        start = start[src] + (np.arange(base_at[-1]) - base_at[src]) * LONGEST
        end = np.minimum(start + LONGEST, end[src])
        first = np.searchsorted(start, np.append(at, len(wide)))
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    move = 64 * (doc + 1) - doc
    return start - move, end - move, first


def _chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, digest (n, 2) of all chunks, places counted from each document's start, and each document's first chunk."""
    starts, ends, digests, counts = [], [], [], [np.zeros(1, np.int64)]
    for i, j in base.blocks(texts):
        part = texts[i:j]
        start, end, first = borders(part)
        raw = b"\n".join(part)
        digests.append(b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)))
        low = np.repeat(np.concatenate(([0], np.cumsum([len(x) + 1 for x in part])))[:-1], np.diff(first))
        starts.append(start - low)
        ends.append(end - low)
        counts.append(np.diff(first))
    return np.concatenate([np.zeros(0, np.int64), *starts]), np.concatenate([np.zeros(0, np.int64), *ends]), np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2), np.cumsum(np.concatenate(counts))


def _keys(digest: np.ndarray, first: np.ndarray, doc_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records of the distinct digests of a batch, each with its earliest place, and the number of each chunk's record."""
    doc = doc_ids[base.segment_of(first)]
    order = np.lexsort((np.arange(len(doc)), doc, digest[:, 1], digest[:, 0]))
    d = digest[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]).any(1)
    records = np.zeros(int(new.sum()), _RECORD)
    lead = order[new]
    records["a"], records["b"], records["doc"], records["ord"] = digest[lead, 0], digest[lead, 1], doc[lead], lead
    which = np.empty(len(d), np.int64)
    which[order] = np.cumsum(new) - 1
    return records, which


def _answer(asked: list[tuple[int, bytes]]) -> list[bytes]:
    """Of every digest that several batches have: the document with its earliest place, and whether that is the asker's."""
    parts = [np.frombuffer(x, _RECORD) for _, x in asked]
    batch = np.repeat(np.array([n for n, _ in asked]), [len(p) for p in parts])
    of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    at = np.concatenate([np.arange(len(p)) for p in parts])
    r = np.concatenate(parts)
    order = np.lexsort((r["ord"], batch, r["doc"], r["b"], r["a"]))
    s = r[order]
    new = np.ones(len(s), bool)
    new[1:] = (s["a"][1:] != s["a"][:-1]) | (s["b"][1:] != s["b"][:-1])
    group = np.cumsum(new) - 1
    again = np.bincount(group)[group] > 1
    owner = np.flatnonzero(new)[group]
    out = np.zeros(len(s), _REPLY)
    out["at"], out["doc"], out["own"] = at[order], s["doc"][owner], owner == np.arange(len(s))
    of = of[order]
    out, of = out[again], of[again]
    by = np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[by], np.arange(len(parts) + 1))
    return [out[by][a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def deduplicate(docs: DataFrame, least_run: int = LEAST_RUN, copies: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_chunks, n_removed, n_spans, kept (text), kept_sha256, kept_in of each row.

    A chunk is repeated if it stands earlier in the same or another document (ascending doc_id, then any fixed order of
    rows with equal ids); runs of repeated chunks of least_run bytes or more are removed, and with copies also a shorter
    run that is the whole document. Bytes of a repeat in the chunks at its two ends do not count. kept_in: the documents that
    hold the kept copies. The earliest copy is never removed. Null counts as empty text, a null doc_id as the smallest.
    Repeated rows repeat each other: all but one lose their chunks. kept is text again where cuts split no character;
    bytes of split characters become replacement characters there, and kept_sha256 is of the bytes.
    """
    rows = packed.pack(docs)
    buckets = base.tasks(docs.sparkSession, packed.megabytes(rows), 100)

    def keys(batch: packed.Batch, _: dict) -> tuple[np.ndarray, np.ndarray]:
        _, _, digest, first = _chunks(batch.texts)
        records, _ = _keys(digest, first, batch.doc_ids)
        return records, records["a"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in packed.rows_of(batches):
            batch = packed.opened(row)
            start, end, digest, first = _chunks(batch.texts)
            records, which = _keys(digest, first, batch.doc_ids)
            owner, own = records["doc"].copy(), np.ones(len(records), bool)
            for slot, reply in packed.slots(records["a"], buckets, row["replies"]):
                got = np.frombuffer(reply, _REPLY)
                owner[slot[got["at"]]], own[slot[got["at"]]] = got["doc"], got["own"] > 0
            again = ~own[which] | (records["ord"][which] != np.arange(len(which)))
            out = []
            for k, text in enumerate(batch.texts):
                a, z = first[k], first[k + 1]
                spans, kept_in = _runs(again[a:z], start[a:z], end[a:z], owner[which[a:z]], 0 if copies and again[a:z].all() else least_run)
                kept = b"".join(text[i:j] for i, j in zip([0, *(j for _, j in spans)], [*(i for i, _ in spans), len(text)], strict=True))
                doc = int(batch.doc_ids[k])
                out.append({"doc_id": None if doc == packed.NO_ID else doc, "n_bytes": len(text), "n_chunks": int(z - a), "n_removed": len(text) - len(kept), "n_spans": len(spans), "kept": kept.decode(errors="replace"), "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept_in": kept_in})
            yield pa.RecordBatch.from_pylist(out, shape)

    shape = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_chunks", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string()), ("kept_in", pa.list_(pa.int64()))])
    return packed.ask(rows, keys, _answer, buckets).mapInArrow(run, "doc_id long, n_bytes long, n_chunks long, n_removed long, n_spans long, kept string, kept_sha256 string, kept_in array<long>")


def _runs(again: np.ndarray, start: np.ndarray, end: np.ndarray, owner: np.ndarray, least: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Removed byte ranges of a document and the documents that keep them."""
    if not again.any():
        return [], []
    edge = np.flatnonzero(np.diff(np.concatenate(([0], again.view(np.int8), [0]))))
    spans, kept_in = [], set()
    for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if end[z - 1] - start[a] >= least:
            spans.append((int(start[a]), int(end[z - 1])))
            kept_in.update(owner[a:z].tolist())
    return spans, sorted(kept_in - {packed.NO_ID})
