"""Alignment of two tokenizers over the same texts, and how often their ids meet in the corpus.

Each tokenizer's tokens are summed up to byte ends; a dictionary leads from each end to the token's index. The ends that
both dictionaries have, in order, slice the two id lists into groups, and each slice is expanded to its links: pairs of
tokens whose byte ranges overlap. The dictionaries are arrays addressed by the end, for all pieces of a batch at once.

Both tokenizers look at a text piece by piece: neither has a token that reaches from a character that is not white space
over one space or line feed to the next such character, so a text may be cut there without a change of its tokens. The
pieces are mostly words; each distinct piece of a batch of documents is encoded and aligned once.

Counts of id pairs are summed by Spark, first in each task. For the documents' sums each batch sends its distinct pairs
to the buckets of the pair table that hold them and gets one reply from each. A bucket is a slice of the table by the
second tokenizer's id, so its size is bounded by the vocabularies; questions pass it as a stream. Where many batches ask,
buckets are copied (one copy for COPY_BATCHES batches), so no task grows with the corpus.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.llm import base
from tallycast.llm.packed import NO_ID, rows_of

BATCH_BYTES = 8 << 20
#: Pairs in a bucket, and batches that one copy of it answers.
BUCKET_PAIRS, COPY_BATCHES = 200_000, 4096
_AT_ONCE = 20_000
_SPACE_MARK = "▁"
COLUMNS = {"doc_id": "long", "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "n_best": "long", "count_sum": "long", "groups_sha256": "string"}

#: Bytes beside a cut: printable ASCII, or a two-byte character from U+00C0 on. None of these is white space.
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_LEAD = np.zeros(256, bool)
_LEAD[0xC3:0xE0] = True


def _byte_of_mark() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: itself if it is printable, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(0x100 + k): b for k, b in enumerate(hidden)}}


def byte_pieces(tokenizer: str) -> list[bytes]:
    """Bytes of each id of a byte-level tokenizers file; raises for files that read text in another way."""
    parsed = json.loads(tokenizer)
    split = parsed.get("pre_tokenizer") or {}
    if parsed.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError("only byte-level tokenizers without a normaliser, a prefix space or a pattern of their own")
    mark = _byte_of_mark()
    vocabulary = {i: bytes(mark[c] for c in w) for w, i in parsed["model"]["vocab"].items()}
    vocabulary |= {t["id"]: t["content"].encode() for t in parsed["added_tokens"] if t["id"] not in vocabulary}
    return [vocabulary.get(i, b"") for i in range(max(vocabulary) + 1)]


def mark_pieces(model: bytes) -> list[bytes]:
    """Bytes of each id of a sentencepiece model; raises if a piece could reach over a cut."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
    if any(_SPACE_MARK in p.lstrip(_SPACE_MARK) or ("\n" in p and len(p) > 1) for p in pieces):
        raise ValueError("only models whose pieces have the space mark at their start, and no line feed")
    return [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace(_SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]


def _cut(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """A space and the text of each document, cut into pieces: the bytes, start and end of each, where each document's start (n + 1)."""
    buf, at = base.joined([b" " + t for t in texts])
    gap = (buf == 0x20) | (buf == 0x0A)
    after = np.zeros(len(buf), bool)
    after[:-1] = _PLAIN[buf[1:]] | _LEAD[buf[1:]]
    before = np.zeros(len(buf), bool)
    before[1:] = _PLAIN[buf[:-1]]
    before[2:] |= _LEAD[buf[:-2]]  # of valid UTF-8, so the byte between ends the character
    here = gap & after & before
    here[at[1:] - 1] = False
    here[at[:-1]] = True
    here[at[-1] :] = False
    start = np.flatnonzero(here)
    first = np.searchsorted(start, at)
    end = np.append(start[1:], at[-1])
    end[first[1:] - 1] = at[1:] - 1
    return buf.tobytes(), start, end, first


def _distinct(raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Distinct pieces, and which of them each piece is. They are told apart by a 64-bit hash."""
    buf = np.frombuffer(raw, np.uint8)
    h = base.hashes(buf, start, end)
    _, one, which = np.unique(h, return_index=True, return_inverse=True)
    return [raw[a:b] for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)], which


def _encoded(pieces: list[bytes], first, second, first_bytes: list[bytes], second_bytes: list[bytes], mark: int) -> tuple[np.ndarray, ...]:
    """Ids of all pieces by both tokenizers, how many each piece has, and whether both give back its bytes."""
    n, ids = ([], []), ([], [])
    good = []
    for s in range(0, len(pieces), _AT_ONCE):
        some = pieces[s : s + _AT_ONCE]
        a = [x.ids for x in first.encode_batch_fast([p.decode() for p in some], add_special_tokens=False)]
        b = second.encode([(p[1:] if p[0] == 0x20 else p).decode() for p in some], num_threads=1)
        b = [x[1:] if p[0] == 0x0A and x[:1] == [mark] else x for p, x in zip(some, b, strict=True)]
        good += [b"".join([first_bytes[i] for i in x]) == p == b"".join([second_bytes[i] for i in y]) for p, x, y in zip(some, a, b, strict=True)]
        for k, lists in enumerate((a, b)):
            n[k].append(np.fromiter(map(len, lists), np.int64, len(lists)))
            ids[k].append(np.fromiter((i for x in lists for i in x), np.int64))
    return *(np.concatenate(x) for x in (ids[0], n[0], ids[1], n[1])), np.array(good, bool)


def _slices(ids_a: np.ndarray, ids_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of aligned pieces, one after another: index after each group's last token in both lists; both indices of each link."""
    end_a, end_b = np.cumsum(size_a[ids_a]), np.cumsum(size_b[ids_b])
    total = int(end_a[-1]) if len(end_a) else 0
    index_a, index_b = np.zeros(total + 1, np.int64), np.zeros(total + 1, np.int64)
    index_a[end_a], index_b[end_b] = np.arange(1, len(end_a) + 1), np.arange(1, len(end_b) + 1)
    common = np.flatnonzero((index_a > 0) & (index_b > 0))
    link = np.flatnonzero((index_a > 0) | (index_b > 0))
    # A link ends where the first of its two tokens does; the other is the next that ends at or after that.
    a, b = np.searchsorted(end_a, link), np.searchsorted(end_b, link)
    return index_a[common], index_b[common], a, b


def _keys(ids_a: np.ndarray, ids_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A pair's key: the second tokenizer's id in the upper half."""
    return ids_b[b] << 32 | ids_a[a]


def _per_piece(ends: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """How many of the sorted `ends` each piece has; upto: the last one it can have."""
    return np.diff(np.concatenate(([0], np.searchsorted(ends, upto, "right"))))


def _bytes_of(*arrays: np.ndarray) -> bytes:
    """Integer arrays, each in the fewest bytes, the bytes of equal weight together, compressed."""
    out = []
    for x in arrays:
        wide = next(k for k in (1, 2, 4, 8) if k == 8 or not len(x) or int(x.max()) < 1 << 8 * k)
        planes = np.ascontiguousarray(x.astype(f"<u{wide}").view(np.uint8).reshape(-1, wide).T)
        out.append(np.array([len(x), wide], "<i8").tobytes() + planes.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def _arrays_of(body: bytes) -> Iterator[np.ndarray]:
    raw, at = zstandard.ZstdDecompressor().decompress(body), 0
    while at < len(raw):
        n, wide = np.frombuffer(raw, "<i8", 2, at).tolist()
        planes = np.frombuffer(raw, np.uint8, n * wide, at + 16).reshape(wide, n)
        yield np.ascontiguousarray(planes.T).view(f"<u{wide}")[:, 0].astype(np.int64) if n else np.zeros(0, np.int64)
        at += 16 + n * wide


def _batch(ids: list[int | None], texts: list[bytes], tools: tuple) -> tuple[np.ndarray, np.ndarray, list[bytes], bytes]:
    """Of a batch: doc_ids, counts by document, digests, and the pieces with their places, packed."""
    first, second, first_bytes, second_bytes, size_a, size_b, mark, number = tools
    counts, digests = np.zeros((4, len(texts)), np.int64), [b""] * len(texts)
    full = [k for k, t in enumerate(texts) if t]
    which, seq_first = np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    ids_a = ids_b = n_a = n_b = np.zeros(0, np.int64)
    if full:
        raw, start, end, at = _cut([texts[k] for k in full])
        pieces, which = _distinct(raw, start, end)
        ids_a, n_a, ids_b, n_b, good = _encoded(pieces, first, second, first_bytes, second_bytes, mark)
        doc = base.segment_of(at)
        fine = np.ones(len(full), bool)
        fine[doc[~good[which]]] = False
        stay = fine[doc]
        which = which[stay]
        used = np.bincount(which, minlength=len(pieces)) > 0
        new = np.cumsum(used) - 1
        ids_a, ids_b = ids_a[np.repeat(used, n_a)], ids_b[np.repeat(used, n_b)]
        n_a, n_b, which = n_a[used], n_b[used], new[which]
        after_a, after_b, a, b = _slices(ids_a, ids_b, size_a, size_b)
        groups, links = _per_piece(after_a, np.cumsum(n_a)), _per_piece(a + 1, np.cumsum(n_a))
        text_a, text_b = [number[i] for i in ids_a.tolist()], [number[i] for i in ids_b.tolist()]
        ends = list(zip([0, *after_a.tolist()], after_a.tolist(), [0, *after_b.tolist()], after_b.tolist(), strict=False))
        group = [b",".join(text_a[w:x]) + b"|" + b",".join(text_b[y:z]) for w, x, y, z in ends]
        cuts = np.cumsum(groups).tolist()
        whole = [b";".join(group[x:y]) for x, y in zip([0, *cuts], cuts, strict=False)]
        seq_at = np.concatenate(([0], np.cumsum(np.bincount(doc[stay], minlength=len(full)))))
        for row, per in enumerate((n_a, n_b, groups, links)):
            counts[row, full] = base.add_at(per[which], seq_at)
        places = which.tolist()
        for k, x, y in zip(full, seq_at[:-1].tolist(), seq_at[1:].tolist(), strict=True):
            if y > x:
                digests[k] = hashlib.sha256(b";".join([whole[i] for i in places[x:y]])).digest()
        n_places = np.zeros(len(texts), np.int64)
        n_places[full] = np.diff(seq_at)
        seq_first = np.concatenate(([0], np.cumsum(n_places)))
    numbers = np.array([NO_ID if i is None else i for i in ids], np.int64)
    return numbers, counts, digests, _bytes_of(which, np.diff(seq_first), ids_a, n_a, ids_b, n_b)


def _links_of(body: bytes, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a packed batch: piece of each place, places of each document, distinct pairs, which pair each link is, where pieces' links start."""
    which, n_places, ids_a, n_a, ids_b, _ = _arrays_of(body)
    _, _, a, b = _slices(ids_a, ids_b, size_a, size_b)
    pairs, link = np.unique(_keys(ids_a, ids_b, a, b), return_inverse=True)
    return which, n_places, pairs, link, np.concatenate(([0], np.cumsum(_per_piece(a + 1, np.cumsum(n_a)))))


class Alignment:
    """Documents encoded by two tokenizers and aligned, in checkpointed batches."""

    def __init__(self, docs: DataFrame, tokenizer: str, model: bytes, batch_bytes: int = BATCH_BYTES):
        """tokenizer: JSON text of a byte-level tokenizers file; model: bytes of a sentencepiece model file."""
        spark = docs.sparkSession
        first_bytes, second_bytes = byte_pieces(tokenizer), mark_pieces(model)
        self.sizes = spark.sparkContext.broadcast(tuple(np.array([len(x) for x in p], np.int64) for p in (first_bytes, second_bytes)))
        files, sizes = spark.sparkContext.broadcast((tokenizer, model, first_bytes, second_bytes)), self.sizes

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            import sentencepiece
            from tokenizers import Tokenizer

            text, proto, one, two = files.value
            first, second = Tokenizer.from_str(text), sentencepiece.SentencePieceProcessor(model_proto=proto)
            first.encode_special_tokens = True
            number = [str(i).encode() for i in range(max(len(one), len(two)))]
            tools = (first, second, one, two, *sizes.value, second.piece_to_id(_SPACE_MARK), number)

            def row(ids: list, texts: list[bytes]) -> pa.RecordBatch:
                numbers, counts, digests, body = _batch(ids, texts, tools)
                values = [numbers.tobytes(), counts.astype("<i8").tobytes(), b"".join(x or bytes(32) for x in digests), body]
                return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], ["doc_ids", "counts", "digests", "body"])

            ids: list[int | None] = []
            texts: list[bytes] = []
            total = 0
            for b in batches:
                for i, t in zip(b.column(0).to_pylist(), base.texts_of(b.column(1)), strict=True):
                    ids.append(i)
                    texts.append(t)
                    total += len(t) + 1
                    if total >= batch_bytes:
                        yield row(ids, texts)
                        ids, texts, total = [], [], 0
            if ids:
                yield row(ids, texts)

        rows = base.id_and_text(docs).mapInArrow(run, "doc_ids binary, counts binary, digests binary, body binary")
        n = base.tasks(spark, (docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0) / 1e6, 128)
        self.rows = base.cut(rows.withColumn("batch", F.monotonically_increasing_id()).repartition(n, "batch"))

    def pairs(self) -> DataFrame:
        """pair, count: links of each id pair over all documents; pair is the second id times 2 ** 32 plus the first."""
        sizes = self.sizes

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in rows_of(batches):
                which, _, pairs, link, at = _links_of(r["body"], *sizes.value)
                times = np.bincount(which, minlength=len(at) - 1)
                n = np.bincount(link, np.repeat(times, np.diff(at)).astype(float), len(pairs)).astype(np.int64)
                if len(pairs):
                    yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "count"])

        return self.rows.select("body").mapInArrow(run, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count"))

    def links(self) -> DataFrame:
        """a, b, count, best: the id pairs that are linked, and whether no pair of the same b has more links."""
        top = F.max("count").over(_by_second())
        rows = self.pairs().withColumn("best", F.col("count") == top)
        return rows.select(F.col("pair").bitwiseAND(0xFFFFFFFF).alias("a"), F.shiftright("pair", 32).alias("b"), "count", "best")

    def documents(self) -> DataFrame:
        """The columns in COLUMNS for each row (see align)."""
        spark, sizes = self.rows.sparkSession, self.sizes
        table = base.cut(self.pairs())
        n_pairs, n_batches = table.count(), self.rows.count()
        buckets = max(1, -(-n_pairs // BUCKET_PAIRS))
        buckets = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
        copies = max(1, -(-n_batches // COPY_BATCHES))
        shape = "slot long, kind int, pair long, count long, batch long, asked binary"

        def slot_of(pairs: np.ndarray) -> np.ndarray:
            return (base.mix((pairs >> 32).astype(np.uint64) * base.M1) % base.U(buckets)).astype(np.int64)

        def told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                slot = slot_of(b.column(0).to_numpy())
                for c in range(copies):
                    n = b.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array(slot * copies + c), pa.array(np.zeros(n, np.int32)), b.column(0), b.column(1), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], ["slot", "kind", "pair", "count", "batch", "asked"])

        def asked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in rows_of(batches):
                pairs = _links_of(r["body"], *sizes.value)[2]
                slot = slot_of(pairs)
                order = np.argsort(slot, kind="stable")
                edges = np.searchsorted(slot[order], np.arange(buckets + 1))
                have = np.flatnonzero(np.diff(edges))
                parts = [pairs[order[edges[k] : edges[k + 1]]].tobytes() for k in have]
                n = len(have)
                copy = r["batch"] % copies
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(have * copies + copy), pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([r["batch"]] * n, pa.int64()), pa.array(parts, pa.binary())], ["slot", "kind", "pair", "count", "batch", "asked"])

        def replied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            small, now, parts, known = zstandard.ZstdCompressor(level=3), None, [], None
            for b in batches:
                slots, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
                edges = (np.flatnonzero((slots[1:] != slots[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist()
                for x, y in zip([0, *edges], [*edges, len(slots)], strict=True):
                    if x == y:
                        continue
                    if slots[x] != now:
                        now, parts, known = int(slots[x]), [], None
                    piece = b.slice(x, y - x)
                    if kinds[x] == 0:
                        parts.append((piece.column(2).to_numpy(), piece.column(3).to_numpy()))
                        continue
                    known = known or _with_best(parts)
                    for batch, keys in zip(piece.column(4).to_pylist(), piece.column(5), strict=True):
                        values = known[1][np.searchsorted(known[0], np.frombuffer(keys.as_py(), np.int64))]
                        yield pa.RecordBatch.from_arrays([pa.array([batch]), pa.array([now // copies]), pa.array([small.compress(values.tobytes())], pa.binary())], ["batch", "slot", "reply"])

        def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wide = zstandard.ZstdDecompressor()
            for r in rows_of(batches):
                which, n_places, pairs, link, at = _links_of(r["body"], *sizes.value)
                values, slot = np.zeros(len(pairs), np.int64), slot_of(pairs)
                order = np.argsort(slot, kind="stable")
                edges = np.searchsorted(slot[order], np.arange(buckets + 1))
                for reply in r["replies"] or ():
                    k = reply["slot"]
                    values[order[edges[k] : edges[k + 1]]] = np.frombuffer(wide.decompress(reply["reply"]), np.int64)
                places = np.concatenate(([0], np.cumsum(n_places)))
                n_best = base.add_at(base.add_at((values & 1)[link], at)[which], places)
                total = base.add_at(base.add_at((values >> 1)[link], at)[which], places)
                ids = np.frombuffer(r["doc_ids"], np.int64)
                counts = np.frombuffer(r["counts"], "<i8").reshape(4, -1)
                digests = [r["digests"][s : s + 32].hex() if n else "" for s, n in zip(range(0, len(r["digests"]), 32), counts[0].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == NO_ID), *(pa.array(c) for c in (*counts, n_best, total)), pa.array(digests)], list(COLUMNS))

        together = table.mapInArrow(told, shape).unionByName(self.rows.select("batch", "body").mapInArrow(asked, shape))
        slots = together.repartition(min(buckets * copies, base.tasks(spark, buckets * copies * 16, 64)), "slot").sortWithinPartitions("slot", "kind")
        replies = slots.mapInArrow(replied, "batch long, slot long, reply binary")
        gathered = replies.groupBy("batch").agg(F.collect_list(F.struct("slot", "reply")).alias("replies"))
        return self.rows.join(gathered, "batch", "left").mapInArrow(summed, ", ".join(f"{c} {t}" for c, t in COLUMNS.items()))


def _by_second():
    from pyspark.sql import Window

    return Window.partitionBy(F.shiftright("pair", 32))


def _with_best(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs in order, and twice the count of each, plus one if no pair of its second id has more."""
    pairs, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(pairs)
    pairs, n = pairs[order], n[order]
    first = np.flatnonzero(np.append(True, (pairs[1:] >> 32) != (pairs[:-1] >> 32)))
    most = np.repeat(np.maximum.reduceat(n, first), np.diff(np.append(first, len(n))))
    return pairs, n * 2 + (n == most)


def align(docs: DataFrame, tokenizer: str, model: bytes) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row.

    A space and the text is encoded by the byte-level tokenizer (a), the text by the sentencepiece model, which adds the
    space itself (b); special tokens are neither added nor found. Groups are cut where tokens of both end; links are the
    pairs of overlapping tokens. n_best: links whose id pair has the highest count of all pairs with its b id, ties
    included, over all documents; count_sum: the sum of the links' counts. groups_sha256 is the digest of the groups as
    `a1,a2|b1;a3|b2,b3`. Null and empty texts, and texts whose bytes one of the two does not give back, have no tokens:
    zeros and an empty digest column. Repeated rows and ids count and come back each time; an empty table gives no rows.
    """
    return Alignment(docs, tokenizer, model).documents()
