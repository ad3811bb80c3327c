"""BPE encoding and decoding through a table of distinct words.

Batches of documents are split into words, the distinct words of all batches meet by hash and each is encoded once, and
the ids go back to the places of the word. Decoding looks each id's piece up in the vocabulary.
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

from tallycast.llm import base, packed

BATCH_BYTES = 4 << 20
_AT_ONCE = 20_000


def _distinct(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, nearly in byte order, their hashes, the number of each place's word, and where each document's words start (n + 1).

    Words are runs without ASCII white space. What the tokenizer does never reaches over it: it is dropped, nothing is
    composed or lower-cased across it, and no added token has any. Words are told apart by a 64-bit hash.
    """
    hashes, heads, starts, ends, counts, low = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)], 0
    for i, j in base.blocks(texts):
        buf, at = base.joined(texts[i:j])
        start, end, first = base.words(buf, at)
        hashes.append(base.hashes(buf, start, end))
        heads.append(np.ndarray(len(buf) - 7, dtype=">u8", buffer=buf.data, strides=(1,))[start].astype(np.uint64))
        starts.append(start + low)
        ends.append(end + low)
        counts.append(np.diff(first))
        low += int(at[-1])
    h, head, start, end = (np.concatenate(x) for x in (hashes, heads, starts, ends))
    order = np.argsort(h)
    new = np.ones(len(h), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    one = order[new]
    by_head = np.argsort(head[one], kind="stable")
    rank = np.empty(len(one), np.int64)
    rank[by_head] = np.arange(len(one))
    which = np.empty(len(h), np.int64)
    which[order] = rank[np.cumsum(new) - 1]
    one = one[by_head]
    raw = b"\n".join([*texts, b""])
    words = [raw[a:b] for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)]
    return words, h[one], which, np.cumsum(np.concatenate(counts))


def _answer(tokenizer):
    """Ids of the words that batches ask for: how many each word has, then all of them, compressed."""

    def answer(asked: list[tuple[int, bytes]]) -> list[bytes]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        known: dict[bytes, int] = {}
        wide, small = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        number = [np.array([known.setdefault(w, len(known)) for w in wide.decompress(x).split(b"\n")], np.int32) for _, x in asked]
        todo, t = list(known), Tokenizer.from_str(tokenizer.value)
        known.clear()
        n, pool = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for i in range(0, len(todo), _AT_ONCE):
            ids = [x.ids for x in t.encode_batch_fast([w.decode() for w in todo[i : i + _AT_ONCE]], add_special_tokens=False)]
            n.append(np.array([len(x) for x in ids], np.int64))
            pool.append(np.fromiter((k for x in ids for k in x), np.uint32))
        n, pool = np.concatenate(n), np.concatenate(pool)
        end, wide_id = np.cumsum(n), "<u2" if t.get_vocab_size() <= 1 << 16 else "<u4"
        return [small.compress(n[k].astype("<u4").tobytes() + _gather(pool, end[k] - n[k], n[k]).astype(wide_id).tobytes()) for k in number]

    return answer


def _gather(pool: np.ndarray, low: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.concatenate(([0], np.cumsum(n)))
    return pool[np.repeat(low - out[:-1], n) + np.arange(out[-1])]


COLUMNS = {"doc_id": "long", "ids": "array<int>", "n_tokens": "long", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}
_ARROW = {"long": pa.int64(), "array<int>": pa.list_(pa.int32()), "string": pa.string()}


def encode(docs: DataFrame, tokenizer: str, columns: Iterable[str] = tuple(COLUMNS)) -> DataFrame:
    """doc_id, ids (array), n_tokens, ids_sha256, decoded, decoded_sha256 of each row, or those of them in `columns`.

    tokenizer: the JSON text of a tokenizers file whose words stand between white space, with no decoder: decoded are
    the pieces joined by spaces. No special tokens are added; those written in the text are found. Null counts as empty
    text, which has no ids. Repeated rows give repeated results.
    """
    spark, columns = docs.sparkSession, [c for c in COLUMNS if c in set(columns)]
    parsed = json.loads(tokenizer)
    if parsed.get("decoder"):
        raise ValueError("only tokenizers without a decoder")
    vocabulary = {**{i: w for w, i in parsed["model"]["vocab"].items()}, **{t["id"]: t["content"] for t in parsed["added_tokens"]}}
    pieces = spark.sparkContext.broadcast([vocabulary.get(i, "").encode() for i in range(max(vocabulary) + 1)])
    wide_id = "<u2" if len(vocabulary) <= 1 << 16 else "<u4"
    rows = packed.pack(docs, BATCH_BYTES, keep=False)
    buckets = base.tasks(spark, packed.megabytes(base.id_and_text(docs)), 50)

    def keys(batch: packed.Batch, _: dict) -> tuple[list[bytes], np.ndarray]:
        words, h, _, _ = _distinct(batch.texts)
        return words, h

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, wide = pieces.value, zstandard.ZstdDecompressor()
        number_text = [str(i).encode() for i in range(len(piece))]
        for row in packed.rows_of(batches):
            batch = packed.opened(row)
            words, h, which, first = _distinct(batch.texts)
            n, own = np.zeros(len(words), np.int64), []
            for slot, reply in packed.slots(h, buckets, row["replies"]):
                got = wide.decompress(reply)
                n[slot] = np.frombuffer(got, "<u4", len(slot))
                own.append((slot, np.frombuffer(got, wide_id, offset=4 * len(slot))))
                if len(own[-1][1]) != n[slot].sum():
                    raise ValueError("the documents came in another order the second time; checkpoint them first")
            low = np.cumsum(n) - n
            flat = np.zeros(n.sum(), np.int32)
            for slot, ids in own:
                flat[_gather(np.arange(len(flat)), low[slot], n[slot])] = ids
            yield from _rows(batch, which, first, flat, low, n, number_text, piece, shape)

    shape = pa.schema([(c, _ARROW[COLUMNS[c]]) for c in columns])
    asked = packed.ask(rows, keys, _answer(spark.sparkContext.broadcast(tokenizer)), buckets)
    return asked.mapInArrow(run, ", ".join(f"{c} {COLUMNS[c]}" for c in columns))


def _rows(batch: packed.Batch, which: np.ndarray, first: np.ndarray, flat: np.ndarray, low: np.ndarray, n: np.ndarray, number_text: list[bytes], piece: list[bytes], shape: pa.Schema) -> Iterator[pa.RecordBatch]:
    """What the batch's documents get: ids of their words (flat, from low on, n of them) at the words' places."""
    ids, cuts = flat.tolist(), np.append(low, len(flat)).tolist()
    spans = list(zip(cuts[:-1], cuts[1:], strict=True))
    as_ids = [b" ".join([number_text[i] for i in ids[a:z]]) for a, z in spans]
    as_text = [b" ".join([piece[i] for i in ids[a:z]]) for a, z in spans] if {"decoded", "decoded_sha256"} & set(shape.names) else as_ids
    out: list[dict] = []
    size = 0
    for k, doc in enumerate(batch.doc_ids.tolist()):
        w = which[first[k] : first[k + 1]]
        w = w[n[w] > 0]
        places = w.tolist()
        row = {"doc_id": None if doc == packed.NO_ID else doc, "n_tokens": int(n[w].sum()), "ids_sha256": hashlib.sha256(b" ".join([as_ids[i] for i in places])).hexdigest()}
        decoded = b" ".join([as_text[i] for i in places])
        row["decoded_sha256"] = hashlib.sha256(decoded).hexdigest()
        if "decoded" in shape.names:
            row["decoded"] = decoded.decode()
        if "ids" in shape.names:
            row["ids"] = _gather(flat, low[w], n[w])
        out.append(row)
        size += len(batch.texts[k]) + 1000
        if size > base.BLOCK_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in out], f.type) for f in shape], schema=shape)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in out], f.type) for f in shape], schema=shape)
