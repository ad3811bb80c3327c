"""Language ID by multilingual mixture inference.

Every language is a table of hashed byte n-grams (2 and 4 bytes, lower case) counted over all labelled documents. A
document is a mixture: each word comes from one language. Expectation-maximisation over the words estimates the
proportions; languages are taken into the set one by one as long as the likelihood gains more than the penalty.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.llm import base

ORDERS, BITS, ROUNDS = (2, 4), 15, 6
_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _folded(buf: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the two-byte Latin capitals (C3 80 to C3 9E)."""
    low = base.LOWER[buf]
    high = (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[:-1] == 0xC3)
    low[1:][high] += 0x20
    return np.where(base.SPACE[low], np.uint8(32), low)


def _grams(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bucket of the n-gram that ends at each byte of each word, by order; where each word's bytes start (n + 1).

    A word is read with the separator before it and the one after it.
    """
    n = end - start + 1
    first = np.concatenate(([0], np.cumsum(n)))
    pos = np.repeat(start - first[:-1], n) + np.arange(first[-1])
    room = pos - np.repeat(start, n) + 2
    padded = np.concatenate((np.full(8, 32, np.uint8), low)).astype(np.uint64)
    out = []
    for k, order in enumerate(ORDERS):
        h = np.full(len(pos), k + 1, np.uint64)
        for j in range(order):
            h = h * base.U(257) + np.where(room > j, padded[pos + 8 - j], base.U(32))
        out.append((base.mix(h) >> base.U(64 - BITS)).astype(np.int64) + (k << BITS))
    return out, first


def _size(languages: int) -> int:
    return max(1 << 16, base.BLOCK_BYTES * 4 // max(languages, 4))


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities (n-gram, language) from `text` and non-null `lang` of all given rows.

    The driver gets one number per language and bucket, whatever the number of documents.
    """
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    names = sorted(r[0] for r in rows.select("lang").distinct().collect())
    width = len(ORDERS) << BITS
    if not names:
        return [], np.zeros((width, 0), np.float32)
    index = {x: i for i, x in enumerate(names)}

    def count(batches: Iterable[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((len(names), width), np.int64)
        for b in batches:
            lang = np.array([index[x] for x in b.column(0).to_pylist()], np.int64)
            texts = base.texts_of(b.column(1))
            for i, j in base.blocks(texts):
                buf, at = base.joined(texts[i:j])
                start, end, first = base.words(buf, at)
                if not len(start):
                    continue
                grams, per_word = _grams(_folded(buf), start, end)
                of = np.repeat(np.repeat(lang[i:j], np.diff(first)), np.diff(per_word)) * width
                for g in grams:
                    total += np.bincount(of + g, minlength=total.size).reshape(total.shape)
        return total.ravel()

    counts = base.sum_arrays(rows, count, len(names) * width).reshape(len(names), len(ORDERS), 1 << BITS)
    p = np.log((counts + 0.5) / (counts.sum(2, keepdims=True) + 0.5 * (1 << BITS)))
    return names, np.ascontiguousarray(p.reshape(len(names), width).T.astype(np.float32))


def _estimate(e: np.ndarray, mask: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each document whose words have likelihoods e, with the languages in mask."""
    seg, n = base.segment_of(first), np.diff(first)[:, None]
    share = mask / mask.sum(1, keepdims=True)
    for _ in range(ROUNDS):
        r = e * share[seg]
        total = r.sum(1, keepdims=True)
        share = base.add_at(r / total, first) / n
    total = np.maximum((e * share[seg]).sum(1), 1e-30)
    return share, base.add_at(np.log(total.astype(np.float64)), first)


def _mixtures(ll: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Proportions (document, language) of documents with at least one word, by forward selection.

    A set of k languages costs (k - 1) * log(words) / 2. Documents whose best word-wise choice cannot repay a second
    language keep one; the others try each round the language that would gain most over their current mixture.
    """
    best = ll.max(1, keepdims=True)
    total, top = base.add_at(ll.astype(np.float64), first), base.add_at(best[:, 0].astype(np.float64), first)
    docs, langs = total.shape
    one = total.argmax(1)
    share = np.zeros((docs, langs))
    share[np.arange(docs), one] = 1.0
    cost = np.maximum(0.5 * np.log(np.diff(first)), 1.0)
    mask, now = share > 0, total[np.arange(docs), one] - top
    open_ = np.flatnonzero(-now > cost)
    for _ in range(langs - 1):
        if not len(open_):
            break
        n = np.diff(first)[open_]
        sub = np.concatenate(([0], np.cumsum(n)))
        take = np.repeat(first[:-1][open_] - sub[:-1], n) + np.arange(sub[-1])
        e = np.exp(np.maximum(ll[take] - best[take], -60)).astype(np.float32)
        seg = base.segment_of(sub)
        mix = np.maximum((e * share[open_].astype(np.float32)[seg]).sum(1, keepdims=True), 1e-26)
        gain = base.add_at(np.log1p(0.25 * (np.minimum(e / mix, 1e26).astype(np.float64) - 1)), sub)
        gain[mask[open_]] = -np.inf
        tried = mask[open_].copy()
        tried[np.arange(len(open_)), gain.argmax(1)] = True
        new, like = _estimate(e, tried.astype(np.float32), sub)
        better = like - now[open_] > cost[open_]
        open_, new, like, tried = open_[better], new[better], like[better], tried[better]
        share[open_], now[open_], mask[open_] = new, like, tried
        open_ = open_[(-now[open_] > cost[open_]) & (mask[open_].sum(1) < langs)]
    return share


def predict(docs: DataFrame, names: list[str], table: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score, langs (those of the chosen set with their shares, largest first) of each row.

    lang_pred is the language with the largest share, the first by name of equal ones, and score its share. `und` and 0
    if the text is null or has no letter, or if nothing was learned. Repeated rows give repeated results.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = base.texts_of(b.column(1))
            pred, score, langs = ["und"] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
            for i, j in base.blocks(texts, _size(len(names))) if names else ():
                buf, at = base.joined(texts[i:j])
                start, end, first = base.words(buf, at)
                if not len(start):
                    continue
                grams, per_word = _grams(_folded(buf), start, end)
                rows = table[grams[0]]
                for g in grams[1:]:
                    rows += table[g]
                ll = np.add.reduceat(rows, per_word[:-1], axis=0) / len(ORDERS)
                full = np.flatnonzero(np.diff(first))
                share = _mixtures(ll, np.append(first[:-1][full], first[-1]))
                letters = np.add.reduceat(_ASCII_LETTER[buf[: at[-1]]], at[:-1], dtype=np.int64)
                for k, p in zip(full, share, strict=True):
                    if letters[k] or _LETTER.search(texts[i + k].decode()):
                        order = [x for x in np.argsort(-p, kind="stable") if p[x] > 0]
                        pred[i + k], score[i + k] = names[order[0]], min(1.0, p[order[0]])
                        langs[i + k] = [{"lang": names[x], "share": min(1.0, float(p[x]))} for x in order]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred), pa.array(score), pa.array(langs, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))], ["doc_id", "lang_pred", "score", "langs"])

    return base.id_and_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, langs array<struct<lang:string,share:double>>")


def held_out() -> F.Column:
    """The fold that is never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, langs of each document, learned from the documents that are not held out.

    A null lang is not learned from; a null doc_id counts as the empty text in the fold. An empty table gives no rows.
    """
    names, table = learn(docs.where(~held_out()))
    return predict(docs, names, table).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "langs")
