"""Quality classifier by importance resampling.

Two generative models of hashed word n-grams, one of the target (documents labelled good), one of the raw corpus (all
documents), give each document a log-ratio; Gumbel top-k samples documents in proportion to it. What the sample leaves
out is rejected.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallycast.llm import base

BUCKETS = 10_000
#: Labelled target documents that the target model is fitted on at most (those with the smallest hash of the id).
TARGET_LIMIT = 20_000
#: Log-ratios are scaled to documents of so many n-grams, so that length alone neither selects nor rejects.
SCALE = 100.0
_CLASS = np.full(256, 2, np.uint8)
_CLASS[base.SPACE] = 0
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_AGAIN, _LAST = base.U(11), base.U(13)


def _features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the unigrams and bigrams of each document and where each document's start (n + 1).

    Tokens are runs of letters and digits (as written, bytes from 128 on included) and runs of other marks. A token
    that repeats the one before it makes the same bigram whatever it is; the last one of a document makes none.
    """
    buf, at = base.joined(texts)
    kind = np.concatenate(([0], _CLASS[buf[: at[-1]]]))
    edge = np.flatnonzero(kind[1:] != kind[:-1])
    if not len(edge):
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    end = np.append(edge[1:], at[-1])
    word = kind[1:][edge] > 0
    start, end = edge[word], end[word]
    first = np.searchsorted(start, at)
    h = base.hashes(buf, start, end)
    after = np.append(h[1:], base.U(0))
    pair = np.where(h == after, _AGAIN, base.stir(h, after))
    pair[first[1:][np.diff(first) > 0] - 1] = _LAST
    both = np.stack((h, base.mix(pair)), 1)
    both = (both >> base.U(16)) % base.U(BUCKETS // 2)
    both[:, 1] += base.U(BUCKETS // 2)
    return both.astype(np.int64).ravel(), first * 2


def target_ids(labels: DataFrame, limit: int = TARGET_LIMIT) -> tuple[list[int], int, int]:
    """Ids labelled good (at most `limit`, a bounded sample by hash), and how many of how many labelled ids are good.

    A doc_id with several labels is good if all of them are; null labels do not count.
    """
    by_id = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") >= 1).alias("good"))
    good, n = by_id.agg(F.count_if("good"), F.count("*")).first()
    chosen = by_id.where("good").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return [r[0] for r in chosen.select("doc_id").collect()], good, n


def learn(docs: DataFrame, ids: list[int]) -> np.ndarray:
    """Log-ratio of target to raw probability of each bucket; docs: doc_id, text. Raw counts are of all documents."""
    wanted = np.sort(np.array(ids, np.int64))

    def count(batches: Iterable[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            doc = np.array([-1 if x is None else x for x in b.column(0).to_pylist()], np.int64)
            known = np.isin(doc, wanted) & np.array(b.column(0).is_valid())
            texts = base.texts_of(b.column(1))
            for i, j in base.blocks(texts):
                f, first = _features(texts[i:j])
                total[1] += np.bincount(f, minlength=BUCKETS)
                total[0] += np.bincount(f[np.repeat(known[i:j], np.diff(first))], minlength=BUCKETS)
        return total.ravel()

    c = base.sum_arrays(docs, count, 2 * BUCKETS).reshape(2, 2, BUCKETS // 2)
    if not c[0].any():
        return np.zeros(BUCKETS)
    p = (c + 1.0) / (c.sum(2, keepdims=True) + BUCKETS // 2)
    return np.log(p[0] / p[1]).ravel()


def weigh(docs: DataFrame, ratio: np.ndarray, seed: int = 0, whole: bool = False) -> DataFrame:
    """doc_id and, if whole, all other columns of each row, with its log-weight and sample key as the last two columns.

    The sample key is the log-weight plus Gumbel noise, drawn by a hash of id and seed. Text that is null or has no
    token weighs 0. The new columns are log_weight and sample_key, or those names with underscores if they are taken.
    """
    weight, key = base.fresh(docs, "log_weight"), base.fresh(docs, "sample_key")
    seen, text = docs.columns, docs.columns.index("text")
    kept = seen if whole else ["doc_id"]
    shape = T.StructType([*(docs.schema[c] for c in kept), T.StructField(weight, T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = base.texts_of(b.column(text))
            total = np.zeros(len(texts))
            for i, j in base.blocks(texts):
                f, first = _features(texts[i:j])
                total[i:j] = base.add_at(ratio[f], first) / np.maximum(np.diff(first), 1) * SCALE
            yield pa.RecordBatch.from_arrays([*(b.column(seen.index(c)) for c in kept), pa.array(total)], [*kept, weight])

    unit = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return docs.mapInArrow(run, shape).withColumn(key, F.col(weight) - F.log(-F.log(unit)))


def largest(scored: DataFrame, k: int, column: str = "sample_key") -> float:
    """The k-th largest value, by counting in ever finer bins; the driver gets a thousand counts a round."""
    low, high, n = scored.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k >= n:
        return float("-inf")
    for _ in range(12):
        if high <= low:
            break
        step = (high - low) / 1000
        place = F.least(F.floor((F.col(column) - low) / step), F.lit(999)).cast("int")
        inside = scored.where(F.col(column).between(low, high))
        bins = {r[0]: (r[1], r[2], r[3]) for r in inside.groupBy(place.alias("b")).agg(F.count("*"), F.min(column), F.max(column)).collect()}
        for b in sorted(bins, reverse=True):
            if k <= bins[b][0]:
                low, high = bins[b][1:]
                break
            k -= bins[b][0]
    return low


def sample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 0) -> tuple[np.ndarray, DataFrame, float]:
    """Log-ratios, weighed ids, and the sample key from which on a document is in the sample.

    The sample takes `share` of the documents: by default the upper end (two standard errors) of the share of good
    documents among the labelled ones, so that an error of the estimate does not reject good documents. Equal keys at
    the limit are all taken. Without a good label, or on an empty table, everything is.
    """
    ids, good, n = target_ids(labels)
    rows = base.id_and_text(docs)
    ratio = learn(rows, ids)
    weighed = base.cut(weigh(rows, ratio, seed))
    if share is None:
        share = 1.0 if not good else good / n
        share = min(1.0, share + 2 * (share * (1 - share) / max(n, 1)) ** 0.5)
    return ratio, weighed, largest(weighed, int(np.ceil(weighed.count() * share)))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, log_weight, sample_key of the documents in the sample (k of all, without replacement)."""
    _, weighed, limit = sample(docs, labels)
    return weighed.where(F.col("sample_key") >= limit)


def stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents in the sample, with their columns. Rows are weighed again where they are read, without a join."""
    ratio, _, limit = sample(docs, labels)
    weighed = weigh(docs, ratio, whole=True)
    return weighed.where(F.col(weighed.columns[-1]) >= limit).select(*docs.columns)
