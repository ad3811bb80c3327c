"""Similarity join of word 5-gram sets by Jaccard, with prefix, length, positional and suffix filters.

Documents with equal sets are one node. Every node's 5-grams are ordered rare first, by the number of nodes that have
them; two sets with a Jaccard of 0.8 share one of their first n - ceil(0.8 n) + 1. Nodes that share such a 5-gram are
filtered by size, by what the places of the shared 5-gram leave possible, and by a parity bitmap (the suffix filter: it
bounds the size of the difference of the sets from below), and what remains is verified once per pair.

A pair comes in the group of the first 5-gram that both prefixes have. Each entry knows the few 5-grams before its own,
and two entries with one of those in common are left to that group; so a pair comes once for each run of common
5-grams, and never less than once.

For components not every pair is needed. In each group of nodes with a common 5-gram one hub is compared with all
others, then 16, then 256 and so on until all are hubs; pairs that are connected by then are left out, pairs that were
compared do not come again. After each round the graph is contracted: nodes get the label of a neighbour, and links
are kept between labels, each once. So large groups of near copies are connected by few pairs, and no link between
components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycast.llm import base, packed

GROWTH = 16
BEFORE = 4  # 5-grams of the prefix before its own that an entry carries
_SIGNATURE = 512
_RECORD = np.dtype([("key", "<u4"), ("n", "u1")])


def _sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the documents, sorted in each, and where each document's start (n + 1)."""
    values, counts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for i, j in base.blocks(texts):
        buf, at = base.joined(texts[i:j])
        buf = base.LOWER[buf]
        start, end, first = base.words(buf, at)
        s, out = base.shingles(base.hashes(buf, start, end), first)
        doc = base.segment_of(out)
        order = np.lexsort((s, doc))
        s, doc = s[order], doc[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
        values.append(s[new])
        counts.append(np.bincount(doc[new], minlength=j - i))
    return np.concatenate(values), np.cumsum(np.concatenate(counts))


def _members(rows: DataFrame) -> DataFrame:
    """batch, at, doc_id, text_hash (as Spark's xxhash64), n_shingles, node (digest of the set, null if it is empty) of each document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in packed.rows_of(batches):
            batch = packed.opened(row)
            s, first = _sets(batch.texts)
            raw, cut = s.tobytes(), (first * 8).tolist()
            node = [hashlib.blake2b(raw[a:z], digest_size=16).digest() if z > a else None for a, z in zip(cut[:-1], cut[1:], strict=True)]
            n, text_hash = len(node), np.array([xxhash.xxh64_intdigest(x, 42) for x in batch.texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([row["batch"]] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(batch.doc_ids), pa.array(text_hash), pa.array(np.diff(first)), pa.array(node, pa.binary())], ["batch", "at", "doc_id", "text_hash", "n_shingles", "node"])

    return rows.mapInArrow(run, "batch long, at int, doc_id long, text_hash long, n_shingles long, node binary")


def _answer(asked: list[tuple[int, bytes]]) -> list[bytes]:
    """Rarity of each 5-gram asked for: 0 if one node has it, else the logarithm of their number, rounded up."""
    parts = [np.frombuffer(x, _RECORD) for _, x in asked]
    all_ = np.concatenate(parts)
    keys, back = np.unique(all_["key"], return_inverse=True)
    level = np.ceil(np.log2(np.bincount(back, all_["n"]))).astype(np.uint8)[back]
    return [x.tobytes() for x in np.split(level, np.cumsum([len(p) for p in parts])[:-1])]


def nodes(rows: DataFrame, members: DataFrame, threshold: int) -> DataFrame:
    """node, n, signature, grams (sorted hashes), hs and ps (hash and place of 5-grams in the prefix that other nodes have).

    Only nodes with such a 5-gram: the others are linked with nothing. They are dealt out by node, so that joins by node
    move no grams again.
    """
    first = members.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "batch", "at")).alias("first"))
    first = first.groupBy(F.col("first.batch").alias("batch")).agg(F.sort_array(F.collect_list("first.at")).alias("firsts"))
    buckets = base.tasks(rows.sparkSession, packed.megabytes(rows), 50)

    def unique(batch: packed.Batch, row: dict) -> tuple[np.ndarray, ...]:
        s, cut = _sets([batch.texts[i] for i in row["firsts"] or ()])
        return s, cut, *np.unique(s, return_inverse=True, return_counts=True)

    def keys(batch: packed.Batch, row: dict) -> tuple[np.ndarray, np.ndarray]:
        _, _, h, _, n = unique(batch, row)
        records = np.zeros(len(h), _RECORD)
        records["key"], records["n"] = h >> base.U(32), np.minimum(n, 255)
        return records, h

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in packed.rows_of(batches):
            s, cut, h, back, _ = unique(packed.opened(row), row)
            level = np.zeros(len(h), np.uint8)
            for slot, reply in packed.slots(h, buckets, row["replies"]):
                level[slot] = np.frombuffer(reply, np.uint8)
            level = level[back]
            doc, n = base.segment_of(cut), np.diff(cut)
            order = np.lexsort((s, level, doc))
            place = np.arange(len(s)) - cut[doc]
            prefix = n - (n * threshold + 99) // 100 + 1
            kept = np.flatnonzero((place < prefix[doc]) & (level[order] > 0))
            cuts = np.searchsorted(doc[kept], np.arange(len(n) + 1))
            out = []
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                own, at = s[cut[k] : cut[k + 1]], kept[cuts[k] : cuts[k + 1]]
                bits = np.bincount((own >> base.U(7)).astype(np.int64) % _SIGNATURE, minlength=_SIGNATURE) % 2
                out.append({"node": hashlib.blake2b(own.tobytes(), digest_size=16).digest(), "n": len(own), "signature": np.packbits(bits.astype(np.uint8)).view(np.int64).tolist(), "grams": own.tobytes(), "hs": s[order[at]].view(np.int64).tolist(), "ps": place[at].tolist()})
            if out:
                yield pa.RecordBatch.from_pylist(out, shape)

    shape = pa.schema([("node", pa.binary()), ("n", pa.int32()), ("signature", pa.list_(pa.int64())), ("grams", pa.binary()), ("hs", pa.list_(pa.int64())), ("ps", pa.list_(pa.int32()))])
    asked = packed.ask(rows.join(first, "batch"), keys, _answer, buckets, ("firsts",))
    found = asked.mapInArrow(run, "node binary, n int, signature array<long>, grams binary, hs array<long>, ps array<int>")
    return base.cut(found.repartition(buckets, "node"))


def _possible(x: str, y: str, threshold: int) -> Column:
    """Whether two entries of a group (structs or aliases with n and place) can be of similar sets.

    By length; and by place: no more can be shared than stands before the shared 5-gram in both, it, and after it in both.
    """
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    most = 1 + F.least(f"{x}.place", f"{y}.place") + F.least(n - 1 - F.col(f"{x}.place"), m - 1 - F.col(f"{y}.place"))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * threshold) & (most >= _need(n, m, threshold))


def _need(n: Column, m: Column, threshold: int) -> Column:
    """Shared elements that make sets of n and m similar."""
    return F.ceil((n + m) * threshold / float(100 + threshold) - 1e-9)


def _alike(x: Column, y: Column, n: Column, m: Column, threshold: int) -> Column:
    """Whether sets with these signatures can be similar: they differ in at least as many elements as their parity bitmaps in bits."""
    apart = sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(_SIGNATURE // 64)), F.lit(0))
    return apart <= n + m - 2 * _need(n, m, threshold)


def _candidates(entries: DataFrame, labels: DataFrame | None, hubs: int, before: int, threshold: int) -> DataFrame:
    """Pairs (a, b) of nodes of which one is a hub of their first common group, of different labels, that pass the filters.

    Pairs of which one was a hub before are left out, and so are groups all of whose nodes were.
    """
    entries = entries.where(F.col("m") > before)
    if labels is not None:
        entries = entries.join(labels.withColumnRenamed("x", "node").hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    else:
        entries = entries.withColumn("label", F.col("node"))

    def hub(of: str, number: int) -> Column:
        draw = (F.shiftrightunsigned(F.col(f"{of}.u"), 11) / float(1 << 53)) * F.col(f"{of}.m") < number
        return F.lit(False) if not number else (F.col(f"{of}.u") == F.col(f"{of}.least")) | (draw if number > 1 else F.lit(False))

    x, y = entries.alias("x"), entries.alias("y")
    new = (~hub("y", hubs) | (F.col("x.node") < F.col("y.node"))) & ~(hub("x", before) | hub("y", before))
    new &= ~F.arrays_overlap("x.earlier", "y.earlier")
    pairs = x.where(hub("x", hubs)).join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.label") != F.col("y.label")) & new & _possible("x", "y", threshold) & _alike(*(F.col(c) for c in ("x.signature", "y.signature", "x.n", "y.n")), threshold))
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """a, b, n_shared, n_union of the pairs that are similar."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ga, gb = (c.to_pylist() for c in batch.columns)
            sizes = []
            for p, q in zip(ga, gb, strict=True):
                s, t = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                shared = int((s[np.minimum(np.searchsorted(s, t), len(s) - 1)] == t).sum())
                sizes.append((shared, len(s) + len(t) - shared))
            good = [i for i, (s, u) in enumerate(sizes) if 100 * s >= threshold * u]
            yield pa.RecordBatch.from_arrays([pa.array([v[i] for i in good], pa.binary()) for v in (a, b)] + [pa.array([sizes[i][k] for i in good], pa.int64()) for k in (0, 1)], ["a", "b", "n_shared", "n_union"])

    grams = sets.select("node", "grams")
    both = pairs.distinct().join(grams.toDF("a", "ga"), "a").join(grams.toDF("b", "gb"), "b").select("a", "b", "ga", "gb")
    return base.cut(both.mapInArrow(run, "a binary, b binary, n_shared long, n_union long"))


def _groups(sets: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of the groups of two that pass the filters, and the entries of larger groups.

    A group is what has a 5-gram in its prefixes. An entry is a row for each of its nodes: h, node, n, place, signature,
    a draw u, earlier (the shared 5-grams just before h in the node's prefix), and m, least: size and least draw of the
    group. Groups of two, which most are, come from one aggregate.
    """
    rows = sets.select("node", "n", F.xxhash64("node").alias("u"), F.posexplode(F.arrays_zip("hs", "ps")).alias("i", "e"))
    rows = rows.select("node", "n", "u", "i", F.col("e.hs").alias("h"), F.col("e.ps").alias("place"))
    entry, two = F.struct("node", "n", "place"), F.col("m") == 2
    groups = rows.groupBy("h").agg(F.count("*").alias("m"), F.min("u").alias("least"), F.min(entry).alias("x"), F.max(entry).alias("y")).where("m >= 2")
    ends = (F.when(two & _possible("x", "y", threshold), F.col(f"{of}.node")).alias(name) for of, name in (("x", "a"), ("y", "b")))
    groups = base.cut(groups.select("h", "m", "least", *ends).where("m > 2 or a is not null"))
    own = sets.select("node", "signature", "hs")
    earlier = F.slice("hs", F.greatest(F.col("i") - BEFORE + 1, F.lit(1)), F.least("i", F.lit(BEFORE))).alias("earlier")
    full = sets.select("node", "signature", "n")
    pairs = groups.where(two).select("a", "b").distinct().join(full.toDF("a", "sa", "na"), "a").join(full.toDF("b", "sb", "nb"), "b")
    pairs = pairs.where(_alike(F.col("sa"), F.col("sb"), F.col("na"), F.col("nb"), threshold)).select("a", "b")
    entries = rows.join(groups.where("m > 2").select("h", "m", "least"), "h").join(own, "node")
    return pairs, base.cut(entries.select("h", "node", "n", "u", "place", "m", "least", "signature", earlier))


def components(edges: DataFrame) -> DataFrame:
    """x, label: of each node with an edge (a, b), the least node that edges lead to. Labels spread over edges and jump to their own labels until none changes."""
    both = base.cut(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionAll(edges.select("b", "a")))
    labels = base.cut(both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("label")))
    while True:
        spread = both.join(labels.withColumnRenamed("x", "y").hint("merge"), "y").groupBy("x").agg(F.min("label").alias("near"))
        new = labels.join(spread.hint("merge"), "x").select("x", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("x").alias("label"), F.col("label").alias("far"))
        new = base.cut(new.join(jump.hint("merge"), "label").select("x", "was", F.least("label", "far").alias("label")))
        if new.where("label != was").isEmpty():
            return labels
        labels = new.drop("was")


def links(sets: DataFrame, threshold: int = 80) -> DataFrame:
    """a, b, n_shared, n_union of all pairs of similar nodes (see nodes), each once."""
    two, entries = _groups(sets, threshold)
    largest = entries.agg(F.max("m")).first()[0] or 1
    return _verified(two.unionAll(_candidates(entries, None, largest + 1, 0, threshold)), sets, threshold)


def connected(sets: DataFrame, threshold: int = 80) -> DataFrame:
    """x, label of each node that is linked with another, by as few verified pairs as the groups allow."""
    two, entries = _groups(sets, threshold)
    largest = entries.agg(F.max("m")).first()[0] or 1
    edges = _verified(two.unionAll(_candidates(entries, None, 1, 0, threshold)), sets, threshold).select("a", "b")
    labels, edges = _contracted(None, edges)
    hubs = 1
    while hubs < largest:
        hubs, before = hubs * GROWTH, hubs
        found = _verified(_candidates(entries, labels, hubs, before, threshold), sets, threshold).select("a", "b")
        labels, edges = _contracted(labels, edges.unionAll(found))
    ends = components(_relabelled(edges, labels)).toDF("label", "end")
    return labels.join(ends.hint("merge"), "label", "left").select("x", F.coalesce("end", "label").alias("label"))


def _relabelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges (a, b) between the labels of their ends, each once, a < b; what has no label is its own."""
    for end in ("a", "b"):
        edges = edges.join(labels.toDF(end, "label").hint("merge"), end, "left").withColumn(end, F.coalesce("label", end)).drop("label")
    return edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _contracted(labels: DataFrame | None, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels (x, label) after another step over the edges, and the edges between the labels of before.

    Each label goes to its neighbour with the least draw, if that is less than its own, and on to that one's, if it ends
    there; else it stays. So a label is always its own label, and what it has led to is connected. Labels that are
    connected may stay apart, which only makes more pairs be compared. Labels grow with the documents, so joins with them
    are merge joins: nothing is broadcast from the driver.
    """
    edges = edges if labels is None else base.cut(_relabelled(edges, labels))
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionAll(edges.select("b", "a"))
    near = both.groupBy("x").agg(F.min(F.struct(F.xxhash64("y").alias("u"), "y")).alias("best"))
    near = near.select("x", F.when(F.col("best.u") < F.xxhash64("x"), F.col("best.y")).otherwise(F.col("x")).alias("to"))
    step = near.toDF("to", "next").hint("merge")
    two = near.join(step, "to").select("x", F.col("next").alias("to")).join(step, "to")
    moved = two.select("x", F.when(F.col("next") == F.col("to"), F.col("to")).otherwise(F.col("x")).alias("label"))
    if labels is None:
        return base.cut(moved), edges
    moved = moved.toDF("label", "new")
    known = labels.unionAll(moved.select(F.col("label").alias("x"), "label")).distinct()
    return base.cut(known.join(moved.hint("merge"), "label", "left").select("x", F.coalesce("new", "label").alias("label"))), edges


def _rooted(docs: DataFrame, threshold: int) -> DataFrame:
    """Members with root, the label of their component; null without shingles."""
    rows = packed.pack(docs)
    members = base.cut(_members(rows))
    labels = connected(nodes(rows, members, threshold), threshold)
    return members.join(labels.withColumnRenamed("x", "node"), "node", "left").withColumn("root", F.coalesce("label", "node"))


def classes(docs: DataFrame, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of each row; threshold in percent.

    component_id is the smallest doc_id that links lead to, the own included; a null doc_id is the smallest. Documents
    with equal sets are linked. A text without words, or null, has no shingles and no links; one with fewer than five
    words has one shingle, all of them. Repeated rows are linked like any copies.
    """
    rooted = _rooted(docs, threshold)
    least = rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component"))
    real = lambda c: F.when(c != packed.NO_ID, c)
    out = rooted.join(least, "root", "left").withColumn("component", F.coalesce("component", "doc_id"))
    return out.select(real(F.col("doc_id")).alias("doc_id"), "n_shingles", real(F.col("component")).alias("component_id"))


def stage(docs: DataFrame, threshold: int = 80) -> DataFrame:
    """One document of each component with its columns: the one with the smallest doc_id (null first), then text hash.

    Of rows with equal doc_id and text one stays, whatever their other columns. Rows without words are linked with
    nothing and all stay, also with equal or null ids.
    """
    rooted = _rooted(docs, threshold)
    me = F.struct("doc_id", "text_hash").alias("me")
    kept = rooted.where("root is not null").groupBy("root").agg(F.min(me).alias("me"))
    name = base.fresh(docs, "row_key")
    key = lambda i, h: F.concat_ws(":", i.cast("string"), h.cast("string"))
    kept = kept.select(key(F.col("me.doc_id"), F.col("me.text_hash")).alias(name)).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    has_words = text.rlike(r"[^\x20\x09-\x0D]")
    own = key(F.coalesce(F.col("doc_id").cast("long"), F.lit(packed.NO_ID)), F.xxhash64(text))
    once = docs.where(has_words).withColumn(name, own).join(kept, name).dropDuplicates([name]).select(*docs.columns)
    return once.unionAll(docs.where(~has_words))
