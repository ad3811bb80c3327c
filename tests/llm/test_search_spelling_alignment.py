"""Nearest neighbours, spelling variants and tokenizer alignment against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from handmade_text import SHAPE, odd_documents
from tokenizers import Tokenizer

from tallycast.llm import alignment, base, multi_index, spelling

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, score string, rank int, row string, query string"


# 11


def exact_neighbours(rows, k, every):
    """(query_id, rank, vec_id, score) of each usable query row, by a full scan."""
    width = max((len(v) for _, v in rows if v), default=0)
    good = []
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.append((i, np.array([*v, *[0.0] * (width - len(v))])))
    out = []
    for q, (i, v) in enumerate(good):
        if i % every == 0:
            near = sorted((-math.fsum(v * w), j, e) for e, (j, w) in enumerate(good) if e != q)[:k]
            out += [(i, r + 1, j, round(-s, 9)) for r, (s, j, _) in enumerate(near)]
    return Counter(out)


def found(df, **kw):
    return Counter((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in multi_index.search(df, **kw).collect())


def test_neighbours_of_odd_vectors_are_exact(spark):
    rng = np.random.default_rng(3)
    f32 = lambda n: [float(x) for x in rng.normal(size=n).astype(np.float32)]
    rows = [(i, f32(6)) for i in range(60)]
    rows += [(60, None), (61, []), (62, [0.0] * 6), (63, [1.0, None, 0.0]), (64, [1.0, float("nan"), 0.0]), (65, [float("inf"), 1.0]), (None, f32(6))]
    rows += [(80, rows[0][1]), (100, rows[0][1]), (100, rows[0][1]), (120, f32(3)), (140, f32(1))]
    df = spark.createDataFrame([(i, v, "s", 1, "r", "q") for i, v in rows], VECTORS).repartition(3)
    assert found(df, miss=0.0) == exact_neighbours(rows, 20, 20)
    few = spark.createDataFrame([(i, v, "s", 1, "r", "q") for i, v in rows[:5]], VECTORS)
    assert found(few) == exact_neighbours(rows[:5], 20, 20)


def test_no_vectors_no_neighbours(spark):
    none = spark.createDataFrame([], VECTORS)
    assert multi_index.search(none).collect() == []
    assert multi_index.search(spark.createDataFrame([(0, None, "", 1, "", "")], VECTORS)).collect() == []
    one = multi_index.search(spark.createDataFrame([(0, [1.0], "", 1, "", "")], VECTORS))
    assert one.collect() == [] and one.columns == ["query_id", "rank", "vec_id", "score"]


def test_copies_that_fill_several_chunks_keep_the_smallest_ids(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "CHUNK", 16)
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 2.0, 0.5, -1.0] if i % 3 == 0 else [float(x) for x in rng.normal(size=4).astype(np.float32)]) for i in range(300)]
    df = spark.createDataFrame([(i, v, "s", 1, "r", "q") for i, v in rows], VECTORS)
    assert found(df, k=5, miss=0.0) == exact_neighbours(rows, 5, 20)


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = exact_neighbours(rows, 20, 20)
    pairs = {(q, v) for q, _, v, _ in want}
    got = multi_index.search(df).collect()
    assert len(got) == len(pairs)
    assert len(pairs & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(pairs)
    assert {(r.query_id, r["rank"]) for r in got} == {(q, r) for q, r, _, _ in want}


def test_walk_visits_every_pair_by_descending_sum():
    a, b = np.array([0.3, -1.0, 0.3, 2.0]), np.array([0.0, 0.5, 0.5])
    pairs = list(multi_index.walk((a, b)))
    assert len(set(pairs)) == len(pairs) == 12
    sums = [a[i] + b[j] for i, j in pairs]
    assert sums == sorted(sums, reverse=True)


# 12


def brute_variants(docs, min_length=5, min_count=3, factor=2):
    c = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            c[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in c.items() if n >= min_count and len(w) >= min_length}
    near, shape = defaultdict(set), defaultdict(set)
    for w in words:
        for p in range(len(w)):
            shape[w[:p], w[p + 1 :]].add(w)
            if (less := w[:p] + w[p + 1 :]) in words:
                near[w].add(less)
                near[less].add(w)
    for same in shape.values():
        for w in same:
            near[w] |= same - {w}
    form = {}
    for w in words:
        if near[w] and words[best := min(near[w], key=lambda y: (-words[y], y))] >= factor * words[w]:
            form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return out


def got_variants(docs, **kw):
    rows = spelling.variants(docs, **kw).collect()
    assert len({r.word for r in rows}) == len(rows)
    return {tuple(r) for r in rows}


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "l", "s", 1, "k", "l", 1, 1, "g", 1, "w", "y") for i, t in rows], SHAPE).repartition(3)


def test_variants_of_real_texts(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert got_variants(df) == brute_variants([(r.doc_id, r.text) for r in df.collect()])


def made_up(seed, n):
    rnd = random.Random(seed)
    stems = ["".join(rnd.choice("abé") for _ in range(rnd.randint(1, 9))) for _ in range(40)] + ["a" * 300, "a" * 299 + "b", "ÀÿÀÿÀ", "àÿÀÿÀ"]
    out = []
    for k in range(n):
        w = rnd.choice(stems)
        p = rnd.randint(0, len(w))
        w = rnd.choice([w, w, w[:p] + rnd.choice("abé") + w[p:], w[:p] + w[p + 1 :], w[:p] + rnd.choice("abÉ") + w[p + 1 :], w.upper()])
        out.append((k % 70 if k % 11 else None, f"{w} {rnd.choice(stems)},{w}-{w}Ā{w}×{w}"))
    return out


@pytest.mark.parametrize("length", [1, 5])
def test_variants_of_short_long_and_accented_words(spark, length):
    rows = [*made_up(length, 1500), (None, None), (3, ""), (4, "12 . !")]
    df = documents(spark, rows)
    assert got_variants(df, min_length=length) == brute_variants(rows, min_length=length)


def test_large_lists_are_halved_without_loss(spark):
    words = base.cut(spelling.vocabulary(documents(spark, made_up(9, 1500)), 1, 1))
    whole, halved = ({tuple(r) for r in spelling.near_words(words, limit=n).collect()} for n in (10**6, 2))
    assert whole == halved and len(whole) > 50


def test_odd_documents_and_none(spark):
    rows = odd_documents()
    df = spark.createDataFrame(rows, SHAPE).repartition(2)
    assert got_variants(df) == brute_variants([(i, t) for i, t, *_ in rows])
    none = spelling.variants(spark.createDataFrame([], SHAPE))
    assert none.collect() == [] and none.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    with pytest.raises(ValueError):
        spelling.variants(df, factor=1)


def test_carried_checksums():
    words = [b"", b"a", b"abc" * 50, "né".encode(), b"word"]
    buf, at = base.joined(words)
    before = np.array([zlib.crc32(b"%d:" % k) for k in range(len(words))], np.uint32)
    got = spelling._crcs(buf, at[:-1], np.diff(at) - 1, before)
    assert got.tolist() == [zlib.crc32(b"%d:" % k + w) for k, w in enumerate(words)]


# 13


@pytest.fixture(scope="module")
def tools():
    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
    first = Tokenizer.from_file(path)
    first.encode_special_tokens = True
    return Path(path).read_text(encoding="utf-8"), model, first, sentencepiece.SentencePieceProcessor(model_proto=model)


def spans(ids, pieces):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(pieces[i]), i))
        at += len(pieces[i])
    return out


def brute_alignment(docs, tools):
    """Rows of align and the links of each id pair, from whole texts and all pairs of tokens of a group."""
    text, model, first, second = tools
    mark = alignment._byte_of_mark()
    names = [first.id_to_token(i) for i in range(first.get_vocab_size())]
    one = [bytes(mark[c] for c in n) if all(c in mark for c in n) else n.encode() for n in names]
    two = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(second.id_to_piece, range(second.get_piece_size())))]
    rows, links = [], Counter()
    for i, t in docs:
        whole = (" " + (t or "")).encode()
        a, b = (first.encode(whole.decode(), add_special_tokens=False).ids, second.encode(t)) if t else ([], [])
        if b"".join(one[x] for x in a) != whole or b"".join(two[x] for x in b) != whole:
            rows.append((i, [], [], 0, [], ""))
            continue
        a, b = spans(a, one), spans(b, two)
        ends = sorted({y for _, y, _ in a} & {y for _, y, _ in b})
        groups, own = [], []
        for low, high in zip([0, *ends], ends, strict=False):
            ga, gb = ([x for x in s if low < x[1] <= high] for s in (a, b))
            groups.append(",".join(str(x[2]) for x in ga) + "|" + ",".join(str(x[2]) for x in gb))
            own += [(x[2], y[2]) for x in ga for y in gb if x[0] < y[1] and y[0] < x[1]]
        links.update(own)
        rows.append((i, a, b, len(ends), own, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = Counter()
    for (_, y), n in links.items():
        top[y] = max(top[y], n)
    return Counter((i, len(a), len(b), g, len(own), sum(links[x] == top[x[1]] for x in own), sum(links[x] for x in own), h) for i, a, b, g, own, h in rows), links


def odd_texts():
    rnd = random.Random(5)
    letters = "ab c\n\t  '.1é 　\u0085▁日<s>\r\x00 ñ​ "
    parts = ["it's", "é", "\n", "a\nb", "<|endoftext|>", "<s>", "x\n", "日本", " ", "«a»", "́", "'s", "1 2", "don't", " "]
    out = [(1000 + k, "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60)))) for k in range(600)]
    return out + [(2000 + k, rnd.choice([" ", "\n"]).join(rnd.choice(parts) for _ in range(rnd.randint(0, 20)))) for k in range(600)]


def test_alignment_of_odd_texts(spark, tools):
    rows = [(i, t) for i, t, *_ in odd_documents() if not t or len(t) < 20_000] + odd_texts()
    want, links = brute_alignment(rows, tools)
    df = documents(spark, rows)
    assert Counter(tuple(r) for r in alignment.align(df, tools[0], tools[1]).collect()) == want
    assert sum(1 for r in want if r[1] == 0) > 3
    both = alignment.Alignment(df, tools[0], tools[1], batch_bytes=2000)
    assert Counter(tuple(r) for r in both.documents().collect()) == want
    table = both.links().collect()
    assert {(r.a, r.b): r["count"] for r in table} == dict(links)
    assert all(r.best == (r["count"] == max(n for (_, y), n in links.items() if y == r.b)) for r in table[:200])


def test_alignment_of_real_texts_in_several_copies_of_buckets(spark, tools, monkeypatch):
    monkeypatch.setattr(alignment, "COPY_BATCHES", 2)
    monkeypatch.setattr(alignment, "BUCKET_PAIRS", 300)
    df = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = alignment.Alignment(documents(spark, rows), tools[0], tools[1], batch_bytes=20_000)
    assert Counter(tuple(r) for r in got.documents().collect()) == brute_alignment(rows, tools)[0]


def test_alignment_of_nothing_and_of_other_tokenizers(spark, tools):
    none = alignment.align(spark.createDataFrame([], SHAPE), tools[0], tools[1])
    assert none.collect() == [] and none.columns == list(alignment.COLUMNS)
    other = Path(public_tokenizers.path("word_bpe_49k.json")).read_text(encoding="utf-8")
    with pytest.raises(ValueError):
        alignment.align(none.selectExpr("doc_id", "'x' AS text"), other, tools[1])
