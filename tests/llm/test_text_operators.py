import hashlib
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from handmade_text import SHAPE, covered, odd_documents, one_edit, sentence, shingle_set, similar
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallycast.llm import base, bpe, decontaminate, fingerprint, jaccard, language, lines, packed, quality, substring, suffix, tokens

SF = "/root/testdata/sf0.001"


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def tokenizer(name):
    path = public_tokenizers.path(name)
    return Path(path).read_text(encoding="utf-8"), Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_documents(), SHAPE).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SHAPE)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# 1


@pytest.mark.parametrize("source", ["odd", "real"])
def test_suffix_removal_equals_brute_force(request, source):
    df = request.getfixturevalue(source)
    docs = rows_of(df)
    gone = covered([(t or "").encode() for _, t in docs], 200)
    want = Counter()
    for (i, t), g in zip(docs, gone, strict=True):
        kept = bytes(b for b, m in zip((t or "").encode(), g, strict=True) if not m)
        spans = sum(1 for k in range(len(g)) if g[k] and not (k and g[k - 1]))
        want[(i, len(g), len(g) - len(kept), spans, sha(kept))] += 1
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.repeats(df).collect())
    assert got == want
    assert any(k[2] for k in got)


def test_suffix_other_lengths_and_empty(spark, none):
    assert suffix.repeats(none).count() == 0
    with pytest.raises(ValueError, match="128"):
        suffix.repeats(none, 100)
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab"), 700)) for _ in range(6)]
    texts += [texts[0][100:400] + texts[1][:350], "ab" * 300, texts[2][5:260]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for length in (128, 150, 301):
        want = {i: sum(g) for i, g in enumerate(covered([t.encode() for t in texts], length))}
        assert {r["doc_id"]: r["n_removed"] for r in suffix.repeats(df, length).collect()} == want


def test_suffix_levels_merge_geometrically():
    index, total = suffix.Levels(False), 0
    for k in range(1, 40):
        rows = np.zeros(10, suffix._SUFFIX)
        rows["a"] = np.arange(k * 10, k * 10 + 10)
        index.add(rows)
        total += 10
        sizes = [len(x) for x in index.levels]
        assert sum(sizes) == total and all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))


# 2


def test_quality_keeps_good_and_rejects_bad(spark):
    real, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept = {r[0] for r in quality.classify(real, labels).select("doc_id").collect()}
    by = {q: [r["doc_id"] in kept for r in labels.where(F.col("quality") == q).collect()] for q in (0, 1)}
    assert np.mean(by[1]) >= 0.97
    assert np.mean(by[0]) <= 0.25
    assert kept == {r[0] for r in quality.stage(real, labels).select("doc_id").collect()}


def test_quality_sample_is_gumbel_top_k(spark):
    scored = spark.range(1000).select((F.pmod(F.xxhash64("id"), F.lit(97)) / 7.0).alias("sample_key"))
    values = sorted((r[0] for r in scored.collect()), reverse=True)
    for k in (1, 2, 500, 999):
        assert quality.largest(scored, k) == values[k - 1]
    assert quality.largest(scored, 1000) == float("-inf")


def test_quality_odd_cases(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 0, 0), (14, 0, 0), (None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(none, labels).count() == 0
    assert quality.stage(none, labels).columns == none.columns
    assert quality.stage(odd, labels.limit(0)).count() == odd.count()
    kept = quality.stage(odd, labels)
    assert kept.columns == odd.columns and 0 < kept.count() <= odd.count()
    assert quality.target_ids(labels) == ([1], 1, 3)


# 3


@pytest.mark.parametrize("source", ["odd", "real"])
def test_line_dedup_equals_brute_force(request, source):
    df = request.getfixturevalue(source)
    order = lambda i: -1 if i is None else i
    docs = {(order(i), t) for i, t in rows_of(df) if t is not None}
    hashed = {(order(r["doc_id"]), r["text"]): r["h"] for r in df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    all_ = sorted((i, k, hashed[i, t], x) for i, t in docs for k, x in enumerate(t.split("\n")) if len(x) >= 16)
    want, by_length = set(), {}
    for i, k, h, x in all_:
        near = [p for n in (-1, 0, 1) for p in by_length.get(len(x) + n, ()) if p[3] != x and one_edit(p[3], x)]
        same = [p for p in all_ if p[3] == x][0]
        first = min((p for p in near if p[:3] < same[:3]), default=None) if near else None
        if first or same[:3] != (i, k, h):
            want.add((i, k, *(first or same)[:2]))
        by_length.setdefault(len(x), []).append((i, k, h, x))
    got = {(order(r["doc_id"]), r["line_no"], order(r["kept_doc_id"]), r["kept_line_no"]) for r in lines.repeated(df).collect()}
    assert got == want and want


def test_line_dedup_stage(odd, none):
    out = lines.stage(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    by_id = {r["doc_id"]: r["text"] for r in out.collect() if r["doc_id"] in (1, 4, 5, 11, 12)}
    assert by_id[12] == sentence(10, 30)
    assert "same line of text here" in by_id[11] and by_id[4] is None and by_id[5] == ""
    assert lines.stage(none).count() == 0 and lines.repeated(none).count() == 0


def test_line_dedup_is_native(odd):
    plan = lines.repeated(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("length", [16, 17, 19, 20, 33, 61])
def test_line_variants_meet_for_every_edit(spark, length):
    line = "".join(chr(97 + (k * k + k // 3) % 26) for k in range(length))
    edits = [line[:k] + "#" + line[k + 1 :] for k in range(length)] + [line[:k] + "#" + line[k:] for k in range(length + 1)]
    edits += [line[:k] + line[k + 1 :] for k in range(length)] if length > 16 else []
    df = spark.createDataFrame([(0, line), *((1 + k, x) for k, x in enumerate(edits))], "doc_id long, text string")
    got = {r["doc_id"]: r["kept_doc_id"] for r in lines.repeated(df).collect()}
    assert got == {1 + k: 0 for k in range(len(edits))}


@pytest.mark.parametrize("source", ["odd", "real", "short"])
def test_line_dedup_of_short_lines_equals_brute_force(request, spark, source):
    if source == "short":
        rng = np.random.default_rng(8)
        texts = ["\n".join("".join(rng.choice(list("abc日"), rng.integers(0, 6))) for _ in range(12)) for _ in range(12)]
        texts += ["0123456789abcde\n0123456789abcdef\n0123456789abcdeXf", "}\n0123456789abcdf\n0123456789abcdef", "{\n0123456789abcde"]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    else:
        df = request.getfixturevalue(source)
    order = lambda i: -1 if i is None else i
    hashed = {(order(r["doc_id"]), r["text"]): r["h"] for r in df.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    all_ = sorted((i, k, h, x) for (i, t), h in hashed.items() for k, x in enumerate(t.split("\n")) if x)
    first, by_length, want = {}, {}, set()
    for i, k, h, x in all_:
        if x not in first:
            first[x] = (i, k, h)
            near = [first[y] for n in (-1, 0, 1) for y in by_length.get(len(x) + n, ()) if one_edit(y, x)]
            by_length.setdefault(len(x), []).append(x)
            first[x, "near"] = min(near, default=None)
        kept = first[x, "near"] or first[x]
        if kept != (i, k, h):
            want.add((i, k, *kept[:2]))
    got = {(order(r["doc_id"]), r["line_no"], order(r["kept_doc_id"]), r["kept_line_no"]) for r in lines.repeated(df, 1).collect()}
    assert got == want and want


def test_line_dedup_query_and_stage_take_short_lines(spark, tmp_path):
    from tallycast.llm import queries

    df = spark.createDataFrame([(1, "end\nsome text"), (2, "end\nother things"), (3, "")], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r) for r in queries.op3_line_dedup(spark, str(tmp_path)).collect()] == [(2, 0, 1, 0, True)]
    assert {r["doc_id"]: r["text"] for r in lines.stage(df).collect()} == {1: "end\nsome text", 2: "other things", 3: ""}


# 4


@pytest.mark.parametrize("width", [1, 7, 8, 11, 16, 17, 24, 31])
def test_packing_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 2**width, 1000).astype(np.uint32)
    payload = tokens.pack(ids, width)
    assert len(payload) == -(-1000 * width // 8)
    for a, b in ((0, 1000), (0, 0), (13, 14), (500, 977), (999, 1000)):
        assert (tokens.unpack(payload, width, a, b) == ids[a:b]).all()


@pytest.mark.parametrize("source", ["odd", "real"])
def test_token_files_equal_the_tokenizer(request, spark, tmp_path, source):
    df, (text, t) = request.getfixturevalue(source), tokenizer("byte_bpe_50k.json")
    path = str(tmp_path / "files")
    tokens.write(df, path, text)
    got = tokens.read(spark, path).orderBy("start").collect()
    start, want, ids_by_doc = 0, [], {}
    rows = df.select("doc_id", "text", F.xxhash64("text")).collect()
    for i, x, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[2])):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        ids_by_doc.setdefault(i, []).append(ids)
        start += len(ids)
    assert [tuple(r) for r in got] == want
    some = [i for i in ids_by_doc if i is not None][:3]
    found = {r["doc_id"]: r["ids"] for r in tokens.ids_of(spark, path, some).collect()}
    assert all(found[i] in ids_by_doc[i] for i in some)
    assert {r["width"] for r in spark.read.parquet(path).select("width").collect()} == {16}


def test_token_files_of_an_empty_table(spark, none, tmp_path):
    tokens.write(none, str(tmp_path / "e"), tokenizer("byte_bpe_50k.json")[0])
    assert tokens.read(spark, str(tmp_path / "e")).count() == 0


# 5


def components(docs):
    sets = [shingle_set(t) for _, t in docs]
    top = list(range(len(docs)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if similar(sets[a], sets[b]):
                top[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        least.setdefault(find(k), []).append(i)
    smallest = {r: None if None in v else min(v) for r, v in least.items()}
    return Counter((i, len(sets[k]), smallest[find(k)]) for k, (i, _) in enumerate(docs))


@pytest.mark.parametrize("source", ["odd", "real"])
def test_jaccard_components(request, source):
    df = request.getfixturevalue(source)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.classes(df).collect())
    assert got == components(rows_of(df))


def test_jaccard_large_group_and_all_links(spark):
    rng, words = np.random.default_rng(5), sentence(20, 150).split()
    texts = []
    for _ in range(120):
        own = list(words)
        for k in rng.choice(150, rng.integers(0, 9), replace=False):
            own[k] = f"w{rng.integers(10**6)}"
        texts.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.classes(df).collect()) == components(list(enumerate(texts)))
    sets = [shingle_set(t) for t in {" ".join(sorted(map(str, shingle_set(t)))): t for t in texts}.values()]
    rows = packed.pack(df)
    nodes = jaccard.nodes(rows, base.cut(jaccard._members(rows)), 80)
    want = sum(similar(a, b) for k, a in enumerate(sets) for b in sets[:k])
    got = jaccard.links(nodes)
    assert got.count() == got.select("a", "b").distinct().count() == want


def test_jaccard_stage(odd, none):
    out = jaccard.stage(odd)
    ids = [r["doc_id"] for r in out.collect()]
    assert out.columns == odd.columns
    assert ids.count(None) == 2 and 1 not in ids and 2 not in ids and 3 not in ids
    assert ids.count(12) == 1 and {4, 5, 6, 7, 8, 9, 13, 14} <= set(ids)
    assert jaccard.stage(none).count() == 0 and jaccard.classes(none).count() == 0


def test_jaccard_stage_keeps_all_rows_without_words(spark):
    texts = [(None, "", "a"), (None, "", "b"), (None, None, "c"), (3, "", "d"), (3, "", "e"), (3, " \t\n", "f"), (4, "\u00a0", "g"), (4, "\u00a0", "h"), (5, "some words", "i"), (6, "some words", "j")]
    df = spark.createDataFrame(texts, "doc_id long, text string, key string")
    kept = sorted(r["key"] for r in jaccard.stage(df).collect())
    assert kept[:6] == list("abcdef") and kept[7:] == ["i"] and kept[6] in "gh"


# 6


def test_decontamination_equals_exact_containment(spark, odd, none, real):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    own = [(1, sentence(2, 70)), (2, sentence(2, 70)), (2, sentence(2, 70)), (3, "short"), (4, ""), (5, None), (6, sentence(40, 30)), (7, sentence(2, 60) + " other words at the end"), (None, sentence(12, 9))]
    small = spark.createDataFrame(own, "item_id long, text string")
    for docs, items in ((real, bench), (odd, small)):
        sets = [(i, shingle_set(t)) for i, t in rows_of(docs)]
        distinct = {(r["item_id"], r["text"]) for r in items.collect() if r["text"]}
        want = Counter()
        for item, text in distinct:
            s = shingle_set(text)
            for i, d in sets:
                if s and len(s & d) >= 0.8 * len(s):
                    want[(i, item, len(s & d), len(s))] += 1
        got = Counter((r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in decontaminate.search(docs, items).collect())
        assert got == want and want
    assert decontaminate.search(none, small).count() == 0 and decontaminate.search(odd, small.limit(0)).count() == 0
    kept = decontaminate.stage(odd, small)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert not {9, 18, 16, 7} & set(ids) and ids.count(10) == 1 and ids.count(12) == 2
    assert decontaminate.stage(odd, small.limit(0)).count() == odd.count()


def test_decontamination_in_blocks_of_items(spark, real, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = Counter(map(tuple, decontaminate.search(real, bench).collect()))
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", 16)
    assert Counter(map(tuple, decontaminate.search(real, bench).collect())) == whole


# 7


def test_language_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.identify(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_mixture(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names, table = language.learn(df.where(~language.held_out()))
    pick = {x: df.where((F.col("lang") == x) & language.held_out() & F.col("n_chars").between(1500, 4000)).first()["text"] for x in ("en", "de")}
    half = spark.createDataFrame([(0, pick["en"][:1500] + " " + pick["de"][:1500]), (1, pick["de"])], "doc_id long, text string")
    got = {r["doc_id"]: {x["lang"]: x["share"] for x in r["langs"]} for r in language.predict(half, names, table).collect()}
    assert got[1] == {"de": 1.0}
    assert set(got[0]) == {"de", "en"} and abs(got[0]["en"] - 0.5) < 0.15


def test_language_odd_cases(spark, odd, none):
    got = {r["doc_id"]: r for r in language.identify(odd).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (4, 5, 6, 14))
    assert got[13]["lang_pred"] == "aa" and got[17]["lang_pred"] == "aa"
    assert language.identify(none).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# 8


@pytest.mark.parametrize("source", ["odd", "real"])
def test_bpe_equals_the_tokenizer(request, source):
    df, (text, t) = request.getfixturevalue(source), tokenizer("word_bpe_49k.json")
    want = Counter()
    for i, x in rows_of(df):
        ids = t.encode(x or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        want[(i, tuple(ids), len(ids), sha(" ".join(map(str, ids)).encode()), decoded, sha(decoded.encode()))] += 1
    got = Counter((r["doc_id"], tuple(r["ids"]), r["n_tokens"], r["ids_sha256"], r["decoded"], r["decoded_sha256"]) for r in bpe.encode(df, text).collect())
    assert got == want


def test_bpe_empty_and_decoder(none):
    assert bpe.encode(none, tokenizer("word_bpe_49k.json")[0]).count() == 0
    with pytest.raises(ValueError, match="decoder"):
        bpe.encode(none, tokenizer("byte_bpe_50k.json")[0])


# 9


def test_chunks_cover_and_follow_content():
    texts = [sentence(30, 900).encode(), b"", b"a" * 9000, sentence(31, 3).encode()]
    start, end, first = substring.borders(texts)
    at = np.cumsum([0, *(len(x) + 1 for x in texts)])
    for k, x in enumerate(texts):
        a, z = start[first[k] : first[k + 1]] - at[k], end[first[k] : first[k + 1]] - at[k]
        assert b"".join(x[i:j] for i, j in zip(a, z, strict=True)) == x
        assert all(j - i <= substring.LONGEST for i, j in zip(a, z, strict=True))
    whole = texts[0]
    cut = lambda x: {x[i:j] for i, j in zip(*substring.borders([x])[:2], strict=True)}
    assert len(cut(whole[:500] + b"inserted" + whole[500:]) - cut(whole)) <= 4


def test_substring_dedup(odd, none, spark):
    got = substring.deduplicate(odd).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    texts = {}
    for i, t in rows_of(odd):
        texts.setdefault(i, []).append(t or "")
    assert sum(len(v) for v in by.values()) == odd.count()
    for r in got:
        assert r["n_bytes"] - r["n_removed"] == len(r["kept"].encode()) and r["kept_sha256"] == sha(r["kept"].encode())
    assert by[1][0]["n_removed"] == by[2][0]["n_removed"] == by[1][0]["n_bytes"]
    for i in (9, 10, 18):  # the passage stays in 9 only
        assert all((r["n_removed"] > 100) == (i != 9 and len(t) != len(sentence(6, 20))) for r, t in zip(by[i], texts[i], strict=True) if len(by[i]) == 1)
    assert by[18][0]["kept_in"] == [9] or 9 in by[18][0]["kept_in"]
    assert by[7][0]["n_removed"] == by[14][0]["n_removed"] == by[4][0]["n_removed"] == 0
    assert sorted(r["n_removed"] > 0 for r in by[12]) == [False, True]
    assert substring.deduplicate(none).count() == 0


def test_substring_brute_force(real):
    """Runs of chunks that an earlier place has, worked out by a dictionary."""
    seen, want = {}, {}
    for i, t in sorted(rows_of(real)):
        x = (t or "").encode()
        a, z, _ = substring.borders([x])
        again = [x[p:q] in seen for p, q in zip(a, z, strict=True)]
        fresh = set()
        for k, (p, q) in enumerate(zip(a, z, strict=True)):
            again[k] = again[k] or x[p:q] in fresh
            fresh.add(x[p:q])
        seen.update(dict.fromkeys(fresh, i))
        total = k = 0
        while k < len(again):
            j = k
            while j < len(again) and again[j]:
                j += 1
            if j > k and z[j - 1] - a[k] >= substring.LEAST_RUN:
                total += int(z[j - 1] - a[k])
            k = max(j, k + 1)
        want[i] = total
    assert {r["doc_id"]: r["n_removed"] for r in substring.deduplicate(real).collect()} == want
    assert any(want.values())


def test_substring_query_removes_short_copies(spark, tmp_path):
    from tallycast.llm import queries

    texts = [(1, "a short text"), (2, "a short text"), (3, "a short text, longer"), (4, ""), (5, None), (6, sentence(60, 11)), (7, sentence(60, 11))]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["n_removed"], r["kept_in"]) for r in queries.op9_substring_dedup(spark, str(tmp_path)).collect()}
    n = len(sentence(60, 11))
    assert n < substring.LEAST_RUN and got == {2: (12, [1]), 7: (n, [6])}


# 10


def xx(values, seed=42):
    import xxhash

    for v in values:
        seed = xxhash.xxh64(v if isinstance(v, bytes) else np.int64(v).tobytes(), seed=seed & (2**64 - 1)).intdigest()
    return seed - 2**64 if seed >= 2**63 else seed


def winnowed(text):
    spaced = text.replace("\n", " ").replace("\t", " ").split(" ")
    if len(text) > 32 * len(spaced):
        spaced = [text[i : i + 4] for i in range(0, len(text), 4)]
    h = [xx([w.encode()]) for w in spaced if w]
    runs = [xx(h[i : i + 5]) for i in range(len(h) - 4)]
    if not runs:
        return None
    low, out = 1 << 28, []
    for a in range(max(1, len(runs) - 3)):
        window = [((runs[k] >> 28), k) for k in range(a, min(a + 4, len(runs)))]
        least = min(v for v, _ in window)
        out.append((least, max(k for v, k in window if v == least)))
    return list(dict.fromkeys((v << 28) + (low - 1 - k) for v, k in out))


def test_fingerprints_equal_brute_force(spark, real, odd):
    for df in (real, odd):
        got = fingerprint.with_fingerprint(df.select("doc_id", "text"), "text", "kept").collect()
        checked = 0
        for r in got:
            want = winnowed(r["text"] or "")
            if want is not None and len(winnowed(r["text"])) and len((r["text"] or "").split()) >= 8 or want:
                assert r["kept"] == want
                checked += 1
        assert checked >= 5
    row = fingerprint.with_fingerprint(spark.createDataFrame([(0, "a b c a b c a b c a b c")], "doc_id long, text string"), "text", "kept").select(fingerprint.positions(F.col("kept")).alias("p")).first()["p"]
    assert [x["position"] for x in row] == sorted(x["position"] for x in row)


@pytest.mark.parametrize("source", ["odd", "real"])
def test_edited_texts(request, source):
    df = request.getfixturevalue(source).dropDuplicates(["doc_id", "text"])
    rows = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).distinct().select("*", F.xxhash64("text").alias("h")).collect()
    order = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"], r["h"]))
    want = Counter()
    for k, r in enumerate(order):
        t, n = r["text"], len(r["text"]) // 4
        want[(r["doc_id"], len(t), sha((t[: len(t) - n] + order[(k + 1) % len(order)]["text"][:n]).encode()))] += 1
    got = fingerprint.edited(df).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    if source == "real":
        assert np.mean([r["near_edited"] > r["near_next"] for r in got]) > 0.95
        texts = {r["doc_id"]: r["text"] for r in order}
        by_print = {}
        for r in got:
            by_print.setdefault(r["fingerprint"], set()).add(texts[r["doc_id"]])
        assert sum(len(v) > 1 for v in by_print.values()) <= 1


def test_fingerprints_native_and_small(spark, none, odd):
    assert fingerprint.edited(none).count() == 0
    one = fingerprint.edited(spark.createDataFrame([(3, sentence(50, 40))], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0 and one["n_chars"] == len(sentence(50, 40))
    plan = fingerprint.edited(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert fingerprint.edited(odd).count() == odd.count()


def test_fingerprints_of_unspaced_texts(spark):
    rng = np.random.default_rng(9)
    dense = "".join(chr(0x4E00 + k) for k in rng.integers(0, 3000, 1000))
    texts = [dense, sentence(51, 80), dense[:300] + "新" + dense[300:], "two words " + dense[:60] + " end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprint.edited(df).collect()}
    assert got[0]["near_edited"] > 0.7  # the last quarter is English now
    rows = fingerprint.with_fingerprint(df, "text", "kept", True).select("doc_id", fingerprint.hashes(F.col("kept")).alias("h")).collect()
    sets = {r["doc_id"]: set(r["h"]) for r in rows}
    assert len(sets[0] & sets[2]) > 0.9 * len(sets[0])  # all after the insertion is shifted by one
    assert len(sets[3] & sets[0]) > 0.7 * len(sets[3])
    tokens_of = lambda t: [p for w in t.split(" ") for p in ([w[i : i + 4] for i in range(len(w) - 3)] if len(w) > 32 else [w])]
    assert sets[3] == {v >> 32 for v in winnowed(" ".join(tokens_of(texts[3])))}


# pipeline


def test_pipeline_stages_chain(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "bpe_encode_decode"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == columns
    assert counts == sorted(counts, reverse=True) and counts[-1] > 100
    got = sorted((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == sorted((r["doc_id"], r["ids_sha256"]) for r in docs.collect())
