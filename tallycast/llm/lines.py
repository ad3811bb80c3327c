"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions only.

Two lines are near if one edit (a character replaced, put in or taken out) makes them equal. A line's variants leave
out the place of the edit; equal variants join. First whole quarters are left out, as hashes of what stands before and
after them: 8 keys for a line of any length, which name the few lines that have a partner. Of those, every variant
without a single character of that quarter is emitted, as a hashed key; lines that share one are compared by edit
distance. Short lines emit the variants without a single character at once. A group of equal keys only ever yields its
earliest line, so no pairs within a group arise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycast.llm import base

MIN_CHARS = 16
#: Lines from so many characters on have keys without a half; shorter ones only those without a character.
HALVED = 16


def split_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """place (doc_id, line_no, text_hash), a, b (two hashes of the line), line: the lines of min_chars or more."""
    rows = _rows(docs)
    lines = rows.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.where(F.char_length("line") >= min_chars)
    return lines.select(F.struct("doc_id", "line_no", "text_hash").alias("place"), F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"), "line")


def _rows(docs: DataFrame) -> DataFrame:
    return base.id_and_text(docs).where("text is not null").withColumn("text_hash", F.xxhash64("text"))


def _block(length: Column, parts: int, k: Column | int) -> tuple[Column, Column]:
    """Of the k-th of so many parts of a line of `length`: characters before it, and its size."""
    step = F.floor((length + parts) / parts).cast("int")
    return (step * k).cast("int"), step


def _halves(line: Column) -> list[Column]:
    """Keys of the variants without a half: of the line as it is (0, 1), and as the longer one of a pair (2, 3)."""
    out = []
    for longer in (0, 1):
        length = F.char_length(line) - longer
        for k in (0, 1):
            before, step = _block(length, 2, k)
            after = F.greatest(F.lit(0), length - before - step)
            out.append(F.xxhash64(F.left(line, before), F.right(line, after), length, F.lit(k)))
    return out


def _shared(keyed: DataFrame) -> DataFrame:
    """Keys that two lines at least have, one of them as the shorter one."""
    counts = keyed.groupBy("key").agg(F.count_if(~F.col("longer")).alias("shorter"), F.count("*").alias("n"))
    return counts.where("shorter >= 1 and n >= 2").select("key")


def _fetched(docs: DataFrame, named: DataFrame) -> DataFrame:
    """named (place, and more) with the line at its place."""
    rest = [c for c in named.columns if c != "place"]
    by_doc = named.select("place.doc_id", "place.text_hash", F.struct("place.line_no", *rest).alias("one")).groupBy("doc_id", "text_hash").agg(F.collect_list("one").alias("ones"))
    by_doc = by_doc.withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
    found = _rows(docs).join(by_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")))
    found = found.select("doc_id", "text_hash", F.split("text", "\n").alias("parts"), F.explode("ones").alias("one"))
    place = F.struct("doc_id", F.col("one.line_no").alias("line_no"), "text_hash").alias("place")
    return found.select(place, *(F.col(f"one.{c}").alias(c) for c in rest), F.get("parts", F.col("one.line_no")).alias("line")).distinct()


def _without(cand: DataFrame, parts: int) -> DataFrame:
    """cand (who, key, longer, part: what a named variant leaves out, size: of what is left out where the edit is) with variants that leave out less.

    A row for each of so many parts, with the key of the variant without that part, or for parts = 0 for each character.
    """
    if not parts:
        at = F.explode(F.sequence(F.lit(0), F.col("size") - 1))
        return cand.withColumn("at", at).where(F.col("at") < F.char_length("part"))
    length = F.char_length("part") - F.col("longer").cast("int")
    rows = cand.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    before, step = _block(F.least(F.col("size"), length), parts, F.col("k"))
    rows = rows.withColumn("before", before).withColumn("step", step).where(F.col("before") <= length)
    after = F.greatest(F.lit(0), length - F.col("before") - F.col("step"))
    rows = rows.withColumn("after", after)
    key = F.xxhash64("key", F.expr("left(part, before)"), F.expr("right(part, after)"), "k")
    inner = F.expr("substring(part, before + 1, char_length(part) - before - after)")
    return rows.select("who", key.alias("key"), "longer", inner.alias("part"), (F.col("step") + F.col("longer").cast("int")).alias("size"))


def _roles(single: DataFrame, whole: DataFrame) -> DataFrame:
    """who, role, variant: of single (who, key, longer, at, part), without the character there, and of whole (who, key, part) as it is."""
    without = F.expr("concat(left(part, at), substring(part, at + 2))")
    long = single.where("longer").select("who", F.lit("long").alias("role"), F.xxhash64("key", F.lit(-1), without).alias("variant"))
    same = single.where("not longer").select("who", F.lit("same").alias("role"), F.xxhash64("key", "at", without).alias("variant"))
    short = whole.select("who", F.lit("short").alias("role"), F.xxhash64("key", F.lit(-1), "part").alias("variant"))
    return long.unionByName(same).unionByName(short)


def _short(lines: DataFrame) -> DataFrame:
    """who, line: the distinct lines under HALVED characters, and those of just HALVED, which one of them can be near."""
    rows = lines.where(F.char_length("line") <= HALVED).groupBy("a", "b").agg(F.min("place").alias("place"), F.min("line").alias("line"))
    return base.cut(rows.select(F.struct("place", "a", "b").alias("who"), "line"))


def _short_variants(short: DataFrame) -> DataFrame:
    rows = short.select("who", F.lit(0).cast("long").alias("key"), F.col("line").alias("part"), F.char_length("line").alias("size"))
    under = rows.where(F.col("size") < HALVED)
    single = rows.withColumn("longer", F.lit(True)).unionByName(under.withColumn("longer", F.lit(False)))
    return _roles(_without(single, 0), under)


def _near(docs: DataFrame, lines: DataFrame, short: bool) -> DataFrame:
    """a, b, near: of each line that has an earlier line one edit away, the earliest such line's place; short: also of lines under HALVED."""
    long = lines.where(F.char_length("line") >= HALVED)
    halves = [h.alias(f"k{i}") for i, h in enumerate(_halves(F.col("line")))]
    distinct = long.select("place", "a", "b", *halves).groupBy("a", "b").agg(F.min("place").alias("place"), *(F.min(f"k{i}").alias(f"k{i}") for i in range(4)))
    keys = F.array(*(F.struct(F.col(f"k{i}").alias("key"), F.lit(i >= 2).alias("longer"), F.lit(i % 2).alias("k")) for i in range(4)))
    keyed = distinct.select("a", "b", "place", F.inline(keys))
    named = keyed.join(_shared(keyed.select("key", "longer")), "key")
    cand = _fetched(docs, named)
    length = F.char_length("line") - F.col("longer").cast("int")
    before, step = _block(length, 2, F.col("k"))
    cand = cand.withColumn("before", before).withColumn("step", step).withColumn("after", F.greatest(F.lit(0), length - F.col("before") - F.col("step")))
    part = F.expr("substring(line, before + 1, char_length(line) - before - after)")
    who = F.struct("place", "a", "b").alias("who")
    cand = base.cut(cand.select(who, "key", "longer", part.alias("part"), (F.col("step") + F.col("longer").cast("int")).alias("size"), "line"))
    parts = _without(cand, 8)
    parts = base.cut(parts.join(_shared(parts), "key").distinct())
    single = _without(parts, 0)
    variants = _roles(single, parts.where("not longer")).distinct()
    texts = cand.select("who", "line")
    if short:
        few = _short(lines)
        variants, texts = variants.unionByName(_short_variants(few)), texts.unionByName(few)
    firsts = [F.min(F.when(F.col("role") == r, F.col("who"))).alias(f"first_{r}") for r in ("same", "short", "long")]
    groups = variants.groupBy("variant").agg(*firsts, F.count("*").alias("n")).where("n >= 2").drop("n")
    other = F.when(F.col("role") == "same", F.col("first_same")).when(F.col("role") == "short", F.col("first_long")).otherwise(F.col("first_short"))
    pairs = variants.join(groups, "variant").withColumn("other", other).where("other.place < who.place").select("who", "other").distinct()
    texts = texts.distinct()
    both = pairs.join(texts, "who").join(texts.toDF("other", "other_line"), "other").where(F.levenshtein("line", "other_line", 1) >= 0)
    return both.groupBy("who").agg(F.min("other.place").alias("near")).select("who.a", "who.b", "near")


def repeated(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, line_no, text_hash, kept_doc_id, kept_line_no, exact: every line that repeats an earlier one.

    Lines stand between line feeds and are counted from 0; earlier is by doc_id (null first), line_no and a hash of the
    text. A line is repeated if any earlier line is equal or one edit away, be that one kept or not; kept_* is the
    earliest equal line, or where that is itself near an earlier one, the earliest of those. Lines under min_chars are
    never compared; with 1 every line that is not empty is. Null texts have no lines. Fully repeated rows are one place
    and do not repeat each other.
    """
    if min_chars < 1:
        raise ValueError("min_chars must be 1 at least")
    lines = split_lines(docs, min_chars)
    near = _near(docs, lines, min_chars < HALVED)
    firsts = lines.groupBy("a", "b").agg(F.min("place").alias("first"), F.max("place").alias("last")).join(near, ["a", "b"], "left")
    firsts = firsts.where("first != last or near is not null")
    found = lines.select("place", "a", "b").distinct().join(firsts, ["a", "b"]).where("place != first or near is not null")
    kept = F.coalesce("near", "first")
    return found.select("place.doc_id", "place.line_no", "place.text_hash", kept["doc_id"].alias("kept_doc_id"), kept["line_no"].alias("kept_line_no"), F.col("near").isNull().alias("exact"))


def stage(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """The documents with their columns, without their repeated lines. A document that loses all lines keeps an empty text."""
    gone = repeated(docs, min_chars).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("line_no")).alias("gone"))
    steps = F.zip_with("gone", F.concat(F.array(F.lit(-1)), F.slice("gone", 1, F.size("gone") - 1)), lambda now, last: F.concat(F.array_repeat(F.lit(False), now - last - 1), F.array(F.lit(True))))
    doc, text, mask = (base.fresh(docs, x) for x in ("gone_doc", "gone_text", "gone"))
    gone = gone.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text), F.flatten(steps).alias(mask))
    joined = docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(F.col("text").cast("string")) == F.col(text)), "left")
    left = F.filter(F.split("text", "\n"), lambda _, i: ~F.coalesce(F.get(F.col(mask), i), F.lit(False)))
    return joined.withColumn("text", F.when(F.col(mask).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))).select(*docs.columns)
