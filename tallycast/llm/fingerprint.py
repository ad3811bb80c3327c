"""Document fingerprints by winnowing, in DataFrame functions only.

Hashes of every run of five tokens; of every four neighbouring runs the least hash is kept, the rightmost of equal
ones, with its position. So any eight tokens that two texts share give them a common fingerprint hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallycast.llm import base

GRAM, WINDOW = 5, 4
#: A kept run is one number: its hash without the lowest bits, and there the distance of its position from the end of the range.
POSITION_BITS = 28
#: Tokens of more characters are cut into overlapping pieces of so many, one at each character.
LONG, PIECE = 32, 4


def _cut_up(tokens: Column) -> Column:
    """Tokens without the empty ones, each over LONG characters as its overlapping pieces."""
    long = lambda x: F.char_length(x) > LONG
    pieces = lambda x: F.regexp_extract_all(x, F.lit(f"(?s)(?=(.{{{PIECE}}}))."), F.lit(1))
    full = F.array_remove(tokens, "")
    return F.when(F.exists(tokens, long), F.flatten(F.transform(full, lambda x: F.when(long(x), pieces(x)).otherwise(F.array(x))))).otherwise(full)


def with_fingerprint(rows: DataFrame, text: str, name: str, by_token: bool = False) -> DataFrame:
    """The rows with a column of kept runs (array of long, in order of position) of their text column.

    Tokens stand between spaces, tabs and line feeds. by_token: each token over LONG characters is read as overlapping
    pieces of four characters, one at each character, whatever the rest of the text is, so that shifts and edits
    elsewhere keep the hashes; else a text with tokens of over 32 characters on average is cut into pieces of four
    characters side by side, and shared passages of such texts match only where they are aligned. A text with fewer than five tokens has one run, the whole text; one without
    tokens none. Null counts as empty text.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    spaced = F.split(F.replace(F.replace(whole, F.lit("\n"), F.lit(" ")), F.lit("\t"), F.lit(" ")), " ")
    rows = rows.withColumn("_tokens", spaced)
    sides = F.when(F.char_length(whole) > 32 * F.size("_tokens"), F.regexp_extract_all(whole, F.lit("(?s).{1,4}"), F.lit(0))).otherwise(F.array_remove("_tokens", ""))
    rows = rows.withColumn("_tokens", _cut_up(F.col("_tokens")) if by_token else sides)
    rows = rows.withColumn("_hashes", F.transform("_tokens", lambda x: F.xxhash64(x)))
    h, n = F.col("_hashes"), F.size("_hashes")
    low, room = 1 << POSITION_BITS, (1 << POSITION_BITS) - 1

    def packed(run: Column, i: Column) -> Column:
        return F.shiftleft(F.shiftright(run, POSITION_BITS), POSITION_BITS) + (F.lit(room).cast("long") - F.pmod(i, F.lit(low)))

    runs = F.transform(F.slice(h, 1, n - GRAM + 1), lambda x, i: packed(F.xxhash64(x, *(F.get(h, i + j) for j in range(1, GRAM))), i))
    alone = F.when(n > 0, F.array(packed(F.xxhash64(h), F.lit(0)))).otherwise(F.array().cast("array<long>"))
    rows = rows.withColumn("_runs", F.when(n >= GRAM, runs).otherwise(alone))
    p, m = F.col("_runs"), F.size("_runs")
    rows = rows.withColumn("_twos", F.when(m >= WINDOW, F.zip_with(F.slice(p, 1, m - 1), F.slice(p, 2, m - 1), lambda x, y: F.least(x, y))).otherwise(F.array(F.array_min(p))))
    t, k = F.col("_twos"), F.size("_twos")
    fours = F.array_distinct(F.zip_with(F.slice(t, 1, k - 2), F.slice(t, 3, k - 2), lambda x, y: F.least(x, y)))
    kept = F.when(m >= WINDOW, fours).when(m > 0, t).otherwise(F.array().cast("array<long>"))
    return rows.withColumn(name, kept).drop("_tokens", "_hashes", "_runs", "_twos")


def positions(kept: Column) -> Column:
    """Array of (hash, position in tokens) from kept runs."""
    room = (1 << POSITION_BITS) - 1
    return F.transform(kept, lambda x: F.struct(F.shiftright(x, POSITION_BITS).alias("hash"), (F.lit(room) - F.pmod(x, F.lit(1 << POSITION_BITS))).cast("int").alias("position")))


def hashes(kept: Column) -> Column:
    """Set of the hashes (their upper 32 bits), without positions."""
    return F.array_distinct(F.transform(kept, lambda x: F.shiftright(x, 32).cast("int")))


def likeness(left: Column, right: Column) -> Column:
    """Share of hashes that two sets have in common (twice the common ones by the sum of sizes); 1 of empty sets."""
    total = F.size(left) + F.size(right)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(left, right)) / total)


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_chars of each distinct row and the next one's next_id, next_hash by doc_id (null first) and hash of the text; after the last comes the first.

    Only ids and hashes are ordered: dealt out by ranges, ordered within each, and joined at the ends of ranges.
    """
    ids = docs.select("doc_id", "text_hash", F.char_length("text").alias("n_chars")).distinct()
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = base.cut(ids.repartitionByRange(n, "doc_id", "text_hash").withColumn("part", F.spark_partition_id()))
    heads = [r for r in ids.groupBy("part").agg(F.min(F.struct("doc_id", "text_hash")).alias("head")).orderBy("part").collect()]
    after = [(r["part"], s["head"]["doc_id"], s["head"]["text_hash"]) for r, s in zip(heads, heads[1:] + heads[:1], strict=True)]
    ends = F.broadcast(docs.sparkSession.createDataFrame(after, "part int, head_id long, head_hash long"))
    order = Window.partitionBy("part").orderBy("doc_id", "text_hash")
    following = F.lead(F.struct("doc_id", "text_hash")).over(order)
    out = ids.withColumn("following", following).join(ends, "part")
    following = F.coalesce("following", F.struct(F.col("head_id").alias("doc_id"), F.col("head_hash").alias("text_hash")))
    return out.select("doc_id", "text_hash", "n_chars", following["doc_id"].alias("next_id"), following["text_hash"].alias("next_hash"))


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, kept of each row.

    The edited text has the last quarter of the code points (rounded down) replaced by as many of the next document's
    first ones, or all it has. fingerprint is the sha256 of the kept runs (hashes with positions); kept are these runs.
    The likenesses compare hashes. All texts are read by_token. Null counts as empty text. Repeated rows are one document and give repeated results;
    a document alone is its own next.
    """
    rows = base.id_and_text(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    key = lambda i, h: F.concat_ws(":", F.coalesce(F.col(i).cast("string"), F.lit("none")), h)
    order = neighbours(rows)
    order = order.select("doc_id", key("doc_id", "text_hash").alias("own"), F.expr("n_chars div 4").cast("int").alias("cut"), key("next_id", "next_hash").alias("key"))
    rows = rows.select("text", key("doc_id", "text_hash").alias("key"))  # both joins read these columns: texts are moved once
    theirs = with_fingerprint(rows.join(order, "key"), "text", "next_kept", True)
    theirs = theirs.select("doc_id", F.col("own").alias("key"), "cut", F.left("text", "cut").alias("start"), hashes(F.col("next_kept")).alias("next_set"))
    both = rows.join(theirs.groupBy("key").agg(*(F.first(c).alias(c) for c in ("doc_id", "cut", "start", "next_set"))), "key")
    n = F.char_length("text")
    both = both.select("doc_id", "text", n.cast("long").alias("n_chars"), F.concat(F.left("text", n - F.col("cut")), "start").alias("edited"), "next_set")
    both = with_fingerprint(with_fingerprint(both, "text", "kept", True), "edited", "edited_kept", True)
    both = both.withColumn("own_set", hashes(F.col("kept"))).withColumn("edited_set", hashes(F.col("edited_kept")))
    digest = lambda c: F.sha2(F.array_join(F.col(c).cast("array<string>"), ","), 256)
    return both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digest("kept").alias("fingerprint"), digest("edited_kept").alias("edited_fingerprint"), likeness(F.col("own_set"), F.col("edited_set")).alias("near_edited"), likeness(F.col("own_set"), F.col("next_set")).alias("near_next"), "kept")
