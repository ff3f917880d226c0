"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when they are identical after every run of white space became one
space; a null text is the empty text.  The row with the smallest id stays (null ids
last); rows that repeat an id and its text count as copies too, and one of them stays.
An empty table gives an empty result; other columns are neither read nor returned.

1. Length: rows whose length no other row has are alone.
2. Prefix hash: of the others, rows whose (length, prefix hash) no other row has are alone.
3. Full hash: only the others are grouped by the hash of the whole text.

``exact_groups`` owes every row its hash, so it reads each text once, keeps (id, length,
prefix hash, full hash) in a table and refines that; only survivors of a step enter
the next.  ``drop_exact_copies`` owes no hashes: its first pass keeps (length, prefix hash), and
its second pass hashes the whole text of the survivors only.  They are told by a bitmap of
2**SLOT_BITS slots (16 MB, broadcast whatever the input's size); a slot shared by chance
costs one needless hash and nothing else.

Texts are never shuffled, but for the rows that stay of groups of copies.  Groups are aggregated before
the shuffle, and where a group's rows meet its first row, hot groups (see
``hot_keys``) are dealt to many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampspark.llm.common import Scratch, hot_keys, spread_join, text_or_empty

PREFIX = 256
SLOT_BITS = 27
BUCKET_BITS = 15  # a bitmap of Spark's holds so many bits
#: Runs of white space but for a single space, which needs no change.
RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(column), RUNS, " ")


def _facts(docs: DataFrame, *more: Column) -> DataFrame:
    """n (length), p (prefix hash) and more columns over ``norm``; the text is normalised once."""
    rows = docs.select(F.col("doc_id"), F.array(normalised()).alias("norms")).select("doc_id", F.explode("norms").alias("norm"))
    return rows.select("doc_id", F.length("norm").alias("n"), F.xxhash64(F.substring("norm", 1, PREFIX)).alias("p"), *more)


def _counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def survivors(facts: DataFrame, scratch: Scratch) -> DataFrame:
    """n, p, rows of the (length, prefix hash) groups with more than one row.  ``facts`` is stored; it has n, p, uid."""
    lengths = scratch.put(_counted(facts, ["n"]), "lengths")
    long_enough = spread_join(facts.select("n", "p", "uid"), lengths.select("n"), ["n"], hot_keys(lengths, ["n"], "rows"), F.col("uid"))
    return scratch.put(_counted(long_enough, ["n", "p"]), "prefixes")


def _first() -> list[Column]:
    return [F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("uid"))).alias("first"), F.count(F.lit(1)).alias("group_size")]


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    scratch = Scratch(docs.sparkSession)
    uid = F.monotonically_increasing_id().alias("uid")
    facts = scratch.put(_facts(docs, F.unhex(F.sha2("norm", 256)).alias("sha"), uid), "facts")
    prefixes = survivors(facts, scratch)
    rest = spread_join(facts, prefixes.select("n", "p"), ["n", "p"], hot_keys(prefixes, ["n", "p"], "rows"), F.col("uid"))
    groups = scratch.put(rest.groupBy("sha").agg(*_first()).where("group_size > 1"), "groups")
    rows = spread_join(facts.select("doc_id", "sha", "uid"), groups, ["sha"], hot_keys(groups, ["sha"], "group_size"), F.col("uid"), "left")
    alone = F.col("first").isNull()
    out = rows.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("uid") == F.col("first.uid"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
    scratch.clear(facts, groups)
    return out


def slot_of(n: Column, p: Column) -> Column:
    return F.pmod(F.xxhash64(n, p), F.lit(1 << SLOT_BITS))


def slot_bitmaps(prefixes: DataFrame) -> DataFrame:
    """bucket, bitmap of the slots of (n, p): at most 2**(SLOT_BITS - BUCKET_BITS) rows of 4 kB."""
    slot = slot_of(F.col("n"), F.col("p"))
    rows = prefixes.select(F.shiftright(slot, BUCKET_BITS).alias("bucket"), slot.bitwiseAND(F.lit((1 << BUCKET_BITS) - 1)).alias("bit"))
    return rows.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def with_hit(rows: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """rows (with n and p) with ``hit``: their slot is set."""
    slot = slot_of(F.col("n"), F.col("p"))
    rows = rows.withColumns({"bucket": F.shiftright(slot, BUCKET_BITS), "bit": slot.bitwiseAND(F.lit((1 << BUCKET_BITS) - 1)).cast("int")})
    hit = F.expr("shiftright(cast(conv(hex(substring(bitmap, shiftright(bit, 3) + 1, 1)), 16, 10) as int), bit & 7) & 1 = 1")
    return rows.join(F.broadcast(bitmaps), "bucket", "left").withColumn("hit", F.coalesce(hit, F.lit(False))).drop("bucket", "bit", "bitmap")


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns.

    Rows whose (length, prefix hash) nobody shares pass without a shuffle and without a hash of their text.
    The others meet the ids that stay by id and hash, so that a large group is spread.
    """
    scratch = Scratch(docs.sparkSession)
    prefixes = survivors(scratch.put(_facts(docs, F.monotonically_increasing_id().alias("uid")).drop("doc_id"), "facts"), scratch)
    bitmaps = scratch.put(slot_bitmaps(prefixes), "bitmaps")
    rows = docs.select("doc_id", F.struct("*").alias("row"), F.array(normalised()).alias("norms")).select("doc_id", "row", F.explode("norms").alias("norm"))
    rows = with_hit(rows.withColumns({"n": F.length("norm"), "p": F.xxhash64(F.substring("norm", 1, PREFIX))}), bitmaps)
    alone = rows.where("not hit").select("row.*")
    hashed = rows.where("hit").select("doc_id", F.unhex(F.sha2("norm", 256)).alias("sha"), "row")
    counted = hashed.groupBy("doc_id", "sha").agg(F.count(F.lit(1)).alias("rows"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))).alias("first")
    stay = scratch.put(counted.groupBy("sha").agg(first).select(F.col("sha").alias("keep_sha"), F.col("first.id").alias("keep_id")), "stay")
    scratch.clear(bitmaps, stay)
    kept = hashed.join(stay, F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("sha") == F.col("keep_sha")))
    return alone.unionByName(kept.dropDuplicates(["doc_id", "sha"]).select("row.*"))
