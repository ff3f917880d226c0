"""Mixing sources to target weights.

A document's size is its number of words (null: 0).  Sources are ordered by code point,
null last, and weigh 1, 2, 3, 1, ... of all words.  No target exceeds ``cap`` times its
source's size; the excess is reshared by weight (water-filling, solved exactly over the
table of sources).  A source's rate is target / size; each document is taken
floor(rate) times and once more if a hash of seed, id and text length falls below the
fraction.  The choice depends on the row alone, so reruns agree and rows that repeat an
id agree too.  Sources without words get the target 0.  An empty table gives no rows.

Only per-source sums are shuffled.  The table of sources (one row per source) is
joined back by broadcast behind a check of its size, else by a join on the source with
a salt that spreads the rows of a large source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampspark.llm.common import text_or_empty

CAP = 3
WEIGHTS = (1, 2, 3)
BROADCAST_SOURCES = 20_000
SALTS = 32


def n_words(column: str = "text") -> Column:
    """Number of runs of ``[^\\x20\\x09-\\x0D]+``."""
    return F.regexp_count(text_or_empty(column), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sources: DataFrame, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size -> the same with target.  The input has one row per source.

    With the sources in order of size / weight, those that stop at the cap are a prefix:
    the i-th stops if cap * size_i * (weights from i on) <= weight_i * (words not given before i).
    """
    rank = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(rank) - 1) % len(weights) + 1).cast("int"))
    order = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    t = sources.withColumn("weight", weight.cast("long")).withColumn("full", F.col("source_size") * cap)
    t = (
        t.withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("left_words", F.sum("source_size").over(every) - F.coalesce(F.sum("full").over(before), F.lit(0)))
        .withColumn("stops", F.col("full") * F.col("left_weight") <= F.col("weight") * F.col("left_words"))
    )
    free = F.when(~F.col("stops"), 1)
    t = t.withColumn("free_words", F.max(F.when(free == 1, F.col("left_words"))).over(every)).withColumn(
        "free_weight", F.sum(F.when(free == 1, F.col("weight"))).over(every)
    )
    share = F.col("weight").cast("double") * F.col("free_words").cast("double") / F.col("free_weight").cast("double")
    target = F.when(F.col("stops"), F.col("full").cast("double")).otherwise(F.least(share, F.col("full").cast("double")))
    return t.select("source", "source_size", target.alias("target"))


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the id: 52 bits of an md5."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mixed(docs: DataFrame, seed: int = 17, cap: int = CAP, keep: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken; row: the document, if ``keep``.  One row per document."""
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words().alias("size"), *([F.struct("*").alias("row")] if keep else []))
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    few = len(sums.select("source").limit(BROADCAST_SOURCES + 1).take(BROADCAST_SOURCES + 1)) <= BROADCAST_SOURCES
    targets = source_targets(sums, cap).withColumnRenamed("source", "s")
    match = F.col("source").eqNullSafe(F.col("s"))
    if few:
        joined = rows.join(F.broadcast(targets), match)
    else:
        salted = targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
        joined = rows.withColumn("own", own).join(salted, match & (F.col("own") == F.col("salt")))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    whole = F.floor(rate)
    copies = (whole + (draw(F.col("doc_id"), seed) < rate - whole).cast("long")).cast("long")
    return joined.select(
        "doc_id", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), *(["row"] if keep else [])
    )


def mix_documents(docs: DataFrame, seed: int = 17, cap: int = CAP) -> DataFrame:
    """The documents, each as many times as the mix takes it, with all their columns."""
    return mixed(docs, seed, cap, keep=True).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
