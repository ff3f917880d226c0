"""Document fingerprints: a homomorphic multiset hash.

A text is the multiset of its paragraphs (split at line feeds).  Two kinds of wide
vectors are hashed from them and summed lane by lane modulo powers of two:

* every paragraph gives EXACT uniform lanes, summed modulo 2**31 (equality), as is the number of pieces;
* every piece of a paragraph gives NEAR lanes of 0 or 1, summed modulo 2**19 (likeness).
  A piece ends after a punctuation mark, one of two letters, or, in letters beyond ASCII, one of four
  UTF-8 bytes, so where it ends depends on the text before the cut only, in any script, and the pieces
  of a text are all of it.  (Whole paragraphs would not do: a text of one paragraph whose end changes
  would share nothing.)  Centred sums of such vectors keep inner products, so their cosine estimates
  how much two multisets share (standard error about 1 / sqrt(NEAR)).

Sums are order-independent, and ``combined`` / ``removed`` insert and delete text
without the rest of the document.  Elements are exploded and summed by built-in
aggregates, three lanes of 20 bits to a long, in blocks of 2**19 elements, so that a lane
can't overflow however long a text is.

The texts are shuffled once, to ranges of ids, where each meets the next one; a range's rows are
fingerprinted, and a fingerprint meets the next one, where they are.  Rows that share
an id, and rows with a null id, are ordered by a hash of their text and dealt to as many ranges as their
share asks for.

Null counts as empty; the empty text is the empty multiset (all lanes zero).  Equal
texts have equal fingerprints; two empty texts have likeness 1, an empty and another 0.
Rows that repeat an id are documents of their own.  Null ids come last in descending
order.  An empty table gives no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ampspark.llm.common import shuffle_parts, text_or_empty

SEEDS = 2
SHIFTS = 20
MOD = 1 << 19
EXACT_MOD = 1 << 31
EXACT = 8
#: A piece ends at the end of its paragraph and after these bytes (as Latin-1 characters).
CUT = r"\n|(?<=[.!?,;:|yz\x8F\x9F\xAF\xBF])"
ONES = 1 | 1 << 20 | 1 << 40
NEAR = SEEDS * SHIFTS * 3
LONGS = SEEDS * SHIFTS


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def elements(text: Column) -> Column:
    """array<struct<whole: boolean, h: bigint>>: hashes of the pieces and of the paragraphs."""
    pieces = F.filter(F.split(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), CUT), lambda x: F.length(x) > 0)
    paragraphs = F.when(F.length(text) > 0, F.split(text, "\n")).otherwise(F.array().cast("array<string>"))

    def hashed(parts: Column, whole: bool) -> Column:
        return F.transform(parts, lambda p: F.struct(F.lit(whole).alias("whole"), F.xxhash64(p, F.lit(int(whole))).alias("h")))

    return F.concat(hashed(pieces, False), hashed(paragraphs, True))


def fingerprinted(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, fp: array<long> of EXACT lanes, the number of pieces and NEAR lanes.  ``keys`` name a row."""
    tall = rows.select(*keys, F.posexplode_outer(elements(F.col(text))).alias("at", "e"))
    tall = tall.select(*keys, F.shiftright("at", 19).alias("block"), F.col("e.whole").alias("whole"), F.col("e.h").alias("h0"))
    for s in range(1, SEEDS):
        tall = tall.withColumn(f"h{s}", F.xxhash64("h0", F.lit(s)))
    exact = [
        F.coalesce(F.sum(F.when(F.col("whole"), F.xxhash64("h0", F.lit(100 + i)).bitwiseAND(_long(EXACT_MOD - 1)))), _long(0)).alias(f"e{i}") for i in range(EXACT)
    ]
    near = [
        F.coalesce(F.sum(F.when(~F.col("whole"), F.shiftrightunsigned(f"h{s}", k).bitwiseAND(_long(ONES)))), _long(0)).alias(f"n{s * SHIFTS + k}")
        for s in range(SEEDS)
        for k in range(SHIFTS)
    ]
    n = F.sum(F.when(~F.col("whole"), 1).otherwise(0)).alias("n")
    sums = tall.groupBy(*keys, "block").agg(*exact, n, *near)
    lanes = F.flatten(
        F.array(*[F.array(*[F.shiftrightunsigned(f"n{i}", 20 * j).bitwiseAND(_long(MOD - 1)) for j in range(3)]) for i in range(LONGS)])
    )
    whole = F.array(*[F.pmod(f"e{i}", _long(EXACT_MOD)) for i in range(EXACT)], F.pmod("n", _long(EXACT_MOD)))
    blocks = sums.select(*keys, "block", F.concat(whole, lanes).alias("fp"))
    # Nearly every text has one block; the others are folded.
    joined = blocks.groupBy(*keys).agg(F.collect_list("fp").alias("fps"))
    total = F.when(F.size("fps") == 1, F.element_at("fps", 1)).otherwise(F.aggregate("fps", F.array_repeat(_long(0), EXACT + 1 + NEAR), combined))
    return joined.select(*keys, total.alias("fp"))


def _modulus(i: Column) -> Column:
    return F.when(i <= EXACT, _long(EXACT_MOD)).otherwise(_long(MOD))


def combined(a: Column, b: Column) -> Column:
    """Fingerprint of the multiset union: insertion."""
    return F.transform(F.zip_with(a, b, lambda x, y: x + y), lambda x, i: F.pmod(x, _modulus(i)))


def removed(a: Column, b: Column) -> Column:
    """Fingerprint of ``a`` without the elements of ``b``: deletion."""
    return F.transform(F.zip_with(a, b, lambda x, y: x - y), lambda x, i: F.pmod(x, _modulus(i)))


def _centred(fp: Column) -> Column:
    """2 * sum - n of every likeness lane, from its value modulo 2 * MOD."""
    n = F.element_at(fp, EXACT + 1)
    return F.transform(F.slice(fp, EXACT + 2, NEAR), lambda s: ((s * 2 - n + _long(3 * MOD)).bitwiseAND(_long(2 * MOD - 1)) - _long(MOD)).cast("double"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def likeness(a: Column, b: Column) -> Column:
    """Share of pieces two fingerprints have in common, estimated: 0 to 1, 1 if they are equal."""
    x, y = _centred(a), _centred(b)
    norm = F.sqrt(_dot(x, x) * _dot(y, y))
    return F.when(a == b, 1.0).when(norm == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), _dot(x, y) / norm)))


def as_hex(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x, i: F.lpad(F.hex(x), F.when(i <= EXACT, 8).otherwise(5), F.lit("0"))), "")


def _below(cuts: Column, n: int, x: Column, equal: bool) -> Column:
    """How many of the ``n`` sorted values of the array ``cuts`` are less than ``x`` (or equal), by binary search."""

    def step(found: Column, jump: Column) -> Column:
        at = F.get(cuts, found + jump - 1)
        return found + F.when((at <= x) if equal else (at < x), jump).otherwise(0)

    jumps = F.lit([1 << k for k in reversed(range(n.bit_length()))])
    return F.aggregate(jumps, F.lit(0), step)


def with_next(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """rows(doc_id, text, ...) with to, rank, own, next_text: the text of the next row in descending doc_id, after the last the first.

    Rows are dealt to ranges of (id, hash of the text), quantiles of the ids, so that gaps and clumps do no harm; and
    each range gets one more copy (own 0) of the row before its first; the neighbour is then found inside a
    range, the row of the rank before.  The driver holds the range bounds only.
    """
    parts = shuffle_parts(spark)
    rows = rows.withColumn("h", F.xxhash64("text"))
    found = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("q"), F.count("doc_id").alias("n"), F.count(F.lit(1)).alias("all_n")).first()
    cuts = sorted(found["q"] or [])
    nulls = -(-(found["all_n"] - found["n"]) * parts // max(1, found["all_n"]))
    array = F.from_json(F.lit(json.dumps(cuts)), "array<bigint>")
    first, last = (_below(array, len(cuts), F.col("doc_id"), e) if cuts else F.lit(0) for e in (False, True))
    place = F.col("h") / F.lit(2.0**64) + 0.5  # of the row among those of its id, 0 to 1
    of_null = F.least(F.floor(place * nulls), F.lit(max(0, nulls - 1)))
    of_id = nulls + first + F.least(F.floor(place * (last - first + 1)), last - first)
    dealt = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), of_null).otherwise(of_id).cast("int"))
    tops = {r["bucket"]: r["top"] for r in dealt.groupBy("bucket").agg(F.max(F.struct("doc_id", "h")).alias("top")).collect()}
    order = sorted(tops)
    follows = dict(zip(order, order[1:] + order[:1]))
    size = max(order, default=0) + 1
    tables = {"top_id": [tops[i]["doc_id"] if i in tops else None for i in range(size)], "top_h": [tops[i]["h"] if i in tops else None for i in range(size)], "copy_to": [follows.get(i) for i in range(size)]}
    at = {k: F.get(F.from_json(F.lit(json.dumps(v)), "array<bigint>"), F.col("bucket")) for k, v in tables.items()}
    is_top = F.col("doc_id").eqNullSafe(at["top_id"]) & (F.col("h") == at["top_h"])
    there = F.struct(F.col("bucket").alias("to"), F.lit(1).alias("own"))
    copy = F.struct(at["copy_to"].cast("int").alias("to"), F.lit(0).alias("own"))
    near = Window.partitionBy("to").orderBy("own", F.col("doc_id").asc_nulls_first(), "h", "text")
    return (
        dealt.withColumn("target", F.explode(F.when(is_top, F.array(there, copy)).otherwise(F.array(there))))
        .select("*", "target.*")
        .repartition(max(parts, size), "to")
        .withColumns({"next_text": F.lag("text").over(near), "rank": F.row_number().over(near)})
        .drop("bucket", "target", "h")
    )


def edited_text() -> Column:
    n = F.col("n_chars").cast("int")
    half = F.floor(n / 2).cast("int")
    return F.concat(F.col("text").substr(F.lit(1), n - half), F.col("next_text").substr(F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp; see the contract of the query."""
    text = text_or_empty()
    rows = docs.select("doc_id", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
    paired = with_next(docs.sparkSession, rows)
    plain = F.struct(F.lit(False).alias("edited"), F.lit(None).cast("string").alias("sha"), F.col("text").alias("t"))
    other = F.struct(F.lit(True).alias("edited"), F.sha2(edited_text(), 256).alias("sha"), edited_text().alias("t"))
    both = F.when(F.col("own") == 1, F.array(plain, other)).otherwise(F.array(plain))
    place = ["to", "rank"]
    versions = paired.select(*place, "own", "doc_id", "n_chars", F.inline(both).alias("edited", "sha", "text"))
    # Grouped by the range first: every step finds its rows in one task already.
    fps = fingerprinted(versions, [*place, "own", "doc_id", "n_chars", "edited", "sha"])
    mine, theirs = (F.first(F.when(F.col("edited") == e, F.col("fp")), ignorenulls=True).alias(n) for e, n in ((False, "fp"), (True, "edited_fp")))
    each = fps.groupBy(*place, "own", "doc_id", "n_chars").agg(F.max("sha").alias("edited_sha256"), mine, theirs)
    near = Window.partitionBy("to").orderBy("rank")
    return each.withColumn("next_fp", F.lag("fp").over(near)).where("own = 1").drop(*place, "own")
