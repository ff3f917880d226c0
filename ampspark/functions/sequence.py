"""Column functions on sequences and Phred strings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CLAMP = 0.79433
IUPAC = ("ACGTURYSWKMBDHVNXacgturyswkmbdhvnx", "TGCAAYRSWMKVHDBNXtgcaayrswmkvhdbnx")


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once a row, also where ``f`` uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), f), 1)


def hpc(seq: Column) -> Column:
    """Homopolymer compression: every run becomes one base."""
    return F.regexp_replace(seq, r"(.)\1+", "$1")


def phred(c: Column) -> Column:
    """Error probability of a Phred+33 character."""
    return F.pow(F.lit(10.0), -(F.ascii(c) - 33) / 10.0)


def error_probabilities(qual: Column, clamp: bool = False) -> Column:
    def p(c: Column) -> Column:
        return F.least(phred(c), F.lit(CLAMP)) if clamp else phred(c)

    return F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), p)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean_error(qual: Column, clamp: bool = False) -> Column:
    """Mean of the probabilities, not of the Q values; null for the empty string."""
    n = F.length(qual)
    return F.when(n > 0, total(error_probabilities(qual, clamp)) / n)


def read_score(qual: Column, k: int) -> Column:
    """Expected number of k-mers without an error: sum over windows of the product of 1 - p."""
    windows = F.length(qual) - k + 1
    right = F.transform(error_probabilities(qual, clamp=True), lambda p: 1 - p)

    def product(q: Column, i: Column) -> Column:
        return F.aggregate(F.slice(q, i, F.lit(k)), F.lit(1.0), lambda a, x: a * x)

    score = bound(right, lambda q: total(F.transform(F.sequence(F.lit(1), F.size(q) - k + 1), lambda i: product(q, i))))
    return F.when(windows > 0, score).otherwise(0.0)


def best_run_quality(seq: Column, qual: Column) -> Column:
    """Quality string of the compressed read: the best character of every run."""
    runs = F.regexp_extract_all(seq, F.lit(r"((.)\2*)"), F.lit(1))
    start = F.struct(F.lit(0).alias("at"), F.lit("").cast("binary").alias("out"))

    def folded(raw: Column) -> Column:
        def step(acc: Column, run: Column) -> Column:
            best = F.array_max(F.split(F.substring(raw, acc["at"] + 1, F.length(run)).cast("string"), ""))
            return F.struct((acc["at"] + F.length(run)).alias("at"), F.concat(acc["out"], best.cast("binary")).alias("out"))

        return F.aggregate(runs, start, step, lambda acc: acc["out"].cast("string"))

    return bound(qual.cast("binary"), folded)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, *IUPAC))


def minimizers(h: Column, k: int, w: int, stop_early: bool = False) -> Column:
    """array<struct<km, pos>>: leftmost smallest k-mer of every window of w bases, each position once.

    A read shorter than ``w`` has one window.  With ``stop_early`` the last k-mer of
    longer reads is not seen.  Works inside the row: no shuffle however long the read.
    """
    per = w - k + 1

    def kmers(raw: Column) -> Column:  # bytes: a slice doesn't scan the string from its start
        n = F.length(raw)
        count = F.greatest(n - k + 1 - (F.when(n > w, 1).otherwise(0) if stop_early else F.lit(0)), F.lit(1 if stop_early else per))
        all_ = F.transform(F.sequence(F.lit(1), count), lambda i: F.struct(F.substring(raw, i, F.lit(k)).alias("km"), (i - 1).alias("pos")))
        return F.filter(all_, lambda x: F.length(x["km"]) > 0)

    def smallest(all_: Column) -> Column:
        windows = F.sequence(F.lit(1), F.greatest(F.size(all_) - per + 1, F.lit(1)))
        return F.transform(windows, lambda i: F.array_min(F.slice(all_, i, F.lit(per))))

    def moves(found: Column) -> Column:  # positions never go back: a repeat follows at once
        return F.filter(found, lambda x, i: (i == 0) | (F.get(found, i - 1)["pos"] != x["pos"]))

    chosen = bound(bound(bound(h.cast("binary"), kmers), smallest), moves)
    return F.transform(chosen, lambda x: F.struct(x["km"].cast("string").alias("km"), x["pos"].alias("pos")))


def error_bin(e: Column) -> Column:
    """Hundredths, 1 to 15."""
    return F.least(F.greatest(F.round(e * 100).cast("int"), F.lit(1)), F.lit(15))


def gap_open(error_sum: Column) -> Column:
    return F.when(error_sum <= 0.01, 5).when(error_sum <= 0.04, 4).when(error_sum <= 0.1, 3).otherwise(2)
