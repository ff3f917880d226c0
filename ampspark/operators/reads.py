"""Filters, scores and samples of reads (read_id, acc, seq, qual)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ampspark.functions import batches

LETTERS = "abcdefghijklmnopqrstuvwxyz"
BASES = "ACGTACGTACGTACGTACGTACGTAC"
QUALS = "#%&()*+,-./0123456789:;<=>"


def spread(rows: DataFrame) -> DataFrame:
    """Deals a scan with fewer splits than cores (one row group, say) to all cores: what follows costs far more than the rows weigh."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(4 * cores) if rows.rdd.getNumPartitions() < cores else rows


BASE_OF, QUAL_OF = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
for _case in (LETTERS, LETTERS.upper()):
    BASE_OF[list(_case.encode())], QUAL_OF[list(_case.encode())] = list(BASES.encode()), list(QUALS.encode())


def surrogate(b: batches.Block) -> batches.Block:
    """seq and qual from ``text``: letters become bases and qualities."""
    text = b.flat("text")
    letters = text.kept(BASE_OF[text.data] > 0)
    return b.put(seq=batches.Flat(BASE_OF[letters.data], letters.off), qual=batches.Flat(QUAL_OF[letters.data], letters.off))


def surrogates(spark: SparkSession, sf_dir: str, *steps: batches.Step, out: tuple[str, ...], where=None) -> DataFrame:
    """Columns ``out`` of the reads made from whole document texts, after further steps on them; ``where``: of documents."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("doc_id", "read_id")
    docs = docs if where is None else docs.where(where)
    rows = docs.select("read_id", "text", *[c for c in ("lang", "source") if c in out])
    return batches.through(rows, [surrogate, *steps], batches.columns(*out), "text")


def surrogate_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads made from whole document texts: letters become bases and qualities."""
    rows = surrogates(spark, sf_dir, out=("read_id", "seq", "qual", "lang", "source"))
    return rows.select("read_id", F.col("read_id").cast("string").alias("acc"), "seq", "qual", "lang", "source")


def usable(reads: DataFrame, k: int, q: float) -> DataFrame:
    """Drops short or degenerate reads and those whose mean quality is at most ``q``; adds hpc, error_rate."""
    return batches.through(reads, [batches.usable(k, q)], _with(reads, "hpc", "error_rate"), "seq")


def scored(reads: DataFrame, k: int, q: float) -> DataFrame:
    return batches.through(reads, [batches.usable(k, q), batches.with_score(k)], _with(reads, "hpc", "error_rate", "score"), "seq")


def _with(reads: DataFrame, *names: str) -> StructType:
    return StructType([f for f in reads.schema.fields if f.name not in names] + batches.columns(*names).fields)


def length_window(reads: DataFrame, m: int, s: int) -> DataFrame:
    """Inclusive, and only when both are positive."""
    return reads.where(F.length("seq").between(m - s, m + s)) if m > 0 and s > 0 else reads


def top(reads: DataFrame, n: int) -> DataFrame:
    """The best ``n`` by score to six decimals (ties by id, null last); 0 means all."""
    ordered = reads.orderBy(F.desc(F.round("score", 6)), F.asc_nulls_last("read_id"))
    return ordered.limit(n) if n > 0 else ordered


def sample(reads: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Uniform sample of ``n`` reads without replacement, repeatable: the smallest seeded hashes."""
    return reads.orderBy(F.xxhash64("read_id", F.lit(seed)), "read_id").limit(n)


def error_stats(scored_reads: DataFrame) -> DataFrame:
    """One row: n, min, max, upper median and mean of error_rate; nulls if there are no reads.

    The upper median (rank floor(n / 2)) is the lower median of the descending order.
    """
    e = F.col("error_rate")
    upper = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY error_rate DESC)")
    return scored_reads.agg(F.count(e).alias("n"), F.min(e).alias("min_e"), F.max(e).alias("max_e"), upper.alias("median_e"), F.avg(e).alias("mean_e"))


def ranked_clusters(assignment: DataFrame) -> DataFrame:
    """cl_id, n_reads, score, output_cl_id: dense ids by (size, best score) descending.

    ``assignment`` has read_id, cl_id and score.  The window runs over one row per cluster.
    """
    sizes = assignment.groupBy("cl_id").agg(F.count(F.lit(1)).alias("n_reads"), F.max("score").alias("score"))
    order = Window.orderBy(F.desc("n_reads"), F.desc("score"), "cl_id")
    return sizes.withColumn("output_cl_id", F.row_number().over(order).cast("long") - 1)


def running_batches(sizes: DataFrame, key: str, size: str, n: int) -> DataFrame:
    """key, size, batch: largest first, a batch ends with the row that brings its total to ``total div n + 1``; the total then starts at 0.

    A fold, so in order; it runs over one row per cluster or batch, in one task.
    """
    total = sizes.agg(F.sum(size).alias("all_size"))
    rows = sizes.join(F.broadcast(total)).select(F.struct((-F.col(size)).alias("order"), F.col(key).alias("key"), F.col(size).alias("size")).alias("row"), F.expr("all_size div " + str(n) + " + 1").alias("chunk"))
    listed = rows.groupBy("chunk").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    zero = F.lit(0).cast("long")

    def step(acc, row):
        held = acc["held"] + row["size"]
        full = held >= acc["chunk"]
        done = F.concat(acc["out"], F.array(acc["batch"]))
        return F.struct(done.alias("out"), (acc["batch"] + full.cast("long")).alias("batch"), F.when(full, zero).otherwise(held).alias("held"), acc["chunk"].alias("chunk"))

    start = F.struct(F.array().cast("array<bigint>").alias("out"), zero.alias("batch"), zero.alias("held"), F.col("chunk").cast("long").alias("chunk"))
    batches = F.aggregate("rows", start, step, lambda acc: acc["out"])
    return listed.select(F.explode(F.arrays_zip(F.col("rows"), batches.alias("batch"))).alias("z")).select(F.col("z.rows.key").alias(key), F.col("z.rows.size").alias(size), F.col("z.batch").alias("batch"))
