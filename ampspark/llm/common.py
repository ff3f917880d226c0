"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: exactly what ``bytes.split()`` splits on.
SPACE = r"[\x20\x09-\x0D]+"
#: A key with more than one in so many rows is hot: there are at most so many of them.
SHARES = 1024
BLOCK_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_mod(n: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(n))


def blocks(lengths: list[int], most: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """(first, end) of consecutive texts with about ``most`` characters together, or of one longer text."""
    first, held = 0, 0
    for i, n in enumerate(lengths):
        if i > first and held + n > most:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(lengths):
        yield first, len(lengths)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; in local mode one of our own where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = getattr(spark, "_ampspark_shared", None) or tempfile.mkdtemp(prefix="ampspark-")
    spark._ampspark_shared = path
    return path


class Scratch:
    """Tables in the shared folder; they are deleted when the operator that made them has its result."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.made: list[tuple[DataFrame, str]] = []

    def put(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` and read it back: the lineage ends there."""
        path = f"{shared_dir(self.spark)}/ampspark/{label}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.made.append((back, path))
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Only for tables that no unfinished DataFrame reads."""
        for df, path in self.made:
            if any(df is t for t in tables):
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self.made = [(df, path) for df, path in self.made if not any(df is t for t in tables)]

    def clear(self, *keep: DataFrame) -> None:
        self.drop(*[df for df, _ in self.made if not any(df is k for k in keep)])


def stored(df: DataFrame, label: str) -> DataFrame:
    """A table of its own in the shared folder, for results that a returned DataFrame reads."""
    return Scratch(df.sparkSession).put(df, label)


@contextmanager
def configured(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for the queries that run inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def shuffles_freed(spark: SparkSession) -> AbstractContextManager[None]:
    """The shuffle files of a query that runs inside go when it ends, not when the driver next collects garbage."""
    return configured(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def batches_bounded(spark: SparkSession, most: int) -> AbstractContextManager[None]:
    """Queries that run inside send rows to Python in batches of ``most`` bytes (or one longer row), not only of so many rows."""
    return configured(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """keys, parts of the keys with more than one in SHARES of all rows: at most SHARES of them.

    ``counts`` has a row per key with its number of rows.  A hot key's rows are to be
    dealt to ``parts`` parts, 2 * SHARES at most over all keys, so the table can be broadcast.
    """
    total = F.broadcast(counts.agg(F.sum(n).alias("total")))
    share = F.ceil(F.col(n) * SHARES / F.col("total")).cast("int")
    return counts.join(total).where(F.col(n) * SHARES > F.col("total")).select(*keys, share.alias("parts"))


def dealt(rows: DataFrame, keys: list[str], hot: DataFrame, by: Column) -> DataFrame:
    """rows with ``part``: 0, or for a hot key a number from the hash of ``by``; rows with a null key meet nothing and go anywhere."""
    none = F.lit(False)
    for k in keys:
        none = none | F.col(k).isNull()
    part = F.when(none, F.pmod(F.xxhash64(by), F.lit(SHARES))).when(F.col("parts").isNotNull(), F.pmod(F.xxhash64(by), F.col("parts"))).otherwise(0)
    return rows.join(F.broadcast(hot), keys, "left").withColumn("part", part.cast("int")).drop("parts")


def copied(rows: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """rows (the side with few rows a key) with ``part``, once for each part of their key."""
    parts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    return rows.join(F.broadcast(hot), keys, "left").withColumn("part", parts).drop("parts")


def spread_join(rows: DataFrame, few: DataFrame, keys: list[str], hot: DataFrame, by: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``few`` (few rows a key) on ``keys``, the rows of hot keys dealt to many tasks."""
    return dealt(rows, keys, hot, by).join(copied(few, keys, hot), [*keys, "part"], how).drop("part")
