"""FASTQ and FASTA files as DataFrames, and text sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def records(text: str) -> Iterator[tuple[str, str, str | None]]:
    """(acc, seq, qual or None); multi-line records; a record whose quality is cut short ends the file without one."""
    lines = iter(text.splitlines())
    line = next(lines, None)
    while line is not None:
        if line[:1] not in (">", "@"):
            line = next(lines, None)
            continue
        acc, seq = line[1:], []
        line = next(lines, None)
        while line is not None and line[:1] not in (">", "@", "+"):
            seq.append(line.strip())
            line = next(lines, None)
        s = "".join(seq)
        if line is None or line[:1] != "+":
            yield acc, s, None
            continue
        qual = ""
        while len(qual) < len(s) and (line := next(lines, None)) is not None:
            qual += line.rstrip("\r\n")
        if len(qual) < len(s):
            yield acc, s, None
            return
        yield acc, s, qual
        line = next(lines, None)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """file, ordinal, acc, seq, qual of all files at ``path``; each file is parsed whole by one task, read by Spark."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, text in zip(batch["file"], batch["value"]):
                yield pd.DataFrame([(name, i, *r) for i, r in enumerate(records(text))], columns=["file", "ordinal", "acc", "seq", "qual"])

    files = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_name"))
    return files.select("file", "value").mapInPandas(parse, "file string, ordinal long, acc string, seq string, qual string")


def as_fastq(reads: DataFrame) -> DataFrame:
    """One column of four-line records."""
    return reads.select(F.concat(F.lit("@"), "acc", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value"))


def as_fasta(found: DataFrame) -> DataFrame:
    """One column of records named by cluster and support."""
    name = F.format_string(">consensus_cl_id_%d_total_supporting_reads_%d\n%s", "cl_id", "n_reads", "seq")
    return found.select(name.alias("value"))


def write_clusters(assignment: DataFrame, path: str) -> None:
    """Tab-separated (cl_id, read_id)."""
    assignment.select("cl_id", "read_id").write.option("sep", "\t").csv(path)


def write_by_cluster(reads: DataFrame, assignment: DataFrame, path: str, least: int = 0) -> None:
    """FASTQ text, one folder per cluster with at least ``least`` reads."""
    big = assignment.groupBy("cl_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("cl_id")
    rows = reads.join(assignment.join(big, "cl_id").select("read_id", "cl_id"), "read_id")
    text = F.concat(F.lit("@"), "acc", F.lit("\n"), "seq", F.lit("\n+\n"), "qual")
    rows.select("cl_id", text.alias("value")).write.partitionBy("cl_id").text(path)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """read, chrom, start, end, flag of the primary alignments in SAM text; ends come from the CIGAR."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("@"))
    rows = rows.select(f[0].alias("read"), f[1].cast("int").alias("flag"), f[2].alias("chrom"), (f[3].cast("long") - 1).alias("start"), f[5].alias("cigar"))
    span = F.aggregate(F.regexp_extract_all("cigar", F.lit(r"(\d+)[MDN=X]"), F.lit(1)), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    return rows.where(F.col("flag").bitwiseAND(4 | 256 | 2048) == 0).select("read", "chrom", "start", (F.col("start") + span).alias("end"), "flag")
