"""From sequence files to cluster tables and consensus sequences: one run, and its command.

    python -m ampspark.plans.run READS OUT [--primers FASTA] [--m 800 --s 100] [--sample-size 500 [--top-reads]]

Every file is a sample of its own.  ``OUT`` must be a folder that all executors share; tables are folders of part
files in order, as Spark writes them.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampspark.functions import kernels
from ampspark.operators import leader, reads
from ampspark.sources import fastq


@dataclass(frozen=True)
class Run:
    """Settings of a run beside those of clustering: target length ``m`` with tolerance ``s`` (0: any), sampling, primers, polisher."""

    params: leader.Params = field(default_factory=leader.Params)
    m: int = 0
    s: int = 0
    sample_size: int = 0
    top_reads: bool = False
    primers: str | None = None
    tails: tuple[str, ...] = ()
    polisher: str = "vote"
    reuse_sorted: bool = False

    def __post_init__(self) -> None:
        if (self.m > 0) != (self.s > 0):
            raise ValueError("m and s are given together")
        if self.primers and self.tails:
            raise ValueError("primers or universal tails, not both")
        if self.polisher != "vote":
            raise NotImplementedError(f"no polisher {self.polisher!r}: only the alignment vote is built in")


def sorted_reads(spark: SparkSession, path: str, out: str, r: Run) -> DataFrame:
    """Scored reads with ``read_id``, the rank by score (then file and place); stored at ``out``/sorted, or read from there."""
    where = f"{out}/sorted"
    if r.reuse_sorted:
        return spark.read.parquet(where)
    raw = fastq.read_sequences(spark, path).where("qual is not null").withColumn("read_id", F.lit(None).cast("long"))
    scored = reads.scored(reads.spread(raw), r.params.k, r.params.q).drop("read_id")
    ranked = scored.orderBy(F.desc("score"), "file", "ordinal").withColumn("place", F.monotonically_increasing_id())  # rises with the order; dense ids follow from the counts before
    ranked.write.mode("overwrite").parquet(f"{where}.ordered")
    ranked = spark.read.parquet(f"{where}.ordered").withColumn("part", F.shiftright("place", 33))
    sizes = {x["part"]: x["n"] for x in ranked.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, at = {}, 0
    for part in sorted(sizes):  # one number per partition of the sort
        before[part], at = at, at + sizes[part]
    starts = spark.createDataFrame(sorted(before.items()), "part long, start long")
    dense = ranked.join(F.broadcast(starts), "part").withColumn("read_id", F.col("start") + F.col("place") - F.shiftleft("part", 33))
    dense.drop("part", "start", "place").write.mode("overwrite").parquet(where)
    return spark.read.parquet(where)


def primer_set(spark: SparkSession, r: Run) -> DataFrame:
    """name, seq of the primers or tails in both orientations (names end in _fw and _rc)."""
    rows = [(x.acc, x.seq) for x in fastq.read_sequences(spark, r.primers).collect()] if r.primers else [(f"tail{i}", t) for i, t in enumerate(r.tails, 1)]
    both = [y for n, s in rows for y in ((f"{n}_fw", s), (f"{n}_rc", kernels.reverse_complement(s)))]
    return spark.createDataFrame(both, "name string, seq string")


def run(spark: SparkSession, path: str, out: str, r: Run = Run()) -> dict[str, DataFrame]:
    """Writes the tables of a run below ``out``; returns them (reads, clusters, centers)."""
    found = reads.length_window(sorted_reads(spark, path, out, r), r.m, r.s)
    if r.sample_size:
        found = reads.top(found, r.sample_size) if r.top_reads else reads.sample(found, r.sample_size)
    found.write.mode("overwrite").parquet(f"{out}/reads")
    found = spark.read.parquet(f"{out}/reads")
    reads.error_stats(found).write.mode("overwrite").option("header", True).option("sep", "\t").csv(f"{out}/logfile")
    leader.clustered(found, r.params, "file").write.mode("overwrite").parquet(f"{out}/assignment")
    own = spark.read.parquet(f"{out}/assignment")
    ranks = reads.ranked_clusters(own).select("cl_id", "output_cl_id")
    members = own.select("read_id", "cl_id").join(ranks, "cl_id").join(found, "read_id")
    order = ["output_cl_id", F.desc("score"), "read_id"]
    tsv = {"sep": "\t", "quote": "", "mode": "overwrite"}
    members.orderBy(*order).select("output_cl_id", "acc").write.csv(f"{out}/final_clusters", **tsv)
    origins = members.where("read_id = cl_id").orderBy("output_cl_id")
    origins.select("output_cl_id", "acc", "seq", "qual", "score", "error_rate").write.csv(f"{out}/final_cluster_origins", **tsv)
    found.orderBy("read_id").select(F.concat(F.lit("@"), "acc", F.lit("_"), F.col("score").cast("string"), F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value")).write.mode("overwrite").text(f"{out}/sorted_fastq")
    primers = tuple(x.seq for x in primer_set(spark, r).where("name like '%_fw'").collect()) if r.primers or r.tails else ()
    leader.merged(leader.centers(own, found, r.params), r.params, primers).write.mode("overwrite").parquet(f"{out}/centers")
    centers = spark.read.parquet(f"{out}/centers")
    fastq.as_fasta(centers).write.mode("overwrite").text(f"{out}/consensus_reference")
    support = centers.select(F.col("cl_id").alias("center"), F.explode("members").alias("cl_id")).join(own.select("cl_id", "read_id"), "cl_id").join(found, "read_id")
    # Accessions end at the first space; of equal ones in a file one stays.
    support = support.withColumn("acc", F.substring_index("acc", " ", 1)).dropDuplicates(["center", "acc"])
    value = F.concat(F.lit("@"), "acc", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value")
    support.select(F.col("center").alias("cl_id"), value).write.mode("overwrite").partitionBy("cl_id").text(f"{out}/reads_to_consensus")
    return {"reads": found, "clusters": members.select("output_cl_id", "cl_id", "read_id", "acc", "score"), "centers": centers}


def main(argv: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    a.add_argument("path")
    a.add_argument("out")
    for name, kind in (("k", int), ("w", int), ("q", float), ("abundance-ratio", float), ("rc-identity", float), ("max-seqs", int), ("m", int), ("s", int), ("sample-size", int)):
        a.add_argument(f"--{name}", type=kind)
    a.add_argument("--top-reads", action="store_true")
    a.add_argument("--reuse-sorted", action="store_true")
    a.add_argument("--primers")
    given = {k: v for k, v in vars(a.parse_args(argv)).items() if v is not None}
    path, out = given.pop("path"), given.pop("out")
    own = {k: given.pop(k) for k in list(given) if k in leader.Params.__dataclass_fields__}
    run(SparkSession.builder.appName("ampspark").getOrCreate(), path, out, Run(params=leader.Params(**own), **given))


if __name__ == "__main__":
    main()
