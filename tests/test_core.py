"""The read-clustering engine: SQL comparison, file formats, kernels, clustering."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ampspark.functions import batches, kernels
from ampspark.functions import sequence as S
from ampspark.operators import leader, reads
from ampspark.plans import queries
from ampspark.sources import fastq

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_same_as_sql(spark, same_as_sql, name):
    same_as_sql(queries.queries()[name], queries.oracle_sql()[name], SMALL)


@pytest.mark.parametrize("name", [k for k, (_, sql) in queries.FOUND.items() if not sql])
def test_runs_without_sql(spark, name):
    assert queries.queries()[name](spark, SMALL).count() > 0


def test_whole_tables_are_read(spark):
    q, docs = queries.queries(), spark.read.parquet(f"{SMALL}/documents.parquet")
    assert q["member_order_all"](spark, SMALL).count() == docs.count()
    got = q["band_semi_join_all"](spark, SMALL).select("read_id").join(docs, F.col("read_id") == F.col("doc_id")).select("lang").distinct().collect()
    assert {r.lang for r in got} - {"de"}


def test_simulation_has_all_pairs_of_bins(spark, monkeypatch):
    assert queries.REPLICATES == 999
    monkeypatch.setattr(queries, "REPLICATES", 20)
    got = {(r.e1, r.e2): (r.p, r.least, r.most) for r in queries.queries()["shared_probability"](spark, SMALL).collect()}
    assert set(got) == {(a, b) for a in range(1, 16) for b in range(a, 16)}
    for e in ((1, 1), (2, 5)):
        assert got[e] == pytest.approx(kernels.simulated_share(queries.K, queries.W, *e))


def test_mapped_ratio_uses_error_bins(spark):
    q = queries.queries()
    binned = {(r.read_id, r.cl_id): r.mapped_ratio for r in q["mapped_ratio_binned"](spark, SMALL).collect()}
    fixed = {(r.read_id, r.cl_id): r.mapped_ratio for r in q["mapped_ratio"](spark, SMALL).collect()}
    # Bins of 9 and more leave longer stretches without a shared minimizer mapped.
    assert set(binned) == set(fixed) and sum(binned.values()) > sum(fixed.values())
    u = {r.read_id: r.error_rate for r in queries.U_(spark, SMALL).select("read_id", "error_rate").collect()}
    h = {}
    for r in queries.H(spark, SMALL).collect():
        h.setdefault((r.read_id, r.cl_id), []).append(r)
    for (a, b), rows in h.items():
        bins = [min(15, max(1, int(u[x] * 100 + 0.5))) for x in (a, b)]
        found = sorted((r.idx, r.pos) for r in rows)
        own, _ = leader._ratio(found, rows[0].n_min, rows[0].hpc_len, 1, 1 - leader.closed_form_share(*bins, queries.K), 0.1)
        assert binned[a, b] == pytest.approx(own, abs=1e-7)


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_records():
    text = "@a b\nAC\nGT\n+\n!!\n!!\n>f\nACGT\n@c\nAC\n+\n@>\n@d\nACG\n+\n!!"
    assert list(fastq.records(text)) == [("a b", "ACGT", "!!!!"), ("f", "ACGT", None), ("c", "AC", "@>"), ("d", "ACG", None)]
    assert list(fastq.records("")) == []


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.fastq").write_text("@r1 tail\nACGT\n+\nIIII\n@r2\nAC\n+\nII\n")
    got = fastq.read_sequences(spark, str(tmp_path / "in")).orderBy("ordinal").collect()
    assert [(r.file, r.ordinal, r.acc, r.seq, r.qual) for r in got] == [("x.fastq", 0, "r1 tail", "ACGT", "IIII"), ("x.fastq", 1, "r2", "AC", "II")]
    rows = spark.createDataFrame([(1, "r1", "ACGT", "IIII"), (2, "r2", "AC", "II"), (3, "r3", "GG", "II")], "read_id long, acc string, seq string, qual string")
    own = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "read_id long, cl_id long")
    fastq.write_by_cluster(rows, own, str(tmp_path / "out"), least=2)
    back = spark.read.text(str(tmp_path / "out")).collect()
    assert len(back) == 8 and {r.cl_id for r in back} == {1}


def test_sam(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@HD\tx\nr1\t0\tc1\t11\t9\t5M2D3M1I2S\t*\n" + "r2\t4\t*\t0\t0\t*\t*\nr3\t256\tc1\t1\t9\t5M\t*\n")
    got = [(r.read, r.chrom, r.start, r.end) for r in fastq.read_sam(spark, str(tmp_path / "a.sam")).collect()]
    assert got == [("r1", "c1", 10, 20)]


def test_minimizers_by_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choices("ACGT", k=n))) for i, n in enumerate([13, 19, 20, 21, 60, 200])]
    df = spark.createDataFrame(rows, "id int, h string").select("id", S.minimizers(F.col("h"), 13, 20).alias("m"))
    for r in df.collect():
        h = rows[r.id][1]
        kmers = [(h[i : i + 13], i) for i in range(max(len(h) - 12, 8)) if h[i : i + 13]]
        want = {min(kmers[i : i + 8]) for i in range(max(1, len(kmers) - 7))}
        assert {(x.km, x.pos) for x in r.m} == want


def test_alignment_and_primers():
    a = "".join(random.Random(1).choices("ACGT", k=80))
    assert kernels.highest_identity(a, a) == 1.0
    assert kernels.highest_identity(a, kernels.reverse_complement(a)) == 1.0
    s, t = kernels.align(a, a[:40] + a[43:])
    assert len(s) == len(t) and s.replace("-", "") == a and t.replace("-", "") == a[:40] + a[43:]
    assert kernels.find_primer("TTTTACGTACGTTTTT", "ACGTACGT", 1) is not None
    assert kernels.find_primer("TTTTTTTTTTTT", "ACGACGACG", 1) is None


def test_clusters_separate_templates(spark):
    rng = random.Random(7)
    templates = ["".join(rng.choices("ACGT", k=400)) for _ in range(3)]
    rows = []
    for i in range(30):
        t = "".join(c if rng.random() > 0.01 else rng.choice("ACGT") for c in templates[i % 3])
        rows.append((i, f"r{i}", t, "".join(rng.choices("5678", k=400)), "s"))
    made = spark.createDataFrame(rows, "read_id long, acc string, seq string, qual string, sample string")
    scored = reads.scored(made, 13, 7.0)
    own = leader.clustered(scored)
    got = own.groupBy("cl_id").agg(F.collect_set(F.col("read_id") % 3).alias("t"), F.count(F.lit(1)).alias("n")).collect()
    assert sorted(r.n for r in got) == [10, 10, 10] and all(len(r.t) == 1 for r in got)
    found = leader.merged(leader.centers(own, scored)).collect()
    assert max(kernels.highest_identity(found[0].seq, t) for t in templates) > 0.98


def test_batches_restart_their_total(spark):
    made = spark.createDataFrame([(i, 6) for i in range(4)], "k long, nt long")
    assert [r.batch for r in reads.running_batches(made, "k", "nt", 4).orderBy("k").collect()] == [0, 0, 1, 1]
    rng = random.Random(3)
    sizes = [rng.randrange(1, 50) for _ in range(60)]
    rows = sorted(((-n, i) for i, n in enumerate(sizes)))
    chunk, held, batch, want = sum(sizes) // 5 + 1, 0, 0, {}
    for n, i in rows:
        want[i], held = batch, held - n
        if held >= chunk:
            batch, held = batch + 1, 0
    got = reads.running_batches(spark.createDataFrame(list(enumerate(sizes)), "k long, nt long"), "k", "nt", 5)
    assert {r.k: r.batch for r in got.collect()} == want
    assert reads.running_batches(made.limit(0), "k", "nt", 4).count() == 0


def test_trim_cuts_at_the_last_base_of_the_head_primer():
    rng = random.Random(5)
    body, primer = "".join(rng.choices("ACGT", k=400)), "ACGTTGCATGCCTAGA"
    assert leader.trim("TTGG" + primer + body + kernels.reverse_complement(primer) + "CC", [primer], leader.Params()) == primer[-1] + body
    assert leader.trim(body, [primer], leader.Params()) == body


def test_run_from_files_to_consensus(spark, tmp_path):
    from ampspark.plans import run

    rng = random.Random(17)
    primer = "ACGTTGCATGCCTAGA"
    templates = ["".join(rng.choices("ACGT", k=300)) for _ in range(2)]
    rows = []
    for i in range(24):
        t = primer + "".join(c if rng.random() > 0.01 else rng.choice("ACGT") for c in templates[i % 3 == 0])
        rows.append(f"@r{i} tail\n{t}\n+\n{''.join(rng.choices('56789', k=len(t)))}\n")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.fastq").write_text("".join(rows))
    (tmp_path / "p.fa").write_text(f">p1\n{primer}\n")
    out = str(tmp_path / "out")
    got = run.run(spark, str(tmp_path / "in"), out, run.Run(primers=str(tmp_path / "p.fa"), m=316, s=20))
    ids = [r.read_id for r in got["reads"].orderBy(F.desc("score"), "file", "ordinal").collect()]
    assert ids == list(range(24))
    lines = [r.value.split("\t") for r in spark.read.text(f"{out}/final_clusters").collect()]
    assert sorted(x for x, _ in lines) == ["0"] * 16 + ["1"] * 8
    assert {a: int(a[1:].split()[0]) % 3 == 0 for x, a in lines if x == "1"} == {a: True for x, a in lines if x == "1"}
    fasta = "\n".join(r.value for r in spark.read.text(f"{out}/consensus_reference").collect())
    assert {int(n) for n in __import__("re").findall(r"reads_(\d+)", fasta)} == {16, 8}
    for c in got["centers"].collect():
        assert max(kernels.highest_identity(c.seq, t) for t in templates) > 0.98 and not c.seq.startswith(primer)
    assert spark.read.text(f"{out}/reads_to_consensus").count() == 4 * 24
    again = run.run(spark, str(tmp_path / "in"), out, run.Run(reuse_sorted=True, sample_size=5, top_reads=True))
    assert {r.read_id for r in again["reads"].collect()} == set(range(5))
    for bad in ({"m": 3}, {"primers": "x", "tails": ("A",)}):
        with pytest.raises(ValueError):
            run.Run(**bad)
    with pytest.raises(NotImplementedError):
        run.Run(polisher="neural")


def test_no_reads(spark):
    empty = spark.createDataFrame([], "read_id long, acc string, seq string, qual string, sample string")
    scored = reads.scored(empty, 13, 7.0)
    assert leader.clustered(scored).count() == 0
    assert reads.error_stats(scored).first().n == 0


def test_parameters_are_checked():
    with pytest.raises(ValueError):
        leader.Params(k=30, w=20)


def test_interval_times_go_to_the_nearest_second(spark, same_as_sql, tmp_path):
    import duckdb

    times = ["00:00:00.5", "00:00:01.5", "00:00:01.51", "00:16:41.4", "00:16:41.6", "00:33:21.5", "00:33:22.5", "00:33:22.6"]
    rows = ", ".join(f"({i + 20 * k}::BIGINT, TIMESTAMP '2024-01-01 {t}', {k}::BIGINT, {v}::DOUBLE)" for k in range(3) for i, (t, v) in enumerate(zip(times, [1.9, 0, 1, 1, 0.2, 1, 0, 0][k:] + [1] * k)))
    null = "(90::BIGINT, NULL, 0::BIGINT, 1.0::DOUBLE), (91::BIGINT, TIMESTAMP '2024-01-01 00:00:00', 7::BIGINT, NULL), (92::BIGINT, TIMESTAMP '2024-01-01 00:00:01', 7::BIGINT, 1.0::DOUBLE)"
    duckdb.sql(f"COPY (SELECT * FROM (VALUES {rows}, {null}) t(event_id, ts, user_id, value)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    assert same_as_sql(queries.interval_classes, queries.oracle_sql()["interval_classes"], str(tmp_path)) == 27


@pytest.mark.parametrize("k,w", [(13, 20), (15, 50), (5, 5), (3, 9), (30, 40)])
def test_batch_minimizers_by_brute_force(k, w):
    rng = random.Random(4)
    for letters in ("ACGT", "ACGTN"):
        reads_ = ["".join(rng.choices(letters, k=n)) for n in (0, 1, 2, 5, 13, 19, 20, 21, 60, 200, 700)]
        m = batches.minimizers(batches.Flat.of(pa.array(reads_)), k, w)
        got = [[] for _ in reads_]
        for row, idx, pos, km in zip(m.row, m.idx, m.pos, m.words().to_pylist()):
            assert idx == len(got[row])
            got[row].append((km, pos))
        assert got == [kernels.lexicographic_minimizers(x, k, w) for x in reads_]


def test_hits_are_the_same_where_representatives_are_joined(spark, monkeypatch):
    q, names = queries.queries(), ("shared_hits", "candidate_rank", "mapped_ratio", "mapped_ratio_binned", "band_semi_join_all")
    few = {n: sorted(map(tuple, q[n](spark, SMALL).collect())) for n in names}
    monkeypatch.setattr(queries, "MAX_REPS", 3)
    for n in names:
        assert few[n] and sorted(map(tuple, q[n](spark, SMALL).collect())) == few[n], n


#: The reads' columns are made in batches, once a scan; what a query joins besides is in its second figure.
IN_BATCHES = {
    "map_accept_binned": 0,
    "mapped_ratio_binned": 0,
    "band_semi_join": 1,
    "candidate_rank": 0,
    "shared_hits": 0,
    "map_accept": 0,
    "minimizers": 0,
    "mapped_ratio": 0,
    "band_semi_join_all": 1,
    "primer_hits": 0,
    "minimizers_sim_variant": 0,
    "minimizer_df": 0,
    "scored_reads": 0,
    "top_reads": 0,
    "hpc_quality": 0,
    "length_quality_filter": 0,
    "error_stats": 0,
    "prob_lookup": 1,
}


@pytest.mark.parametrize("name", list(IN_BATCHES))
def test_reads_are_made_in_batches(spark, name):
    plan = queries.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "regexp" not in plan and plan.count("Join ") == IN_BATCHES[name]


def bin_of(r) -> int:
    return int(batches.error_bin(batches.mean_error(batches.best_run_quality(batches.Flat.of(pa.array([r.seq])), batches.Flat.of(pa.array([r.qual]))), clamp=True))[0])


def lead(rows, p):
    """The clustering of one sample, a read and a minimizer at a time."""
    rows = rows.sort_values(["score", "read_id"], ascending=[False, True])
    index: dict[str, set[int]] = {}
    reps: dict[int, tuple] = {}
    out = []
    for r in rows.itertuples():
        ms = kernels.lexicographic_minimizers(r.hpc, p.k, p.w)
        found: dict[int, list[tuple[int, int]]] = {}
        for idx, (km, pos) in enumerate(ms):
            for c in index.get(km, ()):
                found.setdefault(c, []).append((idx, pos))
        order = sorted(found, key=lambda c: (len(found[c]), sum(x for _, x in found[c]), c), reverse=True)
        top = len(found[order[0]]) if order else 0
        chosen = None
        if top >= p.min_shared:
            for c in order:
                if len(found[c]) < max(p.min_fraction * top, p.min_shared):
                    break
                q = 1 - leader.closed_form_share(bin_of(r), reps[c][1], p.k)
                own, rep = leader._ratio(found[c], len(ms), len(r.hpc), reps[c][2], q, p.min_prob_no_hits)
                if (min(own, rep) if p.symmetric else own) > p.mapped_threshold:
                    chosen = c
                    break
            if chosen is None and p.align:
                for c in order:
                    if len(found[c]) < top:
                        break
                    error_sum = r.error_rate + reps[c][3]
                    opened = 5 if error_sum <= 0.01 else 4 if error_sum <= 0.04 else 3 if error_sum <= 0.1 else 2
                    s, t = kernels.align(r.seq, reps[c][0], opened)
                    if kernels.block_ratio(s, t, p.k, int((1 - error_sum) * p.k // 1)) >= p.aligned_threshold:
                        chosen = c
                        break
        if chosen is None:
            chosen = r.read_id
            reps[chosen] = (r.seq, bin_of(r), len(r.hpc), r.error_rate)
            for km, _ in ms:
                index.setdefault(km, set()).add(chosen)
        out.append((r.sample, r.read_id, chosen, r.score))
    return {x[1]: x[2] for x in out}


def _families(rng, letters: str, n: int = 120):
    """Reads of two samples: mutated pieces of a few templates, so that they share some minimizers with several representatives."""
    templates = ["".join(rng.choices(letters, k=500)) for _ in range(6)]
    for i in range(n):
        parts = "".join(t[rng.randrange(200) : rng.randrange(250, 500)] for t in rng.sample(templates, rng.randrange(1, 4)))
        seq = "".join(c if rng.random() > 0.03 else rng.choice(letters) for c in parts)
        yield i, seq, "".join(rng.choices("+,-./0123", k=len(seq))), "ab"[i % 3 == 0]


@pytest.mark.parametrize("p", [leader.Params(align=False), leader.Params(align=False, symmetric=True, mapped_threshold=0.5), leader.Params(k=30, w=40, align=False), leader.Params(), leader.Params(k=9, w=11, min_shared=2, align=False)])
@pytest.mark.parametrize("letters", ["ACGT", "ACGTN"])
def test_clusters_by_brute_force(spark, monkeypatch, p, letters):
    monkeypatch.setattr(leader, "BLOCK_BYTES", 3000)
    rows = list(_families(random.Random(11), letters, 40 if p.align else 120))
    scored = reads.scored(spark.createDataFrame(rows, "read_id long, seq string, qual string, sample string"), p.k, 7.0)
    got = {r.read_id: r.cl_id for r in leader.clustered(scored, p).collect()}
    pdf = scored.toPandas()
    want = {}
    for _, one in pdf.groupby("sample"):
        want |= lead(one, p)
    assert got == want and 2 < len(set(got.values())) < len(got)


def test_minimizer_df_counts_repeated_ids_once(spark, monkeypatch, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(30)
    odd = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, 3).when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("doc_id")))
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    by_read = queries.M(spark, str(tmp_path), out=("read_id", "km")).groupBy("km").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("read_id").alias("n_reads"))
    want = sorted(map(tuple, by_read.collect()))
    assert sorted(map(tuple, queries.minimizer_df(spark, str(tmp_path)).collect())) == want
    monkeypatch.setattr(queries, "MAX_REPEATED", 0)
    assert sorted(map(tuple, queries.minimizer_df(spark, str(tmp_path)).collect())) == want


def test_bands_by_brute_force(spark):
    from ampspark.operators import hits

    rng = random.Random(8)
    first = [(i, rng.choice("ab"), rng.randrange(4000)) for i in range(400)]
    second = [(rng.choice("abc"), rng.randrange(0, 4000, 7)) for _ in range(9)] + [("a", 499), ("a", 500), ("b", 1000)]
    a, b = spark.createDataFrame(first, "read_id long, km string, pos int"), spark.createDataFrame(second, "km string, pos int")
    want = sorted(x for x in first if any(x[1] == km and abs(x[2] - pos) < 500 for km, pos in second))
    for few in (False, True):
        assert sorted(map(tuple, hits.shared_within(a, b, few=few).collect())) == want and 0 < len(want) < 400
