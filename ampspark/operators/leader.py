"""Greedy leader clustering, consensus, center merging and primer trimming, per sample.

Reads of one sample, best score first, join the first acceptable representative or become
one.  Samples run in parallel.  Clustering takes a sample's reads in order as a stream: a
worker holds the representatives and one block of reads, whatever the sample's size.
Consensus and merging still hold the members of a cluster, or the centers of a sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ampspark.functions import batches, kernels

#: Bytes of minimizers in a block of reads that are looked up at once.
BLOCK_BYTES = 8_000_000


@dataclass(frozen=True)
class Params:
    """Settings of a run; see the README for their meaning."""

    k: int = 13
    w: int = 20
    q: float = 7.0
    min_shared: int = 5
    min_fraction: float = 0.8
    mapped_threshold: float = 0.7
    aligned_threshold: float = 0.4
    min_prob_no_hits: float = 0.1
    symmetric: bool = False
    align: bool = True
    abundance_ratio: float = 0.1
    rc_identity: float = 0.9
    max_seqs: int = -1
    polish_rounds: int = 2
    primer_max_ed: int = 2
    trim_window: int = 150

    def __post_init__(self) -> None:
        if not self.k <= self.w <= 100:
            raise ValueError("k <= w <= 100 is needed")


def closed_form_share(e1: int, e2: int, k: int) -> float:
    """Probability that a minimizer is shared, from error rates in hundredths: no error in either k-mer."""
    return ((1 - e1 / 100) * (1 - e2 / 100)) ** k


def _ratio(found: list[tuple[int, int]], n: int, length: int, other: int, q: float, t: float) -> tuple[float, float]:
    total, prev_idx, prev_pos = 0, -1, 0
    for idx, pos in found:
        if q ** (idx - prev_idx - 1) >= t:
            total += pos - prev_pos
        prev_idx, prev_pos = idx, pos
    if q ** (n - 1 - prev_idx) >= t:
        total += length - prev_pos
    return total / length, total / other


def code_type(k: int) -> type:
    return np.uint32 if 5**k < 1 << 32 else np.int64


def prepared(p: Params) -> batches.Step:
    """What clustering needs of scored reads: hpc_len, e_bin and the minimizers as bytes (codes, pos); ``words`` where letters or k have no codes."""

    def packed(values: np.ndarray, count: np.ndarray) -> pa.Array:
        off = np.concatenate(([0], np.cumsum(count))) * values.itemsize
        return pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])

    def step(b: batches.Block) -> batches.Block:
        h = b.flat("hpc")
        m = batches.minimizers(h, p.k, p.w)
        code = np.zeros(len(m.pos), np.int64) if m.code is None else m.code
        words = pa.nulls(b.rows, pa.string())
        if m.code is None:
            each = m.words().to_pylist()
            ends = np.cumsum(m.count).tolist()
            words = pa.array(["\n".join(each[e - n : e]) for e, n in zip(ends, m.count.tolist())], pa.string())
        e_bin = batches.error_bin(batches.mean_error(batches.best_run_quality(b.flat("seq"), b.flat("qual")), clamp=True))
        return b.put(hpc_len=h.lengths.astype(np.int32), e_bin=e_bin, codes=packed(code.astype(code_type(p.k)), m.count), pos=packed(m.pos, m.count), words=words)

    return step


def _code(word: str, k: int, others: dict[str, int]) -> int:
    """The number that batches give to the word, or a negative one of its own."""
    if k > 26 or word.strip("ACGT"):
        return others.setdefault(word, -1 - len(others))
    n = 0
    for c in word.ljust(k):
        n = 5 * n + " ACGT".index(c)
    return n


class Sample:
    """The representatives of one sample so far; ``take`` adds a block of its reads, in order."""

    def __init__(self, p: Params) -> None:
        self.p = p
        self.ids, self.length, self.e_bin = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.codes, self.of = np.zeros(0, np.int64), np.zeros(0, np.int64)  # in the order of the codes
        self.texts: list[tuple[str, float]] = []
        self.others: dict[str, int] = {}

    def _candidates(self, hits: np.ndarray, bits: int, reps: tuple, block: tuple, top: np.ndarray) -> list[tuple]:
        """(row, hits, sum of positions, id, accepted, number) of candidates that may still be chosen; raises ``top``.

        ``hits``: sorted (row * representatives + number) << bits | index of the minimizer.
        """
        p, (ids, length, e_bin), (pos, off, count, own_length, own_bin) = self.p, reps, block
        key = hits >> bits
        first = np.flatnonzero(np.diff(key, prepend=-1))
        n = np.diff(np.append(first, len(key)))
        row, cl = np.divmod(key[first], len(ids))
        np.maximum.at(top, row, n)
        keep = (n >= p.min_fraction * top[row]) & (n >= p.min_shared)
        if not keep.any():
            return []
        hits, row, cl, n = hits[np.repeat(keep, n)], row[keep], cl[keep], n[keep]
        first = np.concatenate(([0], np.cumsum(n)[:-1]))
        last = first + n - 1
        idx = hits & ((1 << bits) - 1)
        at = pos[np.repeat(off[row], n) + idx]
        q = 1 - ((1 - own_bin[row] / 100) * (1 - e_bin[cl] / 100)) ** p.k
        before, start = np.concatenate(([-1], idx[:-1])), np.concatenate(([0], at[:-1]))
        before[first], start[first] = -1, 0
        inner = np.where(np.power(np.repeat(q, n), idx - before - 1) >= p.min_prob_no_hits, at - start, 0)
        tail = np.where(np.power(q, count[row] - 1 - idx[last]) >= p.min_prob_no_hits, own_length[row] - at[last], 0)
        total = np.add.reduceat(inner, first) + tail
        ratio = total / own_length[row]
        if p.symmetric:
            ratio = np.minimum(ratio, total / length[cl])
        return list(zip(row.tolist(), n.tolist(), np.add.reduceat(at, first).tolist(), ids[cl].tolist(), (ratio > p.mapped_threshold).tolist(), cl.tolist()))

    def _aligned(self, ordered: list[tuple], top: int, seq: str, error_rate: float) -> int | None:
        for n, _, c, _, cl in ordered:
            if n < top:
                break
            text, rate = self.texts[cl]
            error_sum = error_rate + rate
            opened = 5 if error_sum <= 0.01 else 4 if error_sum <= 0.04 else 3 if error_sum <= 0.1 else 2
            s, t = kernels.align(seq, text, opened)
            if kernels.block_ratio(s, t, self.p.k, int((1 - error_sum) * self.p.k // 1)) >= self.p.aligned_threshold:
                return c
        return None

    def take(self, b: batches.Block) -> np.ndarray:
        """cl_id of each read."""
        p, ids = self.p, b.values("read_id").astype(np.int64)
        pos = np.frombuffer(b"".join(b.columns["pos"].to_pylist()), np.int32).astype(np.int64)
        code = np.frombuffer(b"".join(b.columns["codes"].to_pylist()), code_type(p.k)).astype(np.int64)
        count = np.array([len(x) // 4 for x in b.columns["pos"].to_pylist()], np.int64)
        off = np.concatenate(([0], np.cumsum(count)))
        if b.columns["words"].null_count < b.rows:
            for i, words in enumerate(b.columns["words"].to_pylist()):
                if words is not None:
                    code[off[i] : off[i + 1]] = [_code(x, p.k, self.others) for x in words.split("\n")]
        length, e_bin = b.values("hpc_len").astype(np.int64), b.values("e_bin")
        block = pos, off, count, length, e_bin
        row, idx = np.repeat(np.arange(b.rows), count), batches.ranges(count)
        bits = int(count.max() if b.rows else 1).bit_length()
        order = np.argsort(code, kind="stable")
        ordered = code[order]
        new = np.flatnonzero(np.diff(ordered, prepend=ordered[:1] - 1))
        ends = np.append(new[1:], len(ordered))
        group = np.empty(len(code), np.int64)  # the number of each minimizer's k-mer in this block
        group[order] = np.repeat(np.arange(len(new)), ends - new)

        top, found = np.zeros(b.rows, np.int64), [[] for _ in range(b.rows)]

        def put(candidates: list[tuple]) -> None:
            for r, *c in candidates:
                found[r].append(tuple(c))

        if len(self.ids):
            low = np.searchsorted(self.codes, ordered[new], "left")
            many = np.searchsorted(self.codes, ordered[new], "right") - low
            each = np.repeat(many, ends - new)
            at = np.repeat(order, each)
            cl = self.of[np.repeat(np.repeat(low, ends - new), each) + batches.ranges(each)]
            hits = np.sort((row[at] * len(self.ids) + cl) << bits | idx[at])
            put(self._candidates(hits, bits, (self.ids, self.length, self.e_bin), block, top))

        chosen, made = np.empty(b.rows, np.int64), []
        seqs = b.columns["seq"] if p.align else None
        for r in range(b.rows):
            best = sorted(found[r], reverse=True)
            least = max(p.min_fraction * top[r], p.min_shared)
            c = next((x[2] for x in best if x[3] and x[0] >= least), None)
            if c is None and p.align and top[r] >= p.min_shared:
                c = self._aligned(best, top[r], seqs[r].as_py(), b.columns["error_rate"][r].as_py())
            if c is not None:
                chosen[r] = c
                continue
            chosen[r] = ids[r]
            made.append(r)
            if p.align:
                self.texts.append((seqs[r].as_py(), b.columns["error_rate"][r].as_py()))
            g = np.unique(group[off[r] : off[r + 1]])
            at = order[np.repeat(new[g], ends[g] - new[g]) + batches.ranges(ends[g] - new[g])]
            at = at[row[at] > r]
            if len(at):
                made_before = len(self.ids) + len(made) - 1
                added = self._candidates(np.sort(row[at] << bits | idx[at]), bits, (ids[r : r + 1], length[r : r + 1], e_bin[r : r + 1]), block, top)
                put([(*x[:5], made_before) for x in added])
        if made:
            at = np.concatenate([np.arange(off[r], off[r + 1]) for r in made])
            pairs = np.unique(group[at] * len(made) + np.repeat(np.arange(len(made)), count[made]))
            codes = np.concatenate((self.codes, ordered[new][pairs // len(made)]))
            of = np.concatenate((self.of, len(self.ids) + pairs % len(made)))
            place = np.argsort(codes, kind="stable")
            self.codes, self.of = codes[place], of[place]
            self.ids, self.length, self.e_bin = np.append(self.ids, ids[made]), np.append(self.length, length[made]), np.append(self.e_bin, e_bin[made])
        return chosen


CLUSTERED = StructType([StructField("sample", StringType()), StructField("read_id", LongType()), StructField("cl_id", LongType()), StructField("score", DoubleType())])


def clustered(scored: DataFrame, p: Params = Params(), sample: str = "sample") -> DataFrame:
    """sample, read_id, cl_id, score from scored reads (with hpc, error_rate and ``sample``); cl_id is the read_id of the representative."""
    rows = scored.select(F.col(sample).cast("string").alias("sample"), "read_id", "seq", "qual", "hpc", "error_rate", "score")
    out = ("sample", "read_id", "score", "hpc_len", "e_bin", "codes", "pos", "words", *(("error_rate", "seq") if p.align else ()))
    ready = batches.through(rows, [prepared(p)], StructType([f if f.name != "pos" else StructField("pos", batches.BinaryType()) for f in batches.columns(*out).fields]), "seq")
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = ready.repartition(parts, "sample").sortWithinPartitions("sample", F.desc("score"), "read_id")

    def run(arrived):
        held, state = (), None
        for b in arrived:
            columns = dict(zip(b.schema.names, b.columns))
            names, codes = columns["sample"].to_pylist(), columns["codes"]
            edges = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for start, stop in zip(edges, edges[1:]):
                if held != (name := (names[start],)):
                    held, state = name, Sample(p)
                for first, end in batches.bounds(np.array([len(x) for x in codes.slice(start, stop - start).to_pylist()]), BLOCK_BYTES):
                    block = batches.Block({k: x.slice(start + first, end - first) for k, x in columns.items()}, end - first)
                    cl = state.take(block)
                    yield pa.RecordBatch.from_arrays([block.array("sample"), block.array("read_id"), pa.array(cl), block.array("score")], CLUSTERED.names)

    return ready.mapInArrow(run, CLUSTERED)


def centers(assignment: DataFrame, reads: DataFrame, p: Params = Params()) -> DataFrame:
    """sample, cl_id, n_reads, seq: consensus of clusters with at least int(ratio * reads of the sample) members."""
    sizes = assignment.groupBy("sample", "cl_id").agg(F.count(F.lit(1)).alias("n_reads"))
    totals = assignment.groupBy("sample").agg(F.count(F.lit(1)).alias("all_reads"))
    enough = sizes.join(totals, "sample").where(F.col("n_reads") >= F.floor(F.col("all_reads") * p.abundance_ratio)).select("sample", "cl_id", "n_reads")
    members = assignment.join(enough, ["sample", "cl_id"]).join(reads.select("read_id", "seq"), "read_id")

    def draft(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(own=rows["read_id"] != rows["cl_id"]).sort_values(["own", "score", "read_id"], ascending=[True, False, True])
        seqs = rows["seq"].tolist()[: p.max_seqs if p.max_seqs >= 0 else None]
        first = rows.iloc[0]
        return pd.DataFrame([(first["sample"], first["cl_id"], first["n_reads"], kernels.consensus(seqs, p.polish_rounds))], columns=["sample", "cl_id", "n_reads", "seq"])

    return members.groupBy("sample", "cl_id").applyInPandas(draft, "sample string, cl_id long, n_reads long, seq string")


def trim(seq: str, primers: list[str], p: Params) -> str:
    """Without primers (either orientation) near both ends."""
    window = min(p.trim_window, len(seq) // 2)
    if not window:
        return seq
    both = [o for x in primers for o in (x, kernels.reverse_complement(x))]
    head = [h for x in both if (h := kernels.find_primer(seq[:window], x, p.primer_max_ed))]
    tail = [h for x in both if (h := kernels.find_primer(seq[-window:], x, p.primer_max_ed))]
    # The cut is at the primer's last base (its stop is inclusive), which stays: the behaviour to match.
    start = max((stop for _, stop, _ in head), default=0)
    end = len(seq) - (window - min((s for s, _, _ in tail), default=window))
    return seq[start:end] if start < end else seq


def merged(found: DataFrame, p: Params = Params(), primers: tuple[str, ...] = ()) -> DataFrame:
    """sample, cl_id, n_reads, seq, members: centers of a sample merged, largest first, by identity on either strand."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_reads", "cl_id"], ascending=[False, True])
        kept: list[list] = []
        for r in rows.itertuples():
            seq = trim(r.seq, list(primers), p) if primers else r.seq
            for c in kept:
                if kernels.highest_identity(c[3], seq) >= p.rc_identity:
                    c[2] += r.n_reads
                    c[4].append(r.cl_id)
                    break
            else:
                kept.append([r.sample, r.cl_id, r.n_reads, seq, [r.cl_id]])
        return pd.DataFrame(kept, columns=["sample", "cl_id", "n_reads", "seq", "members"])

    return found.groupBy("sample").applyInPandas(merge, "sample string, cl_id long, n_reads long, seq string, members array<long>")
