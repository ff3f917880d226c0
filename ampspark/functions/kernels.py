"""Alignment kernels in numpy: affine semi-global alignment, infix edit distance, consensus voting."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

MASKS = {"A": 1, "C": 2, "G": 4, "T": 8, "U": 8, "R": 5, "Y": 10, "S": 6, "W": 9, "K": 12, "M": 3, "B": 14, "D": 13, "H": 11, "V": 7, "N": 15, "X": 15}
COMPLEMENT = str.maketrans("ACGTURYSWKMBDHVNXacgturyswkmbdhvnx", "TGCAAYRSWMKVHDBNXtgcaayrswmkvhdbnx")
NEG = -(1 << 28)


def reverse_complement(seq: str) -> str:
    if unknown := set(seq) - set("ACGTURYSWKMBDHVNXacgturyswkmbdhvnx"):
        raise ValueError(f"not a base: {sorted(unknown)}")
    return seq.translate(COMPLEMENT)[::-1]


def align(a: str, b: str, open_: int = 5, extend: int = 1, match: int = 2, mismatch: int = -2) -> tuple[str, str]:
    """Gapped strings of the best alignment with free end gaps in both; ``open_`` is the whole cost of a gap's first base.

    Rows are vectorised: along a row, gaps in ``a`` are a running maximum.
    """
    n, m = len(a), len(b)
    x, y = np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
    h = np.zeros((n + 1, m + 1), np.int32)
    up = np.full((n + 1, m + 1), NEG, np.int32)
    left = np.full((n + 1, m + 1), NEG, np.int32)
    ramp = extend * np.arange(m + 1)
    for i in range(1, n + 1):
        up[i, 1:] = np.maximum(h[i - 1, 1:] - open_, up[i - 1, 1:] - extend)
        best = np.maximum(h[i - 1, :-1] + np.where(y == x[i - 1], match, mismatch), up[i, 1:])
        own = np.concatenate(([0], best))
        run = np.maximum.accumulate(own + ramp)
        left[i, 1:] = run[:-1] - open_ + extend - ramp[1:]
        h[i, 1:] = np.maximum(best, left[i, 1:])
    ends = [(int(h[n].argmax()), n), (m, int(h[:, m].argmax()))]
    j, i = max(ends, key=lambda e: h[e[1], e[0]])
    s, t = [a[i:] + "-" * (m - j)], ["-" * (n - i) + b[j:]]
    while i and j:
        if h[i, j] == h[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
            i, j = i - 1, j - 1
            s.append(a[i])
            t.append(b[j])
        elif h[i, j] == up[i, j]:
            while True:
                opened = up[i, j] == h[i - 1, j] - open_
                i -= 1
                s.append(a[i])
                t.append("-")
                if opened:
                    break
        else:
            while True:
                opened = left[i, j] == h[i, j - 1] - open_
                j -= 1
                s.append("-")
                t.append(b[j])
                if opened:
                    break
    s.append(a[:i][::-1] + "-" * j)
    t.append("-" * i + b[:j][::-1])
    return _turned(s), _turned(t)


def _turned(parts: list[str]) -> str:
    """parts[0] is the tail in order, the rest was collected from the end."""
    return "".join(parts[1:])[::-1] + parts[0]


def identity(s: str, t: str) -> float:
    """Equal columns over all columns, end gaps included."""
    return sum(x == y for x, y in zip(s, t)) / len(s) if s else 0.0


def highest_identity(a: str, b: str, open_: int = 3) -> float:
    return max(identity(*align(a, b, open_)), identity(*align(a, reverse_complement(b), open_)))


def block_ratio(s: str, t: str, k: int, match_id: int) -> float:
    """Share of windows of k columns with at least ``match_id`` equal ones."""
    equal = np.array([x == y for x, y in zip(s, t)], np.int64)
    if len(equal) < k:
        return float(equal.sum() >= match_id)
    runs = np.convolve(equal, np.ones(k, np.int64), "valid")
    return float((runs >= match_id).mean())


def find_primer(seq: str, primer: str, max_edits: int) -> tuple[int, int, int] | None:
    """(start, stop inclusive, edits) of the best infix match under IUPAC equality; the first end, then the latest start."""
    q = [MASKS[c] for c in primer.upper()]
    n = len(q)
    row, start = list(range(n + 1)), [0] * (n + 1)
    best = None
    for j, c in enumerate(seq.upper()):
        base = MASKS.get(c, 0)
        new, begin = [0] * (n + 1), [j + 1] * (n + 1)
        for i in range(1, n + 1):
            options = ((row[i - 1] + (q[i - 1] & base == 0), -start[i - 1]), (row[i] + 1, -start[i]), (new[i - 1] + 1, -begin[i - 1]))
            new[i], at = min(options)
            begin[i] = -at
        row, start = new, begin
        if row[n] <= max_edits and (best is None or row[n] < best[2]):
            best = (start[n], j, row[n])
    return best


def expand_cigar(cigar: str, a: str, b: str) -> tuple[str, str]:
    """Gapped strings of a CIGAR over ``= X I D``; anything else is an error."""
    s, t, i, j, used = [], [], 0, 0, 0
    for part in re.finditer(r"(\d+)([=XID])", cigar):
        n, op, used = int(part[1]), part[2], used + len(part[0])
        s.append(a[i : i + n] if op != "D" else "-" * n)
        t.append(b[j : j + n] if op != "I" else "-" * n)
        i, j = i + n * (op != "D"), j + n * (op != "I")
    if used != len(cigar):
        raise ValueError(f"unsupported CIGAR: {cigar}")
    return "".join(s), "".join(t)


def vote(draft: str, reads: list[str], open_: int = 3) -> str:
    """One polishing round: reads are aligned to the draft and vote on every column and on what follows it."""
    columns: list[dict[str, int]] = [{} for _ in range(len(draft) + 1)]
    for read in reads:
        s, t = align(draft, read, open_)
        covered = [k for k, c in enumerate(t) if c != "-"]
        if not covered:
            continue
        at, cell = -1, ""
        first, last = covered[0], covered[-1]
        begun = False
        for k, (x, y) in enumerate(zip(s, t)):
            if x != "-":
                if begun:
                    columns[at + 1][cell] = columns[at + 1].get(cell, 0) + 1
                at, cell, begun = at + 1, "", first <= k <= last
                cell = y if y != "-" else ""
            elif begun and first <= k <= last:
                cell += y
        if begun:
            columns[at + 1][cell] = columns[at + 1].get(cell, 0) + 1
    out = []
    for base, votes in zip(draft, columns[1:]):
        out.append(max(sorted(votes), key=votes.get) if votes else base)
    return "".join(out)


def consensus(reads: list[str], rounds: int = 3) -> str:
    """Starts from the first read and polishes until nothing changes."""
    draft = reads[0] if reads else ""
    for _ in range(rounds):
        new = vote(draft, reads)
        if new == draft:
            break
        draft = new
    return draft


def lexicographic_minimizers(h: str, k: int, w: int) -> list[tuple[str, int]]:
    per = w - k + 1
    kmers = [(h[i : i + k], i) for i in range(max(len(h) - k + 1, per)) if h[i : i + k]]
    return list(dict.fromkeys(min(kmers[i : i + per]) for i in range(max(1, len(kmers) - per + 1)))) if kmers else []


def replicate_share(k: int, w: int, e1: int, e2: int, replicate: int, length: int = 1000, seed: int = 0) -> float:
    """Share of a read's minimizers found in another read of the same random transcript.

    Error rates are in hundredths: half deletions, half insertions.
    """
    rng = np.random.default_rng((seed, k, w, e1, e2, replicate))
    source = rng.integers(0, 4, length)

    def mutated(e: float) -> str:
        kept = source[rng.random(length) >= e / 2]
        out = []
        for base, more, extra in zip(kept, rng.random(len(kept)) < e / 2, rng.integers(0, 4, len(kept))):
            out += [base, extra] if more else [base]
        return re.sub(r"(.)\1+", r"\1", "".join("ACGT"[x] for x in out))

    a, b = (lexicographic_minimizers(mutated(e / 100), k, w) for e in (e1, e2))
    at: dict[str, list[int]] = {}
    for km, pos in b:
        at.setdefault(km, []).append(pos)
    return sum(any(abs(pos - q) < 500 for q in at.get(km, ())) for km, pos in a) / max(1, len(a))


@lru_cache(maxsize=None)
def simulated_share(k: int, w: int, e1: int, e2: int, replicates: int = 20, length: int = 1000, seed: int = 0) -> tuple[float, float, float]:
    """Mean, least and most ``replicate_share``."""
    shares = [replicate_share(k, w, e1, e2, r, length, seed) for r in range(replicates)]
    return float(np.mean(shares)), min(shares), max(shares)
