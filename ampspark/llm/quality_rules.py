"""Quality classifier: a sparse rule ensemble compiled into Spark columns.

Statistics of the whole text are counted by a vectorised function (built-in regular
expressions took about ten times the CPU time for the same counts).  Small trees are grown on
bootstraps of a labelled sample; every path from a root to a node is a conjunctive
rule.  A logistic model with a lasso penalty weighs the rules (proximal gradient with
momentum), and the rules that keep a weight become one column expression over
the statistics.

Learning uses the labelled rows whose crc32(id) modulo ``FOLDS`` is not ``HELD_OUT``: the
``SAMPLE`` of them with the smallest id hash (a documented bound; all statistics of a
scored text cover the whole text).  Only text statistics are inputs.  Null counts as
the empty text, whose statistics are all zero; it gets a score like any other.  If no
label of one kind is known the score is the share of good labels (0.5 without any).
Ids with contradicting labels count once with each.  Rows that repeat an id each get
the same score; an empty table gives no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampspark.llm.common import crc_mod, text_or_empty

FOLDS, HELD_OUT = 5, 0
SAMPLE = 20_000
THRESHOLD = 0.3
TREES, DEPTH, BINS, TRY = 40, 3, 24, 5
LASSO = 0.002
STEPS = 400


STATISTICS = ("log_chars", "word_length", "upper", "exclaim", "bars", "symbols", "digits", "stops", "short", "stutter", "line_words", "same_lines")


COUNTS = ("n_chars", "n_words", "n_short", "n_stutter", "n_lines", "n_unlike", "n_upper", "n_exclaim", "n_bars", "n_symbols", "n_digits", "n_stops")
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!?", b"|<>{}[]\\/=_", b"#$%&*@^~+", b"0123456789", b".,;:")


def counts(texts: Iterable[str]) -> np.ndarray:
    """(texts, COUNTS): over whole texts; all but the lines are 0 for the empty text."""
    member = np.array([[byte in c for c in CLASSES] for byte in range(256)], np.float64)
    out = []
    for text in texts:
        words, lines = text.split(), text.split("\n")
        stutter = sum(map(eq, words, islice(words, 1, None)))
        short = sum(map((4).__gt__, map(len, words)))
        classes = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256) @ member
        out.append((len(text), len(words), short, stutter, len(lines), len(set(lines)), *classes))
    return np.array(out, np.float64).reshape(-1, len(COUNTS))


def statistics() -> dict[str, Column]:
    """Name -> statistic, from columns with the names of ``counts``; all are 0 for the empty text."""

    def per(n: str, of: str) -> Column:
        return F.when(F.col(of) > 0, F.col(n) / F.col(of)).otherwise(0.0)

    return dict(
        zip(
            STATISTICS,
            [F.log1p("n_chars"), per("n_chars", "n_words"), per("n_upper", "n_chars"), per("n_exclaim", "n_words"), per("n_bars", "n_words"), per("n_symbols", "n_words")]
            + [per("n_digits", "n_chars"), per("n_stops", "n_words"), per("n_short", "n_words"), per("n_stutter", "n_words"), per("n_words", "n_lines")]
            + [F.when(F.col("n_chars") > 0, 1 - F.col("n_unlike") / F.col("n_lines")).otherwise(0.0)],
        )
    )


def with_statistics(rows: DataFrame, text: Column, others: list[str]) -> DataFrame:
    """``others`` and the statistics.  One pass of Arrow batches counts; ratios and rules are columns."""

    @F.pandas_udf(", ".join(f"{n} double" for n in COUNTS))
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(counts(batch), columns=list(COUNTS))

    return rows.select(*others, counted(text).alias("c")).select(*others, "c.*").select(*others, *[c.alias(n) for n, c in statistics().items()])


@dataclass(frozen=True)
class Model:
    """rules: ((feature, is_greater, cut), ...) each; weights and the intercept of the logistic model."""

    rules: tuple[tuple[tuple[str, bool, float], ...], ...]
    weights: tuple[float, ...]
    intercept: float

    def score(self) -> Column:
        """From columns with the names of the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            holds = None
            for name, greater, cut in rule:
                test = F.col(name) > cut if greater else F.col(name) <= cut
                holds = test if holds is None else holds & test
            total = total + F.when(holds, F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _grow(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], rng: np.random.Generator, path: tuple = ()) -> list[tuple]:
    """Paths (feature index, greater, cut) to all nodes below the root of a Gini tree."""
    if len(path) == DEPTH or len(y) < 20 or y.min() == y.max():
        return []
    best, base = None, len(y) * y.mean() * (1 - y.mean())
    for f in rng.choice(x.shape[1], min(TRY, x.shape[1]), replace=False):
        for cut in cuts[f]:
            above = x[:, f] > cut
            n = int(above.sum())
            if 5 <= n <= len(y) - 5:
                p, q = y[above].mean(), y[~above].mean()
                gain = base - n * p * (1 - p) - (len(y) - n) * q * (1 - q)
                if best is None or gain > best[0]:
                    best = gain, int(f), float(cut), above
    if best is None or best[0] <= 1e-9:
        return []
    _, f, cut, above = best
    out = []
    for greater, rows in ((True, above), (False, ~above)):
        here = (*path, (f, greater, cut))
        out += [here, *_grow(x[rows], y[rows], cuts, rng, here)]
    return out


def _holds(rule: tuple, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, greater, cut in rule:
        out &= (x[:, f] > cut) == greater
    return out


def fit(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 3) -> Model:
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        return Model((), (), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, BINS))) for f in range(x.shape[1])]
    found: dict[bytes, tuple] = {}
    for _ in range(TREES):
        # Half of each bootstrap's rows are of either kind: rare kinds get rules too.
        rows = np.concatenate([rng.choice(np.flatnonzero(y == k), min(1000, len(y))) for k in (0, 1)])
        for rule in _grow(x[rows], y[rows], cuts, rng):
            found.setdefault(np.packbits(_holds(rule, x)).tobytes(), rule)
    rules = list(found.values())
    r = np.stack([_holds(rule, x) for rule in rules], axis=1).astype(np.float64)
    mean, scale = r.mean(axis=0), np.maximum(r.std(axis=0), 0.05)
    z = (r - mean) / scale
    step = 4.0 / max(np.linalg.norm(z[rng.choice(len(z), min(len(z), 4000), replace=False)], 2) ** 2 / min(len(z), 4000), 1e-9)
    w, b, momentum = np.zeros(len(rules)), float(np.log(y.mean() / (1 - y.mean()))), 1.0
    v, vb = w.copy(), b
    for _ in range(STEPS):
        error = 1 / (1 + np.exp(-np.clip(z @ v + vb, -30, 30))) - y
        moved = v - step * (z.T @ error) / len(y)
        new, new_b = np.sign(moved) * np.maximum(np.abs(moved) - step * LASSO, 0), vb - min(step, 4.0) * error.mean()
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        v, vb = new + (momentum - 1) / after * (new - w), new_b + (momentum - 1) / after * (new_b - b)
        w, b, momentum = new, new_b, after
    kept = np.flatnonzero(np.abs(w) > 1e-4)
    return Model(
        tuple(tuple((names[f], g, c) for f, g, c in rules[i]) for i in kept),
        tuple(float(w[i] / scale[i]) for i in kept),
        float(b - sum(w[i] * mean[i] / scale[i] for i in kept)),
    )


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from ``labels`` (doc_id, quality) of documents in ``docs``, without the held-out fold."""
    known = (
        labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).where(crc_mod(FOLDS) != HELD_OUT).distinct()
    )
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample))  # at most ``sample`` rows of two numbers
    rows = docs.select("doc_id", text_or_empty().alias("t")).join(chosen, "doc_id").dropDuplicates(["doc_id", "quality"])
    rows = with_statistics(rows, F.col("t"), ["doc_id", "quality"]).limit(sample).toPandas().sort_values(["doc_id", "quality"])
    return fit(rows[list(STATISTICS)].to_numpy(np.float64), rows["quality"].to_numpy(np.int64), list(STATISTICS))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per document."""
    rows = with_statistics(docs, text_or_empty(), ["doc_id"]).select("doc_id", model.score().alias("score"))
    return rows.select("doc_id", (crc_mod(FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
