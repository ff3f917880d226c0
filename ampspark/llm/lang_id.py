"""Language identification by cross-parsing entropy.

For each language, a suffix automaton of labelled text.  A document is parsed greedily
into the longest phrases that occur in that text; the language that needs fewest
normalised phrases wins (among equals the first by code point): naming a place in a text of n symbols
takes log2(n) bits, so phrases count that much each.  ``score`` is the
runner-up's share of the bits of the best two, 0.5 to 1 (1 if one language only was
learned; 0 for ``und``).  ``und``: the text is null or has no letter, or nothing was learned.

Letters of all scripts are lower-cased and told apart; every run of other characters is one space.
The commonest letters are one symbol each; every other learned letter is an escape and two
digits, so that the tables stay narrow; letters that no language has are one symbol that matches nothing.
Texts are parsed whole (a symbol that the language lacks is a phrase).  Long texts are parsed in stretches of ``STRETCH`` symbols side by side; each stretch is then parsed on
from where the one before it really ended until both parses start a phrase at the same symbol, from
where on they agree, so the result is that of one parse.  Rows that repeat an id each
get the same prediction; an empty table gives no rows; other columns are neither read nor returned.

The fit uses a bounded sample of labelled rows, each with its whole text: of each language, the
rows of at most ``ROW_CHARS`` characters with the smallest id hash, ``SAMPLE_DOCS`` at most, as long as those
before have fewer than ``SAMPLE_CHARS`` characters.  (A language whose labelled texts are all longer is
not learned.)  That bounds the broadcast tables: about 2 * (SAMPLE_CHARS + ROW_CHARS) states of 300 bytes a language.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ampspark.llm.common import crc_mod

FOLDS, HELD_OUT = 4, 2
SAMPLE_DOCS = 60
SAMPLE_CHARS = 20_000
ROW_CHARS = 20_000
SINGLES, DIGITS = 60, 60
STRETCH = 2048
BLOCK = 4_000_000
OTHER, SPACE = 1, 0
OUT = "doc_id long, lang_pred string, score double"


def training_rows(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, docs_per_lang: int = SAMPLE_DOCS) -> DataFrame:
    """lang, text of the bounded sample."""
    usable = F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= ROW_CHARS) & (crc_mod(folds) != held_out)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    return docs.select("doc_id", "lang", "text").where(usable).withColumn("n", F.row_number().over(order)).where(F.col("n") <= docs_per_lang).select("lang", "n", "text")


def letter_table() -> np.ndarray:
    """code point -> whether it is a letter."""
    return np.frombuffer(bytes(unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), np.bool_)


def symbols_of(text: str, table: np.ndarray) -> np.ndarray:
    """The text as symbol numbers; runs of non-letters are one SPACE.  ``table`` holds a symbol, or ~(rank of an escaped letter)."""
    s = table[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
    space = s == SPACE
    s = s[~(space & np.concatenate(([False], space[:-1])))] if len(s) else s
    if not len(s) or s.min() >= 0:
        return s
    rank, wide = ~s, s < 0
    out = np.repeat(s, np.where(wide, 3, 1))
    at = np.flatnonzero(wide) + 2 * np.arange(int(wide.sum()))
    rank = rank[wide]
    out[at], out[at + 1], out[at + 2] = 2 + SINGLES + rank // DIGITS**2, 2 + rank // DIGITS % DIGITS, 2 + rank % DIGITS
    return out


def automaton(symbols: list[int], width: int) -> np.ndarray:
    """Suffix automaton as a flat table: state * width + symbol -> next state * width, or ~that if a new phrase begins.

    The last state is the one before the text, and after a symbol that the text lacks: all symbols begin a phrase there.
    """
    nxt, link, longest, last = [{}], [-1], [0], 0
    for c in symbols:
        new = len(nxt)
        nxt.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if longest[p] + 1 == longest[q]:
                link[new] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    nxt.append({})
    root = np.array([nxt[0].get(c, len(nxt) - 1) for c in range(width)], np.int64) * width
    table = np.tile(~root, (len(nxt), 1)).astype(np.int32)
    for state, edges in enumerate(nxt):
        for c, to in edges.items():
            table[state, c] = to * width
    return table.ravel()


def fit(samples: list[tuple[str, str]], chars: int = SAMPLE_CHARS) -> dict:
    """langs, their automata and bits a phrase, and the symbol table, from (lang, text) pairs."""
    letters = letter_table()
    chosen: dict[str, list[str]] = {}
    for lang, t in samples:
        own = chosen.setdefault(lang, [])
        if sum(map(len, own)) < chars:
            own.append(t)
    seen = Counter(c for own in chosen.values() for t in own for c in t.lower() if letters[ord(c)])
    table = np.where(letters, OTHER, SPACE).astype(np.int32)
    for i, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))):
        table[ord(c)] = i + 2 if i < SINGLES else ~(i - SINGLES)
    width = 2 + SINGLES + -(-max(0, len(seen) - SINGLES) // DIGITS**2)
    langs = sorted(chosen)
    learned = [[s for t in chosen[lang] for s in [*symbols_of(t, table).tolist(), SPACE]] for lang in langs]
    return {"langs": langs, "automata": [automaton(own, width) for own in learned], "width": width, "bits": np.log2([max(2, len(own)) for own in learned]), "table": table}


def _parsed(flat: np.ndarray, start: np.ndarray, n: np.ndarray, table: np.ndarray, before: int, flips: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(phrases, last state) of the stretches (longest first) flat[start : start + n]; marks in ``flips`` where phrases begin."""
    state, count = np.full(len(n), before, np.int32), np.zeros(len(n), np.int64)
    active = np.searchsorted(-n, -np.arange(n[0]), side="left")
    for step, m in enumerate(active):
        at = start[:m] + step
        v = table[state[:m] + flat[at]]
        flip = v >> 31
        count[:m] -= flip
        state[:m] = v ^ flip
        if flips is not None:
            flips[at] = flip != 0
    return count, state


def _joined(flat: np.ndarray, start: np.ndarray, n: np.ndarray, carry: np.ndarray, table: np.ndarray, flips: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(change of the number of phrases, whether the parses met) of stretches that are really entered in state ``carry``."""
    change, met = np.zeros(len(n), np.int64), np.zeros(len(n), bool)
    live, state, step = np.arange(len(n)), carry.copy(), 0
    while len(live):
        at = start[live] + step
        v = table[state + flat[at]]
        flip = v >> 31
        begins = flips[at].astype(np.int64)
        change[live] -= flip + begins
        same = (flip != 0) & (begins != 0)
        met[live[same]] = True
        step += 1
        go = ~same & (n[live] > step)
        live, state = live[go], (v ^ flip)[go]
    return change, met


def phrases(texts: list[np.ndarray], model: dict, stretch: int = STRETCH) -> np.ndarray:
    """Number of phrases of each text (symbols) in each language: array (texts, languages)."""
    out = np.zeros((len(texts), len(model["langs"])), np.int64)
    spans = [(i, j, min(len(t), j + stretch) - j) for i, t in enumerate(texts) for j in range(0, len(t), stretch)]
    if not spans:
        return out
    owner, inside, n = map(np.array, zip(*spans))
    offset = np.concatenate(([0], np.cumsum([len(t) for t in texts])[:-1]))
    start, flat = offset[owner] + inside, np.concatenate(texts)
    later = np.flatnonzero(inside > 0)  # stretches with one before them
    order = np.argsort(-n, kind="stable")
    flips = np.zeros(len(flat), bool) if len(later) else None
    for k, table in enumerate(model["automata"]):
        count, state = np.empty(len(n), np.int64), np.empty(len(n), np.int32)
        before = len(table) - model["width"]
        count[order], state[order] = _parsed(flat, start[order], n[order], table, before, flips)
        again = np.zeros(0, np.int64)
        if len(later):
            change, met = _joined(flat, start[later], n[later], state[later - 1], table, flips)
            count[later] += change
            followed = np.zeros(len(n), bool)
            followed[later - 1] = True
            again = np.unique(owner[later[~met & followed[later]]])
        np.add.at(out[:, k], owner, count)
        for i in again:  # a stretch that never met: one parse
            out[i, k] = _parsed(texts[i], np.zeros(1, np.int64), np.array([len(texts[i])]), table, before, None)[0][0]
    return out


def identify(texts: list[str | None], model: dict, block: int = BLOCK) -> list[tuple[str, float]]:
    """(lang_pred, score) of each text; about ``block`` characters are held as symbols at once, or one longer text."""
    out, first, held = [], 0, 0
    for i, t in enumerate(texts):
        if i > first and held + len(t or "") > block:
            out += _identified(texts[first:i], model)
            first, held = i, 0
        held += len(t or "")
    return out + _identified(texts[first:], model)


def _identified(texts: list[str | None], model: dict) -> list[tuple[str, float]]:
    symbols = [symbols_of(t or "", model["table"]) for t in texts]
    usable = [bool(model["langs"]) and t is not None and bool((s != SPACE).any()) for t, s in zip(texts, symbols)]
    table = phrases([s for s, u in zip(symbols, usable) if u], model) * model["bits"]
    out, at = [], 0
    for u in usable:
        if not u:
            out.append(("und", 0.0))
            continue
        row, at = table[at], at + 1
        best = int(row.argmin())
        rest = np.delete(row, best)
        out.append((model["langs"][best], float(rest.min() / (rest.min() + row[best])) if len(rest) else 1.0))
    return out


def language_of(docs: DataFrame, train: DataFrame, keep: bool = False) -> DataFrame:
    """doc_id, lang_pred, score; row: the document and lettered: it has a letter, if ``keep``.  ``train`` holds doc_id, lang and text."""
    spark = docs.sparkSession
    sample = sorted((r["lang"], r["n"], r["text"]) for r in training_rows(train).collect())
    model = spark.sparkContext.broadcast(fit([(lang, text) for lang, _, text in sample]))

    @F.pandas_udf("lang_pred string, score double, lettered boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.DataFrame(identify([None if t is None else t for t in batch], model.value), columns=["lang_pred", "score"])
            # Without a language learned all are und.
            table = model.value["table"]
            lettered = found["lang_pred"] != "und" if model.value["langs"] else [bool((symbols_of(t or "", table) != SPACE).any()) for t in batch]
            yield found.assign(lettered=np.asarray(lettered, bool))

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), *([F.struct("*").alias("row")] if keep else []))
    return rows.withColumn("p", predict("text")).select("doc_id", "p.lang_pred", "p.score", *(["row", "p.lettered"] if keep else []))
