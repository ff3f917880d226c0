"""Language-model scores from a log-frequency Bloom filter.

Tokens are the words between white space with A-Z lower-cased, then one end per text.
The filter stores, for every unigram and for every bigram of any two words (seen
twice or more) the pairs (n-gram, 1) .. (n-gram, q), where q is its count on a
logarithmic scale; a count is read back by probing 1, 2, ... until a probe fails.

    p(w | v) = (max(q(v w) - D, 0) + (R(v) + D * T(v)) * p(w)) / (Q(v) + R(v))   if v was seen, else p(w)
    p(w) = (q(w) + 0.5) / (M + 0.5 * (V + 1))

where q is a count as it is read back, T(v) the number of v's stored bigrams, Q(v) the sum of their q,
R(v) the count of v that they leave, and M the sum of q over all words: so the probabilities of the
known words and of one unknown add up to 1, and so do those after v.  q(w), T(v), Q(v) and R(v) of the COMMON commonest words
are broadcast exactly; those of other words come from the filter, whose items T and R are too (Q + R is then
taken to be q(v)), so after a rare word, and where a probe is a false positive, the sum is 1 up to the steps
of the logarithmic scale.  ``score`` is the sum of log10 p over the text's tokens.  ``base_score``
uses the exact unigram counts.

Bounds.  Texts come to the workers SCORE_CHARS bytes (or one longer text) at a time.
The filter takes BITS bits an item.  Up to MAX_FILTER_MB it is broadcast, and the
workers of a machine map the one file in which Spark keeps it there; a larger one
stays distributed in its chunks, which the distinct keys of every block of documents
meet in a join.  All counts of the corpus stay distributed: the words beyond the
common ones meet their exact counts in a join on the word's hash.

A null text is empty: one token.  Rows that repeat an id are documents of their own,
in training as well.  Without training documents every count is 0 and V and N are 0.
An empty table gives no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterable, Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampspark.llm.common import Scratch, batches_bounded, blocks, crc_mod, shuffles_freed, text_or_empty

FOLDS, HELD_OUT = 5, 1
COMMON = 1 << 16
BASE = 1.5
PROBES = 4
BITS = 10
CHUNK_BITS = 1 << 18
MAX_FILTER_MB = 256
DISCOUNT = 0.6
FLUSH = 1_500_000
PART_CHARS = 8_000_000  # counts of so much text meet in one part
SCORE_CHARS = 3_000_000
SLICE = 1 << 20
BLOCK = 1024
ROUNDS = 4
PART_CHUNKS = 64
MARK = b"ampspark: a filter's bytes follow"
END = xxhash.xxh64_intdigest(b"\n") - (1 << 64)  # no word can be this
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@cache
def _hashing() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, 0 for white space; the powers of an odd base, and of its inverse modulo 2**64."""
    letters = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
    letters[list(b" \t\n\v\f\r")] = 0
    base = 0x9E3779B97F4A7C15  # 5 modulo 8: differences of its powers are divisible by low powers of 2 only
    powers = []
    for b in (base, pow(base, -1, 1 << 64)):
        x = np.full(SLICE, b, np.uint64)
        x[0] = 1
        powers.append(np.multiply.accumulate(x))
    return letters, *powers


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of some bytes start, and their signed 64-bit hashes: sums of letter * base**place, mixed."""
    letters, powers, inverse = _hashing()
    solid = np.zeros(len(raw) + 2, bool)
    solid[1:-1] = (letters != 0)[raw]
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + SLICE, "right")))
        if ends[j - 1] - low > SLICE:  # one word
            out[i] = xxhash.xxh64_intdigest(raw[low : ends[i]].tobytes())
        else:
            x = letters[raw[low : ends[j - 1]]]
            x *= powers[: len(x)]
            at = starts[i:j] - low
            out[i:j] = mix(np.add.reduceat(x, at) * inverse[at])
        i = j
    return starts, out.view(np.int64)


def hashes_of(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts (one at least) in a row, each text's with the end, and how many each has."""
    encoded = [t.encode("utf-8", "replace").lower() for t in texts]
    starts, words = _words(np.frombuffer(b"\n".join(encoded), np.uint8))
    lengths = np.diff(np.searchsorted(starts, np.cumsum([len(t) + 1 for t in encoded])), prepend=0) + 1
    flat = np.full(len(words) + len(encoded), END)
    inside = np.ones(len(flat), bool)
    inside[np.cumsum(lengths) - 1] = False
    flat[inside] = words
    return flat, lengths


def _summed(key: np.ndarray, columns: tuple[np.ndarray, ...], n: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, their columns and the sums of n (1 each where there is none)."""
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    if n is None:
        n = np.diff(first, append=len(key))
    else:
        n = np.add.reduceat(n[order], first) if len(first) else n
    return key[first], *[c[order[first]] for c in columns], n


def _part_key(first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    """A bigram's part (``bits`` of its key), 20 bits of its first word and the rest of the key: bigrams of a word lie together in a part."""
    key = pair_key(first, second).view(np.uint64)
    key &= ~U((1 << (64 - bits)) - 1) | U((1 << (44 - bits)) - 1)
    word = mix(first.astype(np.uint64))
    word >>= U(44)
    word <<= U(44 - bits)
    word |= key
    return word


def _parted(word: bool, bits: int, key: np.ndarray, *columns: np.ndarray) -> pd.DataFrame:
    """One row for each part that has keys: the columns' bytes in a row."""
    part = (key >> U(64 - bits)).astype(np.int32) if bits else np.zeros(len(key), np.int32)
    at = np.flatnonzero(np.diff(part, prepend=-1, append=1 << 30))
    blobs = [b"".join(c[i:j].tobytes() for c in columns) for i, j in zip(at, at[1:])]
    return pd.DataFrame({"part": part[at[:-1]], "word": word, "body": blobs})


def _counter(bits: int):
    """mapInPandas function: text -> (part, word, body): counts of its words and of its bigrams, FLUSH tokens at a time; the end precedes the first word."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            for first, end in blocks(batch["text"].str.len().tolist()):
                held.append(hashes_of(batch["text"].iloc[first:end])[0])
                n += len(held[-1])
                if n >= FLUSH:
                    yield from flushed(held)
                    n = 0
        if held:
            yield from flushed(held)

    def flushed(held: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        """Empties ``held``; what it yields is sent when the arrays it came from are gone."""
        flat = np.concatenate(held)
        held.clear()
        yield words(flat)
        found = bigrams(flat)
        del flat
        yield found

    def words(flat: np.ndarray) -> pd.DataFrame:
        key, n = _summed(flat.view(np.uint64), ())
        return _parted(True, bits, key, key, n.astype(np.uint32))

    def bigrams(flat: np.ndarray) -> pd.DataFrame:
        before = np.concatenate((flat[-1:], flat[:-1]))  # every text ends with the end
        key, a, b, n = _summed(_part_key(before, flat, bits), (before, flat))
        del before
        return _parted(False, bits, key, a, b, n.astype(np.uint32))

    return count


def _counted(bits: int):
    """applyInPandas function: the bodies of a part -> (word, a, b, n): words (a 0), and bigrams seen twice or more."""

    def columns(bodies: pd.Series, width: int) -> list[np.ndarray]:
        rows = [len(x) // (8 * width + 4) for x in bodies]
        found = [np.concatenate([np.frombuffer(x, np.int64, n, 8 * n * i) for x, n in zip(bodies, rows)]) for i in range(width)]
        return [*found, np.concatenate([np.frombuffer(x, np.uint32, n, 8 * n * width) for x, n in zip(bodies, rows)]).astype(np.int64)]

    def count(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        if part["word"].any():
            key, n = columns(part["body"][part["word"]], 1)
            key, n = _summed(key, (), n)
            out.append(pd.DataFrame({"word": True, "a": 0, "b": key, "n": n}))
        if not part["word"].all():
            a, b, n = columns(part["body"][~part["word"]], 2)
            _, a, b, n = _summed(_part_key(a, b, bits), (a, b), n)
            more = n > 1
            out.append(pd.DataFrame({"word": False, "a": a[more], "b": b[more], "n": n[more]}))
        return pd.concat(out)

    return count


class Common:
    """The commonest words, by hash: ids in order of hash, with exact counts, T, R and Q + R."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, followers: np.ndarray, rest: np.ndarray, whole: np.ndarray) -> None:
        self.keys, self.counts, self.followers, self.rest, self.whole = keys, counts, followers, rest, whole

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Id of each hash, -1 for words that are not common."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)


def level_of(n: np.ndarray) -> np.ndarray:
    """1 + floor(log n): the quantised count."""
    return 1 + np.floor(np.log(np.maximum(n, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


def count_of(level: np.ndarray) -> np.ndarray:
    """A count for a level, 0 for level 0: the middle of the counts it stands for."""
    low = np.ceil(BASE ** (np.maximum(level, 1) - 1) - 1e-9)
    high = np.maximum(low, np.ceil(BASE ** np.maximum(level, 1) - 1e-9) - 1)
    return np.where(level > 0, (low + high) / 2, 0.0)


def read_back(n: Column) -> Column:
    """``count_of(level_of(n))`` as a column."""
    level = F.floor(F.log(BASE, n) + 1e-9) + 1
    low = F.ceil(F.pow(F.lit(BASE), level - 1) - 1e-9)
    return (low + F.greatest(low, F.ceil(F.pow(F.lit(BASE), level) - 1e-9) - 1)) / 2.0


def _steps(key: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(key.astype(np.uint64) + U(level * 0x9E3779B97F4A7C15 % 2**64))
    return h, (h >> U(32)) | U(1)


def _bits(key: np.ndarray, level: int) -> list[np.ndarray]:
    """PROBES positions inside a chunk for each (key, level)."""
    h, step = _steps(key, level)
    return [((h + U(i) * step) & U(CHUNK_BITS - 1)).astype(np.int64) for i in range(PROBES)]


def _chunk(key: np.ndarray, chunks: int) -> np.ndarray:
    return (mix(key.astype(np.uint64) ^ U(0xA0761D6478BD642F)) % U(chunks)).astype(np.int64)


def _levels(filled: np.ndarray, key: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Levels read from the bytes of a filter; ``base`` is the first bit of each key's chunk."""
    level = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    n = 0
    while len(live):
        n += 1
        h, step = _steps(key[live], n)
        for i in range(PROBES):
            at = base[live] + ((h + U(i) * step) & U(CHUNK_BITS - 1)).astype(np.int64)
            hit = (filled[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            live, h, step = live[hit], h[hit], step[hit]
        level[live] = n
    return level


class Filter:
    """All chunks in a row; ``level`` reads counts back by repeated probes."""

    def __init__(self, chunks: int, filled: np.ndarray) -> None:
        self.chunks, self.bytes = chunks, filled

    def level(self, key: np.ndarray) -> np.ndarray:
        return _levels(self.bytes, key, _chunk(key, self.chunks) * CHUNK_BITS)


class Found:
    """Levels that a join has read already: sorted keys, 0 for all others."""

    def __init__(self, keys: np.ndarray, levels: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.levels = keys[order], levels[order].astype(np.int64)

    def level(self, key: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.levels[at], 0)


def filter_chunks(items: DataFrame) -> tuple[int, DataFrame]:
    """From (key, n): the number of chunks and (chunk, bits); items are dealt to chunks of fixed size by hash, each chunk is built by one small group."""
    total = items.select(F.sum(F.floor(F.log(BASE, "n") + 1e-9) + 1).alias("x")).first()["x"] or 0
    chunks = int(total * BITS // CHUNK_BITS + 1)

    @F.pandas_udf("int")
    def chunk(key: pd.Series) -> pd.Series:
        return pd.Series(_chunk(key.to_numpy(), chunks)).astype("int32")

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(CHUNK_BITS, bool)
        key, level = rows["key"].to_numpy(), level_of(rows["n"].to_numpy())
        step = 1
        while len(key):
            for at in _bits(key, step):
                bits[at] = True
            more = level > step
            key, level, step = key[more], level[more], step + 1
        return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    return chunks, items.withColumn("chunk", chunk("key")).groupBy("chunk").applyInPandas(fill, "chunk int, bits binary")


def gathered(chunks: int, made: DataFrame) -> np.ndarray:
    """MARK, then the bytes of all chunks."""
    size = CHUNK_BITS // 8
    filled = np.zeros(len(MARK) + chunks * size, np.uint8)
    filled[: len(MARK)] = np.frombuffer(MARK, np.uint8)
    for r in made.toLocalIterator():
        first = len(MARK) + r["chunk"] * size
        filled[first : first + size] = np.frombuffer(r["bits"], np.uint8)
    return filled


def mapped(model: Broadcast, chunks: int) -> np.ndarray:
    """The bytes of all chunks on a worker, from Spark's file of the broadcast: it is one for the workers of a machine, and none holds a copy."""
    path = getattr(model, "_path", None)  # none if Spark's files are encrypted
    if path:
        with open(path, "rb") as file:
            pages = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        at = pages.find(MARK, 0, 4096)
        if at >= 0:
            return np.frombuffer(pages, np.uint8, chunks * CHUNK_BITS // 8, at + len(MARK))
    return model.value[len(MARK) :]


def built_filter(items: DataFrame) -> Filter:
    chunks, made = filter_chunks(items)
    return Filter(chunks, gathered(chunks, made)[len(MARK) :])


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Filter key of a bigram of word hashes; apart from the words' own."""
    return mix(mix(first.astype(np.uint64) + U(0x5851F42D4C957F2D)) + second.astype(np.uint64)).view(np.int64)


def followers_key(word: np.ndarray) -> np.ndarray:
    return mix(word.astype(np.uint64) ^ U(0xD6E8FEB86659FD93)).view(np.int64)


def rest_key(word: np.ndarray) -> np.ndarray:
    return mix(word.astype(np.uint64) ^ U(0xA5A3564E27F88691)).view(np.int64)


class Tokens:
    """Texts in a row by their distinct words and bigrams (the end comes before the first word), and where the texts start."""

    def __init__(self, texts: Iterable[str]) -> None:
        self.flat, self.lengths = hashes_of(texts)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.words, self.at = np.unique(self.flat, return_inverse=True)
        # Every text ends with the end.
        before = np.concatenate((self.at[-1:], self.at[:-1]))
        pairs, self.pair = np.unique(before * len(self.words) + self.at, return_inverse=True)
        self.first, self.second = np.divmod(pairs, len(self.words))


def asked_keys(texts: Iterable[str], common: Common) -> np.ndarray:
    """All filter keys that a score of these texts can ask for."""

    def distinct(x: np.ndarray) -> np.ndarray:
        x = np.sort(x)
        return x[np.concatenate(([True], x[1:] != x[:-1]))]

    flat, _ = hashes_of(texts)
    words = distinct(flat)
    rare = words[common.ids(words) < 0]
    # Every text ends with the end.
    return np.concatenate((rare, followers_key(rare), rest_key(rare), distinct(pair_key(np.concatenate((flat[-1:], flat[:-1])), flat))))


class Scorer:
    """log10 probabilities from the common words and a filter.

    ``n`` tokens and ``v`` distinct ones were learned; ``m`` is the sum of all counts as they are read back.
    """

    def __init__(self, common: Common, n: int, m: float, v: int, counts: Filter | Found) -> None:
        self.common, self.n, self.m, self.v, self.counts = common, n, m, v, counts

    def facts(self, words: np.ndarray) -> dict[str, np.ndarray]:
        ids = self.common.ids(words)
        known, rare = ids >= 0, np.flatnonzero(ids < 0)
        c, base, left, followers, rest = np.zeros(len(words)), np.zeros(len(words)), np.ones(len(words)), np.zeros(len(words)), np.zeros(len(words))
        at = ids[known]
        c[known] = self.common.counts[at]
        # A stored bigram was seen twice, and so were its words: levels are never too low.
        followed = c > 1
        level = self.counts.level(words[rare])
        c[rare], followed[rare] = count_of(level), level > 1
        base[known] = np.log10((c[known] + 0.5) / (self.n + 0.5 * (self.v + 1)))
        whole = c.copy()
        whole[known], followers[known], rest[known] = self.common.whole[at], self.common.followers[at], self.common.rest[at]
        ask = rare[level > 1]
        followers[ask] = count_of(self.counts.level(followers_key(words[ask])))
        some = ask[followers[ask] > 0]
        rest[some] = count_of(self.counts.level(rest_key(words[some])))
        some = (followers > 0) & (whole > 0)
        left[some] = np.clip((rest[some] + DISCOUNT * followers[some]) / whole[some], 1e-3, 1.0)
        unigram = (c + 0.5) / (self.m + 0.5 * (self.v + 1))
        return {"known": known, "base": base, "followed": followed, "followers": followers, "unigram": unigram, "whole": np.maximum(whole, 1), "left": left}

    def pair_scores(self, t: Tokens, x: dict[str, np.ndarray]) -> np.ndarray:
        """One for each distinct bigram."""
        p = x["left"][t.first] * x["unigram"][t.second]
        both = np.flatnonzero((x["followed"] & (x["followers"] > 0))[t.first] & x["followed"][t.second])
        if len(both):
            v = t.first[both]
            level = self.counts.level(pair_key(t.words[v], t.words[t.second[both]]))
            p[both] += np.maximum(count_of(level) - DISCOUNT, 0) / x["whole"][v]
        return np.log10(np.minimum(1.0, p))


def _joined(scratch: Scratch, ready: DataFrame, chunks: int, made: DataFrame, common, score, schema: str) -> DataFrame:
    """Scores with a filter too large to broadcast.  Each block of documents sends its distinct keys to the parts of the filter and
    gets back those found, with a byte for the level.  This is done in ROUNDS, so that only a share of keys and texts is on disk at a time."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, rows in batch.groupby("block"):
                texts = rows["text"]
                known = Common(*common.value)
                # A key may come again in another part of a long block.
                keys = np.concatenate([asked_keys(texts.iloc[i:j], known) for i, j in blocks(texts.str.len().tolist(), SCORE_CHARS)])
                part = _chunk(keys, chunks) // PART_CHUNKS
                order = np.argsort(part)
                keys, part = keys[order], part[order]
                at = np.flatnonzero(np.diff(part, prepend=-1, append=1 << 40))
                yield pd.DataFrame({"block": block, "part": part[at[:-1]], "keys": [keys[i:j].tobytes() for i, j in zip(at, at[1:])]})

    def probe(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"block": [], "keys": [], "levels": []})
        first, size = int(rows["part"].iloc[0]) * PART_CHUNKS, CHUNK_BITS // 8
        filled = np.zeros(PART_CHUNKS * size, np.uint8)
        for chunk, bits in zip(own["chunk"], own["bits"]):
            filled[(chunk - first) * size : (chunk - first + 1) * size] = np.frombuffer(bits, np.uint8)
        found = []
        for body in rows["keys"]:
            key = np.frombuffer(body, np.int64)
            level = _levels(filled, key, (_chunk(key, chunks) - first) * CHUNK_BITS)
            found.append((key[level > 0].tobytes(), level[level > 0].astype(np.uint8).tobytes()))
        return pd.DataFrame({"block": rows["block"].to_numpy(), "keys": [k for k, _ in found], "levels": [x for _, x in found]})

    def answer(part: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        counts = Found(np.frombuffer(b"".join(found["keys"]), np.int64), np.frombuffer(b"".join(found["levels"]), np.uint8))
        return pd.concat([score(part.iloc[i:j], counts) for i, j in blocks(part["text"].str.len().tolist(), SCORE_CHARS)])

    texts = scratch.put(ready.withColumn("block", F.shiftright("uid", BLOCK.bit_length() - 1)), "texts")
    filled = made.withColumn("part", F.floor(F.col("chunk") / PART_CHUNKS).cast("int"))
    # uid starts with the number of the row's partition.
    partitions = (texts.agg(F.max("uid")).first()[0] or 0) // (1 << 33) + 1
    bounds = sorted({i * partitions // ROUNDS for i in range(ROUNDS + 1)})
    done = []
    for first, end in zip(bounds, bounds[1:]):
        some = texts.where(F.col("uid") >= F.lit(first << 33)).where(F.col("uid") < F.lit(end << 33))
        keys = some.select("block", "text").mapInPandas(ask, "block long, part int, keys binary")
        levels = keys.groupBy("part").cogroup(filled.groupBy("part")).applyInPandas(probe, "block long, keys binary, levels binary")
        done.append(scratch.put(some.groupBy("block").cogroup(levels.groupBy("block")).applyInPandas(answer, schema), "scores"))
    scratch.drop(texts)
    return reduce(DataFrame.unionByName, done)


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per document."""
    with shuffles_freed(docs.sparkSession), batches_bounded(docs.sparkSession, SCORE_CHARS):
        return _scored(docs, Scratch(docs.sparkSession))


def _scored(docs: DataFrame, scratch: Scratch) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select("doc_id", text_or_empty().alias("text"), (crc_mod(FOLDS) == HELD_OUT).alias("held_out"))
    train = rows.where("not held_out").select("text")
    # One pass over the texts; bigrams seen once are in no item of the filter, and their count is what R leaves.
    chars = train.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = (chars // PART_CHARS).bit_length()
    counts = train.mapInPandas(_counter(bits), "part int, word boolean, body binary").groupBy("part")
    counts = scratch.put(counts.applyInPandas(_counted(bits), "word boolean, a long, b long, n long"), "counts")
    words, pairs = counts.where("word").select(F.col("b").alias("key"), "n"), counts.where("not word").select("a", "b", "n")
    totals = words.agg(F.sum("n").alias("n"), F.count("key").alias("v")).first()
    n, v = totals["n"] or 0, totals["v"]
    after = pairs.groupBy(F.col("a").alias("key")).agg(F.count(F.lit(1)).alias("followers"), F.sum("n").alias("taken"), F.sum(read_back(F.col("n"))).alias("held"))
    after = scratch.put(after.join(words, "key").select("key", "followers", "held", (F.col("n") - F.col("taken")).alias("rest")), "followers")
    top = words.orderBy(F.desc("n"), "key").limit(COMMON).join(after, "key", "left")
    # At most COMMON rows; without stored bigrams a word leaves all of its count.
    rest = F.coalesce("rest", "n")
    found = top.select("key", "n", F.coalesce("followers", F.lit(0)), rest, rest + F.coalesce("held", F.lit(0.0))).collect()
    found = sorted(map(tuple, found))
    common = tuple(np.array([r[i] for r in found], t) for i, t in enumerate((np.int64, np.int64, np.float64, np.float64, np.float64)))
    steps = words.groupBy("n").agg(F.count(F.lit(1)).alias("words")).agg(F.sum(read_back(F.col("n")) * F.col("words")).alias("m")).first()["m"] or 0.0
    m_all = float(steps + (common[1] - count_of(level_of(common[1]))).sum())

    @F.pandas_udf("long")
    def as_pair(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(pair_key(a.to_numpy(), b.to_numpy()))

    @F.pandas_udf("long")
    def as_followers(key: pd.Series) -> pd.Series:
        return pd.Series(followers_key(key.to_numpy()))

    @F.pandas_udf("long")
    def as_rest(key: pd.Series) -> pd.Series:
        return pd.Series(rest_key(key.to_numpy()))

    items = (
        words.unionByName(pairs.select(as_pair("a", "b").alias("key"), "n"))
        .unionByName(after.select(as_followers("key").alias("key"), F.col("followers").alias("n")))
        .unionByName(after.where("rest > 0").select(as_rest("key").alias("key"), F.col("rest").alias("n")))
    )
    chunks, made = filter_chunks(items)
    made = scratch.put(made, "filter")
    # Plain arrays: workers need not have this package.
    known_words = spark.sparkContext.broadcast(common)
    schema = "uid long, doc_id long, held_out boolean, n_tokens long, common_tokens long, base double, score double, rare array<long>"

    def score(part: pd.DataFrame, counts: Filter | Found) -> pd.DataFrame:
        t, m = Tokens(part["text"]), Scorer(Common(*known_words.value), n, m_all, v, counts)
        x = m.facts(t.words)
        known = x["known"][t.at]
        rare, common_tokens = t.flat[~known], np.add.reduceat(known.astype(np.int64), t.starts)
        ends = np.cumsum(t.lengths - common_tokens)
        return pd.DataFrame(
            {
                "uid": part["uid"].to_numpy(),
                "doc_id": part["doc_id"].astype("Int64"),
                "held_out": part["held_out"].to_numpy(),
                "n_tokens": t.lengths,
                "common_tokens": common_tokens,
                "base": np.add.reduceat(x["base"][t.at], t.starts),
                "score": np.add.reduceat(m.pair_scores(t, x)[t.pair], t.starts),
                "rare": [rare[i:j] for i, j in zip(np.concatenate(([0], ends)), ends)],
            }
        )

    ready = rows.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text")
    if chunks * CHUNK_BITS <= MAX_FILTER_MB * 8 * 2**20:
        model = spark.sparkContext.broadcast(gathered(chunks, made))

        def score_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            counts = Filter(chunks, mapped(model, chunks))
            for batch in batches:
                for first, end in blocks(batch["text"].str.len().tolist(), SCORE_CHARS):
                    yield score(batch.iloc[first:end], counts)

        done = scratch.put(ready.mapInPandas(score_all, schema), "scores")
    else:
        done = _joined(scratch, ready, chunks, made, known_words, score, schema)
    scratch.drop(after, made)
    rest = done.select("uid", F.explode("rare").alias("key")).join(words, "key", "left").withColumn("c", F.coalesce("n", F.lit(0)))
    exact = rest.groupBy("uid").agg(
        F.sum((F.col("c") > 0).cast("long")).alias("known"), F.sum(F.log10((F.col("c") + 0.5) / F.lit(n + 0.5 * (v + 1)))).alias("more")
    )
    return done.drop("rare").join(exact, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("common_tokens") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )
