"""MinHash near-dedup with DartMinHash signatures.

A document is the multiset of its five-word shingles (lower-cased words between white
space; a shorter text is one shingle).  Similar means a weighted Jaccard similarity of
``THRESHOLD`` or more; the classes are the connected components of that relation, and
``class_id`` is the smallest id in them.

* Signatures.  Every unit of weight of a shingle is a strip at which darts are thrown:
  a Poisson process along the rank axis, generated from hashes of (shingle, unit), so two
  documents see the same darts in the region they share.  Each dart has a coordinate;
  the earliest dart per coordinate is the signature.  A document throws darts up to a rank
  that its weight chooses (about K ln K + 2 K of them in all), and on if a coordinate is empty.
* Copies.  Documents with equal shingle sequences are one node from here on.
* Banded joining.  A band's key is the hash of its ROWS coordinates.  Star rounds compare
  the members of a bucket with one member, another one each round (those first that meet most
  others in buckets); members of its class need no comparison.
* The last round takes the buckets whose members are not yet one class: what is in every
  class but a bucket's largest meets the others of its bucket.
* Candidates first meet an exact bound: a node's PARITY bits tell, for each slot, whether an
  odd number of its strips fall there, so two nodes differ in at least as many strips as
  bits.  Pairs that differ in more strips than the threshold allows can't be similar.
* Every other candidate pair is verified exactly on the whole texts.  A group of n copies
  costs about n comparisons, not n squared.
* Components by minimum label propagation with pointer jumping over stored tables.

Hot keys (a bucket, a center, a group of copies with more than a 1/SHARES of all rows) are
dealt to many tasks in every join; group-wise values are aggregated before the shuffle.

A pair at similarity 0.8 shares no band with probability (1 - 0.8**ROWS)**BANDS, below 1e-4.
Nulls count as empty; a document without words is a class of its own.  Rows that repeat
an id are documents of their own: ``kept`` marks one row of each class, the one with the smallest
id (null ids last).  A class of null ids only has a null class_id.  An empty table
gives no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampspark.llm.common import Scratch, copied, dealt, hot_keys, spread_join, text_or_empty

WORDS = 5
THRESHOLD = 0.8
ROWS = 6
BANDS = 32
K = ROWS * BANDS
STARS = 2
MEMO = 300_000
BATCH_WORDS = 100_000
PARITY = 1024
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) >= MEMO:
            self.clear()
        self[word] = h
        return h


def shingles(text: str, memo: WordHashes, words: int = WORDS) -> np.ndarray:
    """Hashes of the text's shingles in order, repeats included."""
    tokens = text.lower().encode("utf-8", "replace").split()
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))
    n = max(1, len(h) - words + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(words, len(h))):
        out = mix(out + h[i : i + n] + U(0x9E3779B97F4A7C15))
    return out


def strips(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, key) of every unit of weight: a shingle's i-th occurrence in its document."""
    owner = np.repeat(np.arange(len(sets), dtype=np.uint64), [len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    element = mix(flat + U(0x9E3779B97F4A7C15) * owner)
    order = np.argsort(element)
    owner, flat, element = owner[order], flat[order], element[order]
    first = np.ones(len(flat), bool)
    first[1:] = element[1:] != element[:-1]
    at = np.arange(len(flat))
    nth = at - np.maximum.accumulate(np.where(first, at, 0))
    return owner.astype(np.int64), mix(flat + U(0x9E3779B97F4A7C15) * nth.astype(np.uint64))


def _gap(h: np.ndarray) -> np.ndarray:
    return -np.log(((h >> U(11)).astype(np.float64) + 0.5) * 2.0**-53)


def parity(owner: np.ndarray, key: np.ndarray, n: int, bits: int = PARITY) -> np.ndarray:
    """(n, bits / 64) of int64: bit j of a document is set if an odd number of its strips fall into slot j."""
    odd = np.bincount(owner * bits + (mix(key) % U(bits)).astype(np.int64), minlength=n * bits) & 1
    return np.packbits(odd.astype(bool).reshape(n, bits), axis=1, bitorder="little").view(np.int64)


def signatures(sets: list[np.ndarray], k: int = K, found: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """(documents, k) of uint32: the earliest dart of each coordinate.  Every set has an element; ``found``: its strips."""
    out = np.full(len(sets) * k, np.uint64(0xFFFFFFFFFFFFFFFF))
    owner, key = found or strips(sets)
    weight = np.array([len(s) for s in sets], np.float64)
    darts = k * np.log(k) + 2 * k
    low, high = np.zeros(len(sets)), darts / weight
    todo = np.ones(len(sets), bool)
    while todo.any():
        use = todo[owner]
        own, seed = owner[use], key[use]
        rank, n, base = np.zeros(len(own)), 0, seed
        while len(own):
            n += 1
            dart = mix(base + U(n * 0xD1342543DE82EF95 % 2**64))
            rank = rank + _gap(dart)
            live = rank <= high[own]
            own, base, rank, dart = own[live], base[live], rank[live], dart[live]
            new = rank > low[own]
            d = mix(dart[new] ^ U(0xA0761D6478BD642F))
            # Ranks as float32 bits keep their order; the low half names the dart.
            value = (rank[new].astype(np.float32).view(np.uint32).astype(np.uint64) << U(32)) | (d & U(0xFFFFFFFF))
            np.minimum.at(out, own[new] * k + ((d >> U(32)) % U(k)).astype(np.int64), value)
        empty = (out.reshape(len(sets), k) == U(0xFFFFFFFFFFFFFFFF)).any(axis=1)
        todo, low, high = todo & empty, high, np.where(empty, high * 2, high)
    return (out & U(0xFFFFFFFF)).astype(np.uint32).reshape(len(sets), k)


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(documents, BANDS) of int64, from the first coordinates."""
    bands = min(BANDS, signature.shape[1] // rows)
    s = signature[:, : bands * rows].reshape(len(signature), bands, rows).astype(np.uint64)
    h = np.tile(np.arange(bands, dtype=np.uint64), (len(signature), 1))
    for i in range(rows):
        h = mix(h + s[:, :, i] + U(0x9E3779B97F4A7C15))
    return h.view(np.int64)


def batched(texts: list[str], memo: WordHashes, words: int = BATCH_WORDS) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(index of the first, shingle sets) of consecutive texts with about ``words`` shingles together, or of one longer text."""
    at, held, n = 0, [], 0
    for i, t in enumerate(texts):
        s = shingles(t, memo)
        if held and n + len(s) > words:
            yield at, held
            at, held, n = i, [], 0
        held.append(s)
        n += len(s)
    if held:
        yield at, held


def sketched(docs: DataFrame) -> DataFrame:
    """uid, doc_id, th (hash of the text), same1, same2 (hash of the shingle sequence), size, keys (one per band), bits; null from same1 on without words."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordHashes()
        for batch in batches:
            for at, sets in batched(batch["text"].tolist(), memo):
                part = batch.iloc[at : at + len(sets)]
                full = [i for i, s in enumerate(sets) if len(s)]
                out = part[["uid", "doc_id", "th"]].assign(same1=None, same2=None, size=None, keys=None, bits=None)
                if full:
                    same = np.array([np.frombuffer(hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), np.int64) for i in full])
                    some = [sets[i] for i in full]
                    found = strips(some)
                    signed, bits = band_keys(signatures(some, found=found)), parity(*found, len(some))
                    known = pd.DataFrame({"same1": same[:, 0], "same2": same[:, 1], "size": list(map(len, some)), "keys": list(signed), "bits": list(bits)})
                    out.iloc[full, 3:] = known.to_numpy(object)
                yield out.astype({c: "Int64" for c in ("doc_id", "same1", "same2", "size")})

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("th"), text_or_empty().alias("text"))
    return rows.mapInPandas(sketch, "uid long, doc_id long, th long, same1 long, same2 long, size long, keys array<long>, bits array<long>")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets of hashes."""
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = np.minimum(nx[i], ny[j]).sum()
    return float(both / (len(a) + len(b) - both))


def verified(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) that are similar.  ``texts`` has node (unique) and text; both are stored tables."""

    @F.pandas_udf("boolean")
    def similar(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        memo = WordHashes()
        for a, b in batches:
            known: dict[str, np.ndarray] = {}  # a batch repeats its first members
            out = []
            for s, t in zip(a, b):
                if s not in known:
                    known = {s: shingles(s, memo)}
                x, y = known[s], shingles(t, memo)
                few, many = sorted((len(x), len(y)))
                out.append(bool(few >= threshold * many and similarity(x, y) >= threshold))
            yield pd.Series(out)

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    hot_a, hot_b = (hot_keys(pairs.groupBy(c).agg(F.count(F.lit(1)).alias("n")), [c]) for c in ("a", "b"))
    both = spread_join(spread_join(pairs, right, ["b"], hot_b, F.col("a")), left, ["a"], hot_a, F.col("b"))
    return both.where(similar("text_a", "text_b")).select("a", "b")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, class (smallest node of its component) of the nodes of ``links`` (a, b)."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = scratch.put(both, "edges")
    hubs = scratch.put(hot_keys(edges.groupBy("b").agg(F.count(F.lit(1)).alias("n")), ["b"]), "hubs")
    labels = scratch.put(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("class")), "labels")
    while True:
        heard = spread_join(edges, labels.select(F.col("node").alias("b"), "class"), ["b"], hubs, F.col("a")).groupBy("a").agg(F.min("class").alias("near"))
        least = heard.join(labels, F.col("a") == F.col("node")).select("node", F.least("near", "class").alias("class"), F.col("class").alias("old"))
        jump = labels.select(F.col("node").alias("class"), F.col("class").alias("beyond"))
        big = hot_keys(labels.groupBy("class").agg(F.count(F.lit(1)).alias("n")), ["class"])
        new = spread_join(least, jump, ["class"], big, F.col("node"), "left").select("node", F.least("class", F.coalesce("beyond", "class")).alias("class"), "old")
        new = scratch.put(new, "labels")
        changed = new.where("class <> old").limit(1).count()
        scratch.drop(labels)
        labels = new
        if not changed:
            scratch.drop(edges, hubs)
            return labels


def possible(size_a: Column, bits_a: Column, size_b: Column, bits_b: Column, threshold: float) -> Column:
    """False only if sizes or parity bits prove that two nodes are not similar."""
    apart = sum((F.bit_count(F.get(bits_a, F.lit(i)).bitwiseXOR(F.get(bits_b, F.lit(i)))) for i in range(PARITY // 64)), F.lit(0))
    near = F.least(size_a, size_b) >= threshold * F.greatest(size_a, size_b) - 1e-6
    return near & (apart * (1 + threshold) <= (1 - threshold) * (size_a + size_b) + 1e-6)


def _bounded(pairs: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that may be similar.  ``pairs`` is stored; ``sizes`` has node (unique), size, bits."""
    both = pairs
    for c, other in (("b", "a"), ("a", "b")):
        hot = hot_keys(pairs.groupBy(c).agg(F.count(F.lit(1)).alias("n")), [c])
        own = sizes.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("bits").alias(f"bits_{c}"))
        both = spread_join(both, own, [c], hot, F.col(other))
    return both.where(possible(F.col("size_a"), F.col("bits_a"), F.col("size_b"), F.col("bits_b"), threshold)).select("a", "b")


def _across(rest: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(a, b), a < b: pairs of different classes in one bucket that may be similar, each once.  ``rest`` (stored) has key, node, class, size, bits."""
    # The largest class of a bucket stays on one side: n texts of it and r others make r * n pairs.
    each = rest.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n"))
    main = each.groupBy("key").agg(F.max(F.struct("n", "class"))["class"].alias("main"), F.sum("n").alias("n"))
    main = scratch.put(main, "main")
    hot = scratch.put(hot_keys(main, ["key"]), "hot")
    right = spread_join(rest, main.select("key", "main"), ["key"], hot, F.col("node"))
    left = right.where(F.col("class") != F.col("main")).select("key", *[F.col(c).alias(f"{c}_l") for c in ("node", "class", "size", "bits")])
    both = copied(left, ["key"], hot).join(dealt(right, ["key"], hot, F.col("node")), ["key", "part"])
    once = (F.col("class") == F.col("main")) | (F.col("node_l") < F.col("node"))
    found = both.where((F.col("class") != F.col("class_l")) & once & possible(F.col("size"), F.col("bits"), F.col("size_l"), F.col("bits_l"), threshold))
    return found.select(F.least("node_l", "node").alias("a"), F.greatest("node_l", "node").alias("b")).distinct()


def near_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: uid (a number of its own), doc_id, th, class_id, kept (one row of each class)."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.put(sketched(docs), "sketches")
    same = ["same1", "same2"]
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "uid", "th")
    groups = rows.where("same1 is not null").groupBy(*same).agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("size", "keys", "bits")])
    groups = scratch.put(groups.withColumn("node", F.col("first.uid")), "groups")
    nodes = groups.select("node", F.explode("keys").alias("key"))
    buckets = scratch.put(nodes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    hot = hot_keys(buckets, ["key"])
    placed = scratch.put(dealt(nodes, ["key"], hot, F.col("node")).join(copied(buckets, ["key"], hot), ["key", "part"]), "placed")
    hot = scratch.put(hot, "hot")
    # Texts that many others meet are the likeliest to be near all of their bucket: they are its first centers.
    met = scratch.put(placed.groupBy("node").agg(F.sum("n").alias("met")), "met")
    wanted = met.join(groups, "node").select("node", F.col("first.id").alias("id"), F.col("first.th").alias("th"))
    found = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text_or_empty()).alias("th"), text_or_empty().alias("text"))
    texts = scratch.put(found.join(wanted.withColumnRenamed("id", "wanted"), ["th"]).where(F.col("id").eqNullSafe(F.col("wanted"))).select("node", "text").dropDuplicates(["node"]), "texts")
    sizes = groups.select("node", "size", "bits")
    classes = done = None
    for turn in range(STARS + 1):
        classed = placed.join(met, "node")
        classed = classed.withColumn("class", F.col("node")) if classes is None else classed.join(classes.select("node", "class"), "node", "left").withColumn("class", F.coalesce("class", "node"))
        other = F.col("met") * (4 - F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(4)) * min(turn, 1))
        center = F.max(F.struct(other.alias("order"), (-F.col("node")).alias("id"), F.col("node").alias("a"), F.col("class").alias("class_a"))).alias("center")
        open_ = classed.groupBy("key").agg(F.min("class").alias("x"), F.max("class").alias("y"), center).where("x < y")
        if turn < STARS:
            star = classed.join(copied(open_.select("key", "center.a", "center.class_a"), ["key"], hot), ["key", "part"]).where("class <> class_a")
            pairs = star.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
        else:
            rest = classed.join(copied(open_.select("key"), ["key"], hot), ["key", "part"]).select("key", "node", "class")
            pairs = _across(scratch.put(rest.join(sizes, "node"), "rest"), threshold, scratch)
        new = scratch.put(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        if turn < STARS:
            new = scratch.put(_bounded(new, sizes, threshold), "bounded")
        links = scratch.put(verified(new, texts, threshold), "links")
        done = new if done is None else done.unionByName(new)
        if links.limit(1).count():
            classes = components(links if classes is None else links.unionByName(classes.select(F.col("class").alias("a"), F.col("node").alias("b")).where("a <> b")), scratch)
    # First document of every class of linked nodes, then of every group with more than one row.
    firsts = groups.select(*same, "node", "first", "n")
    if classes is not None:
        linked = scratch.put(classes.select("node", "class").join(firsts, "node"), "linked")
        of_class = linked.groupBy("class").agg(F.min("first").alias("best"), F.count(F.lit(1)).alias("n"))
        hot = hot_keys(of_class, ["class"])
        best = spread_join(linked, of_class.select("class", "best"), ["class"], hot, F.col("node")).select("node", "best")
        firsts = firsts.join(best, "node", "left").where("n > 1 or best is not null").withColumn("first", F.coalesce("best", "first"))
    else:
        firsts = firsts.where("n > 1")
    firsts = scratch.put(firsts.select(*same, "first", "n"), "firsts")
    joined = spread_join(rows.drop("keys", "size", "bits"), firsts.select(*same, "first"), same, hot_keys(firsts, same), F.col("uid"), "left")
    alone = F.col("first").isNull()
    out = joined.select("uid", "doc_id", "th", F.when(alone, F.col("doc_id")).otherwise(F.col("first.id")).alias("class_id"), (alone | (F.col("uid") == F.col("first.uid"))).alias("kept"))
    out = scratch.put(out, "near")
    scratch.clear(out)
    return out


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that stay, one of each class, with all their columns.

    Rows are told apart by id and text; a row of the table that repeats both is a copy.
    """
    judged = near_classes(docs, threshold)
    key = ["id", "th"]
    found = judged.select(F.col("doc_id").alias("id"), "th", "kept").groupBy(*key).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    # Rows to drop, and rows of which one of several stays; most rows are neither.
    marked = found.where("not kept or n > 1").select(F.col("id").alias("mark"), "th", "kept")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text_or_empty()).alias("th"), F.struct("*").alias("row"))
    joined = rows.join(marked, (rows["th"] == marked["th"]) & F.col("id").eqNullSafe(F.col("mark")), "left").select("id", rows["th"], "row", "kept")
    several = joined.where("kept").groupBy(*key).agg(F.first("row").alias("row"))
    return joined.where("kept is null").select("row.*").unionByName(several.select("row.*"))
