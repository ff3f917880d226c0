"""Packing token ids into sequences by best-fit decreasing.

A document's ids are those of its text (null: empty) and one final id.  Documents
longer than a sequence are first cut into full windows; what remains is packed by
best-fit decreasing: a segment tree over remaining capacities finds the tightest open
window.  Rows that repeat an id are packed as documents of their own; every row gives
at least one piece (the final id).  An empty table gives no rows; other columns are
neither read nor returned.

Texts are tokenised once, where they are read; only (id, start, length) rows travel.
They are stored with a number of their own, dealt to shards of about ``SHARD`` pieces by
its hash (so no shard grows with the input and no group is hot), and packed shard by
shard: each shard leaves at most a few windows that are not full.

Tokenising is memoised by word where the vocabulary's model lower-cases and never joins
white space, letters and other characters (checked when it is loaded): the ids of a text are then
those of its words in a row.  New words are encoded many at a time, and their ids told
apart at the marks that end words.  Control characters that Python splits at and the
tokenizer keeps send the whole text to the tokenizer, as do all texts with another kind of model.

Cost of shards: each leaves at most a few windows open, so with ``SHARD`` pieces (about
15,000 windows) less than one window in a thousand is lost against one shard for all.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampspark.llm.common import blocks, stored, text_or_empty

LENGTH = 2048
FINAL_ID = 1
SHARD = 20_000
MEMO = 900_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


#: The normalizer and the pattern of word pieces that make memoising by word exact (fixed values of that kind of vocabulary).
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PIECE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIAL = "<|"
#: ASCII marks that stand apart from letters; an apostrophe may not.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
CONTROLS = re.compile("[\x1c-\x1f]")


class Encoder(dict):
    """Text -> its ids as little-endian unsigned 32-bit bytes; a memo of words."""

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        given = (made.get("normalizer") or {}).get("normalizers") or []
        steps = (made.get("pre_tokenizer") or {}).get("pretokenizers") or []
        self.by_word = (
            [n["type"] for n in given] == NORMALIZERS
            and [x["type"] for x in steps] == ["Split", "ByteLevel"]
            and steps[0]["pattern"] == {"Regex": PIECE_PATTERN}
            and not steps[1]["add_prefix_space"]
            and not steps[1]["use_regex"]
            and all(t["content"].startswith(SPECIAL) and t["content"].split() == [t["content"]] for t in made.get("added_tokens") or [])
        )
        # Byte-level letters: printable Latin-1 characters stand for themselves, the other bytes for the characters from 256 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.bytes_as = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(plain)))}

    def _letters(self, word: str) -> str | None:
        """What the model is given for a word that is one piece, else None."""
        if word.isascii():
            return word.lower() if word.isalpha() else None
        if not word.isalpha() or not unicodedata.is_normalized("NFC", word):
            return None
        word = word.lower()
        # The vocabulary's rule for a capital sigma doesn't look at its place in the word.
        if not word.isalpha() or "\u03c2" in word or "\u03c3" in word:
            return None
        return word.encode().decode("latin-1").translate(self.bytes_as)

    def __missing__(self, word: str) -> bytes:
        letters, found = self._letters(word), None
        if letters is not None:
            found = array("I", [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()
        elif SPECIAL not in word:
            left = word.lstrip(MARKS)
            core = left.rstrip(MARKS)
            if core and core != word and self._letters(core) is not None:
                found = self[core]
                if core is not left:
                    found += self[left[len(core) :]]
                if left is not word:
                    found = self[word[: len(word) - len(left)]] + found
        if found is None:
            found = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        self[word] = found
        return found

    def __call__(self, text: str) -> bytes:
        if not self.by_word or CONTROLS.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self) > MEMO:
            self.clear()
        return b"".join(map(self.__getitem__, text.split()))


def token_pieces(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, final_id: int = FINAL_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: full windows and remainders of every document."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        encode, end = Encoder(tokenizer_path), final_id.to_bytes(4, "little")
        for batch in batches:
            ids, texts = batch["doc_id"].astype("Int64"), batch["text"].tolist()
            for first, last in blocks(list(map(len, texts))):
                found = [x + end for x in map(encode, texts[first:last])]
                totals = np.array([len(x) // 4 for x in found])
                owner = np.repeat(np.arange(last - first), -(-totals // length))
                start = (np.arange(len(owner)) - np.searchsorted(owner, owner)) * length
                size = np.minimum(length, totals[owner] - start)
                crc = [zlib.crc32(found[i][4 * s : 4 * (s + n)]) for i, s, n in zip(owner.tolist(), start.tolist(), size.tolist())]
                yield pd.DataFrame({"doc_id": ids.iloc[first:last].take(owner), "start": start, "length": size, "ids_crc32": crc, "doc_tokens": totals[owner]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInPandas(cut, PIECES)


class Windows:
    """Open windows by remaining capacity; ``take(n)`` finds the tightest that holds n."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, window: int) -> None:
        self.open[room].append(window)
        i = room + self.size
        while i:
            self.count[i] += 1
            i //= 2

    def take(self, n: int) -> tuple[int, int] | None:
        """(window, its room) of the smallest room >= n, removed; None if there is none."""
        count, i = self.count, n + self.size
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.size
        while i:
            count[i] -= 1
            i //= 2
        return self.open[room].pop(), room


def best_fit(lengths: list[int], capacity: int = LENGTH) -> list[tuple[int, int]]:
    """(window, offset) of each piece.  Longest first, among equals in the given order."""
    windows, out, made = Windows(capacity), [(0, 0)] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        found = windows.take(n)
        if found is None:
            found, made = (made, capacity), made + 1
        window, room = found
        out[i] = window, capacity - room
        if room > n:
            windows.put(room - n, window)
    return out


def packed(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, final_id: int = FINAL_ID, shard: int = SHARD) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = stored(token_pieces(docs, tokenizer_path, length, final_id).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    shards = max(1, -(-pieces.count() // shard))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("piece", kind="stable")
        placed = best_fit(rows["length"].tolist(), length)
        at = int(rows["shard"].iloc[0]) << 32
        return rows.assign(sequence_id=[at + w for w, _ in placed], offset=[o for _, o in placed]).drop(columns=["piece", "shard"])

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("piece"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(pack, PIECES + ", sequence_id long, offset long")
