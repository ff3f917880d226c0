"""The ten operators on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import math
import mmap
import random
import re
import time
import types
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from ampspark.llm import bloom_lm, common, dart_minhash, exact_dedup, html_extract, lang_id, mixing, multiset_hash, packing, quality_rules, queries, url_templates

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, norm string, slot int, key long, uid long, size long, hit boolean, text_a string"
WORDS = {
    "en": "the river house under green morning light people walk along and speak softly while winter comes over hills".split(),
    "de": "der fluss und das haus unter gruenem morgenlicht menschen gehen entlang sprechen leise waehrend winter kommt ueber huegel".split(),
}
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def _texts() -> list[tuple]:
    rng = random.Random(5)
    rows, n = [], 0
    for lang, words in WORDS.items():
        for _ in range(30):
            rows.append((n, " ".join(rng.choices(words, k=60)), lang, f"s{n % 4}"))
            n += 1
    long = " ".join(f"{w}{i % 97}" for i, w in enumerate(rng.choices(WORDS["en"], k=9000)))
    near = (BASE * 4).copy()
    for i in range(8):
        copy = near.copy()
        copy[i * 5] = f"changed{i}"
        rows.append((100 + i, " ".join(copy), "en", "s0"))
    return rows + [
        (200, None, None, None), (201, "", "en", None), (202, " \t ", "en", "s1"), (203, "a b\n\tc", "en", "s1"), (204, "a  b c", "en", "s1"),
        (205, long, "en", "s2"), (206, long, "en", "s2"), (207, "12 34 !!", "de", "s3"), (208, "a b c", "en", "s1"), (208, "a b c", "en", "s1"), (208, "other words", "en", "s1"),
        (None, "no id here", "en", "s1"), (None, "a b c", None, "s1"), (209, "naïve ß İ \U0001f600 \x1c x", "fr", "z"),
    ]


@pytest.fixture(scope="module")
def rows():
    return _texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(i, t, lang, s, len(t) if t else None, "row", "norm", 1, 2, 3, 4, True, "x") for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _key(x):
    return (x is None, x)


def _norm(text: str | None) -> str:
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def _sha(text: str | None) -> str:
    return hashlib.sha256(_norm(text).encode()).hexdigest()


def test_exact_dedup(docs, none, rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[_sha(t)].append(i)
    got = exact_dedup.exact_groups(docs).collect()
    assert Counter((r.doc_id, r.text_sha256) for r in got) == Counter((i, _sha(t)) for i, t, *_ in rows)
    for sha, ids in groups.items():
        own = [r for r in got if r.text_sha256 == sha]
        first = min(ids, key=_key)
        assert {(r.keep_id, r.group_size) for r in own} == {(first, len(ids))}
        assert [r.doc_id for r in own if r.kept] == [first]
    stay = exact_dedup.drop_exact_copies(docs)
    assert stay.columns == docs.columns
    assert Counter((r.doc_id, _sha(r.text)) for r in stay.collect()) == Counter((min(ids, key=_key), sha) for sha, ids in groups.items())
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.drop_exact_copies(none).count() == 0


def test_refinement_steps(spark, docs, rows):
    n, p = {i: len(_norm(t)) for i, (_, t, *_) in enumerate(rows)}, {i: _norm(t)[:256] for i, (_, t, *_) in enumerate(rows)}
    lengths = {k for k, c in Counter(n.values()).items() if c > 1}
    want = Counter((n[i], p[i]) for i in n if n[i] in lengths)
    scratch = common.Scratch(spark)
    facts = scratch.put(exact_dedup._facts(docs, F.monotonically_increasing_id().alias("uid")), "facts")
    got = exact_dedup.survivors(facts, scratch)
    assert Counter(r["rows"] for r in got.collect()) == Counter(c for c in want.values() if c > 1)
    # The long pair and the copies of "a b c" survive; the sixty texts of their own don't.
    marked = exact_dedup.with_hit(facts, exact_dedup.slot_bitmaps(got))
    assert {(r.n, r.hit) for r in marked.collect()} == {(k, want[k, x] > 1) for k, x in set(zip(n.values(), p.values()))} | {(k, True) for k, x in want if want[k, x] > 1}
    plan = exact_dedup.exact_groups(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan  # texts were read and hashed once, before
    scratch.clear()


def test_all_slots_are_read_back(spark):
    made = spark.range(5000).select(F.col("id").alias("n"), (F.col("id") * 7).alias("p"))
    got = exact_dedup.with_hit(made, exact_dedup.slot_bitmaps(made.where("n % 3 = 0")))
    assert {r.n % 3 == 0 for r in got.where("hit").collect()} == {True} and got.where("hit").count() == 1667


def _targets(sizes: dict, cap: int = 3) -> dict:
    order = sorted(sizes, key=_key)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total >= cap * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= target[s]
            open_.discard(s)
    return target


def test_mixing(docs, none, rows):
    n = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in rows]
    sizes = Counter()
    for (_, _, _, s), k in zip(rows, n):
        sizes[s] += k
    target = _targets(dict(sizes))
    got = mixing.mixed(docs).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, k) for (i, *_), k in zip(rows, n))
    assert {r.source_size: pytest.approx(r.target) for r in got} == {sizes[s]: target[s] for s in sizes}
    assert all(r.taken in (math.floor(r.target / r.source_size) * r["size"], (math.floor(r.target / r.source_size) + 1) * r["size"]) for r in got if r.source_size)
    assert all(r.taken <= 3 * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed(docs.repartition(5)).collect()))
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mixed(none).count() == 0


def test_mixing_comes_near_its_targets(spark):
    made = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.concat(F.lit("s"), F.col("id") % 7).alias("source"))
    got = mixing.mixed(made).groupBy(F.col("doc_id") % 7, "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) < 0.06 * r.target for r in got)


def test_many_sources_take_the_other_join(docs, monkeypatch):
    want = sorted(map(str, mixing.mixed(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert sorted(map(str, mixing.mixed(docs).collect())) == want


def test_packing_round_trip(docs, none, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    got = packing.packed(docs, queries.tokenizer_path()).collect()
    want = Counter()
    for i, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for at in range(0, len(ids), 2048):
            part = np.asarray(ids[at : at + 2048], "<u4")
            want[i, at, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.packed(none, queries.tokenizer_path()).count() == 0


def test_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    whole, encode = Tokenizer.from_file(path), packing.Encoder(path)
    assert encode.by_word
    rng = random.Random(1)
    letters = "abcXYZéÉßİıſǅ ŉ' \t\n.,;:!?0123<|>-_&\u0301\u200b\u3000日本ⅠªΣς\U0001f600n\u0308KΩ\x1c"
    texts = ["".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(4000)] + ["", "a" * 5000, "it's <|endoftext|> (well),&&& end"]
    assert [np.frombuffer(encode(t), "<u4").tolist() for t in texts] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    encode.by_word = False
    assert [np.frombuffer(encode(t), "<u4").tolist() for t in texts[-3:]] == [whole.encode(t, add_special_tokens=False).ids for t in texts[-3:]]
    assert list(common.blocks([3, 9, 1, 1, 5], 6)) == [(0, 1), (1, 2), (2, 4), (4, 5)] and list(common.blocks([])) == []


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(1)
    for _ in range(20):
        lengths = [rng.randint(1, 64) for _ in range(rng.randint(0, 200))]
        rooms, want = [], []
        for n in sorted(lengths, reverse=True):
            fits = [r for r in rooms if r >= n]
            want.append(min(fits) if fits else 64)
            if fits:
                rooms.remove(min(fits))
            rooms.append(want[-1] - n)
        got = packing.best_fit(lengths, 64)
        order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
        assert [64 - got[i][1] for i in order] == want


def test_fingerprints(docs, none, rows):
    got = multiset_hash.fingerprints(docs).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((i, len(t or "")) for i, t, *_ in rows)
    by_text = defaultdict(set)
    texts = {i: t or "" for i, t, *_ in rows if i not in (208, None)}
    for r in got:
        if r.doc_id in texts:
            by_text[texts[r.doc_id]].add(tuple(r.fp))
    assert all(len(v) == 1 for v in by_text.values()) and len(set().union(*by_text.values())) == len(by_text)
    ids = sorted({i for i, *_ in rows if i is not None}, reverse=True)
    sha = {r.doc_id: r.edited_sha256 for r in got}
    for a, b in zip(ids, ids[1:]):
        if 208 not in (a, b):
            half = len(texts[a]) // 2
            assert sha[a] == hashlib.sha256((texts[a][: len(texts[a]) - half] + texts[b][:half]).encode()).hexdigest()
    assert multiset_hash.fingerprints(none).count() == 0


def test_fingerprint_insertion_and_deletion(spark):
    rows = spark.createDataFrame([(0, "one fine day.\ntwo birds sing."), (1, "two birds sing.\none fine day."), (2, "one fine day."), (3, "two birds sing."), (4, "")], "id long, text string")
    fp = {r.id: r.fp for r in multiset_hash.fingerprinted(rows, ["id"]).collect()}
    assert fp[0] == fp[1] != fp[2]
    both = spark.createDataFrame([(fp[0], fp[2], fp[3], fp[4])], "a array<bigint>, b array<bigint>, c array<bigint>, e array<bigint>")
    m = multiset_hash
    a, b, c, e = map(F.col, "abce")
    r = both.select(m.combined(b, c).alias("sum"), m.removed(a, b).alias("rest"), m.likeness(a, a).alias("one"), m.likeness(e, e).alias("void"), m.likeness(a, e).alias("zero"), m.likeness(a, b).alias("half")).first()
    assert list(r["sum"]) == fp[0] and list(r.rest) == fp[3]
    assert (r.one, r.void, r.zero) == (1.0, 1.0, 0.0) and 0.4 < r.half < 0.95


def _fingerprint(text: str) -> list[int]:
    """By brute force: the engine's 64-bit hashes of paragraphs and pieces, summed lane by lane."""
    def chained(data: bytes, *more: int) -> int:
        h = xxhash.xxh64_intdigest(data, 42)
        for x in more:
            h = xxhash.xxh64_intdigest(x.to_bytes(4, "little"), h)
        return h

    m = multiset_hash
    raw = text.encode().decode("latin-1")
    pieces = [x for x in re.split(m.CUT, raw) if x]
    exact, near = [0] * m.EXACT, [0] * m.NEAR
    for par in text.split("\n") if text else []:
        h0 = chained(par.encode(), 1).to_bytes(8, "little")
        for i in range(m.EXACT):
            exact[i] = (exact[i] + chained(h0, 100 + i)) % m.EXACT_MOD
    for piece in pieces:
        h0 = chained(piece.encode(), 0)
        for s in range(m.SEEDS):
            h = chained(h0.to_bytes(8, "little"), s) if s else h0
            for k in range(m.SHIFTS):
                for j in range(3):
                    near[(s * m.SHIFTS + k) * 3 + j] += h >> (k + 20 * j) & 1
    return [*exact, len(pieces) % m.EXACT_MOD, *[x % m.MOD for x in near]]


def test_fingerprints_by_brute_force(docs, rows):
    texts = {i: t or "" for i, t, *_ in rows if i not in (208, None)}
    ids = sorted(texts, reverse=True)
    for r in multiset_hash.fingerprints(docs).where("doc_id in (0, 1, 100, 200, 203, 207, 209)").collect():
        assert list(r.fp) == _fingerprint(texts[r.doc_id])
        after = texts[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        if r.doc_id not in (0, 209):  # 208 and the null ids have several texts
            assert list(r.next_fp) == _fingerprint(after)
            half = r.n_chars // 2
            assert list(r.edited_fp) == _fingerprint(texts[r.doc_id][: r.n_chars - half] + after[:half])


def test_fingerprints_of_all_scripts_and_long_texts(spark):
    rng = random.Random(4)
    letters = {"latin": "abcdefghijklmnopqrstuvwxyz ", "cyrillic": "".join(map(chr, range(0x430, 0x450))), "han": "".join(map(chr, range(0x4E00, 0x5E00))), "cuts": "yz.,"}
    rows = []
    for i, x in enumerate(letters.values()):
        a, b = ("".join(rng.choices(x, k=4000)) for _ in range(2))
        rows.append((i, a, a[:2000] + b[2000:], b))
    long = "".join(f"{i}," for i in range((1 << 19) + 5))
    rows.append((9, long, long[: len(long) // 2] + "q," * 1000, "none of it"))
    made = spark.createDataFrame(rows, "id long, a string, b string, c string")
    fp = {n: {r.id: r.fp for r in multiset_hash.fingerprinted(made.select("id", n), ["id"], n).collect()} for n in "abc"}
    both = spark.createDataFrame([(r[0], fp["a"][r[0]], fp["b"][r[0]], fp["c"][r[0]]) for r in rows], "id long, a array<long>, b array<long>, c array<long>")
    got = {r.id: (r.half, r.none) for r in both.select("id", multiset_hash.likeness(F.col("a"), F.col("b")).alias("half"), multiset_hash.likeness(F.col("a"), F.col("c")).alias("none")).collect()}
    assert all(0.25 < got[i][0] < 0.9 and got[i][1] < got[i][0] - 0.15 for i in (0, 1, 2, 9)), got
    assert fp["a"][3] != fp["c"][3] and fp["a"][3][8] == 4000
    assert fp["a"][9][8] == (1 << 19) + 5 and all(0 <= x < 1 << 19 for x in fp["a"][9][9:])


def test_next_document_with_repeated_and_null_ids(spark, monkeypatch):
    rows = [(7, f"seven {i}") for i in range(300)] + [(None, f"none {i}") for i in range(300)] + [(i, f"id {i}") for i in range(100, 130)]
    made = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    got = multiset_hash.with_next(spark, made).where("own = 1").collect()
    ring = {r.text: r.next_text for r in got}
    at, seen = "id 129", []
    for _ in rows:
        seen.append(at)
        at = ring[at]
    assert at == "id 129" and len(set(seen)) == len(rows)
    assert seen[:30] == [f"id {i}" for i in range(129, 99, -1)] and all(x.startswith("seven") for x in seen[30:330]) and all(x.startswith("none") for x in seen[330:])
    assert len({r.to for r in got if r.doc_id == 7}) > 1 and len({r.to for r in got if r.doc_id is None}) > 1


def _multiset(text: str | None) -> Counter:
    w = (text or "").lower().encode("utf-8", "replace").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def test_near_classes(spark, docs, none, rows):
    own = [_multiset(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sum((own[i] & own[j]).values()) >= 0.8 * sum((own[i] | own[j]).values()) > 0:
                parent[root(i)] = root(j)
    classes = defaultdict(list)
    for i in range(len(rows)):
        classes[root(i)].append(rows[i][0])
    first = {c: min(ids, key=_key) for c, ids in classes.items()}
    got = dart_minhash.near_classes(docs).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == Counter((rows[i][0], first[root(i)]) for i in range(len(rows)))
    assert sum(r.kept for r in got) == len(classes) and all(r.doc_id == r.class_id for r in got if r.kept)
    stay = dart_minhash.drop_near_copies(docs)
    assert stay.columns == docs.columns
    assert Counter(r.doc_id for r in stay.collect()) == Counter(first.values())
    # The first of a class that repeats with one text stays once; a text of its own under that id stays too.
    assert Counter(r.text for r in stay.collect() if r.doc_id == 208) == {"other words": 1}
    assert dart_minhash.near_classes(none).count() == 0 and dart_minhash.drop_near_copies(none).count() == 0


def test_near_bound_drops_no_similar_pair(spark):
    rng = random.Random(6)
    memo = dart_minhash.WordHashes()
    base = [f"w{rng.randrange(90)}" for _ in range(300)]
    texts = [" ".join(w if rng.random() > edit else f"x{rng.randrange(999)}" for w in base[: rng.randrange(240, 300)]) for edit in (0.0, 0.005, 0.01, 0.02, 0.04) for _ in range(8)]
    sets = [dart_minhash.shingles(t, memo) for t in texts]
    bits = dart_minhash.parity(*dart_minhash.strips(sets), len(sets))
    rows = spark.createDataFrame([(i, len(s), b.tolist()) for i, (s, b) in enumerate(zip(sets, bits))], "node long, size long, bits array<long>").cache()
    both = rows.alias("x").join(rows.alias("y"), F.col("x.node") < F.col("y.node"))
    left = both.where(dart_minhash.possible(F.col("x.size"), F.col("x.bits"), F.col("y.size"), F.col("y.bits"), 0.8))
    kept = {(r[0], r[1]) for r in left.select("x.node", "y.node").collect()}
    near = {(i, j) for j in range(len(sets)) for i in range(j) if dart_minhash.similarity(sets[i], sets[j]) >= 0.8}
    assert near and near <= kept and len(kept) < len(sets) * (len(sets) - 1) / 4


def test_hot_keys_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(common, "SHARES", 8)
    many = spark.range(1000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.col("id")).alias("k"), "id")
    few = many.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    hot = common.hot_keys(few, ["k"])
    assert [(r.k, r.parts) for r in hot.collect()] == [(7, math.ceil((334 + 0) * 8 / 667))]
    assert common.dealt(many, ["k"], hot, F.col("id")).where("k = 7").select("part").distinct().count() == hot.first().parts
    got = common.spread_join(many, few, ["k"], hot, F.col("id"), "left")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, many.join(few, "k", "left").collect()))


def test_shared_folder_is_required_off_local_mode(spark, monkeypatch):
    class Elsewhere:
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        common.shared_dir(Elsewhere())


def test_dart_signatures_estimate_weighted_similarity():
    memo = dart_minhash.WordHashes()
    rng = random.Random(2)
    words = [f"w{i}" for i in range(600)]
    a = " ".join(words)
    b = " ".join(w if rng.random() > 0.03 else "x" for w in words)
    x, y = dart_minhash.shingles(a, memo), dart_minhash.shingles(b, memo)
    sig = dart_minhash.signatures([x, y], k=1024)
    assert abs((sig[0] == sig[1]).mean() - dart_minhash.similarity(x, y)) < 0.06


def test_language_of(docs, none, rows):
    got = lang_id.language_of(docs, docs).collect()
    assert len(got) == len(rows)
    want = {i: lang for i, t, lang, _ in rows if i is not None and i < 60}
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in want} == want
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert und == {200, 201, 202, 207}
    assert all(0 <= r.score <= 1 for r in got)
    assert lang_id.language_of(none, docs).count() == 0
    assert {r.lang_pred for r in lang_id.language_of(docs, none).collect()} == {"und"}


def test_pipeline_keeps_lettered_documents(spark, docs, rows):
    want = Counter(i for i, *_ in rows if i not in (200, 201, 202, 207))
    for made in (docs, docs.withColumn("lang", F.lit(None).cast("string"))):
        assert Counter(r.doc_id for r in corpus_pipeline.identify_language(spark, made, "").collect()) == want


def test_phrases_are_longest_matches():
    rng = random.Random(3)
    for _ in range(20):
        sample = "".join(rng.choices("abc", k=60))
        text = "".join(rng.choices("abc", k=80))
        model = lang_id.fit([("x", sample)])
        n, at = 0, 0
        while at < len(text):
            end = at + 1
            while end < len(text) and text[at : end + 1] in sample:
                end += 1
            n, at = n + 1, end
        for stretch in (3, 10, 1000):
            got = lang_id.phrases([lang_id.symbols_of(text, model["table"])], model, stretch=stretch)[0, 0]
            assert int(got) == n


def test_long_texts_and_all_scripts_are_parsed_whole():
    rng = random.Random(9)
    cyrillic, han = [chr(0x430 + i) for i in range(32)], [chr(0x4E00 + i) for i in range(4000)]
    learned = {"en": "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=4000)), "ru": "".join(rng.choices(cyrillic, k=4000)), "zh": "".join(rng.choices(han, k=4000)), "gothic": "\U00010330\U00010331\U00010332" * 500}
    model = lang_id.fit(list(learned.items()), chars=10_000)
    texts = ["".join(rng.choices(x, k=5000)) for x in ("abcdefgh ijklmnop", cyrillic, han[:50], "\U00010331\U00010330 ")]
    texts += [learned["en"] * 2, "αβγ ab", learned["zh"][1000:1300]]
    symbols = [lang_id.symbols_of(t, model["table"]) for t in texts]
    whole = lang_id.phrases(symbols, model, stretch=10**9)
    for stretch in (7, 64, 2048):
        assert (lang_id.phrases(symbols, model, stretch=stretch) == whole).all()
    assert [lang for lang, _ in lang_id.identify(texts, model)] == ["en", "ru", "zh", "gothic", "en", "en", "zh"]
    assert lang_id.identify(texts, model, block=100) == lang_id.identify(texts, model)
    sample = lang_id.symbols_of(han[0] + han[-1], model["table"]).tolist()
    assert len(set(map(tuple, (lang_id.symbols_of(c, model["table"]).tolist() for c in han if c in learned["zh"])))) == len(set(learned["zh"])) and len(sample) >= 2


def test_labelled_texts_are_learned_whole_or_not(spark):
    rows = [(1, "en", "x" * 30_000), (2, "en", "short text"), (3, "de", "y" * 20_000), (4, None, "z"), (5, "de", None)]
    got = lang_id.training_rows(spark.createDataFrame(rows, "doc_id long, lang string, text string"), 1, 5).collect()
    assert {(r.lang, len(r.text)) for r in got} == {("en", 10), ("de", 20_000)}


def test_bloom_lm(docs, none, rows):
    def tokens(t):
        return [w.lower() for w in (t or "").encode().split()] + [b"\n"]

    def fold(i):
        return zlib.crc32(("" if i is None else str(i)).encode()) % 5

    train = Counter(w for i, t, *_ in rows if fold(i) != 1 for w in tokens(t))
    n, v = sum(train.values()), len(train)
    got = bloom_lm.scored(docs).collect()
    want = Counter((i, fold(i) == 1, len(tokens(t)), sum(train[w] > 0 for w in tokens(t)), n) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got) == want
    base = {(i, len(tokens(t))): sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)) for i, t, *_ in rows if i is not None}
    for r in got:
        assert math.isfinite(r.score) and r.score <= 0
        if r.doc_id is not None:
            assert r.base_score == pytest.approx(base[r.doc_id, r.n_tokens], rel=1e-9)
    unlike = bloom_lm.scored(docs.where("doc_id >= 0")).where("doc_id < 60").agg(F.sum("score"), F.sum("base_score")).first()
    assert unlike[0] > unlike[1]
    assert bloom_lm.scored(none).count() == 0


def test_bloom_lm_scores_by_brute_force(spark, monkeypatch):
    """Every word is common and the filter hardly errs: scores follow from the counts, and probabilities add up to 1."""
    monkeypatch.setattr(bloom_lm, "BITS", 200)
    rng = random.Random(12)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choices(words, weights=range(1, 13), k=30))) for i in range(60)] + [(1000, "w3 unseen w3")]
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i, _ in rows}
    tokens = {i: [*t.split(), "END"] for i, t in rows}
    train = [tokens[i] for i, _ in rows if fold[i] != 1 and i != 1000]
    rows = [r for r in rows if r[0] != 1000 or fold[1000] == 1] or rows
    c = Counter(w for t in train for w in t)
    pairs = Counter((a, b) for t in train for a, b in zip(["END", *t], t))
    pairs = {k: n for k, n in pairs.items() if n > 1}
    q = {k: float(bloom_lm.count_of(bloom_lm.level_of(np.array([n])))[0]) for k, n in pairs.items()}
    n, v = sum(c.values()), len(c)

    def p(w, a=None):
        alone = (c[w] + 0.5) / (n + 0.5 * (v + 1))
        own = [k for k in pairs if k[0] == a]
        if not own:
            return alone
        rest = c[a] - sum(pairs[k] for k in own)
        return (max(q.get((a, w), 0) - bloom_lm.DISCOUNT, 0) + (rest + bloom_lm.DISCOUNT * len(own)) * alone) / (sum(q[k] for k in own) + rest)

    for a in [None, *c]:
        assert sum(p(w, a) for w in [*c, "unseen"]) == pytest.approx(1)
    got = {r.doc_id: r.score for r in bloom_lm.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, _ in rows:
        assert got[i] == pytest.approx(sum(math.log10(p(w, a)) for a, w in zip(["END", *tokens[i]], tokens[i])), rel=1e-9)


def _bigram_rows(spark):
    rng = random.Random(8)
    words = [f"rare{i}" for i in range(400)]
    train = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 != 1]
    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 == 1]
    rows = [(train[2 * i + j], " ".join(words[i * 10 : i * 10 + 10])) for i in range(40) for j in range(2)]
    rows += [(train[100 + i], " ".join(rng.choices(["the", "of", "and"], k=50))) for i in range(20)]
    rows += [(held[0], " ".join(words[20:30])), (held[1], " ".join(reversed(words[20:30])))]
    return spark.createDataFrame(rows, "doc_id long, text string"), held[:2]


def test_bloom_lm_learns_bigrams_of_rare_words(spark, monkeypatch):
    monkeypatch.setattr(bloom_lm, "COMMON", 4)
    made, (seen, turned) = _bigram_rows(spark)
    got = {r.doc_id: r for r in bloom_lm.scored(made).collect()}
    assert got[seen].base_score == pytest.approx(got[turned].base_score)
    assert got[seen].score > got[turned].score + 9


def test_bloom_lm_large_filter_is_joined(spark, docs, none, monkeypatch):
    made = docs.select("doc_id", "text").unionByName(_bigram_rows(spark)[0]).repartition(3).cache()
    monkeypatch.setattr(bloom_lm, "COMMON", 4)
    monkeypatch.setattr(bloom_lm, "BITS", 200)  # several chunks
    want = Counter(str(r) for r in bloom_lm.scored(made).collect())
    monkeypatch.setattr(bloom_lm, "MAX_FILTER_MB", 0)
    assert Counter(str(r) for r in bloom_lm.scored(made).collect()) == want
    assert bloom_lm.scored(none).count() == 0


def test_bloom_lm_workers_hold_no_copy_of_the_filter(spark, monkeypatch):
    made = _bigram_rows(spark)[0].repartition(3).cache()
    monkeypatch.setattr(bloom_lm, "COMMON", 4)
    monkeypatch.setattr(bloom_lm, "BITS", 100_000)  # about 10 MB
    want = Counter(str(r) for r in bloom_lm.scored(made).collect())
    whole = bloom_lm.Filter

    class Mapped(whole):
        def __init__(self, chunks, filled):
            whole.__init__(self, chunks, filled)
            assert len(filled) == chunks * bloom_lm.CHUNK_BITS // 8 > 5_000_000
            while isinstance(filled, np.ndarray):
                filled = filled.base
            assert isinstance(getattr(filled, "obj", filled), mmap.mmap)

    monkeypatch.setattr(bloom_lm, "Filter", Mapped)
    assert Counter(str(r) for r in bloom_lm.scored(made).collect()) == want
    monkeypatch.setattr(bloom_lm, "Filter", whole)
    # As where Spark encrypts its files: there the value is read whole.
    chunks, filter_ = bloom_lm.filter_chunks(spark.createDataFrame([(i, i % 7 + 1) for i in range(100)], "key long, n long"))
    model = spark.sparkContext.broadcast(bloom_lm.gathered(chunks, filter_))
    filled, no_file = bloom_lm.mapped(model, chunks), types.SimpleNamespace(value=model.value)
    assert (filled == bloom_lm.mapped(no_file, chunks)).all() and filled.any()


def test_bloom_lm_batches_of_long_texts_are_bounded(spark, monkeypatch):
    made = spark.range(300).select(F.col("id").alias("doc_id"), F.expr("repeat(concat('w', id % 7, ' '), 30000)").alias("text")).coalesce(1)
    split = bloom_lm.blocks

    def bounded(lengths, *most):
        assert sum(lengths) <= 2 * bloom_lm.SCORE_CHARS
        return split(lengths, *most)

    monkeypatch.setattr(bloom_lm, "blocks", bounded)
    assert {r.n_tokens for r in bloom_lm.scored(made).collect()} == {30_001}
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None


def _written(spark):
    """Records and bytes that all stages so far wrote to shuffles."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)
    stages = store.stageList(sc._jvm.java.util.ArrayList(), False, False, none, sc._jvm.java.util.ArrayList())
    stages = [stages.apply(i) for i in range(stages.size())]
    return sum(x.shuffleWriteRecords() for x in stages), sum(x.shuffleWriteBytes() for x in stages)


def _shuffle_bytes(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(f.stat().st_size for d in folders for f in Path(d).rglob("shuffle_*.data") if f.exists())


def test_bloom_lm_large_filter_leaves_little_on_disk(spark, monkeypatch):
    rng = random.Random(21)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.5)) % 50_000}" for _ in range(200))) for i in range(600)]
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()
    made.count()
    monkeypatch.setattr(bloom_lm, "MAX_FILTER_MB", 0)
    shared = Path(common.shared_dir(spark)) / "ampspark"
    tables = set(shared.glob("*"))
    records, on_disk = _written(spark)[0], _shuffle_bytes(spark)
    assert bloom_lm.scored(made).count() == 600
    # Keys and counts travel as the bytes of a block or part: far fewer records than one a token and one a key.
    assert _written(spark)[0] - records < 30_000
    # Texts, filter and followers are gone; shuffles go with their query (in the background).
    assert {p.name.split("-")[0] for p in set(shared.glob("*")) - tables} <= {"counts", "scores"}
    for _ in range(50):
        left = _shuffle_bytes(spark) - on_disk
        if left < 500_000:
            break
        time.sleep(0.2)
    assert left < 500_000


def test_bloom_lm_hashes_tell_words_apart():
    size = bloom_lm.SLICE
    rng = random.Random(4)
    mixed = " ".join("".join(rng.choices("ab", k=rng.randrange(1, 9))) for _ in range(3000))
    texts = ["", " \t ", "A b\x0ba\x1cc  x", "é \x85 ß İ", "\ud800 ?", mixed, "x" * (3 * size), "y x " + "x" * (3 * size) + " z", "ab " * size, "a" * (size - 1) + " " + "a" * size + "\n" + "a" * (size + 1)]
    flat, lengths = bloom_lm.hashes_of(texts)
    tokens = [[*t.encode("utf-8", "replace").lower().split(), b"\n"] for t in texts]
    assert lengths.tolist() == [len(t) for t in tokens]
    pairs = set(zip((w for t in tokens for w in t), flat.tolist()))
    assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})
    assert (np.concatenate([bloom_lm.hashes_of([t])[0] for t in texts]) == flat).all()


def test_bloom_lm_probes_equal_bigrams_of_a_block_once():
    asked = []

    class Counts:
        def level(self, key):
            asked.append(len(key))
            return np.full(len(key), 3)

    nothing = np.zeros(0)
    t = bloom_lm.Tokens(["to be or not " * 2000] * 3)
    m = bloom_lm.Scorer(bloom_lm.Common(nothing.astype(np.int64), nothing, nothing, nothing, nothing), 10, 10.0, 5, Counts())
    assert len(m.pair_scores(t, m.facts(t.words))) == 6  # the four in a ring, from and to the end
    assert t.lengths.tolist() == [8001] * 3 and sum(asked) == 3 * 5 + 6


def test_counts_are_read_back_from_the_filter(spark):
    made = spark.range(3000).select(F.xxhash64("id").alias("key"), (F.col("id") % 50 + 1).alias("n"))
    filled = bloom_lm.built_filter(made)
    keys = np.array([r.key for r in made.collect()])
    n = np.array([r.n for r in made.collect()])
    level = filled.level(keys)
    assert (level >= bloom_lm.level_of(n)).all() and (level == bloom_lm.level_of(n)).mean() > 0.97
    # Repeats, and keys that were deep before, are read alike.
    again = np.concatenate((keys[::2], keys[:500], keys[:500]))
    assert (filled.level(again) == np.concatenate((level[::2], level[:500], level[:500]))).all() and (filled.level(keys) == level).all()
    assert (bloom_lm._levels(filled.bytes, keys, bloom_lm._chunk(keys, filled.chunks) * bloom_lm.CHUNK_BITS) == level).all()


def test_quality_rules(spark, docs, none, rows):
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i, *_ in rows if i is not None] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = quality_rules.scored(docs, quality_rules.learned(docs, labels)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in got)
    assert {r.score for r in quality_rules.scored(docs, quality_rules.learned(docs, labels.limit(0))).collect()} == {0.5}
    assert quality_rules.scored(none, quality_rules.learned(none, labels)).count() == 0


def test_rules_find_what_the_statistics_show():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 2] < 0.7)).astype(int)
    model = quality_rules.fit(x, y, ["a", "b", "c"])
    total = np.full(len(x), model.intercept)
    for rule, weight in zip(model.rules, model.weights):
        holds = np.ones(len(x), bool)
        for name, greater, cut in rule:
            holds &= (x[:, "abc".index(name)] > cut) == greater
        total += weight * holds
    assert ((total > 0) == y).mean() > 0.95


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href=x>One</a></li></ul></nav>
<article><h1>Head &amp; tail</h1><p>First   paragraph with
 enough words to be text.</p><p>Second one &eacute;&#8212; ends here, quite long as well.</p></article>
<aside>Side</aside><div class="comments"><p>I like this very much, said a reader at length.</p></div><form>Name</form><footer>Foot</footer></body></html>"""


def test_html(spark):
    want = "Head & tail First paragraph with enough words to be text. Second one é— ends here, quite long as well."
    pages = spark.createDataFrame([(1, "u", PAGE, 1), (2, None, None, 1), (3, "u", "", 1), (3, "u", "<p", 1), (4, "u", PAGE, 2), (None, "u", "<b>&amp", 1)], "page_id long, url string, html string, text int")
    got = html_extract.extracted(pages).collect()
    assert len(got) == 6 and {r.text for r in got if r.page_id in (1, 4)} == {want}
    assert [(r.text, r.n_chars) for r in got if r.page_id == 2] == [("", 0)]
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extracted(pages.limit(0)).count() == 0


STORY = " ".join(f"sentence number {i} of the story goes on and on with many words." for i in range(8))
PLAIN = "".join(
    f"<div class='x{k}'>{body}</div>"
    for k, body in enumerate(["<a href=1>Home</a> <a href=2>News</a> <a href=3>Mail</a>", "Short note", f"<h2>Title</h2><p>{STORY}</p><p>Brief.</p><p>{STORY}</p>", "<b>Buy</b> <i>now</i> <u>or</u> <b>go</b>", "<a href=4>Terms</a>"])
)


def test_html_regions_follow_the_ratios(monkeypatch):
    want = f"Title {STORY} Brief. {STORY}"
    assert html_extract.extract(f"<body>{PLAIN}</body>") == want
    # The same page with other ratios gives another region.
    real = html_extract.dense_lines
    monkeypatch.setattr(html_extract, "dense_lines", lambda ratios: real(sorted(ratios, reverse=True)))
    assert html_extract.extract(f"<body>{PLAIN}</body>") != want
    monkeypatch.setattr(html_extract, "dense_lines", lambda ratios: real([0.0] * len(ratios)))
    assert html_extract.extract(f"<body>{PLAIN}</body>") == ""
    monkeypatch.setattr(html_extract, "dense_lines", real)
    # A teaser that is an article loses to a story that isn't.
    teaser = "<article><a href=9>Read this teaser</a></article>"
    assert html_extract.extract(f"<body>{teaser}{PLAIN}</body>") == want
    ratios = [random.Random(i).random() * 90 for i in range(40)]
    for i, x in enumerate(html_extract.smoothed(ratios, 2.0)):
        w = {j: math.exp(-((i - j) ** 2) / 8) for j in range(40) if abs(i - j) <= 6}
        assert x == pytest.approx(sum(w[j] * ratios[j] for j in w) / sum(w.values()))


def test_html_names_are_whole_and_of_containers():
    page = f"<article><h2 id='social-history'>Social history</h2><p class='notice-of-death'>{STORY}</p><p id=comments>kept</p><div class='box comments'>gone</div><div id=ad>gone</div></article>"
    assert html_extract.extract(page) == f"Social history {STORY} kept"


def test_html_deep_and_long_pages():
    deep = "<div>" * 20_000 + f"<p>{STORY}</p>" + "</div>" * 10_000 + "</b></article>" * 5_000
    assert html_extract.extract(deep) == STORY
    long = "".join(f"<p>{STORY} {i}</p>" for i in range(5_000))
    assert html_extract.extract(f"<nav>x</nav><main>{long}</main>") == " ".join(f"{STORY} {i}" for i in range(5_000))


URLS = [
    ("http://www.Example.com/en/7/a", "www.example.com", "/en/7/a", "example.com/en/7", "allow"), ("https://a.com/en/x?q#f", "a.com", "/en/x", "com/en/", "block"),
    ("http://com/en/", "com", "/en/", "com/en/", "block"), ("http://xcom/en/", "xcom", "/en/", None, "allow"), ("x://example.net/de/8", "example.net", "/de/8", "example.net/de/8", "block"),
    ("x://b.net/de/8", "b.net", "/de/8", "net/de/", "allow"), ("x://h.org?es", "h.org", "", None, "allow"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "x", 1) for i, u in enumerate(URLS)], "page_id long, url string, host string, s1 int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_templates.judged(pages).collect()}
    assert got == {i: u[1:] for i, u in enumerate(URLS)}
    assert url_templates.judged(pages.limit(0)).count() == 0


def test_url_templates_reject_by_purity(spark):
    # One host: /en/ is labelled block by a rule; /de/ is built the same way, /files/ isn't.
    urls = [f"http://shop.com/en/{i}" for i in range(100, 160)] + [f"http://shop.com/de/{i}" for i in range(200, 240)] + [f"http://shop.com/files/v{i}.tar-gz" for i in range(40)]
    urls += [f"http://calm.net/de/{i}" for i in range(40)] + [f"http://calm.net/fr/{i}" for i in range(40)] + [f"http://free.edu/x/{i}" for i in range(30)]
    pages = spark.createDataFrame([(i if i else None, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {(r.host, r.path.split("/")[1], r.rule is None): r.verdict for r in url_templates.judged(pages).collect()}
    assert got == {
        ("shop.com", "en", False): "block", ("shop.com", "de", True): "block", ("shop.com", "files", True): "allow",
        ("calm.net", "de", False): "allow", ("calm.net", "fr", True): "allow", ("free.edu", "x", True): "allow",
    }


def test_url_templates_generalise_at_any_depth(spark):
    deep = "/".join("abcdefgh")
    words = [f"{a}{b}" for a in "qrstuvw" for b in "hijklmn"]
    rows = [("h.org", f"{deep}/{w}/{v}/end", 1) for w in words for v in (w[::-1], "zz" + w)] + [("h.org", "about/us", 3), ("h.org", "", 1)]
    scratch = common.Scratch(spark)
    got = {r.template: r.t for r in url_templates._generalised(spark.createDataFrame(rows, "host string, template string, n long"), scratch).collect()}
    assert got.pop("about/us") == "about/us" and got.pop("") == ""
    # The second variable level is wide only when the first has become one node.
    assert len(got) == 2 * len(words) and set(got.values()) == {f"{deep}/*/*/end"}
    scratch.clear()


def test_free_urls_are_blocked_by_the_tree(spark):
    got = queries.op6_url_templates(spark, "/root/testdata/sf0.1").where("rule is null").groupBy("verdict").count().collect()
    assert {r.verdict for r in got} == {"allow", "block"}
