"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampspark.llm import bloom_lm, dart_minhash, exact_dedup, html_extract, lang_id, mixing, multiset_hash, packing, quality_rules, url_templates
from ampspark.llm.common import crc_mod, table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.scored(docs, quality_rules.learned(docs, table(spark, sf_dir, "labels")))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).drop("copies")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op4_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.scored(table(spark, sf_dir, "documents"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(table(spark, sf_dir, "pages"))


def op6_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judged(table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = multiset_hash.fingerprints(table(spark, sf_dir, "documents"))
    own, edited, following = F.col("fp"), F.col("edited_fp"), F.col("next_fp")
    return f.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        multiset_hash.as_hex(own).alias("fingerprint"),
        multiset_hash.as_hex(edited).alias("edited_fingerprint"),
        multiset_hash.likeness(own, edited).alias("near_edited"),
        multiset_hash.likeness(own, following).alias("near_next"),
    )


def op9_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op10_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = (crc_mod(lang_id.FOLDS) == lang_id.HELD_OUT).alias("held_out")
    return lang_id.language_of(docs, docs).select("doc_id", held_out, "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_source_mixing, op3_exact_dedup, op4_bloom_lm, op5_html_extract, op6_url_templates, op7_packing, op8_multiset_hash, op9_dart_minhash, op10_cross_parsing)}


OP2 = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::BIGINT AS weight, source_size * 3 AS full_size FROM s
), o AS (
  SELECT *, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS left_weight,
         sum(source_size) OVER () - coalesce(sum(full_size) OVER before, 0) AS left_words
  FROM w WINDOW before AS (ORDER BY full_size::DOUBLE / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, full_size * left_weight <= weight * left_words AS stops FROM o
), g AS (
  SELECT *, max(CASE WHEN NOT stops THEN left_words END) OVER () AS free_words, sum(CASE WHEN NOT stops THEN weight END) OVER () AS free_weight FROM f
), t AS (
  SELECT source, source_size,
         CASE WHEN stops THEN full_size::DOUBLE ELSE least(weight::DOUBLE * free_words::DOUBLE / free_weight::DOUBLE, full_size::DOUBLE) END AS target FROM g
), r AS (
  SELECT d.doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5('17:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""

OP3 = """
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS sha FROM documents
), g AS (
  SELECT *, min(doc_id) OVER (PARTITION BY sha) AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
         row_number() OVER (PARTITION BY sha ORDER BY doc_id) AS n FROM d
)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, n = 1 AS kept, sha AS text_sha256 FROM g
"""

OP6 = """
WITH p AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(coalesce(url, ''), '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), rules(verdict, rule, h, q) AS (
  VALUES ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'), ('allow', 'net/de/', 'net', '/de/'),
         ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')
), fit AS (
  SELECT page_id, host, path, max(struct_pack(n := length(rule), rule := rule, verdict := verdict)) FILTER (rule IS NOT NULL) AS f
  FROM p LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY ALL
), seg AS (
  SELECT page_id, host, path, f.rule AS rule, f.verdict AS fixed,
         list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '*' ELSE x END) AS s0,
         regexp_replace(regexp_replace(path, '[0-9]+', '9', 'g'), '[^9/.\\-_]+', 'a', 'g') AS shape FROM fit
), flat AS (
  SELECT * REPLACE (CASE WHEN len(s0) = 0 THEN [''] ELSE s0 END AS s0) FROM seg
), sh AS (
  SELECT host, s0, shape, count(*) AS n, coalesce(sum(CASE WHEN fixed = 'block' THEN 1 ELSE 0 END), 0) AS bad, count(fixed) AS seen FROM flat GROUP BY ALL
), c0 AS (
  SELECT host, s0, s0 AS t, sum(n) AS n FROM sh GROUP BY ALL
), {levels}, b0 AS (
  SELECT host, t, shape, shape, sum(sh.n) AS n, sum(bad) AS bad, sum(seen) AS seen FROM sh JOIN {last} USING (host, s0) GROUP BY ALL
), b AS (
  SELECT *, struct_pack(w := list_transform(t, lambda x: CASE WHEN x = '*' THEN '*' ELSE 'a' END), most := first_value(shape) OVER (PARTITION BY host, t ORDER BY n DESC, shape DESC)) AS pool FROM b0
), own AS (
  SELECT host, pool, t, sum(n) AS m, sum(bad) AS bad, sum(seen) AS seen FROM b GROUP BY ALL
), each_shape AS (
  SELECT host, pool, shape, sum(n) AS shape_n FROM b GROUP BY ALL
), every AS (
  SELECT *, sum(shape_n) OVER (PARTITION BY host, pool) AS all_n, count(*) OVER (PARTITION BY host, pool) AS kinds FROM each_shape
), chi AS (
  SELECT o.host AS host, o.pool AS pool, o.t AS t, e.kinds AS kinds, sum(power(coalesce(b.n, 0) - m * shape_n::DOUBLE / all_n, 2) / (m * shape_n::DOUBLE / all_n)
         + power(coalesce(b.n, 0) - m * shape_n::DOUBLE / all_n, 2) / ((all_n - m) * shape_n::DOUBLE / all_n)) AS chi
  FROM own o JOIN every e USING (host, pool) LEFT JOIN b ON b.host = o.host AND b.t = o.t AND b.shape = e.shape WHERE all_n > m GROUP BY o.host, o.pool, o.t, e.kinds
), same AS (
  SELECT own.*, coalesce(kinds = 1 OR chi <= greatest(kinds - 1, 1) * power(1 - 2.0 / (9.0 * greatest(kinds - 1, 1)) + 1.6449 * sqrt(2.0 / (9.0 * greatest(kinds - 1, 1))), 3), false) AS alike
  FROM own LEFT JOIN chi USING (host, pool, t)
), pooled AS (
  SELECT *, CASE WHEN alike THEN sum(bad) OVER m ELSE bad END AS mb, CASE WHEN alike THEN sum(seen) OVER m ELSE seen END AS ms FROM same WINDOW m AS (PARTITION BY host, pool, alike)
), reject AS (
  SELECT DISTINCT host, s0, true AS gone FROM pooled JOIN {last} USING (host, t) WHERE (mb + 1.0) / (ms + 4.0) >= 0.5
)
SELECT page_id, host, path, rule, coalesce(fixed, CASE WHEN gone THEN 'block' ELSE 'allow' END) AS verdict FROM flat LEFT JOIN reject USING (host, s0)
"""

#: Passes over the template tree that the SQL spells out; further ones change nothing on tables whose variable segments nest less deeply.
PASSES = 3


def _pass(i: int) -> str:
    return f"""e{i} AS (
  SELECT host, s0, n, k, t[k] AS child, t[1:k - 1] AS node FROM (SELECT *, unnest(range(1, len(t) + 1)) AS k FROM c{i - 1})
), k{i} AS (
  SELECT host, k, node, child, sum(n) AS rows_in FROM e{i} GROUP BY ALL
), w{i} AS (
  SELECT *, count(*) OVER (PARTITION BY host, k, node) AS children, sum(rows_in) OVER (PARTITION BY host, k, node) AS all_rows FROM k{i}
), h{i} AS (
  SELECT host, s0, list(k) AS hits FROM e{i} JOIN w{i} USING (host, k, node, child) WHERE children > 20 AND rows_in * 20 < all_rows AND child NOT IN ('*', '') GROUP BY ALL
), c{i} AS (
  SELECT host, s0, CASE WHEN hits IS NULL THEN t ELSE list_transform(t, lambda x, k: CASE WHEN list_contains(hits, k) THEN '*' ELSE x END) END AS t, n FROM c{i - 1} LEFT JOIN h{i} USING (host, s0)
)"""


#: Exact classes: all pairs that share a shingle, then reachability; for small tables.
OP9 = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS t FROM documents
), sh AS (
  SELECT doc_id, unnest(CASE WHEN len(t) < 5 THEN [array_to_string(t, ' ')] ELSE list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')) END) AS s FROM w WHERE len(t) > 0
), c AS (
  SELECT doc_id, s, count(*) AS n FROM sh GROUP BY ALL
), size AS (
  SELECT doc_id, sum(n) AS total FROM c GROUP BY ALL
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) AS both_n FROM c x JOIN c y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE both_n >= 0.8 * (p.total + q.total - both_n)
), reach AS (
  SELECT a AS node, a AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a
), cls AS (
  SELECT node, min(other) AS class_id FROM reach GROUP BY node
)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(class_id, doc_id) = doc_id AS kept FROM documents LEFT JOIN cls ON node = doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_source_mixing": OP2, "op3_exact_dedup": OP3, "op6_url_templates": OP6.replace("{levels}", ", ".join(_pass(i) for i in range(1, PASSES + 1))).replace("{last}", f"c{PASSES}"), "op9_dart_minhash": OP9}
