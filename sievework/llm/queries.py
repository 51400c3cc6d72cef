"""The registered queries of this package, each applied to its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import (
    ann,
    byte_bpe,
    decontaminate,
    html_extract,
    lexical,
    near_vectors,
    prefix_trie,
    quality,
    secret_scan,
    sharding,
    simhash,
    token_count,
    token_orc,
)
from sievework.llm.common import table
from sievework.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), shards=24)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), WORD_BPE)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.encode(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    counts = {f"n_{k}": secret_scan.count_of("spans", k) for k in secret_scan.BASE_KINDS}
    return found.select(
        "doc_id",
        *[c.alias(name) for name, c in counts.items()],
        F.sha2(secret_scan.listed("spans", secret_scan.BASE_KINDS), 256).alias("base_sha256"),
        secret_scan.listed("spans").alias("spans"),
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-orc")
    token_orc.write_orc(table(spark, sf_dir, "documents"), path, WORD_BPE)
    return token_orc.ids_crc32(token_orc.with_start(spark, path))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


QUERIES: dict[str, Query] = {
    "op1_sharding": op1_sharding,
    "op2_simhash": op2_simhash,
    "op3_token_counts": op3_token_counts,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_nearest": op5_nearest,
    "op6_secrets": op6_secrets,
    "op7_decontamination": op7_decontamination,
    "op8_html": op8_html,
    "op9_token_orc": op9_token_orc,
    "op10_quality": op10_quality,
    "op11_lexical": op11_lexical,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_near_vectors": op13_near_vectors,
}

_NEAREST_SQL = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM r WHERE place <= 20"""

_SLOT_SQL = f"""CASE WHEN regexp_matches(x, '^[0-9]') THEN 'num'
  WHEN lower(x) IN ({", ".join(f"'{u}'" for u in decontaminate.UNITS)}) THEN 'unit'
  WHEN regexp_matches(x, '^\\p{{Lu}}') AND (length(x) = 1 OR regexp_matches(x, '\\p{{Ll}}')) THEN 'name' END"""

# How many words lie in at least one of the windows at the given places.
_COVERED_SQL = """coalesce(len(list_distinct(flatten(list_transform({0}, lambda x: range(x, x + {1}))))), 0)"""

_LEAKS_SQL = f"""
WITH w AS (
  SELECT side, id, regexp_extract_all(coalesce(text, ''), '[0-9]+(?:[.,][0-9]+)*|[\\p{{L}}\\p{{M}}]+') AS w
  FROM (SELECT 'doc' AS side, doc_id AS id, text FROM documents
        UNION ALL SELECT 'item', item_id, text FROM benchmark)),
c AS (
  SELECT side, id, len(w) AS n,
    list_transform(w, lambda x: coalesce('<' || ({_SLOT_SQL}) || '>', lower(x))) AS canon,
    list_transform(w, lambda x: ({_SLOT_SQL}) || ':' || lower(x)) AS slot, list_transform(w, lambda x: lower(x)) AS plain
  FROM w WHERE len(w) > 0),
widths AS (SELECT DISTINCT least(n, {decontaminate.WINDOW}) AS width FROM c WHERE side = 'item'),
win AS (
  SELECT side, id, n, width, unnest(list_transform(range(1, n - width + 2), lambda i: struct_pack(
    pos := i, canon := array_to_string(canon[i:i + width - 1], ' '),
    slots := list_filter(slot[i:i + width - 1], lambda x: x IS NOT NULL),
    plain := array_to_string(plain[i:i + width - 1], ' '))), recursive := true)
  FROM c JOIN widths ON n >= width AND (side = 'doc' OR width = least(n, {decontaminate.WINDOW}))),
few AS (
  SELECT side, id, n, width, true AS slotted, canon, pos, slots FROM win WHERE len(slots) > 0 AND len(slots) * 2 <= width
  UNION ALL SELECT side, id, n, width, true, canon, min(pos), [] FROM win WHERE len(slots) = 0 GROUP BY ALL
  UNION ALL SELECT side, id, n, width, false, plain, min(pos), [] FROM win GROUP BY ALL),
spread AS (
  SELECT id, n, {_COVERED_SQL.format("list(pos) FILTER (NOT slotted)", "width")} AS plain,
    {_COVERED_SQL.format("list(pos) FILTER (slotted)", "width")} AS told
  FROM few WHERE side = 'item' GROUP BY id, n, width),
wanted AS (
  SELECT id AS item_id, least(n, {decontaminate.LEAST_WORDS}, plain) AS need,
    least(n, {decontaminate.LEAST_WORDS}, plain, coalesce(nullif(told, 0), n)) AS need_slotted FROM spread),
hit AS (
  SELECT d.id AS doc_id, i.id AS item_id, i.n, i.width, i.slotted, d.pos - i.pos AS shift, i.pos, list_zip(i.slots, d.slots) AS pairs
  FROM few d JOIN few i ON d.side = 'doc' AND i.side = 'item' AND d.canon = i.canon AND d.width = i.width AND d.slotted = i.slotted),
aligned AS (
  SELECT doc_id, item_id, n, width, slotted, shift, list(DISTINCT pos) AS windows, list_distinct(flatten(list(pairs))) AS pairs
  FROM hit GROUP BY ALL),
one AS (
  SELECT * FROM aligned WHERE len(pairs) = len(list_distinct(list_transform(pairs, lambda q: q[1])))
    AND len(pairs) = len(list_distinct(list_transform(pairs, lambda q: q[2])))),
held AS (
  SELECT doc_id, item_id, n, {_COVERED_SQL.format("flatten(list(windows))", "width")} AS words,
    {_COVERED_SQL.format("flatten(list(windows) FILTER (slotted))", "width")} AS told,
    max(len(pairs)) AS slots, max(len(list_filter(pairs, lambda q: q[1] <> q[2]))) AS changed_slots
  FROM one GROUP BY doc_id, item_id, n, width)
SELECT doc_id, item_id, CAST(words AS BIGINT) AS words, CAST(n AS BIGINT) AS item_words,
  CAST(slots AS BIGINT) AS slots, CAST(changed_slots AS BIGINT) AS changed_slots
FROM held JOIN wanted USING (item_id) WHERE words >= need OR told >= need_slotted"""

_TERMS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

_LEXICAL_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS_SQL} AS t FROM documents),
own AS (SELECT r, doc_id, len(t) AS n, t FROM d WHERE len(t) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM own),
i AS (SELECT row_number() OVER () AS q, item_id, {_TERMS_SQL} AS t FROM benchmark),
asked AS (SELECT q, item_id, term, count(*) AS often FROM (SELECT q, item_id, unnest(t) AS term FROM i) GROUP BY ALL),
held AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(t) AS term FROM own)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weight AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM held, total GROUP BY term),
scored AS (
  SELECT q, item_id, r, doc_id,
    CAST(sum(often * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN weight USING (term) JOIN held USING (term), total GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 10"""

# CRC-32 of the decimal id, bit by bit: a byte is taken in, then eight shifts.
_CRC_SQL = """xor(list_reduce(
  flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END,
  CAST(4294967295 AS BIGINT)), 4294967295)"""

_TRIE_SQL = f"""
WITH t AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT c, list(struct_pack(role := role, text := text)
    ORDER BY turn NULLS FIRST, md5(CAST(strlen(role) AS VARCHAR) || ':' || role || text)) AS s FROM t GROUP BY c),
sized AS (SELECT c, s, CAST({_CRC_SQL} % 9 AS BIGINT) AS h FROM own),
seq AS (
  SELECT a.c, list_concat(coalesce(b.s, [])[1:a.h], a.s[a.h + 1:]) AS s
  FROM sized a LEFT JOIN sized b ON b.c = a.c - a.c % 5),
member AS (SELECT c, s[1:d] AS p, d, d = len(s) AS ends FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM seq)),
node AS (
  SELECT p, d, min(c) AS c, count(*) AS n, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '') AS e
  FROM member GROUP BY p, d),
kids AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY 1, 2),
full_node AS (
  SELECT node.*, coalesce(kids.n, 0) AS k, CASE WHEN node.d > 0 THEN (node.n - 1) * strlen(node.p[node.d].text) ELSE 0 END AS saved
  FROM node LEFT JOIN kids ON node.p = kids.p AND node.d = kids.d),
below AS (
  SELECT p[1:u] AS p, u AS d, count_if(k = 0) AS leaves, sum(saved) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS u FROM full_node) GROUP BY 1, 2)
SELECT f.c AS conv_id, CAST(f.d AS BIGINT) AS depth, u.c AS parent_conv_id, CAST(f.n AS BIGINT) AS n_convs, CAST(f.k AS BIGINT) AS n_children,
  CAST(below.leaves AS BIGINT) AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, sha256(f.e) AS ends_sha256
FROM full_node f JOIN below ON f.p = below.p AND f.d = below.d LEFT JOIN node u ON f.d > 0 AND u.d = f.d - 1 AND u.p = f.p[1:f.d - 1]"""

_NEAR_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
good AS (
  SELECT r, vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.r AS x, b.r AS y FROM good a JOIN good b ON a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.9),
reach AS (SELECT r AS x, r AS y FROM v UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
part AS (SELECT reach.x, min(vec_id) AS least FROM reach JOIN v ON v.r = reach.y GROUP BY reach.x),
linked AS (SELECT x, count(*) AS n FROM link GROUP BY x)
SELECT v.vec_id, CAST(coalesce(linked.n, 0) AS BIGINT) AS n_links, part.least AS component_id, coalesce(v.vec_id = part.least, false) AS kept
FROM v JOIN part ON part.x = v.r LEFT JOIN linked ON linked.x = v.r"""

#: The other queries train, hash by XXH64, merge by rank, pack bins or walk trees, which SQL cannot express.
ORACLE: dict[str, str] = {
    "op5_nearest": _NEAREST_SQL,
    "op7_decontamination": _LEAKS_SQL,
    "op11_lexical": _LEXICAL_SQL,
    "op12_prefix_trie": _TRIE_SQL,
    "op13_near_vectors": _NEAR_SQL,
}
