"""The registered queries of the numbered operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversation_repair, fingerprints, language_id, licences, line_runs, packing, prefix_trie, quality_classifier, quality_rules, token_files, vantage, warc
from .shared import Workspace

#: The end id and the sequence length of the token outputs.
END_ID, SEQUENCE = 2, 1024


def tokenizer() -> str:
    """The vocabulary file, installed alike on driver and executors."""
    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"), Workspace(spark))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"), Workspace(spark))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_token_files(token_files.write_token_files(_table(spark, sf_dir, "documents"), tokenizer(), END_ID, Workspace(spark)))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer(), END_ID, SEQUENCE, Workspace(spark))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(_table(spark, sf_dir, "documents"), tokenizer())


def op6_vantage_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage.nearest(_table(spark, sf_dir, "embeddings"), Workspace(spark))


def op7_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_runs.remove_repeated_runs(_table(spark, sf_dir, "documents"), Workspace(spark))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_deleted", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.near_duplicates(_table(spark, sf_dir, "documents"), 3, 3, Workspace(spark))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(_table(spark, sf_dir, "conversations"), Workspace(spark))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"), Workspace(spark)).drop("enter", "exit")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quality_rules, op2_warc, op3_token_files, op4_packing, op5_bpe, op6_vantage_trees, op7_line_runs, op8_simhash, op9_licences, op10_quality_classifier, op11_conversation_repair, op12_prefix_trie, op13_language_id)
    return {f.__name__: f for f in own}


#: The digest is SHA-1 in base32, from the hexadecimal one: five digits make four letters.
WARC_SQL = """WITH h AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS s, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS holder FROM pages)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(s, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
  CASE WHEN holder = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN holder <> page_id THEN holder END AS refers_to
FROM h"""


#: The hash of an id's digits is built bit by bit; each node's subtree is met through the members that pass it.
TRIE_SQL = """WITH own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 100 AS base, CASE WHEN conv_id % 100 = 0 THEN 0 ELSE xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 6 END AS h FROM (SELECT DISTINCT conv_id FROM own)),
rebuilt AS (SELECT c.conv_id, o.i, md5(length(role) || ':' || role || text) AS turn, length(text) AS tokens, 0 AS late FROM convs c JOIN own o ON o.conv_id = c.base AND o.i <= c.h UNION ALL SELECT c.conv_id, o.i, md5(length(role) || ':' || role || text), length(text), 1 FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.i > c.h),
placed AS (SELECT conv_id, turn, tokens, row_number() OVER (PARTITION BY conv_id ORDER BY late, i) AS depth FROM rebuilt),
prefixes AS (SELECT conv_id, depth, tokens, string_agg(turn, '/') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM placed UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
lasts AS (SELECT conv_id, max(depth) AS depth FROM prefixes GROUP BY 1),
nodes AS (SELECT path, p.depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, max(tokens) AS tokens, sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (WHERE p.depth = l.depth), '')) AS ends_sha256, CASE WHEN p.depth > 1 THEN left(path, -33) WHEN p.depth = 1 THEN '' END AS up FROM prefixes p JOIN lasts l ON p.conv_id = l.conv_id GROUP BY path, p.depth),
kids AS (SELECT up, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY 1),
below AS (SELECT DISTINCT a.path AS top, b.path AS path FROM prefixes a JOIN prefixes b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
sums AS (SELECT top, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((n_convs - 1) * tokens)::BIGINT AS saved_tokens FROM below JOIN nodes USING (path) LEFT JOIN kids k ON k.up = path GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256 FROM nodes n JOIN sums ON top = n.path LEFT JOIN nodes p ON p.path = n.up LEFT JOIN kids k ON k.up = n.path"""


def oracle_sql() -> dict[str, str]:
    """SQL for what it can express; the learned and iterative operators are held against plain versions in the tests."""
    return {"op2_warc": WARC_SQL, "op12_prefix_trie": TRIE_SQL}
