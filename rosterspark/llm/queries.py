"""The registered queries of this subpackage: each operator over its whole table, with its digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rosterspark.llm.bpe import digests, encode
from rosterspark.llm.common import documents, public_id
from rosterspark.llm.conversation_repair import audited, damaged
from rosterspark.llm.decontam import overlaps
from rosterspark.llm.jaccard import components
from rosterspark.llm.katz import score_documents
from rosterspark.llm.packing import pack_documents
from rosterspark.llm.pii import replace
from rosterspark.llm.prefix_trie import prefix_trie
from rosterspark.llm.quality_classifier import classify
from rosterspark.llm.quality_rules import rules
from rosterspark.llm.sharding import shard_documents
from rosterspark.llm.substring import drop_repeats
from rosterspark.llm.suffix import strip_repeats


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


def op2_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))


def op4_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(public_id(), "item_id", "doc_start", "item_start", "n_words", "n_equal")


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace(documents(spark, sf_dir)).select("doc_id", "text")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op9_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), copies="copies")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(documents(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_recompression_dedup, op3_katz_scoring, op4_lpt_sharding,
                                 op5_suffix_dedup, op6_spaced_seed_decontamination, op7_pii_surrogates, op8_quality_rules,
                                 op9_compression_classifier, op10_jaccard_join, op11_prefix_trie,
                                 op12_conversation_repair, op13_byte_bpe)}

#: crc32 of a string column {0}, bit by bit.
CRC32 = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length({0}) + 1), lambda i: ascii({0}[i])::UBIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda k: 0::UBIGINT)),
        lambda x, y: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT)"""

ORACLE: dict[str, str] = {
    "op11_prefix_trie": f"""
        WITH ids AS (SELECT DISTINCT conv_id AS c, conv_id - conv_id % 100 AS base FROM conversations WHERE conv_id IS NOT NULL),
        heads AS (SELECT c, base, ({CRC32.format("(c::VARCHAR)")} % 6)::BIGINT AS h FROM ids),
        own AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
                       {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t FROM conversations),
        lists AS (SELECT c, list(t ORDER BY n) AS turns FROM own WHERE c IS NOT NULL GROUP BY c),
        rebuilt AS (SELECT x.c, list_concat(list_slice(coalesce(b.turns, []), 1, x.h), list_slice(o.turns, x.h + 1, len(o.turns))) AS turns
                    FROM heads x JOIN lists o ON o.c = x.c LEFT JOIN lists b ON b.c = x.base),
        steps AS (SELECT c, d, list_slice(turns, 1, d) AS path, len(turns) = d AS ends FROM rebuilt, unnest(range(0, len(turns) + 1)) AS u(d)),
        nodes AS (SELECT path, d, min(c) AS conv_id, count(*) AS n_convs,
                         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256,
                         CASE WHEN d = 0 THEN 0 ELSE length(path[d].text) END AS len FROM steps GROUP BY path, d),
        family AS (SELECT a.path, a.d, b.d AS below, b.n_convs, b.len,
                          NOT EXISTS (SELECT 1 FROM nodes x WHERE x.d = b.d + 1 AND list_slice(x.path, 1, b.d) = b.path) AS leaf
                   FROM nodes a JOIN nodes b ON b.d >= a.d AND list_slice(b.path, 1, a.d) = a.path),
        sums AS (SELECT path, d, count(*) FILTER (WHERE below = d + 1) AS n_children, count(*) FILTER (WHERE leaf) AS n_leaves,
                        sum((n_convs - 1) * len)::BIGINT AS saved_tokens FROM family GROUP BY path, d)
        SELECT a.conv_id, a.d AS depth, p.conv_id AS parent_conv_id, a.n_convs, s.n_children, s.n_leaves, s.saved_tokens, a.ends_sha256
        FROM nodes a JOIN sums s ON s.path = a.path LEFT JOIN nodes p ON p.d = a.d - 1 AND p.path = list_slice(a.path, 1, a.d - 1)""",
}
