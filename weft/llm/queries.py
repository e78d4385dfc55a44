"""The thin queries opN_<name> over whole tables, and the DuckDB SQL of those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitpack, edit_counts, exact_dedup, hard_negatives, html_diff, line_dedup, quality_rules, secret_link, simhash_mih, suffix_dedup, tier_packing, turn_repair, wu_manber
from .common import table
from .tokens import vocabulary_path


def op1_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.decisions(table(spark, sf_dir, "documents"))


def op2_induced_sorting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op3_url_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_diff.extract(table(spark, sf_dir, "pages"))


def op4_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.encode_and_read(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), end_id=1)


def op5_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return edit_counts.recount(docs, edit_counts.redactions(F.col("text")), vocabulary_path("byte_bpe_50k.json"))


def op6_secret_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_link.report(table(spark, sf_dir, "documents"))


def op7_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tier_packing.pack(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), end_id=0)


def op8_simhash_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_mih.near_duplicates(table(spark, sf_dir, "documents"))


def op9_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wu_manber.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op11_blocked_gemm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op13_tight_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_fuzzy_lines, op2_induced_sorting, op3_url_differencing, op4_bit_packing, op5_edit_counts, op6_secret_link, op7_tier_packing, op8_simhash_mih, op9_wu_manber, op10_quality_rules, op11_blocked_gemm, op12_digest_index, op13_tight_arcs)}

ORACLES = {"op10_quality_rules": quality_rules.ORACLE, "op11_blocked_gemm": hard_negatives.ORACLE, "op12_digest_index": exact_dedup.ORACLE, "op13_tight_arcs": turn_repair.ORACLE}
