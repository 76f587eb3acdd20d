"""Queries over the operators of this subpackage, with production parameters, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shroud.llm import adaptive_scan, cover_tree, hash_tree, kneser_ney, oracle, pii
from shroud.llm.common import table
from shroud.llm.fill_in_middle import fill_in_middle, restore
from shroud.llm.jaccard_forest import jaccard_join
from shroud.llm.line_dedup import dedup_lines
from shroud.llm.mixing import mix
from shroud.llm.packing import pack_documents
from shroud.llm.quality import quality_scores
from shroud.llm.secrets import findings_by_path, scan_history
from shroud.llm.whitening import whiten


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_deleted", "text")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file())


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find_pii(docs, pii.train(docs))


def op4_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.top_k(table(spark, sf_dir, "embeddings"))


#: Relative language weights of op5; domains and sources weigh alike.
LANGUAGE_WEIGHTS = {"en": 400, "de": 200, "fr": 200, "es": 200}


def site_group() -> Column:
    """The domain level: sources by a hash, as the tables name no domain."""
    return F.concat(F.lit("d"), F.substring(F.md5("source"), 1, 1))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """120 % of all tokens over hashed site groups, languages and sources, at most four epochs of any source."""
    out = mix(table(spark, sf_dir, "documents"), site_group(), F.col("lang"), F.col("source"), budget_percent=120,
              language_weights=LANGUAGE_WEIGHTS)
    return out.select("doc_id", F.col("mx_domain").alias("domain"), F.col("mx_language").alias("language"),
                      F.col("mx_source").alias("leaf_source"), F.col("mx_epoch").alias("epoch"),
                      F.col("mx_tokens").alias("tokens"), F.col("mx_take").alias("take"))


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = kneser_ney.held_out_tenth(F.col("doc_id"))
    return kneser_ney.score(docs, kneser_ney.train(docs.filter(~held_out)), held_out)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as the first version of every path, scanned against an empty ledger."""
    versions = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("path"), F.lit(1).alias("version"), F.col("text").alias("content"))
    _, findings, light = scan_history(versions)
    return findings_by_path(light, findings).select(
        F.col("path").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op8_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_scan.neighbours(table(spark, sf_dir, "embeddings"))


def op11_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight even shards in two regions of two racks; a ninth would come as a region of its own."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", hash_tree.text_size(F.col("text")).alias("size"), hash_tree.text_crc32(F.col("text")).alias("text_crc32"))
    tree, key = hash_tree.Tree.even(8), F.col("doc_id")
    placed = hash_tree.slots(docs, ["doc_id", "size", "text_crc32"], hash_tree.shard_of(tree, key))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
                         hash_tree.shard_of(tree.with_region(8), key).alias("grown_shard"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("fim_units").alias("n"), F.col("fim_form").alias("form"),
                      F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"),
                      F.sha2("text", 256).alias("output_sha256"),
                      F.sha2(restore(F.col("text"), F.col("fim_form")), 256).alias("restored_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_packing": op2_packing,
    "op3_pii": op3_pii,
    "op4_cover_tree": op4_cover_tree,
    "op5_mixing": op5_mixing,
    "op6_kneser_ney": op6_kneser_ney,
    "op7_secrets": op7_secrets,
    "op8_jaccard_forest": op8_jaccard_forest,
    "op9_quality": op9_quality,
    "op10_adaptive_scan": op10_adaptive_scan,
    "op11_hash_tree": op11_hash_tree,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_whitening": op13_whitening,
}

ORACLE: dict[str, str] = {
    "op4_cover_tree": oracle.TOP_K,
    "op7_secrets": oracle.SECRETS,
    "op11_hash_tree": oracle.HASH_TREE,
    "op12_fill_in_middle": oracle.FILL_IN_MIDDLE,
    "op5_mixing": oracle.MIXING.format(weights=" ".join(f"WHEN '{k}' THEN {v}" for k, v in LANGUAGE_WEIGHTS.items())),
}
