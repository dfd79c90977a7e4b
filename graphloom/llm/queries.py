"""The operators as queries over the tables of a folder, and the SQL that says the same where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_join, filter_audit, html_extract, line_dedup, minhash, mixing, nbsvm, piece_bpe, prefix_trie, quality_rules, token_counts, token_store
from .common import Scratch, documents
from .sql import ORACLES  # noqa: F401


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_store_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "token-files").path("store")
    token_store.write_token_store(documents(spark, sf_dir), path, _tokenizer("byte_bpe_50k.json"))
    return token_store.read_token_store(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(documents(spark, sf_dir), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def embedding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.near_vectors(documents(spark, sf_dir, "embeddings"))


def token_count_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"))


def quality_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_counts(documents(spark, sf_dir))
    return judged.select("doc_id", *(F.col(f"_rule_{n}").alias(n) for n in quality_rules.FEATURES), F.col("_rule_failed").alias("base_failed"), F.col("_rule_kept").alias("kept"))


def html_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(documents(spark, sf_dir, "pages"))


def classifier_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return nbsvm.score_quality(docs, nbsvm.fit_quality(docs, documents(spark, sf_dir, "labels")))


def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text", mixing.token_estimate().alias("n_tokens"))
    return mixing.plan_mix(docs).select("doc_id", "source", "n_tokens", "block", "place", "copies")


def minhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_documents(documents(spark, sf_dir))


def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    spans = F.transform("_dedup_spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    return found.select("doc_id", F.col("_dedup_words").alias("n_words"), F.col("_dedup_removed_words").alias("n_removed_words"), F.array_join(spans, ",").alias("removed_spans"), "text")


def piece_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_documents(documents(spark, sf_dir), _tokenizer("piece_bpe_32k.model"), keep_ids=False)


def trie_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(documents(spark, sf_dir, "conversations"))


def filter_audit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_store": token_store_query,
        "op2_byte_bpe": bpe_query,
        "op3_embedding_near_dedup": embedding_query,
        "op4_token_counts": token_count_query,
        "op5_quality_rules": quality_rules_query,
        "op6_html_extraction": html_query,
        "op7_quality_classifier": classifier_query,
        "op8_source_mixing": mixing_query,
        "op9_minhash_near_dedup": minhash_query,
        "op10_substring_dedup": line_dedup_query,
        "op11_piece_bpe": piece_query,
        "op12_prefix_trie": trie_query,
        "op13_filter_audit": filter_audit_query,
    }
