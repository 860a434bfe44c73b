"""The registered queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, merkle, oracle, toxicity
from .bpe_codec import decode_ids, encode_texts
from .common import small_batches
from .decontaminate import benchmark_overlap, is_contaminated
from .html_extract import extract
from .line_dedup import dedup_lines
from .mixing import mix_sources
from .quality_rules import apply_rules
from .simhash import near_duplicates
from .substring_dedup import remove_repeats
from .token_counts import count_tokens
from .vector_codes import codebooks_digest, compress


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    found = benchmark_overlap(docs, items, keep=["doc_id"])
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), is_contaminated().alias("contaminated"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), share=1.5, most=2.0, shards=64)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken", F.transform("draws", lambda d: d["shard"]).alias("shards"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold(5) != 0)
    model = toxicity.fit(toxicity.labelled_terms(docs, labels, "doc_id", "text", "toxic", max_rows=20_000))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, "text", "lang", fold(3) != 1)
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score", "ambiguous")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), scale=1024, parts=4, entries=256, rounds=4)
    return coded.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def op12_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    decoded = decode_ids(encoded, ranks)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    leaf = lambda text: merkle.digest(*map(merkle.field, (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)))
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(fold(5) == 0, leaf(lowered))
    found = merkle.merkle_manifest(docs, leaf(F.col("text")), "source", "doc_id", keep={"doc_id": F.col("doc_id"), "tampered": tampered})
    found = found.withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("steps")))
    proof = F.sha2(merkle.siblings(F.col("steps")).cast("binary"), 256).alias("proof_sha256")
    return found.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_mix_sources": op2_mix_sources,
    "op3_line_dedup": op3_line_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_html_extraction": op6_html_extraction,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_quality_rules": op9_quality_rules,
    "op10_language_id": op10_language_id,
    "op11_vector_codes": op11_vector_codes,
    "op12_bpe_codec": op12_bpe_codec,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": oracle.OP1,
    "op3_line_dedup": oracle.OP3,
    "op7_substring_dedup": oracle.OP7,
    "op9_quality_rules": oracle.OP9,
    "op11_vector_codes": oracle.vector_codes(),
    "op13_merkle_manifest": oracle.merkle(),
}
