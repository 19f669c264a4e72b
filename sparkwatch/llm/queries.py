"""The queries opN_<name> over the whole tables, and the SQL that states their results where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprint, importance, langid, licenses, middle, minhash, oracles, packing, pii, quality, substrings, tokenfile, toxicity
from .common import fold, sha256_of, shared_dir, table

#: The key of the surrogates in queries; a deployment passes a secret of its own.
PII_KEY = "sparkwatch"

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary file is on this machine (and on every executor)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    held_out = (fold(F.col("doc_id")) == 1).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = (fold(F.col("doc_id")) == 1).alias("held_out")
    return langid.identify(docs, langid.train(docs)).select("doc_id", held_out, "lang_pred", "score")


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.document_files(spark, sf_dir)).withColumnRenamed("file", "doc_id")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    held_out = (fold(F.col("doc_id")) == 1).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middle.restore(middle.transform(table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha256_of(F.col("output")).alias("output_sha256"), sha256_of(F.col("restored")).alias("restored_sha256"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    tokenfile.write(table(spark, sf_dir, "documents"), folder, tokenizer_path())
    return tokenfile.documents(spark, folder)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict[str, Query]:
    return {
        "op1_minhash_near_dedup": op1_minhash_near_dedup,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_pii_surrogates": op3_pii_surrogates,
        "op4_benchmark_decontamination": op4_benchmark_decontamination,
        "op5_language_id": op5_language_id,
        "op6_document_fingerprints": op6_document_fingerprints,
        "op7_license_scan": op7_license_scan,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_toxicity": op9_toxicity,
        "op10_best_fit_packing": op10_best_fit_packing,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_token_files": op12_token_files,
        "op13_importance_resampling": op13_importance_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_near_dedup": oracles.OP1,
        "op4_benchmark_decontamination": oracles.OP4,
        "op8_substring_dedup": oracles.OP8,
        "op11_fill_in_middle": oracles.OP11,
        "op13_importance_resampling": oracles.OP13,
    }
