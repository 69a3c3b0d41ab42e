"""The dealt operators as queries over the test tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import bpe, codes, hmm, manifest, media, mixing, packing, pii, quality_classifier, quality_rules, secrets, simhash, sql, tokenfiles
from strata.llm.batches import small_batches

TOKENIZER = "byte_bpe_50k.json"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.score(documents(spark, sf_dir), labels)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_column(F.col("fp")).alias("fingerprint"), "component_id")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenfiles.write_token_files(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), end_id=0)
    return tokenfiles.read_token_files(manifest)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(documents(spark, sf_dir))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(documents(spark, sf_dir))


def op9_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(documents(spark, sf_dir))


WEIGHTS = {"clean": 0.90, "junk": 0.08, "toxic": 0.02}


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), WEIGHTS)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verify(spark.read.parquet(f"{sf_dir}/documents.parquet"), manifest.tampered(F.col("text"), F.col("doc_id")))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), end_id=1)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.digests(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_bpe": op2_bpe,
    "op3_quality_rules": op3_quality_rules,
    "op4_pii": op4_pii,
    "op5_simhash": op5_simhash,
    "op6_token_files": op6_token_files,
    "op7_secrets": op7_secrets,
    "op8_media": op8_media,
    "op9_hmm": op9_hmm,
    "op10_mixing": op10_mixing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_packing": op12_packing,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE: dict[str, str] = {"op11_merkle_manifest": sql.MERKLE_MANIFEST, "op13_vector_codes": sql.VECTOR_CODES}
