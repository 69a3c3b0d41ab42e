"""Corpus pipeline: the stages in order, each written as Parquet and read again.

Quality rules drop what they reject; one document of each near-duplicate group
stays; personal data in texts is replaced by its kind; the domains' tokens are
brought to their target weights by thinning documents of unwanted domains; the
last stage gives each document's BPE ids and the text they decode to.

Stages take and, but for the last, return the columns of documents; further
columns pass through.  A null text has no words, so the rules reject it; a text
without words never reaches the later stages.  Of repeated rows the near-duplicate
stage keeps one.  Ties there go to the smallest doc_id and the first row.  Very
long texts take each stage whole.  An empty table stays one through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import bpe, mixing, pii, quality_rules, simhash
from strata.llm.batches import small_batches
from strata.storage import new_path, scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

TOKENIZER = "byte_bpe_50k.json"
#: Tokens that each domain shall have, as a share of what it has.
FACTORS = {"clean": 1.0, "junk": 0.5, "toxic": 0.1}


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality_rules.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.keep_one_each(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return mixing.thin(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), FACTORS)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    path = public_tokenizers.path(TOKENIZER)
    encoded = docs.select("doc_id", "lang", "source", bpe.encode_column("text", path).alias("ids"))
    return encoded.select("*", F.size("ids").cast("bigint").alias("n_tokens"), bpe.decode_column("ids", path).alias("text"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", apply_quality_rules),
    ("SimHash near-dedup", drop_near_duplicates),
    ("PII", redact_personal_data),
    ("mixing", mix_domains),
    ("BPE", encode_and_decode),
]

#: Expectation-maximisation, SimHash components and iterated graphs are beyond the SQL check.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, "stage-" + name.replace(" ", "-"))
        with scratch(spark):  # a stage's own tables go once its result is written
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
