"""From raw documents to token ids, in five stages that each write their table.

Null and empty texts have no words and go with the first stage; repeated rows of one id
stay one document from the second stage on; an empty table gives an empty result; extra
columns stay up to the last stage, which returns the ids."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.llm import bpe, exact_dedup, minhash, mixing, quality
from foliolake.llm.store import keep
from foliolake.session import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The index is made for this run and dropped, so that a run's result depends on its
    documents alone; a growing corpus would give keep_first_seen one name for all runs."""
    name = f"corpus_{uuid.uuid4().hex}"
    try:
        return exact_dedup.keep_first_seen(docs, name)
    finally:
        exact_dedup.DigestIndex(spark, name).drop()


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    df = bpe.encode_decode(docs, carry=("doc_id", "lang", "source"))
    return df.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("bpe", tokens)]

#: MinHash classes and BPE merges have no SQL; a test compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
