"""A training corpus from raw documents: five stages, each one operator, each written and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodeworks.llm import decontaminate, langid, mixing, simhash, token_shards
from lodeworks.llm.shared import shared_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is found; those without letters or without a clear language go.

    Null and empty texts have none, so they go; rows without an id and repeated rows are judged each; of languages that tie
    the first by name counts, and its score decides. Other columns stay as they are; an empty table stays one.
    """
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one with the smallest id.

    Rows without an id come after all others, of rows with one id the one of the least hash of its text stays, of equal rows
    one. Null and empty texts are copies of one another. Other columns stay as they are.
    """
    return simhash.keep_representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that contain no benchmark item.

    Null and empty texts contain none, and null and empty items are in none; items and documents without an id count.
    Repeated rows are judged each, other columns stay as they are.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the target weights of its source ask for; the last of a source's prefix in part.

    Texts without words aren't taken; a null language or source counts as one of the empty name; rows without an id and
    repeated rows are taken like any. Other columns stay as they are, but n_chars of a text that is cut.
    """
    return mixing.select_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences in the order of training, written as shards, and read from them with their documents and places.

    Every row gives its text's ids and an end mark, repeated rows each; a null id stays one; no rows give no shards.
    """
    return token_shards.write(docs)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID output", write_tokens),
]

#: Learned models, own hashes and a tokenizer: SQL can't express the stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
    return docs
