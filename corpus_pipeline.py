"""A corpus pipeline: language, near duplicates, benchmark passages, personal data, packing.

Each stage takes the documents that its predecessor kept and returns those that it keeps,
all columns; the last returns packed pieces. A stage's rows are written as Parquet and read
again, so an executor's loss costs one stage's work at most.
"""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import decontaminate, language, nearjoin, packing, pseudonyms
from corvane.llm.queries import table
from corvane.llm.shared import cut


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no language has half the letters go, those without letters too; lang becomes the language found.

    Null and empty texts go. Repeated rows stay or go together; an empty table stays empty.
    """
    return language.keep_identified(docs)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    A row without an id stays if its group has no other; of repeated rows one stays. Null
    texts and texts without words are alike only to themselves, under one id. An empty table
    stays empty.
    """
    return nearjoin.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go.

    Null and empty texts hold none and stay, as do rows without ids; repeated rows stay or
    go together. Either table may be empty.
    """
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses get pseudonyms; n_chars follows the text.

    The key is the session's setting spark.corvane.pseudonymKey, which links the values of
    several runs; without it a new random one, which nobody keeps. No row goes: null texts
    stay null, and repeated rows stay alike. An empty table stays empty.
    """
    names = docs.columns
    out = pseudonyms.pseudonymised(docs, spark.conf.get(pseudonyms.KEY_SETTING, None) or secrets.token_hex(32))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*names)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens, as op9_packing gives them.

    A null or empty text is one token; repeated rows are packed once each; an empty table
    gives no rows.
    """
    return packing.op9(docs)


STAGES = [
    ("language", identified),
    ("near_duplicates", deduplicated),
    ("decontaminate", decontaminated),
    ("pseudonyms", pseudonymised),
    ("packing", packed),
]

#: The language model, the permutations and the packing have no SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
