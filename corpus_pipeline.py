"""From raw documents to packed training sequences.

Each stage gets all rows that the one before it kept, as a table written and read again. All but the
last return the columns of ``documents``; where a stage changes texts, ``n_chars`` follows.

All stages take null and empty texts, texts of any length (whole), repeated rows and ids, null ids,
empty tables (which give none of their rows), and extra columns of any name, which stay as they are
until packing. What becomes of each is said at the stage. Tables between stages are written to
``pipeline-<uuid>`` in the shared folder; they are read when the result is, so it is the caller who
can delete them afterwards.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import decontaminate, language, packing, simhash, substrings
from tracewell.llm.shared import shared_dir, table


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in none of the languages go.

    Null and empty texts and those without letters are in none, so they go, each copy like the others.
    A null ``lang`` or ``source`` is no evidence; ties go to the first language by name.
    """
    return language.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id.

    SimHash links, and all pairs with a similarity of 0.8 or more on 5-word shingles. Null and empty
    texts are each other's copies; of rows that share an id in one group, one stays; rows with a null id
    connect others but can't be told apart, and stay.
    """
    return simhash.keep_first(docs, width=5, threshold=0.8)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that occur more than once go; every document stays.

    A null text stays null; a text of nothing else becomes empty; texts shorter than a window stay.
    """
    return _recounted(substrings.remove_repeats(docs))


def remove_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans that benchmark windows cover go; every document stays.

    A null text stays null; items with null or empty text have no windows; items may repeat.
    """
    return _recounted(decontaminate.strip(docs, table(spark, sf_dir, "benchmark")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All tokens of all documents, in sequences of 2048 at most.

    A null or empty text is the closing id alone; a row per piece, with the document's id, also if null
    or repeated; lengths that tie are ranked in any order. Other columns end here.
    """
    return packing.pack(docs, digest=True)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", remove_repeated_passages),
    ("decontamination", remove_benchmark_passages),
    ("packing", pack_sequences),
]

#: Language scores, fingerprints and tokens are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written as Parquet and read again."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
