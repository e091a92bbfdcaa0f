"""A training corpus from ``documents`` in five stages, each written as Parquet before the next one reads it.

Every stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with their columns;
the last returns where each piece of each document is packed.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.llm.decontaminate import clean
from palimpsest.llm.jaccard import one_of_each
from palimpsest.llm.packing import document_sizes, pack_documents
from palimpsest.llm.pii import redact
from palimpsest.llm.shared import written
from palimpsest.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts have no toxic feature and stay; rows that repeat are judged alike; a null doc_id is as good as
    another; an empty table, or one without labels, loses nothing. Other columns are carried along whatever their names.
    """
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, that with the smallest doc_id (a null one only where there is no other).

    Rows that repeat are a group, of rows that share the smallest doc_id any one stays; texts without words are in no group and all stay. An empty
    table gives an empty one. Other columns are carried along whatever their names.
    """
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, and with them rows of the same doc_id (of none, where such a row holds one).

    Null, empty and wordless texts hold none, and null, empty and wordless items are held by none; rows and items may repeat. An empty
    table, or an empty benchmark, loses nothing. Other columns are carried along whatever their names.
    """
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in brackets; n_chars follows the text (null for null).

    Every row stays, with other columns as they are; of spans that overlap the first is replaced, and the rest of the other with it. Null and
    empty texts stay so, rows that repeat are redacted alike. An empty table gives an empty one.
    """
    return redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, n_tokens, bin, offset: where each piece of each document is packed, with an end token after each document.

    A null or empty text is its end token alone; rows that repeat are packed each, and as they are of one cluster never into one
    bin (but for empty ones, which have no cluster); a null source is a source like others. An empty table gives an empty one.
    """
    sizes = document_sizes(docs, public_tokenizers.path("word_bpe_49k.json"), by_word=True)
    return pack_documents(sizes)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: A learnt classifier, a learnt field and a tokenizer are beyond SQL; tests/llm holds the other stages against brute-force versions, and toxicity against what was planted.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
