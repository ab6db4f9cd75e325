"""From raw documents to packed training sequences: five stages, each one corpus operator over all that its predecessor kept.

1. toxicity: documents that the classifier rejects go.
2. n-gram Jaccard join: of each group of near copies the document with the smallest id stays.
3. decontamination: documents that hold a benchmark item go.
4. PII: spans are replaced by their kinds in brackets; n_chars follows.
5. packing: what is left, as pieces in sequences.

Defined cases: documents with a null text pass all stages and pack as their end token;
documents with a null id are judged by their texts alone (nothing can be a copy of them); of rows that share an id, toxicity and
decontamination judge each by its own text, while near copies take them as one document, so that they stay or go together, repeated rows
included; further columns are carried on up to packing; an empty table packs to nothing.

What lies between stages is written to the shared folder and removed once the next stage is written, or once a stage fails; packing keeps
what it needs of the last one in a checkpoint.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumidisc.llm import decontamination, jaccard_join, packing, pii, toxicity
from lumidisc.llm.common import fold, sent_if_small, shared_folder, table
from lumidisc.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), fold(4) != 2))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    copies = jaccard_join.join_components(docs).where("doc_id <> component_id").select("doc_id")
    return docs.join(sent_if_small(copies), "doc_id", "left_anti").select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack),
]

#: Training, edit distances and vocabularies are beyond SQL: see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def remove(spark: SparkSession, path: str) -> None:
    """By Hadoop, as the shared folder needn't be a local one."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages."""
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}", None
    try:
        for name, stage in STAGES[:-1]:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            if before:
                remove(spark, before)
            before = f"{folder}/{name}"
            docs = spark.read.parquet(before)
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:  # the pieces are checkpointed
        remove(spark, folder)
