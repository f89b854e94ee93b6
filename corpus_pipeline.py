"""Preparing ``documents`` for training: reject poor texts, drop copies and near copies, mask secrets, pack sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each result as Parquet to the work area and reads it again for the next
stage, so that a lost executor costs one stage's tasks and no stage depends on another's memory.

Defined results, whatever the rows: a null text counts as empty, which the quality rules reject; rows are
judged one by one, where ids repeat as well; of equal texts the longest original stays, then the
smallest id; of each group of similar documents the one with the smallest id stays; a text with secrets
stays with ``[SECRET]`` in their place; an empty table gives no rows. Further columns are carried along,
whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skylane.llm import adaptive_join, decision_lists, digest_index, entropy_secrets, squares_packing, word_pieces
from skylane.session import work_area

# Near copies: five-word shingles, similarity of 0.8 or more. Sequences: 2048 tokens, documents ended by id 0.
NEAR = adaptive_join.Similarity(words=5, percent=80)
SEQUENCE, END_ID = 2048, 0


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return decision_lists.only_kept(docs, decision_lists.fit(decision_lists.training_rows(docs, labels)))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digest_index.without_copies(docs, digest_index.fresh_index(spark))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return adaptive_join.without_near_copies(docs, NEAR)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return entropy_secrets.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return squares_packing.pack(docs, word_pieces.default_file(), END_ID, SEQUENCE)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("secret scans", secret_scan),
    ("best-fit packing", packing),
]

# The learned quality rules and the tokenizer are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        path = f"{work_area(spark)}/pipeline-{uuid.uuid4().hex}-{n}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
