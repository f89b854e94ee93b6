"""The registered queries of the training-data operators; each runs its operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from skylane.llm import adaptive_join, decision_lists, digest_index, entropy_secrets, hamming_join, matrix_bpe, orc_tokens, path_templates, periodic_runs, phrase_trees, quote_links, squares_packing, weak_pii, word_pieces

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[run.__name__] = run
        if sql:
            ORACLE_SQL[run.__name__] = sql.strip()
        return run

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@register(digest_index.SQL)
def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return digest_index.fresh_index(spark).deduplicate(table(spark, folder, "documents"))


@register()
def op9_orc_tokens(spark: SparkSession, folder: str) -> DataFrame:
    path = orc_tokens.new_path(spark)
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orc_tokens.write(table(spark, folder, "documents"), path, word_pieces.default_file(), 1, files)
    return orc_tokens.facts(orc_tokens.read(spark, path))


@register()
def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return squares_packing.pack(table(spark, folder, "documents"), word_pieces.default_file(), 0, 2048)


@register()
def op6_entropy_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return entropy_secrets.scan(table(spark, folder, "documents"))


@register()
def op10_matrix_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return matrix_bpe.encode(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)


@register()
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    learned = decision_lists.fit(decision_lists.training_rows(docs, table(spark, folder, "labels")))
    return decision_lists.judge(docs, learned)


@register(adaptive_join.SQL)
def op7_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return adaptive_join.similarity_classes(table(spark, folder, "documents"), adaptive_join.Similarity(words=3, percent=90))


@register()
def op1_weak_pii(spark: SparkSession, folder: str) -> DataFrame:
    return weak_pii.scan(table(spark, folder, "documents"))


RULES = (
    path_templates.Rule("block", "net", "/"),
    path_templates.Rule("allow", "example.net", "/en/"),
    path_templates.Rule("block", "example.com", "/de/"),
    path_templates.Rule("allow", "org", "/fr/"),
)


@register()
def op8_path_templates(spark: SparkSession, folder: str) -> DataFrame:
    return path_templates.judge(table(spark, folder, "pages"), RULES)


@register(quote_links.SQL)
def op5_quote_links(spark: SparkSession, folder: str) -> DataFrame:
    return quote_links.conversations(table(spark, folder, "conversations"))


@register(hamming_join.SQL)
def op11_hamming_join(spark: SparkSession, folder: str) -> DataFrame:
    signatures = hamming_join.Signatures(adaptive_join.Similarity(words=5, percent=85))
    return hamming_join.near_copies(table(spark, folder, "documents"), signatures)


@register()
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.find(table(spark, folder, "documents"))


@register(phrase_trees.SQL)
def op13_phrase_trees(spark: SparkSession, folder: str) -> DataFrame:
    return phrase_trees.collocations(table(spark, folder, "documents"))


@register()
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
