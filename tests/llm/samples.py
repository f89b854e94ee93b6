"""Small tables with the cases that every operator must answer: nulls, empty and very long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLASHING = "digest keep_id kept n node items label lane length row part ids pos token s words text_sha256 base more rule template n_words".split()


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghiéöñ") for _ in range(r.randint(1, 9))) for _ in range(words))


def edge_rows() -> list[tuple[int | None, str | None]]:
    long = prose(1, 20_000)
    return [
        (1, None),
        (2, ""),
        (3, " \t\n"),
        (4, "one"),
        (5, "One two"),
        (6, "one two\nthree four"),
        (7, "onetwo three four"),
        (8, "one two\nthree four"),
        (8, "one two\nthree four"),
        (9, long),
        (10, long + " x"),
        (11, "a" * 60_000),
        (12, prose(2, 300)),
        (13, prose(2, 300) + " tail"),
        (14, prose(2, 300).upper()),
        (None, prose(2, 300)),
        (None, "no id"),
        (15, "😀 ́x İstanbul ΣΑΣ don't it's 12.5 ﬁ  two  blanks \r\n <|endoftext|> end"),
        (16, "x " * 400),
    ]


def table(spark: SparkSession, rows: list, columns: str = "doc_id long, text string", clash: bool = True) -> DataFrame:
    df = spark.createDataFrame(rows, columns)
    if clash:
        taken = {c.lower() for c in df.columns}
        df = df.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHING if c not in taken])
    return df


def empty(spark: SparkSession, columns: str = "doc_id long, text string") -> DataFrame:
    return spark.createDataFrame([], columns)


def collected(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
