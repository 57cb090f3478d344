"""A corpus from raw documents to packed sequences: each stage applies one operator to what the one before has kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import jaccard, language, packing, secrets, substrings
from tallyforge.llm.queries import vocabulary
from tallyforge.session import stage

#: Packing and two stages before it cannot be expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def _with_text(row: Column, columns: list[str], text: Column) -> list[Column]:
    """The columns of documents with another text and its number of characters."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return [new[c].alias(c) if c in new else row[c].alias(c) for c in columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those with no letter go. The language that is found stands in ``lang``.

    The model learns from a bounded sample of the labelled documents, as the query of the operator does.
    """
    held_out = language.held_out(F.col("doc_id"))
    model = language.fit(docs.where(~held_out).select(F.col("doc_id").alias("key"), "text", "lang"))
    found = language.predict(docs, model)
    columns = [F.col("lang_pred").alias(c) if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns]
    return found.where(F.col("lang_pred") != language.NONE).select(*columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Of rows with the same id and text one stays. Rows without an id stay, as nothing tells which of them was meant.
    """
    groups = jaccard.near_copies(docs)
    keep = groups.where("component_id = doc_id").select("doc_id").distinct()
    kept = docs.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id IS NULL")).select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that occur earlier; one that has no word left goes.

    Where no word is removed the text stays as it is, with its line ends.
    """
    out = substrings.without_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row")["text"])
    return out.where("n_words > n_removed").select(*_with_text(F.col("row"), docs.columns, text))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    found = secrets.find(docs)
    text = secrets.redacted(F.col("row")["text"], F.col("spans"))
    return found.select(*_with_text(F.col("row"), docs.columns, text))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences of tokens."""
    return packing.pack(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("secret_scan", secret_scan),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
