"""A corpus from raw documents: quality rules, near duplicates, repeated passages, benchmark passages, token ids."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderworks.llm.bpe_automaton import encode_texts
from ladderworks.llm.decontaminate import decontaminate
from ladderworks.llm.frames import kept
from ladderworks.llm.ngram_join import drop_near_duplicates
from ladderworks.llm.quality_rules import CLEAN_RULES, measure
from ladderworks.llm.substring_dedup import remove_repeated_passages


def _cut(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The documents with the text as the operator leaves it, and its length; other columns stay, whatever their names."""
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_whole")
    changed = operator(docs.select(others, "text"))
    kind = {f.name: f.dataType for f in docs.schema.fields}
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(kind.get("n_chars", "long"))}
    return changed.select(*[new.get(c, F.col(f"_whole.`{c}`")).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the table of thresholds, with all their columns; the others go.

    Null and empty texts fail the base rule of 50 words. Rows are judged alone, so repeated rows stay or go together.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole")
    judged = measure(docs.select(row, F.col("text").alias("_body")), text_col="_body", rules=CLEAN_RULES)
    return judged.where("kept").select("_whole.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id; rows without an id come last.

    Texts without words are linked with nothing and stay. Of repeated rows one stays; several texts under one id are several
    documents.
    """
    return drop_near_duplicates(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 35 words or more that repeat; every document stays, with what is left of its text.

    Null and empty texts stay as they are. Repeated rows are copies of each other.
    """
    return _cut(docs, remove_repeated_passages)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the spans of benchmark windows; every document stays, with what is left of its text.

    Null and empty texts stay as they are; repeated rows are cut alike. Benchmark items without an id count.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _cut(docs, lambda rows: decontaminate(rows, items, cut=True))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text (little-endian unsigned 32-bit integers) and their number, a row for each document.

    Null and empty texts have no ids. Rows without an id and repeated rows each have their own result.
    """
    coded = encode_texts(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), decode=False)
    return coded.select("doc_id", "n_tokens", "ids")


STAGES = [("quality_rules", quality), ("ngram_join", near), ("substring_dedup", passages), ("decontaminate", benchmark), ("bpe_automaton", tokens)]
#: Byte-pair encoding can't be said in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. What a stage returns is kept, as later ones read it more than once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        docs = kept(docs) if k < len(STAGES) else docs
    return docs
