"""From raw documents to mixed, encoded training data: five stages over all documents."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marketlens.llm import decontamination, language_id, mixing, ngram_join, token_files
from marketlens.llm.storage import written
from marketlens.session import scratch_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the labelled ones; those without letters, and those far below what their length reaches, go."""
    return language_id.keep_known(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (five-word shingles, similarity 0.8) the row with the smallest doc_id, null last."""
    return ngram_join.keep_first(docs, words=5, threshold=Fraction(4, 5))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of the sources takes it."""
    return mixing.repeated(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token ids in doc_id order; doc_id, start, n_tokens and ids_crc32 of every row, from the files."""
    manifest = token_files.write_token_files(docs, scratch_folder(spark, "token-files"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_token_files(manifest)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", known_languages),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", token_output),
]

#: Vectors of letters, hashes of shingles and a tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return docs
