"""The registered query of each operator: the whole table in, the contract's columns out."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import (
    conversation_repair,
    decontamination,
    html_extract,
    language_id,
    line_dedup,
    manifest,
    mixing,
    ngram_join,
    packing,
    token_counts,
    token_files,
    topk,
    url_filter,
)
from marketlens.llm.oracles import ORACLES  # noqa: F401
from marketlens.session import scratch_folder

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = "byte_bpe_50k.json"
PACKED = "word_bpe_49k.json"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document when all sources are mixed by weights 1, 2, 3."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that are similar to an earlier line of any document, short lines included."""
    return line_dedup.remove_similar_lines(table(spark, sf_dir, "documents"), min_words=1)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's URL."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows for every 50th vector."""
    return topk.search(table(spark, sf_dir, "embeddings"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return language_id.identify_languages(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds, with the best window."""
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the token ids of all documents into files and reads every document back."""
    folder = scratch_folder(spark, "token-files")
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(TOKENIZER), shared=True)
    return token_files.read_token_files(manifest)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of 4-word shingles and group of every document."""
    return ngram_join.link_documents(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and witness digest of every document; where a third of the texts was tampered with, the check fails."""
    docs = table(spark, sf_dir, "documents")
    values = ["doc_id", "source", "lang", "n_chars"]
    leaf, changed = (manifest.row_digest(*map(F.col, values), text) for text in (F.col("text"), F.translate("text", CAPITALS, CAPITALS.lower())))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, changed)
    leaves = docs.select("doc_id", "lang", leaf.alias("leaf"), tampered.alias("tampered"))
    built = manifest.build(leaves, F.col("lang"), [F.col("doc_id")], F.col("leaf"), keep=["doc_id", "tampered"])
    checked = manifest.verify(built.withColumn("tampered", F.coalesce("tampered", "leaf")), "tampered")
    return checked.select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("witness").cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after a test damage."""
    conversations = table(spark, sf_dir, "conversations")
    audits = conversation_repair.audit(conversation_repair.damaged(conversations), conversations)
    return audits.select(F.col("conv").cast("long").alias("conv_id"), *audits.columns[1:])


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(PACKED), ids=False)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_source_mixing,
        op2_line_dedup,
        op3_token_counts,
        op4_url_filter,
        op5_exact_topk,
        op6_language_id,
        op7_benchmark_decontamination,
        op8_token_files,
        op9_ngram_jaccard_join,
        op10_html_extraction,
        op11_merkle_manifest,
        op12_conversation_repair,
        op13_packing,
    )
}
