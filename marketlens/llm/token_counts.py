"""Token counts of whole texts without encoding them whole: a two-tier lookup of pre-token lengths.

First tier: the lengths of the pre-tokens that are frequent over all documents, in one table that
is broadcast. Each task keeps the frequent ones it meets, in bounded summaries; only those are
added up, no stream of pre-tokens is shuffled. Second tier: a cache in every task for the others,
which the tokenizer encodes when they are met first. The tables speed up the counts and never
change them.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketlens.llm import pretokens

#: Entries of the broadcast table: under 2 MB.
TABLE = 1 << 15
#: Entries of a task's summary and cache.
SUMMARY, CACHE = 1 << 13, 1 << 19


def frequent_pretokens(texts: DataFrame, model: str, entries: int) -> list[str]:
    """About the most frequent pre-tokens of all texts: sums of the tasks' most frequent ones."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = pretokens.Splitter(Tokenizer.from_str(model))
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(splitter.pieces(text))
                    if len(counts) > CACHE:
                        counts = Counter(dict(counts.most_common(SUMMARY)))
        most = counts.most_common(SUMMARY)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in most], pa.string()), pa.array([n for _, n in most], pa.int64())], ["piece", "n"])

    total = texts.mapInArrow(summarise, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return [r["piece"] for r in total.orderBy(F.desc("n"), "piece").limit(entries).collect()]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, entries: int = TABLE) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of every row of ``docs`` (doc_id, text, anything else).

    Tokens are those of the tokenizers library (.json files) or of sentencepiece (.model files),
    without added ones; special strings inside a text count as the library takes them by default.
    A null text counts as empty; repeated rows each get a row. The file is read by the driver and
    broadcast: a vocabulary, whose size does not depend on the data.
    """
    spark, texts = docs.sparkSession, docs.select("text")
    with open(tokenizer_path, "rb") as file:
        content = file.read()
    if tokenizer_path.endswith(".model"):
        return shaped(docs, sentencepiece_counter(spark.sparkContext.broadcast(content)), limit)
    model = content.decode()
    tokenizer = Tokenizer.from_str(model)
    split = pretokens.byte_level(tokenizer)
    pieces = frequent_pretokens(texts, model, entries) if split else []
    table = dict(zip(pieces, map(len, pretokens.encoded(tokenizer, pieces)), strict=True))
    return shaped(docs, two_tier_counter(spark.sparkContext.broadcast((model, table)), split), limit)


def two_tier_counter(shared, split: bool):
    def start():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        model, table = shared.value
        tokenizer = Tokenizer.from_str(model)
        if not split:
            return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
        splitter, lengths = pretokens.Splitter(tokenizer), dict(table)

        def count(text: str) -> int:
            nonlocal lengths
            pieces = splitter.pieces(text)
            try:
                return sum(map(lengths.__getitem__, pieces))
            except KeyError:
                missing = [p for p in set(pieces) if p not in lengths]
                if len(lengths) + len(missing) > CACHE:
                    lengths = dict(table)
                    missing = [p for p in set(pieces) if p not in lengths]
                lengths.update(zip(missing, map(len, pretokens.encoded(tokenizer, missing)), strict=True))
                return sum(map(lengths.__getitem__, pieces))

        return count

    return start


def sentencepiece_counter(shared):
    def start():
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        return lambda text: len(processor.encode(text))

    return start


def shaped(docs: DataFrame, start, limit: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = start()
        for batch in batches:
            n = [tokens(text) if text else 0 for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    counted = docs.select(F.col("doc_id").cast("long"), size, "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
