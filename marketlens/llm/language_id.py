"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A run of three letters is bound: the first letter's
vector permuted twice, the second's once, the third's as it is, multiplied. A text's vector is the
sum of those of its runs (bundling), a language's prototype the sum over its training texts; a text
gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.storage import broadcast_if_small, written

DIMENSIONS = 1024
#: Symbols: 0 is a gap between words, 1 to 26 are a to z, other letters share the rest by code point.
SYMBOLS = 64
UNKNOWN = "und"
#: Documents whose vectors are made by one product of matrices.
GROUP = 64
#: Texts are of a language if their cosine is at least this share of the quantile that training documents of their length reach
#: with their own language; lengths go by powers of two, and count where there are so many training documents.
FLOOR_QUANTILE, FLOOR_SHARE, FLOOR_LEAST = 0.01, 0.5, 100


def letter_table() -> np.ndarray:
    """The symbol of every code point."""
    table = np.zeros(0x110000, np.uint32)
    letters = np.array([c for c in range(0x110000) if chr(c).isalpha()])
    table[letters] = 27 + letters % (SYMBOLS - 27)
    table[97:123] = np.arange(1, 27)
    return table


def letter_vectors(seed: int) -> np.ndarray:
    """Vectors of the symbols, permuted twice, once and not at all."""
    rng = np.random.Generator(np.random.PCG64(seed))
    plain = rng.integers(0, 2, (SYMBOLS, DIMENSIONS), np.int8) * 2 - 1
    order = rng.permutation(DIMENSIONS)
    once = plain[:, order]
    return np.stack([once[:, order], once, plain]).astype(np.int8)


def bound(grams: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The vectors of runs of three symbols."""
    return vectors[0][grams >> 12] * vectors[1][(grams >> 6) & 63] * vectors[2][grams & 63]


def grams_of(text: str | None, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of three symbols of a whole text and how often each occurs; none if it has no letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    symbols = table[codes]
    letter = symbols > 0
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # of several gaps, the first
    line = np.concatenate([[0], symbols[kept], [0]] if letter[-1] else [[0], symbols[kept]]).astype(np.int64)
    return np.unique((line[:-2] << 12) | (line[1:-1] << 6) | line[2:], return_counts=True)


def prototypes(texts: DataFrame, seed: int) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, of length one, from rows of (text, lang).

    Each task adds up the counts of runs per language; the sums of a language have a fixed bound.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sums = letter_table(), {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams, n = grams_of(text, table)
                if len(grams):
                    sums.setdefault(lang, np.zeros(SYMBOLS**3, np.int64))[grams] += n
        for lang, total in sums.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(total[some])], ["lang", "gram", "n"])

    def bundle(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        vectors, total, group = letter_vectors(seed), np.zeros(DIMENSIONS), group.sort_values("gram")
        for at in range(0, len(group), 4096):
            part = group.iloc[at : at + 4096]
            total += part["n"].to_numpy(np.float64) @ bound(part["gram"].to_numpy(), vectors)
        return pd.DataFrame({"lang": [key[0]], "vector": [(total / max(np.linalg.norm(total), 1e-300)).tobytes()]})

    counts = texts.select("text", "lang").mapInArrow(count, "lang string, gram long, n long")
    summed = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = sorted(summed.groupBy("lang").applyInPandas(bundle, "lang string, vector binary").collect())
    return [r["lang"] for r in rows], np.array([np.frombuffer(r["vector"]) for r in rows]).reshape(len(rows), DIMENSIONS)


def predict(docs: DataFrame, langs: list[str], vectors: np.ndarray, seed: int) -> DataFrame:
    """doc_id, held_out, lang_pred and score of rows of (doc_id, held_out, text, lang); letters, and own: the cosine with lang, null if not learned."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, vectors))

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, goals = shared.value
        table, letters = letter_table(), letter_vectors(seed)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            labels, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            place = {name: i for i, name in enumerate(names)}
            stated = [place.get(lang) for lang in batch.column(3).to_pylist()]
            letters_of, own = np.zeros(len(texts), np.int64), [None] * len(texts)
            for first in range(0, len(texts) if names else 0, GROUP):
                counted = [grams_of(text, table) for text in texts[first : first + GROUP]]
                some = [i for i, (g, _) in enumerate(counted) if len(g)]
                if not some:
                    continue
                known = np.unique(np.concatenate([counted[i][0] for i in some]))
                counts = np.zeros((len(some), len(known)), np.float32)
                for row, i in enumerate(some):
                    counts[row, np.searchsorted(known, counted[i][0])] = counted[i][1]
                # whole numbers, exact whatever the order of the sums
                bundles = (counts @ bound(known, letters).astype(np.float32)).astype(np.float64)
                cosines = bundles @ goals.T / np.maximum(np.linalg.norm(bundles, axis=1, keepdims=True), 1e-300)
                cosines = np.round(cosines, 9)
                best = cosines.argmax(axis=1)
                for row, i in enumerate(some):
                    labels[first + i] = names[best[row]]
                    scores[first + i] = min(1.0, max(0.0, cosines[row, best[row]]))
                    grams, n = counted[i]
                    letters_of[first + i] = n[(grams >> 6) & 63 > 0].sum()
                    if stated[first + i] is not None:
                        own[first + i] = float(cosines[row, stated[first + i]])
            columns = [batch.column(0), batch.column(1), pa.array(labels, pa.string()), pa.array(scores), pa.array(letters_of), pa.array(own, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score", "letters", "own"])

    schema = "doc_id long, held_out boolean, lang_pred string, score double, letters long, own double"
    return docs.select("doc_id", "held_out", "text", "lang").mapInArrow(guess, schema)


def held_out(doc_id: Column, fold: int = 2, folds: int = 4) -> Column:
    """Whether a document is kept from training, by a checksum of its id; one without id is not, but teaches nothing."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def identify_languages(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, held_out, lang_pred and score (cosine, 0 to 1) of every row of ``docs`` (doc_id, text, lang, anything else).

    Trained on all documents with a lang and an id that are not held out; texts are whole. A null
    text, one without letters, and any text if there was nothing to learn from get ``und`` and 0.
    Ties go to the first language by name; repeated rows each get a row.
    """
    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text", "lang")
    langs, vectors = prototypes(rows.where("not held_out and doc_id is not null and lang is not null and text is not null"), seed)
    return predict(rows, langs, vectors, seed).select("doc_id", "held_out", "lang_pred", "score")


def floors(scores: DataFrame) -> list[tuple[int, float]]:
    """(power of two, least score) of texts of at least so many letters, from the training documents among ``scores``; in order.

    Longer texts come nearer to their language: lengths with too few training documents have the
    floor of the next shorter ones, and those before the first have none.
    """
    bucket = F.floor(F.log2("letters")).cast("int").alias("bucket")
    own = scores.where("not held_out and own is not null and letters > 0").groupBy(bucket)
    rows = own.agg(F.count("*").alias("n"), F.percentile_approx("own", FLOOR_QUANTILE, 10_000).alias("low")).where(F.col("n") >= FLOOR_LEAST).collect()
    return sorted((r["bucket"], max(0.0, FLOOR_SHARE * r["low"])) for r in rows)


def keep_known(docs: DataFrame, min_score: float = 0.0, seed: int = 7) -> DataFrame:
    """The rows of ``docs`` whose text has a language: not ``und``, and a score of at least ``min_score`` and the floor of its length."""
    row = F.xxhash64("doc_id", "text")
    teaches = ~held_out(F.col("doc_id")) & F.expr("doc_id is not null and lang is not null and text is not null")
    rows = docs.select(row.alias("doc_id"), (~teaches).alias("held_out"), "text", "lang")
    scores = written(predict(rows, *prototypes(docs.where(teaches), seed), seed), "language-scores")
    floor = F.lit(min_score)
    for bucket, least in floors(scores):  # at most a floor for each power of two
        floor = F.when(F.col("letters") >= 2**bucket, F.greatest(F.lit(min_score), F.lit(least))).otherwise(floor)
    gone = scores.where((F.col("lang_pred") == UNKNOWN) | (F.col("score") < floor)).select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(broadcast_if_small(written(gone, "other-languages")), row == F.col("gone"), "left_anti")
