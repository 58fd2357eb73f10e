"""Line deduplication: an exact set-similarity join of the lines of all documents.

A line's set holds its distinct words. Words are ordered by rarity, told by counters of all lines
in an array of fixed size; the first n - ceil(t * n) + 1 words of a set of n are its signatures
(prefix filter). ``set_join`` compares the lines that share one by size, position and parity
before their words are compared. Sets too small to be similar to any but their copies give no
signatures: copies are found by grouping. A line goes if it is similar to an earlier line, by document and
line number; copies go but for the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm import hashing, set_join
from marketlens.llm.storage import BROADCAST_ROWS, added_up, broadcast_if_small, sliced, written

#: Counters for the rarity of words.
SLOTS = 1 << 22
#: Least words of 64 parity bits that are kept of a line.
PARITY_WORDS = 2
#: Stands for a null doc_id, which comes last.
LAST = (1 << 63) - 1


def slots_of(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64(SLOTS - 1)).astype(np.int64)


def line_sets(texts: pa.Array, rank: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, hashing.Sets]]:
    """(row, line number, sets) of the lines of runs of texts, words from rare to frequent."""
    for first, _, data, offsets in hashing.chunks(texts):
        begin, owner, number = hashing.line_offsets(data, offsets)
        yield first + owner, number, hashing.distinct(hashing.hashed_words(data, begin), lambda w: rank[slots_of(w)])


def profiles(docs: DataFrame, min_words: int) -> DataFrame:
    """place, hash, line, key, size and parity bits of every line of at least min_words distinct words; and rows of word counters."""
    schema = pa.schema(
        [("place", pa.int64()), ("hash", pa.int64()), ("line", pa.int32()), ("key", pa.int64()), ("size", pa.int32()), ("parity", pa.binary()), ("slice", pa.int32()), ("counts", pa.binary())]
    )

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, none = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.uint8)
        for batch in batches:
            place, text_hash = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for row, number, sets in line_sets(batch.column(2), none):
                np.add.at(counts, slots_of(sets.tokens), 1)
                kept = np.flatnonzero(sets.sizes >= min_words)
                n = len(kept)
                columns = [pa.array(place[row[kept]]), pa.array(text_hash[row[kept]]), pa.array(number[kept], pa.int32()), pa.array(hashing.set_keys(sets)[kept]), pa.array(sets.sizes[kept], pa.int32())]
                bits = hashing.sized_parity(sets, PARITY_WORDS)
                columns.append(pa.array([bits[i] for i in kept], pa.binary()))
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
        parts = sliced(counts)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(parts.num_rows, t) for t in schema.types[:6]), *parts.columns], schema=schema)

    return docs.select("place", "hash", "text").mapInArrow(profile, "place long, hash long, line int, key long, size int, parity binary, slice int, counts binary")


def least_similar(threshold: Fraction) -> int:
    """Words of the smallest set that may be similar to another than itself: with one word more, n of n + 1 are shared."""
    return -(-threshold.numerator // (threshold.denominator - threshold.numerator)) if threshold < 1 else LAST


def postings(docs: DataFrame, threshold: Fraction, min_words: int, rank: np.ndarray) -> DataFrame:
    """The signatures of every line; copies that a task meets give them once. Words that occur once match nothing."""
    ranks = docs.sparkSession.sparkContext.broadcast(rank)
    least = max(min_words, least_similar(threshold))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            places = batch.column(0).to_numpy(zero_copy_only=False)
            for row, _, sets in line_sets(batch.column(1), ranks.value):
                size, keys = sets.sizes, hashing.set_keys(sets)
                fresh = np.zeros(len(keys), bool)
                for i in np.flatnonzero(size >= least).tolist():
                    key = int(keys[i])
                    if key not in seen:
                        seen.add(key)
                        fresh[i] = True
                if len(seen) > 1_000_000:
                    seen.clear()
                owner, position = sets.owner, sets.position
                spare = size - set_join.least_overlap(size, threshold)
                at = np.flatnonzero((position <= spare[owner]) & fresh[owner] & (ranks.value[slots_of(sets.tokens)] > 0))
                unit = owner[at]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(sets.tokens[at].view(np.int64)),
                        pa.array(places[row[unit]]),
                        pa.array(keys[unit]),
                        pa.array(size[unit], pa.int32()),
                        pa.array(position[at], pa.int32()),
                        pa.array(hashing.parity(sets)[0].view(np.int64)[unit]),
                    ],
                    ["signature", "place", "key", "size", "position", "parity"],
                )

    return docs.select("place", "text").mapInArrow(sign, set_join.POSTINGS)


def removed_lines(docs: DataFrame, threshold: Fraction, min_words: int) -> DataFrame:
    """place, hash and line of every line that goes, of rows alike repeatedly; ``docs`` has place, text and its hash."""
    both = written(profiles(docs, min_words), "line-profiles")
    lines = both.where("slice is null").select("place", "hash", "line", "key", "size", "parity")
    counts = added_up(both.where("slice is not null").select("slice", "counts"), SLOTS)
    # rarity in steps of a sixteenth of a power of two, 0 for words that occur once
    rank = np.minimum(255, np.rint(16 * np.log2(np.maximum(counts, 1)))).astype(np.uint8)
    first = written(
        lines.groupBy("key").agg(F.min(F.struct("place", "hash", "line")).alias("first"), F.any_value("size").alias("size"), F.first("parity").alias("parity"), F.count("*").alias("copies")),
        "line-sets",
    )
    found = written(set_join.candidates(postings(docs, threshold, min_words, rank), threshold).distinct(), "line-candidates")
    pairs = found.where("frequent is null").select("a", "b")

    def of_keys(keys: DataFrame) -> DataFrame:
        """Those of the sets, written: the table of all sets is read for them, and shuffled once at most."""
        return written(first.join(broadcast_if_small(written(keys, "line-keys")), "key", "left_semi"), "line-ends")

    def similar(candidates: DataFrame, tokens: DataFrame) -> DataFrame:
        """Keys of the later lines of the written pairs (a, b), b the later one, that are similar."""
        return set_join.verified(candidates.select("a", "b"), tokens, threshold, candidates.count()).select(F.col("b").alias("key")).distinct()

    def later(candidates: DataFrame) -> DataFrame:
        """Keys of the lines that are similar to an earlier one: to the first that they may be similar to, or else to any other."""
        own = of_keys(set_join.ends_of(candidates))
        close = set_join.close_pairs(candidates, own, threshold, "first", candidates.count())
        swapped = F.col("first_a") > F.col("first_b")
        ends = [F.when(swapped, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("b", "a", "a"), ("a", "b", "b"))]
        pairs = close.select(*ends, F.least("first_a", "first_b").alias("first"))
        pairs = written(pairs, "line-pairs")
        keys = written(set_join.ends_of(pairs), "line-keys")
        wanted = set_join.key_filter(keys, "key")
        none = np.zeros(SLOTS, np.uint8)
        texts = broadcast_if_small(written(own.join(keys, "key", "left_semi").select("first.place").distinct(), "line-places"))
        bearing = docs.join(texts, "place", "left_semi") if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else docs
        found = set_join.token_sets(bearing.select("text"), lambda batch: (s for _, _, s in line_sets(batch.column(0), none)), wanted)
        tokens = written(found.join(keys, "key", "left_semi"), "line-tokens")
        tried = written(pairs.groupBy("b").agg(F.min_by("a", F.struct("first", "a")).alias("a")), "line-pairs")
        settled = written(similar(tried, tokens), "line-similar")
        rest = pairs.join(settled.withColumnRenamed("key", "b"), "b", "left_anti").join(tried, ["a", "b"], "left_anti")
        rest = written(rest.select("a", "b"), "line-pairs")
        if rest.isEmpty():
            return settled
        ends = broadcast_if_small(written(set_join.ends_of(rest), "line-keys"))
        return settled.union(similar(rest, tokens.join(ends, "key", "left_semi")))

    gone = written(later(pairs), "line-removed")
    # lines with a frequent signature were compared with one line only: those that stay, with all earlier ones
    bearers = found.where("frequent is not null").select(F.col("frequent").alias("signature"), F.col("a").alias("key"))
    rest = bearers.join(of_keys(bearers.select("key").distinct()), "key").join(gone.withColumn("gone", F.lit(True)), "key", "left")
    open_ = rest.where("gone is null").select("signature").distinct()
    rest = written(rest.join(open_, "signature", "left_semi"), "line-bearers")
    if not rest.isEmpty():
        bits = written(set_join.folded_bits(rest.dropDuplicates(["key"]), PARITY_WORDS), "line-bits")
        wide = written(rest.drop("size", "parity").join(bits, "key"), "line-bearers")
        more = set_join.open_pairs(wide, PARITY_WORDS, threshold, F.col("b.gone").isNull() & (F.col("a.first") < F.col("b.first")))
        more = written(more.join(pairs, ["a", "b"], "left_anti"), "line-candidates")
        gone = gone.union(later(more))
    # a line that occurs once and is similar to no earlier one stays, without a look at it
    marks = first.join(broadcast_if_small(written(gone.withColumn("gone", F.lit(True)), "line-removed")), "key", "left").where("gone or copies > 1")
    kept = F.struct("place", "hash", "line") == F.col("first")
    return lines.join(marks.select("key", "first", "gone"), "key").where(F.col("gone").isNotNull() | ~kept).select("place", "hash", "line")


def remove_similar_lines(docs: DataFrame, threshold: Fraction = Fraction(4, 5), min_words: int = 5) -> DataFrame:
    """doc_id, n_lines, n_removed and text (the lines that stay) of every row of ``docs`` (doc_id, text, anything else).

    Lines end with a line feed. Lines of fewer than ``min_words`` distinct words stay; with 1, only
    lines without words do. A null text stays null, with no lines. Documents are told by doc_id and a hash of their
    text, in this order, a null doc_id last: those that share a doc_id, or have none, lose lines each by its own
    text. Rows alike in both count as one document and keep the same lines.
    """
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    placed = docs.select(F.col("doc_id").cast("long"), "text", place.alias("place"), F.xxhash64("text").alias("hash"))
    gone = removed_lines(placed, threshold, min_words).groupBy("place", "hash").agg(F.collect_set("line").alias("gone"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, removed, texts = [], [], []
            for text, lines in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                all_lines = [] if text is None else text.split("\n")
                drop = set(lines or ())
                stay = [x for i, x in enumerate(all_lines) if i not in drop]
                count.append(len(all_lines))
                removed.append(len(all_lines) - len(stay))
                texts.append(None if text is None else "\n".join(stay))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())],
                ["doc_id", "n_lines", "n_removed", "text"],
            )

    joined = placed.join(gone, ["place", "hash"], "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(apply, "doc_id long, n_lines long, n_removed long, text string")
