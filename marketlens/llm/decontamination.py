"""Benchmark decontamination: documents that hold an item of a benchmark, in whole or nearly.

A window has as many words as an item. Its SimHash is a 64-bit fingerprint: each bit is the
majority of that bit over the hashes of the window's words, repeated ones counted. Fingerprints of
windows and items are cut into ``radius + 1`` blocks of bits, and joined on (item length, block
number, block): two fingerprints within the radius agree in a block, so all such pairs are found.
They are verified by the exact similarity of their weighted shingles: runs of ``words`` words
weighted by how often they occur, the share of the item's weight that the window holds.

Only windows that can reach the similarity are fingerprinted. Such a window shares a shingle with
its item; moved to the first one, it keeps all that it shares, and moved back along a run of
consecutive shared shingles it loses none, unless the item repeats a shingle. So windows begin
where such a run begins, and at every shared shingle for items that repeat one; at the end of a
document the last window of that length stands for those that would overrun.

Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.storage import broadcast_if_small, written


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits; an empty array for null and empty texts."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def runs(values: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` elements; none if there are fewer."""
    count = F.size(values) - size + 1
    return F.when(count < 1, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.xxhash64(F.slice(values, i, size)))
    )


def simhash(values: Column) -> Column:
    """The majority of each bit over the hashes."""
    bits = F.sequence(F.lit(0), F.lit(63))

    def majority(j: Column) -> Column:
        ones = F.aggregate(values, F.lit(0), lambda n, h: n + F.getbit(h, j).cast("int"))
        return F.when(ones * 2 > F.size(values), F.call_function("shiftleft", F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long"))

    joined = F.aggregate(F.transform(bits, majority), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return F.coalesce(joined, F.lit(0).cast("long"))  # never null, so that no check for null makes Spark compute it twice


def blocks(fingerprint: Column, radius: int) -> Column:
    """(number, value) of the radius + 1 blocks of bits of a fingerprint."""
    n = radius + 1
    edges = [64 * i // n for i in range(n + 1)]
    values = [F.shiftrightunsigned(fingerprint, edges[i]).bitwiseAND((1 << (edges[i + 1] - edges[i])) - 1) for i in range(n)]
    return F.array(*(F.struct(F.lit(i).alias("number"), v.cast("int").alias("value")) for i, v in enumerate(values)))


def held_weight(window: Column, item: Column) -> Column:
    """Weight of the item's shingles, repeats counted, that the window holds as often."""

    def times(values: Column, one: Column) -> Column:
        return F.size(F.filter(values, lambda x: x == one))

    return F.aggregate(F.array_distinct(item), F.lit(0), lambda n, s: n + F.least(times(item, s), times(window, s)))


def prepared_items(benchmark: DataFrame, words: int) -> DataFrame:
    """A row for each different text of at least ``words`` words: the smallest item_id, length, shingles, fingerprint."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), hashes(words_of(F.col("text"))).alias("item_words"))
    items = items.where(F.size("item_words") >= words).groupBy("item_words").agg(F.min("item_id").alias("item_id"))
    return items.select(
        "item_id",
        F.size("item_words").alias("n_words"),
        runs(F.col("item_words"), words).alias("item_shingles"),
        simhash(F.col("item_words")).alias("item_fingerprint"),
    ).withColumn("repeats", F.size(F.array_distinct("item_shingles")) < F.size("item_shingles"))


def short_leaks(docs: DataFrame, benchmark: DataFrame, words: int) -> DataFrame | None:
    """The first place of every item of fewer than ``words`` words, each one whole shingle; null if there are none."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), hashes(words_of(F.col("text"))).alias("item_words"))
    items = items.where(F.size("item_words").between(1, words - 1)).groupBy("item_words").agg(F.min("item_id").alias("item_id"))
    items = written(items.select("item_id", F.size("item_words").alias("n_words"), F.xxhash64("item_words").alias("run")), "short-items")
    lengths = [r["n_words"] for r in items.select("n_words").distinct().collect()]
    if not lengths:
        return None
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), hashes(words_of(F.col("text"))).alias("words"))
    cut = F.array(*(F.struct(F.lit(n).alias("n_words"), runs(F.col("words"), n).alias("runs")) for n in sorted(lengths)))
    places = hashed.select("doc_id", F.explode(cut).alias("c")).select("doc_id", "c.n_words", F.posexplode("c.runs").alias("first_word", "run"))
    met = places.join(broadcast_if_small(items), ["n_words", "run"]).groupBy("doc_id", "item_id", "n_words").agg(F.min("first_word").alias("first_word"))
    return met.select("doc_id", "item_id", "first_word", "n_words", F.lit(0).alias("distance"), F.lit(1.0).alias("similarity"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 22) -> DataFrame:
    """doc_id, item_id, first_word (from 0), n_words, distance and similarity: for each document and item the best window.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; both may have anything else. Words
    are lower-case runs of letters and digits. Items of fewer than ``words`` words are one
    shingle, found as they are. Of equal texts the smallest item_id stands for all; a document shorter than an item is a
    window as it is. Null and empty texts match nothing; rows with equal doc_id give one row for
    each item; empty tables give none.
    """
    items = written(prepared_items(benchmark, words), "benchmark-items")
    spread = items.select(F.posexplode("item_shingles").alias("offset", "shingle"), "n_words", "repeats", F.col("item_shingles").alias("own"))
    # per shingle and length, the items' shingles: whether the shingle before in the document is one of them
    known = spread.groupBy("shingle", "n_words").agg(F.collect_set(F.struct("repeats", "own")).alias("items"))
    known = broadcast_if_small(written(known, "benchmark-shingles"), 20_000)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("row"))
    hashed = rows.select("row", hashes(words_of(F.col("text"))).alias("words"))  # named: else lambdas compute it per element
    shingled = hashed.select("row", runs(F.col("words"), words).alias("shingles"))
    with_previous = F.arrays_zip(F.col("shingles").alias("shingle"), F.concat(F.array(F.lit(None).cast("long")), "shingles").alias("previous"))
    # the outer form: else Spark infers a filter that computes the shingles once more
    shared = shingled.select("row", with_previous.alias("zipped")).select("row", F.posexplode_outer("zipped").alias("at", "z"))
    shared = shared.select("row", "at", "z.shingle", "z.previous").join(known, "shingle")
    begins = F.exists("items", lambda i: i["repeats"] | F.col("previous").isNull() | ~F.array_contains(i["own"], F.col("previous")))
    found = shared.where(begins).groupBy("row").agg(F.collect_set(F.struct("at", "n_words")).alias("starts"))  # no more than a text has words
    held = rows.join(found, "row").select("doc_id", hashes(words_of(F.col("text"))).alias("words"), "starts")

    def window(start: Column) -> Column:
        first = F.greatest(F.least(start["at"], F.size("words") - start["n_words"]), F.lit(0))
        return F.struct(first.alias("first_word"), start["n_words"].alias("n_words"), F.slice("words", first + 1, start["n_words"]).alias("window"))

    windows = held.select("doc_id", F.explode_outer(F.transform("starts", window)).alias("w")).select("doc_id", "w.*")
    marked = windows.distinct().withColumn("fingerprint", simhash(F.col("window")))
    cut = marked.select("*", F.explode(blocks(F.col("fingerprint"), radius)).alias("block"))
    goal = items.select("item_id", "n_words", "item_shingles", "item_fingerprint", F.explode(blocks(F.col("item_fingerprint"), radius)).alias("block"))
    distance = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint")))
    near = cut.join(broadcast_if_small(written(goal, "benchmark-blocks"), 20_000), ["n_words", "block"]).withColumn("distance", distance).where(F.col("distance") <= radius)
    pairs = near.select("doc_id", "first_word", "n_words", "window", "item_id", "item_shingles", "distance").dropDuplicates(["doc_id", "first_word", "n_words", "item_id", "window"])
    pairs = pairs.withColumn("held", runs(F.col("window"), words))
    share = F.coalesce(held_weight(F.col("held"), F.col("item_shingles")) / F.size("item_shingles"), F.lit(0.0))
    good = pairs.withColumn("similarity", share).where(F.col("similarity") >= similarity)
    best = F.max_by(F.struct("first_word", "n_words", "distance", "similarity"), F.struct("similarity", -F.col("distance"), -F.col("first_word")))
    found = good.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")
    short = short_leaks(docs, benchmark, words)
    return found if short is None else found.union(short)


def clean_documents(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` whose own text holds no item; rows are told by doc_id and text, null and repeated ids included."""
    row = F.xxhash64("doc_id", "text")
    leaks = find_leaks(docs.select(row.alias("doc_id"), "text"), benchmark, **parameters)
    leaks = written(leaks.select(F.col("doc_id").alias("leaking")).distinct(), "leaking")
    return docs.join(broadcast_if_small(leaks), row == F.col("leaking"), "left_anti")
