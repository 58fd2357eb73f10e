"""N-gram Jaccard join: documents whose sets of word n-grams are similar, and the groups they form.

Token-combination prefixes. The n-grams (tokens) of every set are put into one global order: the
rarest first, then by hash. How frequent tokens are is told by counters of all documents, in an array
whose size follows the number of documents up to a bound, so that it tells as much of more documents.
A set of n tokens shares all but e = n - ceil(t * n) with any partner, so

* if e + 1 rare tokens come first, these are its signatures, one by one;
* otherwise all its rare tokens are, and its prefix goes on over frequent tokens, which fall into
  ``CLASSES`` classes by hash, until rare tokens plus, in each class, tokens but one exceed e.
  Then partners share a rare token or two frequent ones of a class: the signatures are the pairs
  of tokens within a class.

Sets of up to ``SMALL`` tokens have too few for pairs: those and their possible partners also take
the first e + 1 tokens singly. ``set_join`` finds the candidates and compares them token by token.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm import hashing, set_join
from marketlens.llm.components import components
from marketlens.llm.storage import BROADCAST_ROWS, added_up, broadcast_if_small, sliced, written

#: Least and most counters for the frequency of tokens, powers of two; and how many a document gets.
SLOTS, MOST_SLOTS, SLOTS_EACH = 1 << 18, 1 << 22, 4
CLASSES = 32
#: Least words of 64 parity bits that are kept of a set.
PARITY_WORDS = 8
SMALL = 64
#: Sets of a frequent signature that the others meet in a round.
LEADERS = 64
MET, FEW = 64, 4


def slots_of(tokens: np.ndarray) -> np.ndarray:
    """The counter of each token among the most; fewer counters take its low bits."""
    return (tokens & np.uint64(MOST_SLOTS - 1)).astype(np.int64)


def slots_for(documents: int) -> int:
    """Counters for so many documents."""
    return min(MOST_SLOTS, max(SLOTS, 1 << (SLOTS_EACH * max(1, documents) - 1).bit_length()))


def ngram_sets(texts: pa.Array, words: int, rank: np.ndarray | None = None) -> Iterator[tuple[int, int, hashing.Sets]]:
    """(first row, end row, sets) of runs of texts, tokens in global order, or by hash if no ranks are given."""
    ranked = None if rank is None else lambda t: rank[slots_of(t) & (len(rank) - 1)]
    for first, end, data, offsets in hashing.chunks(texts):
        units = hashing.shingles(hashing.hashed_words(data, offsets), words)
        yield first, end, hashing.distinct(units, ranked)


def profiles(docs: DataFrame, words: int, slots: int) -> DataFrame:
    """doc_id, text_hash, size, key (null if empty) and parity bits of every document; and rows of counters of its tokens."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("size", pa.int32()), ("key", pa.int64()), ("parity", pa.binary()), ("slice", pa.int32()), ("counts", pa.binary())]
    )

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(slots, np.int64)
        for batch in batches:
            sizes, keys, bits = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
            for _, _, sets in ngram_sets(batch.column(1), words):
                sizes.append(sets.sizes)
                keys.append(hashing.set_keys(sets))
                bits += hashing.sized_parity(sets, PARITY_WORDS)
                np.add.at(counts, slots_of(sets.tokens) & (slots - 1), 1)
            size, n = np.concatenate(sizes), batch.num_rows
            key = pa.array(np.concatenate(keys), mask=size == 0)
            columns = [batch.column(0), batch.column(2), pa.array(size, pa.int32()), key, pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
        parts = sliced(counts)
        n = parts.num_rows
        yield pa.RecordBatch.from_arrays([*(pa.nulls(n, t) for t in schema.types[:5]), *parts.columns], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")).mapInArrow(
        profile, "doc_id long, text_hash long, size int, key long, parity binary, slice int, counts binary"
    )


def ranks_of(counts: np.ndarray | float) -> np.ndarray:
    """Ranks in steps of a sixteenth of a power of two, 0 for a count of one; the last is for all above."""
    return np.minimum(254, np.rint(16 * np.log2(np.maximum(counts, 1)))).astype(np.uint8)


def combinations(tokens: np.ndarray, missing: int) -> np.ndarray:
    """Pairs within a class of the shortest prefix that has ``missing`` tokens beyond the first of each class."""
    kind = ((tokens >> np.uint64(20)) % np.uint64(CLASSES)).astype(np.int64)
    order = np.argsort(kind, kind="stable")
    begin = np.searchsorted(kind[order], np.arange(CLASSES))
    nth = np.empty(len(tokens), np.int64)
    nth[order] = np.arange(len(tokens)) - begin[kind[order]]
    cut = int(np.searchsorted(np.cumsum(nth > 0), missing)) + 1
    out = [np.zeros(0, np.uint64)]
    for k in range(CLASSES):
        own = tokens[:cut][kind[:cut] == k]
        i, j = np.triu_indices(len(own), 1)
        out.append(hashing.mixed(own[i] * np.uint64(3) ^ hashing.mixed(own[j])))
    return np.concatenate(out)


def postings(docs: DataFrame, words: int, threshold: Fraction, rank: np.ndarray, frequent: int) -> DataFrame:
    """The signatures of every set; copies of a set that a task meets give them once.

    ``rank``: how frequent the tokens of each slot are, 0 for those that occur once, which match nothing; tokens
    of the rank ``frequent`` and above count as frequent.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(rank)
    num, den = threshold.numerator, threshold.denominator

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, sets in ngram_sets(batch.column(0), words, ranks.value):
                size, keys = sets.sizes, hashing.set_keys(sets)
                fresh = np.zeros(len(keys), bool)
                for i, key in enumerate(keys.tolist()):
                    if size[i] and key not in seen:
                        seen.add(key)
                        fresh[i] = True
                if len(seen) > 1_000_000:
                    seen.clear()
                owner, position = sets.owner, sets.position
                ranked = ranks.value[slots_of(sets.tokens) & (len(ranks.value) - 1)]
                often = ranked >= frequent
                rare = hashing.reduced(np.add, (~often).astype(np.int64), sets.starts)
                spare = size - set_join.least_overlap(size, threshold)
                # singly: rare tokens among the first e + 1, or any of them in small sets
                single = (position <= spare[owner]) & fresh[owner] & (~often | (size[owner] * num <= SMALL * den))
                at = np.flatnonzero(single & (ranked > 0))
                signature, unit, place = [sets.tokens[at]], [owner[at]], [position[at]]
                for i in np.flatnonzero(fresh & (size > SMALL) & (rare <= spare)):
                    pairs = combinations(sets.tokens[sets.starts[i] + rare[i] : sets.starts[i + 1]], int(spare[i] + 1 - rare[i]))
                    signature.append(pairs)
                    unit.append(np.full(len(pairs), i))
                    place.append(np.zeros(len(pairs), np.int64))
                signature, unit, place = np.concatenate(signature), np.concatenate(unit), np.concatenate(place)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signature.view(np.int64)),
                        pa.array(np.zeros(len(unit), np.int64)),
                        pa.array(keys[unit]),
                        pa.array(size[unit], pa.int32()),
                        pa.array(place, pa.int32()),
                        pa.array(hashing.parity(sets)[0].view(np.int64)[unit]),
                    ],
                    ["signature", "place", "key", "size", "position", "parity"],
                )

    return docs.select("text").mapInArrow(sign, set_join.POSTINGS)


def open_bearers(bearers: DataFrame, roots: DataFrame) -> DataFrame:
    """signature, key and root of the sets whose signature occurs in several groups. ``bearers``: signature, key.

    A signature of one group stays so, so the rows of one round serve the next.
    """
    grouped = written(bearers.join(roots, "key", "left").select("signature", "key", F.coalesce("root", "key").alias("root")), "ngram-bearers")
    spread = grouped.groupBy("signature").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return written(grouped.join(spread.select("signature"), "signature", "left_semi"), "ngram-bearers")


def similar_sets(docs: DataFrame, words: int, threshold: Fraction) -> tuple[DataFrame, DataFrame]:
    """(profiles of the documents, (key, root) of the sets that are linked)."""
    slots = slots_for(docs.count())
    both = written(profiles(docs, words, slots), "ngram-profiles")
    documents = both.where("slice is null").select("doc_id", "text_hash", "size", "key", "parity")
    # of every set its size, parity bits and one document
    one = F.min(F.struct("doc_id", "text_hash")).alias("text")
    sizes = written(documents.where("key is not null").groupBy("key").agg(F.any_value("size").alias("size"), F.first("parity").alias("parity"), one), "ngram-sets")
    counts = added_up(both.where("slice is not null").select("slice", "counts"), slots)
    rank = ranks_of(counts)
    # rare tokens alone would scatter the counters around the mean by its root
    frequent = int(ranks_of(counts.mean() + 6 * np.sqrt(counts.mean()) + 64)) + 1
    found = written(set_join.candidates(postings(docs, words, threshold, rank, frequent), threshold, set_join.RUN).distinct(), "ngram-candidates")
    pairs = found.where("frequent is null").select("a", "b")

    def check(candidates: DataFrame) -> DataFrame:
        """The written pairs that link."""
        keys = written(set_join.ends_of(candidates), "ngram-keys")
        wanted = set_join.key_filter(keys, "key")
        bearing = docs
        if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            keys = F.broadcast(keys)
            texts = sizes.join(keys, "key", "left_semi").select(F.col("text.doc_id").alias("id"), F.col("text.text_hash").alias("hash"))
            same = docs["doc_id"].cast("long").eqNullSafe(F.col("id")) & (F.xxhash64(docs["text"]) == F.col("hash"))
            bearing = docs.join(F.broadcast(texts), same, "left_semi")
        sets = set_join.token_sets(bearing.select("text"), lambda batch: (s for _, _, s in ngram_sets(batch.column(0), words)), wanted)
        return written(set_join.verified(candidates, sets.join(keys, "key", "left_semi"), threshold, candidates.count()), "ngram-links")

    # sets with a frequent signature were compared with one set only: now with a few of them, then with more of them that
    # are in other groups, as long as that halves the number of groups, and at last with all that are in other groups still
    bearers = found.where("frequent is not null").select(F.col("frequent").alias("signature"), F.col("a").alias("key"))
    frequent_ones = not bearers.isEmpty()
    if frequent_ones:
        pairs = written(pairs.union(set_join.leader_pairs(bearers.withColumn("root", F.col("key")))).distinct(), "ngram-candidates")
    roots = components(check(written(set_join.close_pairs(pairs, sizes, threshold, rows=pairs.count()), "ngram-candidates")))
    if frequent_ones:
        rest, draw, rounds = open_bearers(bearers, roots), 0, True
        groups = rest.select("root").distinct().count()
        if groups:
            own = sizes.join(broadcast_if_small(written(rest.select("key").distinct(), "ngram-keys")), "key", "left_semi")
            bits = written(set_join.folded_bits(own, PARITY_WORDS), "ngram-bits")
            # the bits of sets of about as many tokens are not folded: close_pairs has no more of them
            folded = own.where(F.length("parity") > 8 * PARITY_WORDS).count() > 0
        while groups:
            other = F.col("a.root") != F.col("b.root") if rounds else F.col("a.root") < F.col("b.root")
            more = set_join.open_pairs(rest.join(bits, "key"), PARITY_WORDS, threshold, other, LEADERS if rounds else None, draw)
            more = written(more, "ngram-candidates")
            if more.count():
                if folded:
                    more = written(set_join.close_pairs(more, sizes, threshold, rows=more.count()), "ngram-candidates")
                # groups are stars already
                roots = components(check(more).union(roots.select("key", "root")))
            if not rounds:
                break
            before, rest, draw = groups, open_bearers(rest.select("signature", "key"), roots), draw + 1
            groups = rest.select("root").distinct().count()
            rounds = 2 * groups < before
    return documents, roots


def link_documents(docs: DataFrame, words: int = 4, threshold: Fraction = Fraction(85, 100)) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text, anything else).

    A document's set holds its distinct runs of ``words`` words, or all its words as one run if
    they are fewer; two documents link if the Jaccard similarity of their sets is at least
    ``threshold``. component_id is the smallest doc_id that links reach. Null and empty texts have
    no shingles and stay alone; a null doc_id counts as larger than any other; repeated rows each
    get a row; an empty table gives an empty one.
    """
    documents, roots = similar_sets(docs, words, threshold)
    sets = documents.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first"))
    grouped = written(sets.join(roots, "key", "left").select("key", "first", F.coalesce("root", "key").alias("root")), "ngram-groups")
    first = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    component = written(grouped.join(first, "root").select("key", "component_id"), "ngram-components")
    return documents.join(component, "key", "left").select(
        "doc_id", F.col("size").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def keep_first(docs: DataFrame, words: int, threshold: Fraction) -> DataFrame:
    """Of each group of linked rows of ``docs`` the first by doc_id, null last, and by a hash of the text; of repeated rows one.

    Rows are told by doc_id and text together: those that share a doc_id, or have none, stay or go
    each by its own text. Null and empty texts link with nothing and stay.
    """
    documents, roots = similar_sets(docs, words, threshold)
    rows = documents.where("key is not null").select("key", F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "text_hash")
    place = F.struct("none", "id", "text_hash")
    sets = rows.groupBy("key").agg(F.min(place).alias("first"))
    grouped = written(sets.join(roots, "key", "left").select("key", "first", F.coalesce("root", "key").alias("root")), "ngram-groups")
    stays = written(grouped.join(grouped.groupBy("root").agg(F.min("first").alias("stays")), "root").select("key", "stays"), "ngram-components")
    own = written(rows.groupBy("key", "none", "id", "text_hash").count().join(stays, "key").select("id", "text_hash", "count", (place == F.col("stays")).alias("kept")), "ngram-rows")
    keyed = docs.withColumn("text_hash of row", F.xxhash64("text"))

    def listed(condition: str) -> tuple[DataFrame, Column]:
        some = broadcast_if_small(written(own.where(condition).select("id", "text_hash"), "ngram-copies"))
        return some, F.col("doc_id").cast("long").eqNullSafe(some["id"]) & (keyed["text_hash of row"] == some["text_hash"])

    kept = keyed.join(*listed("not kept"), "left_anti")
    again, same = listed("kept and count > 1")
    if not again.isEmpty():
        repeated = kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text_hash of row"])
        kept = kept.join(again, same, "left_anti").union(repeated)
    return kept.drop("text_hash of row")
