"""Mixing sources to target weights: capped water-filling and seeded repetition.

The targets share a total by weight. A source whose share exceeds ``max_epochs`` times its size is
clamped there, and the excess goes to the others by weight, until none is above. Documents are then
repeated as often as their source's target asks: every one a whole number of times, and those that
come first in a seeded order once more, until the words of the source reach the rest of its target.
The order is by a seeded digest of doc_id, then by a digest of the text. The place where it is cut
is found by histograms of the order, refined until few rows or only equal ones are left, so that no
task sorts a source. Of equal rows at that place, as many are taken as the target asks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.ordering import numbered
from marketlens.llm.storage import broadcast_if_small, written

#: Bits of the order that one histogram resolves, and of each of its two digests.
BITS, DIGEST = 12, 60
#: Different rows of a source that are sorted to find where its order is cut.
SORTED = 1 << 14
#: Columns that ``mix`` adds.
ADDED = ("size", "source_size", "target", "repeats", "taken")


def word_count(text: Column) -> Column:
    """Runs of other than space and the control characters tab to carriage return; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def weighted_sources(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """source, source_size, its number and weight; the weights repeat over the sources by code point, null last."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("all", F.lit(0))
    placed = numbered(sources, "all", [F.col("source").asc_nulls_last()])
    sources = placed.select("source", "source_size", (F.col("pos") + 1).alias("no"))
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("no") - 1) % len(weights) + 1).cast("int")))


def water_filled(sources: DataFrame, max_epochs: int) -> DataFrame:
    """The sources with their target. Each round is one aggregate: words clamped, weight not clamped."""
    cap = F.col("source_size") * max_epochs
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    clamped, level = F.lit(False), None
    while True:
        row = sources.agg(
            F.coalesce(F.sum(F.when(clamped, cap)), F.lit(0)).alias("words"),
            F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0)).alias("weight"),
            F.sum(F.when(clamped, 1).otherwise(0)).alias("n"),
        ).first()
        if level is not None and row["n"] == before:
            break
        before = row["n"]
        level = (float(total - row["words"]) / float(row["weight"])) if row["weight"] else 0.0
        clamped = clamped | (F.col("weight") * F.lit(level) > cap)
    return sources.withColumn("target", F.when(clamped, cap.cast("double")).otherwise(F.col("weight") * F.lit(level)))


def bucket_of(level: int) -> Column:
    """Bucket of a row on a level of the histograms: the levels of ``order``, then those of ``tie``."""
    levels = DIGEST // BITS
    digest = "order" if level < levels else "tie"
    return F.shiftrightunsigned(digest, DIGEST - BITS * (level % levels + 1)).bitwiseAND((1 << BITS) - 1)


def cut_histogram(rows: DataFrame, level: int) -> DataFrame:
    """Per source, the bucket of this level in which the words reach ``rest``, the words before it and the rows in it."""
    sums = rows.withColumn("bucket", bucket_of(level)).groupBy("no", "rest", "bucket").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    upto = F.sum("words").over(Window.partitionBy("no").orderBy("bucket"))  # at most 2**BITS rows a source
    reached = sums.withColumn("upto", upto).where("upto >= rest")
    first = F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"), "n"))
    return reached.groupBy("no").agg(first.alias("cut")).select("no", "cut.*")


def cuts_of(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source (no), where its order is cut: all rows before (cut_order, cut_tie) are taken, and ``copies`` of the ``among`` rows there.

    ``rows``: no, rest (words to take), size, order and tie of the rows with words.
    """
    levels = DIGEST // BITS
    found = plan.select("no", F.lit(-1).cast("long").alias("order_from"), F.lit(0).cast("long").alias("tie_from"))
    for level in range(2 * levels):
        cut = written(cut_histogram(rows, level), "mix-cut")
        inside = rows.withColumn("own", bucket_of(level)).join(broadcast_if_small(cut), "no").where("own = bucket")
        rows = inside.select("no", (F.col("rest") - F.col("before")).alias("rest"), "size", "order", "tie")
        side = "order_from" if level < levels else "tie_from"
        start = F.greatest(F.col(side), F.lit(0)) + F.shiftleft(F.col("bucket"), DIGEST - BITS * (level % levels + 1))
        found = found.join(cut.select("no", "bucket"), "no", "left").withColumn(side, F.when(F.col("bucket").isNull(), F.col(side)).otherwise(start)).drop("bucket")
        if (cut.agg(F.max("n")).first()[0] or 0) <= SORTED:
            break
    # at most SORTED rows of a source are left, or rows that are alike: cut on the nearer side of the target
    alike = rows.groupBy("no", "rest", "order", "tie", "size").agg(F.count("*").alias("among"))
    upto = F.sum(F.col("among") * F.col("size")).over(Window.partitionBy("no").orderBy("order", "tie", "size"))
    fits = F.floor((F.col("rest") - upto) / F.col("size") + F.col("among") + 0.5)
    some = alike.withColumn("copies", F.least(fits, F.col("among"))).where("copies > 0")
    last = some.groupBy("no").agg(F.max(F.struct("order", "tie", "size", "copies", "among")).alias("last"))
    cut = found.join(last, "no", "left")
    place = [F.coalesce(F.col(f"last.{c}"), F.col(f"{c}_from")).alias(f"cut_{c}") for c in ("order", "tie")]
    numbers = [F.coalesce(F.col(f"last.{c}"), F.lit(0)).cast("long").alias(c) for c in ("copies", "among")]
    return cut.select("no", *place, *numbers)


def planned(docs: DataFrame, weights: tuple[int, ...], max_epochs: int, seed: str) -> DataFrame:
    """doc (all columns of a row of ``docs``), size, source_size, target and repeats."""
    # 60 bits of a digest: the same order in every run and every engine
    id_ = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    order, tie = (F.conv(F.substring(F.md5(x), 1, DIGEST // 4), 16, 10).cast("long") for x in (F.concat(F.lit(f"{seed}:"), id_), text))
    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    sized = docs.select(doc.alias("doc"), F.col("source"), word_count(F.col("text")).alias("size"), order.alias("order"), tie.alias("tie"))
    narrow = written(sized.select("source", "size", "order", "tie"), "mix-sizes")
    sources = water_filled(written(weighted_sources(narrow, weights), "mix-sources"), max_epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    rest = F.col("target") - whole * F.col("source_size")
    plan = written(sources.select("source", "no", "source_size", "target", whole.alias("whole"), rest.alias("rest")), "mix-plan")

    def with_plan(rows: DataFrame, columns: DataFrame) -> DataFrame:
        columns = broadcast_if_small(columns.withColumnRenamed("source", "plan_source"))
        return rows.join(columns, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")

    rows = with_plan(narrow.where("size > 0"), plan.select("source", "no", "rest").where("rest > 0"))
    cuts = written(plan.join(cuts_of(rows.select("no", "rest", "size", "order", "tie"), plan), "no"), "mix-cuts")
    here = (F.col("order") == F.col("cut_order")) & (F.col("tie") == F.col("cut_tie"))
    before = (F.col("order") < F.col("cut_order")) | ((F.col("order") == F.col("cut_order")) & (F.col("tie") < F.col("cut_tie")))
    sized = with_plan(sized, cuts)
    divided = (F.col("rest") > 0) & (F.col("size") > 0) & here & (F.col("copies") < F.col("among"))

    def counted(rows: DataFrame, more: Column) -> DataFrame:
        more = F.coalesce((F.col("rest") > 0) & more, F.lit(False))
        repeats = F.when(F.col("size") > 0, F.col("whole") + more.cast("long")).otherwise(0).cast("long")
        return rows.select("doc", "size", F.col("source_size").cast("long").alias("source_size"), "target", repeats.alias("repeats"))

    taken = before | (here & (F.col("copies") > 0))
    if cuts.where("rest > 0 and copies < among").isEmpty():
        return counted(sized, taken)
    # equal rows of which some are taken: numbered, without a window over them
    alike = numbered(sized.where(divided).drop("source"), "no", [])
    return counted(sized.where(~divided), taken).union(counted(alike, F.col("pos") < F.col("copies")))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` (doc_id, text, source, anything else) with size, source_size, target, repeats and taken.

    size is the number of words of the text, target that of its source, repeats how often the mix
    takes the document, taken its words in the mix. Documents without words are never taken; null
    is a source of its own, weighted last; rows that share a doc_id, or have none, are told by their
    text, and rows alike in both are documents of their own, of which the needed number is taken;
    an empty table gives an empty one. Columns of ``docs`` with the added names are replaced, any
    others kept, whatever they are called (``repeated`` keeps all). Taken words of a source differ
    from its target by at most half its largest document.
    """
    own = [F.col(f"doc.`{c}`") for c in docs.columns if c.lower() not in ADDED]
    rows = planned(docs, weights, max_epochs, seed)
    return rows.select(*own, "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def repeated(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with the columns of ``docs`` only."""
    rows = planned(docs, weights, max_epochs, seed).where("repeats > 0")
    return rows.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats")))).select("doc.*")
