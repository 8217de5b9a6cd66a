"""Operator 8: mix sources to target weights by repeating documents.

Sizes (words) are summed by source, sources get targets, and a document is taken floor(rate) times plus
one more copy with probability rate - floor(rate), where rate = target / size of its source. That
Bernoulli draw compares a number seeded by hash with the probability. The numbers of documents of
one source and similar size step evenly through [0, 1) from a hashed start (golden-ratio steps): each
is uniform by itself, and together they keep a source's total closer to its target than independent ones.

Everything is DataFrame code; the only numbers that reach the driver are two sums for each round of
sharing out the excess.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: Documents of one source and similar size are dealt into groups of about this many.
GROUP = 100_000
#: Up to so many sources (a name and four numbers each) their table is broadcast; beyond, it is joined.
BROADCAST_SOURCES = 20_000
GOLDEN = 0.6180339887498949


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_sizes(rows: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """source, source_size, n_docs, weight of rows with source and size.

    Weights repeat over the sources in code point order, null last. The order is found by ranges:
    places within a range plus the number of sources in the ranges before.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    ranged = written(
        sums.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()),
        "sources",
    )
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        ranged.groupBy("part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    turn = ((F.col("base") + F.col("place") - 1) % len(weights)).cast("int")
    return (
        ranged.withColumn("place", place)
        .join(F.broadcast(parts), "part")  # one row for each writing task
        .withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), turn + 1))
        .select("source", "source_size", "n_docs", "weight")
    )


def with_targets(sources: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds target: by weight, together `share` of all sizes, none above `most` times its source's size.

    Each round gives what the full sources leave to the others by weight; a level only rises, so a
    source that is full stays full, and the rounds end when no further one fills up.
    """
    cap = F.col("source_size") * F.lit(most)
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, open_weight = 0.0, -1.0
    while True:
        full = cap < F.lit(level) * F.col("weight")
        held, weight = sources.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
        ).first()
        if weight == open_weight:
            break
        open_weight = weight
        level = (share * total - held) / weight if weight else math.inf
    target = F.least(cap, F.lit(level) * F.col("weight"))
    return sources.withColumn("target", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(target))


def with_copies(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds source_size, target and copies to the rows of `_rows`.

    Rows that repeat a doc_id get draws of their own. A source without words is taken 0 times. Each draw by
    itself is uniform, so the chance of the extra copy is the fraction of the rate; draws of one group
    are not independent.
    """
    small = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    other = sources.select(F.col("source").alias("of_source"), "source_size", "n_docs", "target")
    joined = rows.join(
        F.broadcast(other) if small else other, F.col("source").eqNullSafe(F.col("of_source")), "left"
    )
    groups = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / GROUP))
    salt = F.pmod("spread", groups)
    stratum = F.concat_ws(
        "|", F.coalesce("source", F.lit("")), F.length(F.bin("size")).cast("string"), salt.cast("string")
    )
    start = F.conv(F.substring(F.md5("stratum"), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    rank = F.row_number().over(Window.partitionBy("source", "stratum").orderBy("size", "doc_id", "tie"))
    step = F.col("start") + F.col("rank") * F.lit(GOLDEN)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return (
        joined.withColumn("stratum", stratum)
        .withColumns({"rank": rank, "start": start, "rate": rate})
        .withColumn("draw", step - F.floor(step))
        .withColumn(
            "copies",
            F.floor("rate") + F.when(F.col("draw") < F.col("rate") - F.floor("rate"), 1).otherwise(0),
        )
        .drop("of_source", "n_docs", "spread", "stratum", "rank", "start", "rate", "draw")
    )


def _spread(documents: DataFrame) -> Column:
    """A number that deals documents evenly into groups: by a hash of the id, without one of the text."""
    known = F.coalesce(documents["doc_id"].cast("long").cast("string"), documents["text"], F.lit(""))
    return F.conv(F.substring(F.md5(known), 1, 8), 16, 10).cast("long").alias("spread")


def _rows(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        words(F.col("text")).alias("size"),
        F.xxhash64("text").alias("tie"),
        _spread(documents),
    )


def mix_table(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document.

    taken: words the mix takes, repeats counted. A null text has no words; a null source is a source
    of its own, ordered last. Repeated rows count each. An empty table gives an empty one.
    """
    rows = written(_rows(documents), "sizes")
    mixed = with_copies(rows, with_targets(source_sizes(rows)))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed(documents: DataFrame) -> DataFrame:
    """The documents with all their columns, each as often as the mix takes it.

    Draws are made on rows without texts, and met with the documents by id, source and text. Rows that agree in
    these are taken together as often as their draws say: each the fewest times that one of them is, and one
    of them for all the rest.
    """
    rows = written(_rows(documents), "sizes")
    keys = ["of_id", "of_source", "of_tie"]
    drawn = with_copies(rows, with_targets(source_sizes(rows))).select(
        F.col("doc_id").alias("of_id"), F.col("source").alias("of_source"), F.col("tie").alias("of_tie"), "copies"
    )
    counts = written(
        drawn.groupBy(*keys)
        .agg(F.min("copies").alias("each"), (F.sum("copies") - F.count("copies") * F.min("copies")).alias("rest"))
        .where("each > 0 OR rest > 0"),
        "copies",
    )
    found = documents.select(
        F.struct(*(documents[c] for c in documents.columns)).alias("document"),
        F.col("doc_id").cast("long").alias("id"), F.col("source").alias("from"), F.xxhash64("text").alias("tie"),
    )
    met = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(("id", "from", "tie"), keys, strict=True)]
    taken = found.join(counts.where("each > 0"), met).select("document", F.col("each").alias("copies"))
    more = counts.where("rest > 0")
    if not more.isEmpty():
        one = found.join(more, met).groupBy(*keys)
        one = one.agg(F.first("document").alias("document"), F.first("rest").alias("copies"))
        taken = taken.unionByName(one.select("document", "copies"))
    return taken.select(
        "document", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    ).select("document.*")
