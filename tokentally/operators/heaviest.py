"""The heaviest keys, exactly, without shuffling every key.

Keys are dealt to a fixed number of buckets by hash, and weights summed by bucket: at most so many rows
leave a task, however many keys there are. No key weighs more than its bucket. The keys of the heaviest
buckets are counted first; the k-th of them is a bound that the answer reaches. Only the buckets that weigh
as much can hold a key of the answer, and only their keys are counted in full. Where that is most of the
data, as with keys of similar weight, all keys are counted the plain way.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
#: If more than this part of the buckets must be counted, all keys are.
PLAIN = 0.5


def _ranked(df: DataFrame, names: Sequence[str], weight: str) -> DataFrame:
    """Sums by key, heaviest first; ties by key, keys without any weight last."""
    sums = df.groupBy(*names).agg(F.sum(weight).alias(weight), F.count(F.lit(1)).alias("requests"))
    return sums.orderBy(F.desc_nulls_last(weight), *names)


def heaviest(
    df: DataFrame, names: Sequence[str], weight: str, k: int, buckets: int = BUCKETS, plain: float = PLAIN
) -> DataFrame:
    """The k keys (columns `names`) with the largest sum of `weight`, with that sum and the number of rows
    (`requests`), heaviest first; ties go to smaller keys, null ones first.

    Weights are whole numbers, none negative; the sum of a key is null if all of its weights are. Two jobs
    over narrow sums decide what is counted; the result is lazy.
    """
    rows = df.select(*names, weight, F.pmod(F.xxhash64(*names), F.lit(buckets)).cast("int").alias("bucket"))
    table = rows.groupBy("bucket").agg(F.sum(weight).alias("w")).toArrow().to_pydict()  # a row for each bucket
    by_weight = sorted(zip(table["bucket"], table["w"], strict=True), key=lambda r: -(r[1] or 0))
    few = [b for b, _ in by_weight[:k]]
    some = _ranked(rows.where(F.col("bucket").isin(few)), names, weight).limit(k).collect() if few else []
    if len(some) == k and some[-1][weight]:
        needed = [(b,) for b, w in by_weight if w is not None and w >= some[-1][weight]]
        if len(needed) <= plain * len(by_weight):  # keys are even over buckets, whatever they weigh
            # A table, so that the plan is the same for any number of buckets.
            chosen = df.sparkSession.createDataFrame(needed, "bucket int")
            rows = rows.join(F.broadcast(chosen), "bucket", "left_semi")  # BUCKETS numbers
    return _ranked(rows, names, weight).limit(k)
