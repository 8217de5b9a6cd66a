"""Many name patterns at once.

A pattern without its wildcards has pieces that a name must hold. One short run of characters (a gram) of its
longest piece stands for the pattern: the one that fewest patterns share. Names meet patterns in an
equi-join on grams, and LIKE decides on these candidates only. So the plan is the same for any number of
patterns, and the work follows the names and patterns that share something.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a gram; shorter pieces are grams themselves.
GRAM = 8


def _grams(text: Column, size: Column) -> Column:
    """All runs of so many characters."""
    last = F.char_length(text) - size + 1
    every = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda at: F.substr(text, at, size))
    return F.when(last >= 1, every).otherwise(F.array().cast("array<string>"))


def indexed(patterns: DataFrame) -> DataFrame:
    """pattern, gram of the distinct patterns that are not null; a pattern of wildcards only has gram ""."""
    pieces = F.transform(F.split("pattern", "[%_]"), lambda p: F.struct(F.char_length(p).alias("size"), p.alias("piece")))
    longest = F.array_max(pieces)
    size = F.least(longest["size"], F.lit(GRAM))
    of = patterns.select("pattern").where("pattern IS NOT NULL").distinct()
    of = of.withColumn("longest", longest["piece"]).withColumn("size", size)
    grams = of.select(
        "pattern",
        F.explode(F.when(F.col("size") == 0, F.array(F.lit(""))).otherwise(F.array_distinct(_grams(F.col("longest"), F.col("size"))))).alias("gram"),
    )
    shared = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = F.min_by("gram", F.struct("n", "gram")).alias("gram")
    return grams.join(shared, "gram").groupBy("pattern").agg(rarest)


def matches(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """name, pattern of every distinct name that holds a pattern; `_` and `%` are wildcards, as in `by_arn`."""
    index = indexed(patterns)
    # At most GRAM + 1 numbers.
    sizes = sorted(r[0] for r in index.select(F.char_length("gram")).distinct().collect())
    runs = [F.array(F.lit("")) if size == 0 else _grams(F.col("name"), F.lit(size)) for size in sizes]
    own = names.select("name").where("name IS NOT NULL").distinct()
    if not runs:
        return own.withColumn("pattern", F.lit(None).cast("string")).where(F.lit(False))
    met = own.select("name", F.explode(F.array_distinct(F.flatten(F.array(*runs)))).alias("gram")).join(index, "gram")
    open_ended = F.concat(F.lit("%"), F.replace("pattern", F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    return met.withColumn("like", open_ended).where("name LIKE like").select("name", "pattern")
