"""Operator 3: url rules by a cascade of Bloom filters.

Level 1 encodes the listed keys; level 2 the keys of the corpus that level 1 takes for listed though
they are not; level 3 the listed keys that level 2 takes for such; and so on until nobody is taken
wrongly. As the levels are built over every key of the corpus, looking a key up in them is exact: no
join of pages with the list, and no false positive. The levels take a few bits for each listed key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import written
from .texts import constants, mix

#: Bits of one level, at most; longer lists are dealt into shards of keys, looked up one after another.
MOST_BITS = 1 << 28
#: Levels halve what is taken wrongly; so many are never needed unless two keys share 128 bits.
MOST_LEVELS = 96

_SALTS = constants(71, 2 * MOST_LEVELS)
_U = np.uint64


@dataclass(frozen=True)
class Level:
    """One Bloom filter: `hashes` bits of a table of 64-bit words for each key."""

    number: int
    bits: int
    hashes: int
    words: np.ndarray | None = None

    def places(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The bits of each key, whose 128-bit hash is given as two columns."""
        first = mix(one.view(_U) ^ _SALTS[2 * self.number])
        step = mix(two.view(_U) ^ _SALTS[2 * self.number + 1]) | _U(1)
        return (first[:, None] + np.arange(self.hashes, dtype=_U)[None, :] * step[:, None]) % _U(self.bits)

    def holds(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        at = self.places(one, two)
        return ((self.words[at >> _U(6)] >> (at & _U(63))) & _U(1)).all(axis=1)


def level_of(number: int, keys: int, wrong: float) -> Level:
    """The size of a level for so many keys and so large a share of wrong answers."""
    bits = max(64, math.ceil(keys * math.log2(1 / wrong) / math.log(2)))
    return Level(number, bits, max(1, round(bits / max(1, keys) * math.log(2))))


def _filled(keys: DataFrame, level: Level) -> Level:
    """The level with the bits of all keys: tasks set bits, and equal words are or-ed by Spark."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(level.places(*(c.to_numpy().view(_U) for c in batch.columns)))
            values = _U(1) << (at & _U(63))
            word, first = np.unique(at >> _U(6), return_index=True)
            merged = np.bitwise_or.reduceat(values, first) if len(at) else values
            yield pa.RecordBatch.from_arrays(
                [pa.array(word.astype(np.int64)), pa.array(merged.view(np.int64))], ["word", "bits"]
            )

    rows = keys.select("one", "two").mapInArrow(bits, "word long, bits long")
    table = rows.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # MOST_BITS / 64 rows at most
    words = np.zeros(-(-level.bits // 64), dtype=_U)
    words[table["word"].to_numpy()] = table["bits"].to_numpy().view(_U)
    return Level(level.number, level.bits, level.hashes, words)


def listed(levels: Sequence[Level], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether each key of the corpus is listed: the first level that does not hold it decides."""
    open_ = np.arange(len(one))
    result = np.zeros(len(one), dtype=bool)
    for level in levels:
        held = level.holds(one[open_], two[open_])
        result[open_[~held]] = level.number % 2 == 1
        open_ = open_[held]
    result[open_] = len(levels) % 2 == 1
    return result


def _holding(keys: DataFrame, level: Level) -> DataFrame:
    """The keys that a level holds."""
    shared = keys.sparkSession.sparkContext.broadcast(level)  # MOST_BITS at most

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (c.to_numpy() for c in batch.columns)
            yield batch.filter(pa.array(shared.value.holds(one, two)))

    return keys.select("one", "two").mapInArrow(scan, "one long, two long")


def build(corpus: DataFrame, wanted: DataFrame) -> list[Level]:
    """The levels that tell wanted keys from all others of the corpus; both hold distinct (one, two)."""
    wanted = written(wanted.select("one", "two"), "wanted")
    n_wanted, n_corpus = wanted.count(), corpus.count()
    levels: list[Level] = []
    if not n_wanted:
        return levels
    first = min(0.5, math.sqrt(0.5) * n_wanted / max(1, n_corpus))
    level = _filled(wanted, level_of(0, n_wanted, first))
    levels.append(level)
    inside = wanted
    outside = written(_holding(corpus, level).join(wanted, ["one", "two"], "left_anti"), "taken")
    while outside.limit(1).count():
        if len(levels) >= MOST_LEVELS:
            raise ValueError("two different keys have the same hash of 128 bits")
        level = _filled(outside, level_of(len(levels), outside.count(), 0.5))
        levels.append(level)
        inside, outside = outside, written(_holding(inside, level), "taken")
    return levels


def key_hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit(71), key)


# The rules of the url query, host and path in one, and their verdicts.
RULES = (
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
)
#: The verdict of a url whose keys are all unlisted.
UNLISTED = "allow"

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty without `://`."""
    host = F.coalesce(F.regexp_extract(url, _URL, 1), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _url_keys(host: str, path: str, lengths: Sequence[int]) -> Column:
    """Every host + path beginning that a rule for this url can have, longest first, then longest host."""
    labels = F.split(F.col(host), r"\.", -1)
    hosts = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")
    )
    fitting = F.filter(F.array(*(F.lit(n) for n in lengths)), lambda n: n <= F.length(path))
    keys = F.flatten(
        F.transform(
            hosts,
            lambda h: F.transform(
                fitting,
                lambda n: F.struct(
                    (-F.length(h) - n).alias("order"),
                    (-F.length(h)).alias("host_order"),
                    F.concat(h, F.substr(F.col(path), F.lit(1), n)).alias("key"),
                ),
            ),
        )
    )
    return F.transform(F.array_sort(keys), lambda k: k.key)


def judge(pages: DataFrame, rules: DataFrame, unlisted: str = UNLISTED) -> DataFrame:
    """page_id, host, path, rule, verdict of every page by rules (rule, verdict: block or allow).

    A rule `host/path` fits its host and all subdomains if the url's path starts with its path. The
    longest fitting rule decides, of equally long ones that with the longer host; without one, `rule`
    is null and the verdict is `unlisted`. A null url has empty host and path. Repeated rows stay. A
    rule given twice counts as block if any of them does. Null rules are ignored.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    rules = (
        rules.where("rule is not null")
        .groupBy("rule")
        .agg(F.max(F.col("verdict") == "block").alias("block"))
        .select("rule", F.coalesce("block", F.lit(False)).alias("block"))
        .withColumns(dict(zip(("one", "two"), key_hashes(F.col("rule")), strict=True)))
    )
    rules = written(rules, "rules")
    rule_path = F.when(F.instr("rule", "/") > 0, F.length("rule") - F.instr("rule", "/") + 1).otherwise(0)
    lengths = sorted(r[0] for r in rules.select(rule_path.cast("int")).distinct().collect())  # url lengths
    if not lengths:
        none = F.lit(None).cast("string")
        return urls.withColumns({"rule": none, "verdict": F.lit(unlisted)})
    keys = _url_keys("host", "path", lengths)
    one, two = key_hashes(F.col("key"))
    corpus = written(
        urls.select("host", "path").distinct().select(F.explode(keys).alias("key")).select(
            one.alias("one"), two.alias("two")
        ).distinct(),
        "keys",
    )
    # The bound on bits holds for each shard, as a level takes 1.45 bits for a key and halving.
    shards = max(1, math.ceil(rules.count() * 64 / MOST_BITS))
    result = urls.withColumn("keys", keys).select(
        "page_id", "host", "path", "keys",
        F.transform("keys", lambda k: key_hashes(k)[0]).alias("ones"),
        F.transform("keys", lambda k: key_hashes(k)[1]).alias("twos"),
        F.lit(None).cast("int").alias("place"), F.lit(None).cast("boolean").alias("block"),
    )
    for shard in range(shards):
        own = F.pmod("one", F.lit(shards)) == shard
        of_rules, of_corpus = rules.where(own), corpus.where(own)
        known = build(of_corpus, of_rules)
        blocked = build(of_rules, of_rules.where("block"))
        result = _looked_up(spark, result, known, blocked, shard, shards)
    verdict = F.when(F.col("place").isNull(), unlisted).when(F.col("block"), "block").otherwise("allow")
    return result.select(
        "page_id", "host", "path", F.get("keys", F.col("place")).alias("rule"), verdict.alias("verdict")
    )


def _looked_up(
    spark: SparkSession, urls: DataFrame, known: list[Level], blocked: list[Level], shard: int, shards: int
) -> DataFrame:
    """Fills in the place of each url's first listed key and whether that one blocks."""
    shared = spark.sparkContext.broadcast((known, blocked))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, blocked = shared.value
        for batch in batches:
            ones, twos = batch.column(4), batch.column(5)
            bounds = ones.offsets.to_numpy()
            one = ones.values.to_numpy()[bounds[0] : bounds[-1]]
            two = twos.values.to_numpy()[bounds[0] : bounds[-1]]
            bounds = bounds - bounds[0]
            mine = one % shards == shard
            hit = np.zeros(len(one), dtype=bool)
            hit[mine] = listed(known, one[mine], two[mine])
            at = np.flatnonzero(hit)
            first = np.searchsorted(at, bounds[:-1])
            found = np.append(at, len(one))[first]
            some = found < bounds[1:]
            block = np.zeros(batch.num_rows, dtype=bool)
            block[some] = listed(blocked, one[found[some]], two[found[some]])
            place = (found - bounds[:-1]).astype(np.int32)
            old = batch.column(6).fill_null(1 << 30).to_numpy()
            better = some & (place < old)
            place = pa.array(np.where(better, place, old), mask=~better & (old == 1 << 30))
            was = batch.column(7).fill_null(False).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:6], place, pa.array(np.where(better, block, was))], batch.schema.names
            )

    return urls.mapInArrow(scan, urls.schema)


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule string, verdict string")
