"""Operator 1: token ids of documents in ORC files, in document order.

Each row holds doc_id, the ids with an end id, their number, and its place in the file's range. ORC stores the ids with integer
run-length encoding; row indexes and a Bloom filter on doc_id let readers skip stripes and row groups,
and stripes are read in parallel. Documents are dealt by ranges of doc_id and a hash of the text, so each
file holds a range, the files are in ascending order, and an id that very many rows share (or null) is
split over several. Texts, not ids, go through that one shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_folder
from .groups import BATCH_BYTES, settings
from .pieces import encoder

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: Documents whose ids a task holds at once, and bytes of the batches of texts it gets them in.
ROWS = 500
BATCH = 4 << 20

# Options of the ORC writer.
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.stripe.size": str(16 << 20),
    "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def tokenized(documents: DataFrame, vocabulary: str | None = None, end: int = END_ID) -> DataFrame:
    """doc_id, ids, n_tokens, place of every document, sorted by doc_id within ranges of it.

    place: number of the row in its range, from 0. A null or empty text has the end id only. A null
    doc_id sorts first. Repeated rows stay, rows with one doc_id in the order of their texts' hashes.
    Other columns are dropped.
    """
    name = vocabulary or VOCABULARY

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, place = encoder(public_tokenizers.path(name)), 0
        try:
            for batch in batches:
                for k in range(0, batch.num_rows, ROWS):
                    docs, texts = batch.slice(k, ROWS).columns
                    ids = own.encode(texts, end)
                    sizes = pa.array(np.diff(ids.offsets.to_numpy()).astype(np.int64))
                    places = pa.array(np.arange(place, place + len(docs)))
                    place += len(docs)
                    yield pa.RecordBatch.from_arrays([docs, ids, sizes, places], ["doc_id", "ids", "n_tokens", "place"])
        finally:
            own.forget()

    return (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie", "text")
        .select("doc_id", "text")
        .mapInArrow(encode, "doc_id long, ids array<int>, n_tokens long, place long")
    )


def write_tokens(tokens: DataFrame, path: str) -> None:
    """Write token rows as ORC, with the number of the writing task as a column `shard`."""
    tokens.withColumn("shard", F.spark_partition_id()).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Token rows of a folder; bounds on doc_id are checked against files, stripes and row groups."""
    rows = spark.read.schema("doc_id long, ids array<int>, n_tokens long, place long, shard int").orc(path)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    return rows


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(1)
        values = ids.values.to_numpy().view("<u4")
        places = ids.offsets.to_numpy()
        crcs = [zlib.crc32(values[a:b]) for a, b in zip(places[:-1], places[1:], strict=True)]
        counts = pa.array(np.diff(places).astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), batch.column(3), counts, pa.array(crcs, pa.int64())],
            ["doc_id", "shard", "place", "n_tokens", "ids_crc32"],
        )


def token_index(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of stored token rows.

    start: ids of all documents before it, in the order of the files. It is summed within each file's
    range, by place, and added to the sum of the ranges before, of which there is one row for each file.
    """
    rows = tokens.select("doc_id", "ids", "shard", "place").mapInArrow(
        _digests, "doc_id long, shard int, place long, n_tokens long, ids_crc32 long"
    )
    order = Window.partitionBy("shard").orderBy("place")
    within = F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = (
        tokens.groupBy("shard")
        .agg(F.sum("n_tokens").alias("total"))
        .select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    )
    return (
        rows.withColumn("within", F.coalesce(within, F.lit(0)))
        .join(F.broadcast(shards), "shard")  # one row for each file
        .select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
    )


def tokens_through_files(documents: DataFrame) -> DataFrame:
    """Encode, write in the shared folder, read back, and index what the files hold."""
    spark = documents.sparkSession
    path = shared_folder(spark, "tokens")
    with settings(spark, {BATCH_BYTES: str(BATCH)}):
        write_tokens(tokenized(documents), path)
    return token_index(read_tokens(spark, path))
