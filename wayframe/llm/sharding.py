"""Contiguous shards of near-equal bytes by global prefix sums.

Rows become narrow (id, size, checksum) before the only large shuffle, a range
partitioning by id. Each partition yields one total; the totals' prefix sums give
every partition its place in the whole, a running sum inside the partition gives
every row its place, and equal targets cut the line. The sorted narrow rows are
checkpointed, so totals and rows always come from the same partitions even when
executors are lost in between.

Defined cases: null text has no bytes; every row counts one byte more, so rows
without text spread evenly; null ids sort first; rows with equal ids sort by size
and checksum, and rows equal in all three are interchangeable; extra columns are
ignored; an empty table gives an empty result; shards that no row's middle falls
into stay empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, shuffle_partitions

#: Narrow rows of one range partition, of about 40 bytes each.
ROWS_PER_PART = 2_000_000


def _placed(totals: dict[int, tuple[int, int]], shards: int, total: int):
    """Adds each row's shard and global place; ``totals``: bytes and rows before each partition."""

    def run(batches):
        start = row = None
        # the least doubled middle of each shard but the first, in exact integers
        cuts = np.array([-(-2 * total * k // shards) for k in range(1, shards)], dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            if start is None:
                start, row = totals[batch.column("part")[0].as_py()]
            sizes = batch.column("size").to_numpy(zero_copy_only=False)
            ends = start + np.cumsum(sizes)
            # the middle of the row decides
            shard = np.searchsorted(cuts, 2 * ends - sizes, side="right").astype(np.int32)
            places = row + np.arange(len(sizes), dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("size"), batch.column("text_crc32"), pa.array(shard), pa.array(places)],
                names=["doc_id", "size", "text_crc32", "shard", "place"],
            )
            start, row = int(ends[-1]), row + len(sizes)

    return run


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` with shards contiguous in id order."""
    spark = docs.sparkSession
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    parts = max(shuffle_partitions(spark), -(-docs.count() // rows_per_part))
    keys = ["doc_id", "size", "text_crc32"]
    ordered = narrow.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    ordered = checkpointed(ordered)
    # one row per partition
    found = ordered.groupBy("part").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    before, total, count = {}, 0, 0
    for r in found:
        before[r.part] = (total, count)
        total, count = total + r.b, count + r.n
    schema = "doc_id long, size long, text_crc32 long, shard int, place long"
    placed = ordered.mapInArrow(_placed(before, shards, max(total, 1)), schema)
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))  # at most ``shards`` rows
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))
