"""Contiguous, byte-balanced shards from global prefix sums.

Rows are put in order of doc_id by a range partitioning, each partition sums its own bytes in a stream, the
partition totals give every partition its start, and equal cuts of the whole give the shards. Only one row
per partition reaches the driver.

Law ``bytes``: a row belongs to the shard in which the middle of its bytes falls, so that shard sizes differ
from the target by half a row at each end. Defined cases: a null text has size 1; rows of one doc_id lie side
by side in order of size and checksum; a null doc_id comes first; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import cut, prepare, renamed

SHARDS = 16


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32``: UTF-8 bytes plus one, and the unsigned checksum of the bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = renamed(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return kept.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and bytes of this partition before each row."""
    rows = total = 0
    for b in batches:
        size = b.column(1).to_numpy(zero_copy_only=False)
        before = total + np.cumsum(size) - size
        at = rows + np.arange(len(size))
        rows, total = rows + len(size), total + int(size.sum())
        arrays = [*b.columns, pa.array(before.astype(np.int64)), pa.array(at.astype(np.int64))]
        yield pa.record_batch(arrays, names=[*b.schema.names, "before", "at"])


def byte_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: slots count from 0 in each shard, in order of doc_id."""
    spark = docs.sparkSession
    prepare(spark)
    stored = cut(measured(docs, id_col, text_col), "sizes")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows that agree in all are told apart by their place in the stored table, so that a repeated id, or none, splits.
    order = ["doc_id", "size", "text_crc32", "tie"]
    ranged = stored.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order).drop("tie").withColumn("part", F.spark_partition_id())
    fields = "doc_id long, size long, text_crc32 long, part int, before long, at long"
    summed = cut(ranged.mapInArrow(_running, fields), "prefixes")
    totals = summed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).orderBy("part").collect()
    starts, rows, total = [], 0, 0
    for r in totals:  # one row per partition
        starts.append((r["part"], rows, total))
        rows, total = rows + r["rows"], total + r["bytes"]
    first = F.broadcast(spark.createDataFrame(starts, "part int, rows0 long, bytes0 long").coalesce(1))
    middle = F.col("bytes0") + F.col("before") + F.floor((F.col("size") - 1) / 2)
    cuts = [F.lit(-(-total * k // shards)) for k in range(1, shards)]
    shard = sum(((middle >= c).cast("int") for c in cuts), F.lit(0))
    placed = summed.join(first, "part").select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), (F.col("rows0") + F.col("at")).alias("global"))
    begins = F.broadcast(placed.groupBy("shard").agg(F.min("global").alias("begin")))  # one row per shard
    return placed.join(begins, "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("global") - F.col("begin")).alias("slot"))
