"""Streams of events: reading, event-time windows, and sinks that commit each batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from tickloom.plans.commit import commit


def read(spark: SparkSession, path: str, schema: StructType, form: str = "parquet", files_per_trigger: int = 64) -> DataFrame:
    """New files of a folder; the checkpoint knows those that were read. Back-pressure is the number of files
    that one trigger takes."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(form).load(path)


def watermarked(events: DataFrame, late: str | None, at: str = "ts") -> DataFrame:
    """The events with a watermark, if one is asked for; times without a zone are taken as the session's."""
    if not late:
        return events
    timed = events.withColumn(at, F.col(at).cast("timestamp")) if dict(events.dtypes)[at] == "timestamp_ntz" else events
    return timed.withWatermark(at, late)


def tumbling(events: DataFrame, width: str, late: str | None = None, at: str = "ts", *keys: str) -> DataFrame:
    """Counts and sums per window of event time."""
    own = watermarked(events, late, at)
    found = own.groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("window.start").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, width: str, slide: str, late: str | None = None, at: str = "ts", *keys: str) -> DataFrame:
    own = watermarked(events, late, at)
    found = own.groupBy(F.window(at, width, slide), *keys).agg(F.count("*").alias("n"))
    return found.select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, gap: str, key: str, late: str | None = None, at: str = "ts") -> DataFrame:
    own = watermarked(events, late, at)
    found = own.groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"))
    return found.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def count_windows(ticks: DataFrame, ratio: int = 3, tick: str = "tick", session: str = "session") -> DataFrame:
    """Windows of ``ratio`` ticks by number, with how many ticks are missing from, or repeated in, each."""
    own = ticks.withColumn("step", F.floor(F.col(tick) / F.lit(float(ratio))).cast("long"))
    found = own.groupBy(session, "step").agg(F.count("*").alias("_n"), F.count_distinct(tick).alias("_d"))
    return found.select(session, "step", F.col("_d").alias("ticks"), (F.lit(ratio) - F.col("_d")).alias("missing"), (F.col("_n") - F.col("_d")).alias("repeated"))


def deduplicated(events: DataFrame, keys: list[str], late: str, at: str = "ts") -> DataFrame:
    return watermarked(events, late, at).dropDuplicatesWithinWatermark(keys)


def write_committed(stream: DataFrame, path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Each micro-batch is written and then committed under its number, so a batch that is run again after a
    failure is written once. The query drains what there is and ends."""

    def one(df: DataFrame, number: int) -> None:
        commit(df.sparkSession, prepare(df) if prepare else df, path, str(number))

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_append(stream: DataFrame, path: str, checkpoint: str, interval: str | None = None, form: str = "parquet") -> StreamingQuery:
    """Append to files, at an interval or until what there is has been read."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return stream.writeStream.format(form).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger).start()
