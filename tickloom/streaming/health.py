"""Stateful rules: heartbeats, stalls, deferral, and frames that only move on.

Each rule is a function on one key's ordered rows and its state, run by ``applyInPandasWithState``; the batch
form applies the same rule to a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.workers import ship

STALE_SECONDS = 90
MISSES = 2


def advancing(stream: DataFrame, key: str = "session", frame: str = "frame", order: str = "position") -> DataFrame:
    """Rows of which the frame exceeds all before it, over micro-batches; ``advance`` is the step."""
    ship(stream.sparkSession)

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = []
        for r in pd.concat(list(frames)).sort_values(order).itertuples():
            f = int(getattr(r, frame))
            if last is None or f > last:
                rows.append((k[0], f, 1 if last is None else f - last))
                last = f
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(rows, columns=["session", "frame", "advance"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(run, f"session {kind}, frame long, advance long", "last long", "append", GroupStateTimeout.NoTimeout)


def silent_nodes(stream: DataFrame, key: str = "node", at: str = "ts", stale: int = STALE_SECONDS) -> DataFrame:
    """``node, state, misses``: alive with each beat, and, by processing time, unknown after one silent span and
    dead after two."""
    ship(stream.sparkSession)

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            misses = state.get[0] + 1
            name = "dead" if misses >= MISSES else "unknown"
            if name == "dead":
                state.remove()
            else:
                state.update((misses,))
                state.setTimeoutDuration(stale * 1000)
        else:
            for _ in frames:
                pass
            misses, name = 0, "alive"
            state.update((0,))
            state.setTimeoutDuration(stale * 1000)
        yield pd.DataFrame([(k[0], name, misses)], columns=["node", "state", "misses"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(run, f"node {kind}, state string, misses long", "misses long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def node_states(beats: DataFrame, now, key: str = "node", at: str = "ts", stale: int = STALE_SECONDS) -> DataFrame:
    """The same from a table of beats, at one time."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.max(at))
    found = beats.groupBy(key).agg(age.alias("age"))
    misses = F.floor(F.col("age") / stale)
    return found.select(key, "age", F.when(misses < 1, "alive").when(misses < MISSES, "unknown").otherwise("dead").alias("state"))


def stalled(progress: DataFrame, now, seconds: int, least_frame: int, key: str = "job", at: str = "ts", frame: str = "frame") -> DataFrame:
    """Jobs past ``least_frame`` whose frame hasn't risen for so many seconds."""
    high = F.max(frame).over(Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
    rose = progress.withColumn("_h", high).filter(F.col("_h").isNull() | (F.col(frame) > F.col("_h")))
    last = rose.groupBy(key).agg(F.max(at).alias("since"), F.max(frame).alias("frame"))
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("since")
    return last.filter((F.col("frame") >= least_frame) & (age >= seconds))


def deferred(failures: DataFrame, cooldown: float, most_cycles: int, key: str = "job", at: str = "ts") -> DataFrame:
    """Per job its failures, the next time it may run (cooldowns double), and whether it has failed too often."""
    found = failures.groupBy(key).agg(F.count("*").alias("cycles"), F.max(at).alias("last"))
    wait = F.lit(float(cooldown)) * F.pow(F.lit(2.0), F.col("cycles") - 1)
    return found.select(key, "cycles", F.timestamp_seconds(F.unix_timestamp("last") + wait).alias("next_attempt_at"), (F.col("cycles") >= most_cycles).alias("given_up"))
