"""Ticks: ordered rows of a session, and the checks on their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The first playable source frame.
FIRST_PLAYABLE = -39
RATIO = 3


def from_events(events: DataFrame) -> DataFrame:
    """The driver's events as ticks: a session per user, in order of time. ``mask`` is the key in ``props``."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(
        F.col("user_id").alias("session"),
        (F.row_number().over(order) - 1).cast("long").alias("idx"),
        "event_id",
        "ts",
        F.get_json_object("props", "$.k").cast("long").alias("mask"),
        F.col("value").alias("x"),
        F.col("event_type").alias("state"),
    )


def integer_ratio(source_rate: int, target_rate: int) -> int:
    """How many ticks make one step; only 60 to 20 is taken."""
    if source_rate <= 0 or target_rate <= 0 or source_rate % target_rate:
        raise ValueError(f"{source_rate} isn't a multiple of {target_rate}")
    if source_rate // target_rate != RATIO:
        raise ValueError(f"the ratio must be {RATIO}, not {source_rate // target_rate}")
    return RATIO


def contiguity(ticks: DataFrame, index: str = "idx", session: str = "session") -> DataFrame:
    """Per session: its ticks, and how many don't follow the tick before by one."""
    order = Window.partitionBy(session).orderBy(index)
    gap = F.coalesce(F.col(index) - F.lag(index).over(order) != 1, F.lit(False))
    return ticks.select(session, gap.alias("gap")).groupBy(session).agg(F.count("*").alias("n"), F.count_if("gap").alias("gaps"))


def contiguous(ticks: DataFrame, index: str = "idx", session: str = "session") -> DataFrame:
    """The ticks themselves; a gap raises when its row is read."""
    order = Window.partitionBy(session).orderBy(index)
    ok = F.coalesce(F.col(index) - F.lag(index).over(order) == 1, F.lit(True))
    checked = F.when(ok, F.col(index)).otherwise(F.raise_error(F.concat(F.lit("gap before "), F.col(index).cast("string"))))
    return ticks.withColumn("_checked", checked).filter(F.col("_checked").isNotNull()).drop("_checked")


def playable(ticks: DataFrame, frame: str = "frame", first: int = FIRST_PLAYABLE) -> DataFrame:
    return ticks.filter(F.col(frame) >= first)


def complete(ticks: DataFrame, actors: int = 2, keys: tuple[str, ...] = ("session", "frame"), present: Column | None = None) -> DataFrame:
    """Ticks at which all actors have a row (and, if given, ``present``)."""
    seen = F.count("*") if present is None else F.count_if(present)
    return ticks.join(ticks.groupBy(*keys).agg(seen.alias("_n")).filter(F.col("_n") == actors).select(*keys), list(keys), "left_semi")


def completeness(ticks: DataFrame, occupied: Column, complete_row: Column, by: str = "session") -> DataFrame:
    """Empty, occupied, complete and skipped rows, per session."""
    return ticks.groupBy(by).agg(
        F.count_if(~occupied).alias("empty"),
        F.count_if(occupied).alias("occupied"),
        F.count_if(occupied & complete_row).alias("complete"),
        F.count_if(occupied & ~complete_row).alias("skipped"),
    )


def sampled(frame: Column | str, first: int = FIRST_PLAYABLE, ratio: int = RATIO) -> Column:
    """Whether a source frame is on the sampling grid; holds for negative frames too."""
    c = F.col(frame) if isinstance(frame, str) else frame
    return F.pmod(c - first, F.lit(ratio)) == 0


def actor_rows(ticks: DataFrame, leader: str = "leader", follower: str = "follower") -> DataFrame:
    """One row per actor from rows that hold a leader and a follower; absent actors have none."""
    entries = F.array(F.struct(F.lit(False).alias("is_follower"), F.col(leader).alias("actor")), F.struct(F.lit(True).alias("is_follower"), F.col(follower).alias("actor")))
    rest = [c for c in ticks.columns if c not in (leader, follower)]
    return ticks.select(*rest, F.inline(F.filter(entries, lambda e: e["actor"].isNotNull())))


def monotone(rows: DataFrame, frame: str = "frame", order: str = "position", session: str = "session") -> DataFrame:
    """Rows whose frame exceeds all before it, with ``advance``, the step since the last one kept."""
    seen = F.max(frame).over(Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    kept = rows.withColumn("_seen", seen).filter(F.col("_seen").isNull() | (F.col(frame) > F.col("_seen")))
    return kept.withColumn("advance", F.coalesce(F.col(frame) - F.col("_seen"), F.lit(1))).drop("_seen")


def without_repeats(rows: DataFrame, frame: str = "frame", order: str = "position", session: str = "session") -> DataFrame:
    """Rows whose frame differs from that of the row before."""
    before = F.lag(frame).over(Window.partitionBy(session).orderBy(order))
    first = F.row_number().over(Window.partitionBy(session).orderBy(order)) == 1
    return rows.withColumn("_new", first | ~F.col(frame).eqNullSafe(before)).filter("_new").drop("_new")


def last_update(rows: DataFrame, keys: tuple[str, ...] = ("session", "frame", "player"), order: str = "position") -> DataFrame:
    """Of several updates for a key the last one."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])
