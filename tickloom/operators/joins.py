"""Joins by key, place and interval, and the comparisons built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.sets import numbered


def latest_image_join(frames: DataFrame, images: DataFrame, key: str = "frame", order: str = "position") -> DataFrame:
    """Frames with their image, the last one where several share a frame; frames without one are left out."""
    rest = [c for c in images.columns if c != key]
    last = images.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, *[F.col("_r")[c].alias(c) for c in rest])
    return frames.join(last, key)


def by_place(left: DataFrame, right: DataFrame, left_order: tuple[str, ...], right_order: tuple[str, ...], keys: tuple[str, ...] = (), strict: bool = True) -> DataFrame:
    """The n-th row of one table with the n-th of the other, per key. Right rows beyond the left's are left
    out; if strict, a left row without a right one raises."""

    def place(df: DataFrame, order: tuple[str, ...]) -> DataFrame:
        if not keys:  # one order over all rows: numbered by range partitions
            return numbered(df, *order, name="place").withColumn("place", F.col("place") + 1)
        return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))

    other = place(right, right_order).withColumn("_found", F.lit(True))
    out = place(left, left_order).join(other, [*keys, "place"], "left" if strict else "inner")
    if strict:
        checked = F.when(F.col("_found"), F.col("place")).otherwise(F.raise_error(F.lit("fewer rows on the right than on the left")))
        out = out.withColumn("place", checked).filter("place IS NOT NULL")
    return out.drop("_found")


def enriched(rows: DataFrame, facts: DataFrame, on: list[str]) -> DataFrame:
    """All rows, with facts where there are any."""
    return rows.join(facts, on, "left")


def done_or_skipped(jobs: DataFrame, results: DataFrame, on: str, ok: Column, reason: str = "not available") -> DataFrame:
    """Jobs with ``status``: done where their result is ok, else skipped with a reason."""
    good = results.filter(ok).select(on).distinct().withColumn("_ok", F.lit(True))
    out = jobs.join(good, on, "left")
    return out.withColumn("status", F.when(F.col("_ok"), "done").otherwise("skipped")).withColumn("reason", F.when(F.col("_ok").isNull(), reason)).drop("_ok")


def stem_pairs(left: DataFrame, right: DataFrame, left_path: str, right_path: str) -> DataFrame:
    """Rows whose file names agree up to their first dot."""
    stem = lambda c: F.regexp_extract(c, r"([^/]*?)(?:\.[^/]*)?$", 1)
    return left.withColumn("stem", stem(left_path)).join(right.withColumn("stem", stem(right_path)), "stem")


def pending(jobs: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    return jobs.join(done, on, "left_anti")


def opponents(ticks: DataFrame, tick: list[str], actor: str, columns: list[str]) -> DataFrame:
    """Each actor's row with an ordered array of the others at its tick. A tick holds the few actors of one game;
    the array grows with their number, so it isn't for keys that many rows share."""
    one = F.struct(actor, *columns)
    others = F.filter(F.collect_list(one).over(Window.partitionBy(*tick)), lambda o: o[actor] != F.col(actor))
    return ticks.withColumn("opponents", F.array_sort(others))


def ordered_pairs(ticks: DataFrame, tick: list[str], slot: str, columns: list[str]) -> DataFrame:
    """One row per tick with the columns of slot 0 and slot 1 side by side; ticks without both are left out."""
    sides = [F.max(F.when(F.col(slot) == k, F.col(c))).alias(f"{c}_{k}") for c in columns for k in (0, 1)]
    both = ticks.groupBy(*tick).agg(*sides, F.count_distinct(F.when(F.col(slot).isin(0, 1), F.col(slot))).alias("_n"))
    return both.filter("_n = 2").drop("_n")


def in_intervals(ticks: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, ordinal: str, cell: int = 64) -> DataFrame:
    """Ticks inside an interval of their key, with the columns of the last such interval by ordinal.

    Both sides are cut into cells of ``cell`` ticks, so the join is on (key, cell) and a range test remains.
    """
    rest = [c for c in intervals.columns if c not in (key, start, end)]
    group = list(ticks.columns)
    own = ticks.groupBy(*group).agg(F.count("*").alias("_copies"))  # equal ticks meet the intervals once
    cells = F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor(F.col(end) / cell))).alias("_cell")
    spans = intervals.filter(F.col(start) <= F.col(end)).select(key, start, end, *rest, cells)
    found = own.withColumn("_cell", F.floor(F.col(at) / cell)).join(spans, [key, "_cell"]).filter(F.col(at).between(F.col(start), F.col(end)))
    last = found.groupBy(*group, "_copies").agg(F.max_by(F.struct(*rest), ordinal).alias("_r"))
    return last.select(*group, *[F.col("_r")[c].alias(c) for c in rest], F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int"))).alias("_copy")).drop("_copy")


def clip_actions(clips: DataFrame, actions: DataFrame, key: str = "session", first: str = "first_source", last: str = "last_source", frame: str = "frame", actors: int = 2) -> DataFrame:
    """Every source frame of each clip with its actions. A frame at which an actor is missing raises."""
    wanted = clips.select("*", F.explode(F.sequence(F.col(first), F.col(last))).alias(frame))
    there = actions.groupBy(key, frame).agg(F.array_sort(F.collect_list(F.struct(*[c for c in actions.columns if c not in (key, frame)]))).alias("actors"))
    out = wanted.join(there, [key, frame], "left")
    ok = F.coalesce(F.size("actors"), F.lit(0)) == actors
    return out.withColumn("actors", F.when(ok, F.col("actors")).otherwise(F.raise_error(F.concat(F.lit("an actor is missing at frame "), F.col(frame).cast("string")))))


def compared(left: DataFrame, right: DataFrame, on: str, value: str) -> DataFrame:
    """Names whose values differ between two tables, or that only one has: ``left_value, right_value, verdict``."""
    a = left.select(on, F.col(value).alias("left_value"), F.lit(True).alias("_l"))
    b = right.select(on, F.col(value).alias("right_value"), F.lit(True).alias("_r"))
    both = a.join(b, on, "full")
    verdict = F.when(F.col("_r").isNull(), "missing").when(F.col("_l").isNull(), "unexpected").when(~F.col("left_value").eqNullSafe(F.col("right_value")), "different")
    return both.withColumn("verdict", verdict).filter("verdict IS NOT NULL").drop("_l", "_r")


def unpaired(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left rows without a partner; none are expected."""
    return left.join(right, on, "left_anti")


def matching(jobs: DataFrame, markers: DataFrame, on: list[str]) -> DataFrame:
    """Jobs with a marker that agrees on all the named columns, nulls included."""
    m = markers.select(*[F.col(c).alias(f"_{c}") for c in on]).distinct()
    test = F.lit(True)
    for c in on:
        test = test & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return jobs.join(m, test, "left_semi")
