"""Runs of ticks: maximal stretches in which a predicate or a value holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.sets import numbered

#: Whether a missing tick ends a run, or the run goes on to the next tick there is.
GAP_POLICIES = ("break", "extend")


def _runs(rows: DataFrame, keys: tuple[str, ...], order: str, starts: Column) -> DataFrame:
    along = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_start", starts.cast("int")).withColumn("_run", F.sum("_start").over(along))


def runs(rows: DataFrame, keys: tuple[str, ...], order: str, flag: Column, least: int = 1, gap_policy: str = "extend", more: list[Column] | None = None) -> DataFrame:
    """Runs of rows for which ``flag`` holds: ``start, end, length`` and any further aggregates. The end is the
    tick before the first one that breaks the run under ``extend``, and a missing tick breaks it under
    ``break``. Runs shorter than ``least`` are left out."""
    if gap_policy not in GAP_POLICIES:
        raise ValueError(f"gap policy {gap_policy} isn't one of {GAP_POLICIES}")
    along = Window.partitionBy(*keys).orderBy(order)
    flagged = rows.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    breaks = ~F.col("_flag") | ~F.coalesce(F.lag("_flag").over(along), F.lit(False))
    if gap_policy == "break":
        breaks = breaks | (F.col(order) - F.lag(order).over(along) > 1)
    marked = _runs(flagged.withColumn("_next", F.lead(order).over(along)), keys, order, breaks)
    if gap_policy == "extend":
        stop = F.max(F.coalesce(F.col("_next") - 1, F.col(order)))
    else:
        stop = F.max(order)
    found = marked.filter("_flag").groupBy(*keys, "_run").agg(F.min(order).alias("start"), stop.alias("end"), F.count("*").alias("rows"), *(more or []))
    return found.drop("_run").withColumn("length", F.col("end") - F.col("start") + 1).filter(F.col("length") >= least)


def value_runs(rows: DataFrame, keys: tuple[str, ...], order: str, value: str, least: int = 1) -> DataFrame:
    """Runs of rows with one value, null being a value: ``value, start, end, length``."""
    along = Window.partitionBy(*keys).orderBy(order)
    first = F.row_number().over(along) == 1
    marked = _runs(rows, keys, order, first | ~F.col(value).eqNullSafe(F.lag(value).over(along)))
    found = marked.groupBy(*keys, "_run").agg(F.first(value).alias("value"), F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("length"))
    return found.drop("_run").filter(F.col("length") >= least)


def ranged_runs(rows: DataFrame, order: str, flag: Column, width: int = 4096) -> DataFrame:
    """Runs over the whole table, where a missing number breaks one: ``start, end, length``. Runs are found within
    ranges of ``width`` numbers, and those that touch over a border are joined: of each range only its runs at its
    borders, two at most, are looked at together, so no task sees all rows."""
    own = rows.withColumn("_range", F.floor(F.col(order) / width))
    inner = runs(own, ("_range",), order, flag, gap_policy="break")
    low, high = F.col("_range") * width, F.col("_range") * width + width - 1
    edge = (F.col("start") == low) | (F.col("end") == high)
    closed = inner.filter(~edge).select("start", "end")
    ends = inner.filter(edge).select("start", "end")
    # A chain of touching runs: a start that no end precedes, up to the next end that no start follows.
    firsts = ends.join(ends.select((F.col("end") + 1).alias("start")), "start", "left_anti").select(F.col("start").alias("at"), F.lit(0).alias("kind"))
    lasts = ends.join(ends.select((F.col("start") - 1).alias("end")), "end", "left_anti").select(F.col("end").alias("at"), F.lit(1).alias("kind"))
    places = numbered(firsts.unionAll(lasts), "at", "kind", name="_place").withColumn("_pair", F.floor(F.col("_place") / 2))
    joined = places.groupBy("_pair").agg(F.min("at").alias("start"), F.max("at").alias("end")).select("start", "end")
    return closed.unionAll(joined).withColumn("length", F.col("end") - F.col("start") + 1)


def joint(rows: DataFrame, keys: tuple[str, ...], order: str, flag: Column, actors: int | None = None) -> DataFrame:
    """One row per tick with ``all_hold``: whether the flag holds for every actor there (and all are there)."""
    held = F.bool_and(F.coalesce(flag, F.lit(False)))
    return rows.groupBy(*keys, order).agg((held if actors is None else held & (F.count("*") == actors)).alias("all_hold"))


def still(ticks: DataFrame, keys: tuple[str, ...] = ("session", "player"), order: str = "frame", waiting: int = 14, button_mask: int = 0x0FF0, stick: float = 0.15, move: float = 0.03) -> DataFrame:
    """``still``: waiting on the ground with neutral inputs, and hardly moved since the last tick there is."""
    along = Window.partitionBy(*keys).orderBy(order)
    moved = lambda c: F.abs(F.col(c) - F.lag(c).over(along)) < move
    sticks = [F.abs(F.coalesce(c, F.lit(0.0))) < stick for c in ("stick_x", "stick_y", "cstick_x", "cstick_y")]
    calm = (F.col("state") == waiting) & ~F.col("airborne") & (F.col("buttons").bitwiseAND(F.lit(button_mask)) == 0)
    for s in [*sticks, moved("x"), moved("y")]:
        calm = calm & s
    return ticks.withColumn("still", F.coalesce(calm, F.lit(False)))


def jumps(ticks: DataFrame, value: str, keys: tuple[str, ...] = ("session",), order: str = "idx", attributed: Column | None = None) -> DataFrame:
    """Ticks at which a value rises, and whose cause (if asked for) is present at the tick."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    out = ticks.withColumn("before", before).filter(F.col(value) > F.col("before"))
    return out if attributed is None else out.filter(attributed)


def taken(objects: DataFrame, keys: tuple[str, ...], order: str, owner: str, most: int = 3) -> DataFrame:
    """Rows at which an object that nobody owned has an owner of ``0..most``."""
    before = F.lag(owner).over(Window.partitionBy(*keys).orderBy(order))
    begun = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) > 1
    free = before.isNull() | (before < 0)
    return objects.withColumn("_t", begun & free & F.col(owner).between(0, most)).filter("_t").drop("_t")


def transitions(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], value: str) -> DataFrame:
    """Rows at which a value changes, with the one before."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("before", before).filter(F.col("before").isNotNull() & ~F.col("before").eqNullSafe(F.col(value)))


def object_spans(objects: DataFrame, keys: tuple[str, ...] = ("session", "spawn"), order: str = "frame", owner: str = "owner", kind: str = "kind") -> DataFrame:
    """Per object: kind, first and last tick, its owners, and how often it was taken."""
    picks = taken(objects, keys, order, owner).groupBy(*keys).agg(F.count("*").alias("pickups"))
    spans = objects.groupBy(*keys).agg(F.min_by(kind, order).alias(kind), F.min(order).alias("first"), F.max(order).alias("last"), F.array_sort(F.collect_set(owner)).alias("owners"))
    return spans.join(picks, list(keys), "left").fillna(0, ["pickups"])


def changed_spans(pixels: DataFrame, keys: tuple[str, ...] = ("frame", "row"), order: str = "col", value: str = "value", before: str = "before") -> DataFrame:
    """Stretches of a row at which a value differs from the frame before."""
    return runs(pixels, keys, order, F.col(value) != F.col(before), gap_policy="break")


def changed_tiles(pixels: DataFrame, tile: int, value: str = "value", before: str = "before") -> DataFrame:
    """Tiles of a fixed grid in which any value differs from the frame before."""
    tiles = pixels.groupBy("frame", F.floor(F.col("col") / tile).alias("tile_x"), F.floor(F.col("row") / tile).alias("tile_y"))
    return tiles.agg(F.bool_or(F.col(value) != F.col(before)).alias("changed")).filter("changed").drop("changed")
