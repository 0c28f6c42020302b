"""Windows over ordered rows: clips, chunks, strides, deltas and averages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import numbers


def clips(sessions: DataFrame, frames: int, stride: int, n: str = "n", offset: int = 0, cap: int | None = None, strict: bool = False) -> DataFrame:
    """``clip, first, last``: windows of ``frames`` at steps of ``stride`` from ``offset``; ``cap`` bounds the
    clips of one session."""
    count = numbers.clip_count(F.col(n) - offset, frames, stride, strict)
    count = count if cap is None else F.least(count, F.lit(cap))
    each = sessions.withColumn("_clips", count).filter("_clips > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_clips") - 1)).alias("clip"))
    first = F.col("clip") * stride + offset
    return each.withColumn("first", first).withColumn("last", first + frames - 1).drop("_clips")


def chunks(ranges: DataFrame, size: int, first: str = "first", last: str = "last", step: int = 3) -> DataFrame:
    """A range in chunks of at most ``size``, which is a multiple of ``step``."""
    if size < step or size % step:
        raise ValueError(f"chunk size {size} isn't a multiple of {step}")
    each = ranges.select("*", F.explode(F.sequence(F.col(first), F.col(last), F.lit(size).cast("long"))).alias("chunk_first"))
    return each.withColumn("chunk_last", F.least(F.col(last), F.col("chunk_first") + size - 1))


def moving(rows: DataFrame, value: str, width: int, keys: tuple[str, ...] = ("session",), order: str = "idx") -> DataFrame:
    """Mean, least and greatest of the last ``width`` rows; rows before the first full window are left out."""
    along = Window.partitionBy(*keys).orderBy(order)
    frame = along.rowsBetween(1 - width, 0)
    out = rows.withColumn("_n", F.count("*").over(frame)).withColumn("mean", F.avg(value).over(frame)).withColumn("low", F.min(value).over(frame)).withColumn("high", F.max(value).over(frame))
    return out.filter(F.col("_n") == width).drop("_n")


def microsteps(rows: DataFrame, value: str, keys: tuple[str, ...] = ("session",), order: str = "idx", ratio: int = 3) -> DataFrame:
    """Mean, first and last of each transition's steps."""
    own = rows.filter(F.col(order) >= 1).withColumn("transition", F.floor((F.col(order) - 1) / F.lit(float(ratio))).cast("long"))
    return own.groupBy(*keys, "transition").agg(F.avg(value).alias("mean"), F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))


def deltas(rows: DataFrame, value: str, keys: tuple[str, ...] = ("session",), order: str = "idx", modulus: int = 256) -> DataFrame:
    """Difference to the row before: by exclusive-or, and by subtraction modulo ``modulus``; the first row
    differs from 0."""
    before = F.coalesce(F.lag(value).over(Window.partitionBy(*keys).orderBy(order)), F.lit(0))
    return rows.withColumn("xor", F.col(value).bitwiseXOR(before)).withColumn("difference", F.pmod(F.col(value) - before, F.lit(modulus)))


def prefix_fill(rows: DataFrame, size: str, cap: int, order: tuple[str, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """The longest prefix whose sizes sum to ``cap`` at most; the first row always goes in."""
    along = Window.partitionBy(*keys).orderBy(*order)
    filled = rows.withColumn("filled", F.sum(size).over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_rn", F.row_number().over(along))
    return filled.filter((F.col("filled") <= cap) | (F.col("_rn") == 1)).drop("_rn")


def every_third_and_last(n: int, step: int = 3) -> list[int]:
    """Places of the grid of ``n`` rows, and the last one where it is off the grid; checked by count."""
    found = sorted({*range(0, n, step), n - 1}) if n else []
    expected = (n - 1) // step + 1 + ((n - 1) % step > 0) if n else 0
    if len(found) != expected:
        raise ValueError(f"{len(found)} places, not {expected}")
    return found


def ema(rows: DataFrame, value: str, decay: float, start: float = 0.0, keys: tuple[str, ...] = ("session",), order: str = "idx") -> DataFrame:
    """Exponential average of each key's ordered values, from ``start``."""
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, F.col(value).cast("double").alias("v")))).alias("_a"))
    folded = F.aggregate("_a", F.lit(float(start)), lambda a, s: F.lit(decay) * a + F.lit(1 - decay) * s["v"])
    return listed.select(*keys, folded.alias("ema"))


def unbiased_ema(rows: DataFrame, value: str, decay: float, keys: tuple[str, ...] = ("session",), order: str = "idx") -> DataFrame:
    """Average with the weights' own sum as denominator: ``n = n * decay + 1``, ``a += (x - a) / n``."""
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, F.col(value).cast("double").alias("v")))).alias("_a"))
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("a"))

    def step(s, x):
        n = s["n"] * F.lit(decay) + 1
        return F.struct(n.alias("n"), (s["a"] + (x["v"] - s["a"]) / n).alias("a"))

    return listed.select(*keys, F.aggregate("_a", zero, step, lambda s: s["a"]).alias("ema"))


def stratified(rows: DataFrame, k: int, order: tuple[str, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """``k`` evenly spaced rows of each key, both ends included."""
    from tickloom.functions.arrays import spread
    from tickloom.operators.sets import numbered

    if keys:
        ranked = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
        ranked = ranked.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)).cast("int"))
        return ranked.filter(F.array_contains(spread("_n", k), F.col("_i"))).drop("_i", "_n")
    n = rows.count()
    places = F.array_contains(spread(F.lit(n), k), F.col("_i").cast("int")) if n else F.lit(False)
    return numbered(rows, *order, name="_i").filter(places).drop("_i")
