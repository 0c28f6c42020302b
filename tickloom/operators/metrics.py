"""Metrics: interval aggregates, binned losses, effects of interventions, and coverage of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.sets import running


def intervals(steps: DataFrame, value: str, width: int, step: str = "step", keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean, population deviation, least and greatest value per interval of ``width`` steps."""
    own = steps.withColumn("interval", F.floor(F.col(step) / F.lit(float(width))).cast("long"))
    return own.groupBy(*keys, "interval").agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high")
    )


def half_open_bins(rows: DataFrame, t: str, value: str, bins: int = 5) -> DataFrame:
    """Mean value per bin ``[low, high)`` of a time in 0..1; a time of 1 is in no bin, an empty bin is null."""
    own = rows.filter((F.col(t) >= 0) & (F.col(t) < 1)).withColumn("bin", F.floor(F.col(t) * bins).cast("long"))
    return _every_bin(own, value, bins)


def right_closed_bins(rows: DataFrame, t: str, value: str, bins: int = 5) -> DataFrame:
    """Mean value per bin ``(low, high]``; the first bin holds 0 and the last has no end."""
    edges = [k / bins for k in range(1, bins)]
    at = F.lit(bins - 1)
    for k in reversed(range(bins - 1)):
        at = F.when(F.col(t) <= edges[k], k).otherwise(at)
    return _every_bin(rows.withColumn("bin", at.cast("long")), value, bins)


def _every_bin(own: DataFrame, value: str, bins: int) -> DataFrame:
    every = own.sparkSession.range(bins).select(F.col("id").alias("bin"))
    found = own.groupBy("bin").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return every.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean")


def weighted_mean(rows: DataFrame, value: str, weight: str, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0))).alias("mean"))


def reduced(rows: DataFrame, key: str, how: dict[str, str]) -> DataFrame:
    """Values of several ranks as one: by ``sum, min, max`` or ``avg``."""
    kinds = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}
    return rows.groupBy(key).agg(*[kinds[kind](c).alias(c) for c, kind in how.items()])


def effects(rows: DataFrame, value: str, group: str, control, *keys: str) -> DataFrame:
    """Mean per group and how far it lies from the control group's."""
    per = rows.groupBy(*keys, group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    base = F.max(F.when(F.col(group) == control, F.col("mean"))).over(Window.partitionBy(*keys))
    return per.withColumn("delta", F.col("mean") - base)


def change_shares(rows: DataFrame, features: list[str], keys: tuple[str, ...] = ("session", "transition"), step: str = "microstep", actor: str = "player") -> DataFrame:
    """Shares of changes at each level: of features, of steps, of actors, and of whole transitions."""
    along = Window.partitionBy(*[k for k in keys if k != "transition"], actor).orderBy("transition", step)
    flags = [F.coalesce(~F.col(c).eqNullSafe(F.lag(c).over(along)) & F.lag("transition").over(along).isNotNull(), F.lit(False)) for c in features]
    each = rows.withColumn("_f", F.array(*flags))
    each = each.withColumn("_any", F.exists("_f", lambda x: x)).withColumn("_share", F.aggregate("_f", F.lit(0.0), lambda a, x: a + x.cast("double")) / len(features))
    actors = each.groupBy(*keys, actor).agg(F.avg("_share").alias("features"), F.avg(F.col("_any").cast("double")).alias("steps"), F.bool_or("_any").alias("_any"))
    whole = actors.groupBy(*keys).agg(F.avg("features").alias("features"), F.avg("steps").alias("steps"), F.avg(F.col("_any").cast("double")).alias("actors"), F.bool_or("_any").alias("_any"))
    return whole.agg(F.avg("features").alias("features"), F.avg("steps").alias("steps"), F.avg("actors").alias("actors"), F.avg(F.col("_any").cast("double")).alias("transitions"))


def seen_samples(rows: DataFrame, sample: str, step: str = "step", total: int | None = None) -> DataFrame:
    """Per step, how many samples were first met by then, and the share of all."""
    first = rows.groupBy(sample).agg(F.min(step).alias(step)).groupBy(step).agg(F.count("*").alias("new"))
    steps = rows.select(step).distinct().join(first, step, "left").fillna(0, ["new"])
    out = running(steps, [step], "_before", "new").withColumn("seen", F.col("_before") + F.col("new")).drop("_before")
    return out if total is None else out.withColumn("share", F.col("seen") / F.lit(float(total)))


def best_so_far(rows: DataFrame, value: str, step: str = "step", keys: tuple[str, ...] = ()) -> DataFrame:
    along = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("best", F.min(value).over(along))


def throughput(rows: DataFrame, width: int, clips: str = "clips", seconds: str = "seconds", wait: str = "wait", step: str = "step") -> DataFrame:
    """Clips per second and waits per interval; the mean wait both per step and per clip, as both are in use."""
    own = rows.withColumn("interval", F.floor(F.col(step) / F.lit(float(width))).cast("long"))
    return own.groupBy("interval").agg(
        (F.sum(clips) / F.nullif(F.sum(seconds), F.lit(0.0))).alias("clips_per_second"),
        F.max(wait).alias("wait_max"),
        (F.sum(wait) / F.count("*")).alias("wait_per_step"),
        (F.sum(wait) / F.nullif(F.sum(clips), F.lit(0))).alias("wait_per_clip"),
    )


def ratio_summary(rows: DataFrame, key: str, **flags: Column) -> DataFrame:
    """Per key: rows, and for each flag its count and share, the denominator being 1 at least."""
    counts = [F.count_if(c).alias(n) for n, c in flags.items()]
    shares = [(F.count_if(c) / F.greatest(F.lit(1), F.count("*"))).alias(f"{n}_share") for n, c in flags.items()]
    return rows.groupBy(key).agg(F.count("*").alias("n"), *counts, *shares)
