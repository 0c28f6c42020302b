"""Deterministic splits, samples and assignments."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_unique(rows: DataFrame, content: str | Column, order: str) -> DataFrame:
    """Of rows with one content the first by order: ``content_key`` is its hash."""
    c = F.col(content) if isinstance(content, str) else content
    keyed = rows.withColumn("content_key", F.md5(c.cast("binary")))
    first = keyed.groupBy("content_key").agg(F.min(order).alias(order))
    return keyed.join(first, ["content_key", order], "left_semi")


def seeded_sample(rows: DataFrame, key: str, seed: int, most: int) -> DataFrame:
    """The first ``most`` rows by a hash of seed and key, numbered from 0."""
    drawn = rows.withColumn("draw", F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))).orderBy("draw", key).limit(most)
    return drawn.withColumn("target", F.row_number().over(Window.orderBy("draw", key)) - 1)


def group_holdout(rows: DataFrame, group: str, holdout: str | None = None, order: str | None = None) -> DataFrame:
    """``split``: eval for one whole group, else train. The group is the named one, or that of the greatest
    value of ``order``, the first by name on a tie."""
    if holdout is None:
        per = rows.groupBy(group).agg(F.max(order).alias("_m"))
        found = per.orderBy(F.desc("_m"), group).first()
        holdout = found[group] if found else None
    return rows.withColumn("split", F.when(F.col(group) == F.lit(holdout), "eval").otherwise("train"))


def head_tail(rows: DataFrame, train: int, evaluate: int, *order: str) -> DataFrame:
    """The first rows to train on and the last to evaluate on; they must not meet."""
    n = rows.count()
    if train + evaluate > n:
        raise ValueError(f"{train} + {evaluate} rows of {n}")
    head = rows.orderBy(*order).limit(train).withColumn("split", F.lit("train"))
    tail = rows.orderBy(*[F.desc(c) for c in order]).limit(evaluate).withColumn("split", F.lit("eval"))
    return head.unionByName(tail)


def strided(number: Column | str, world: int, workers: int) -> tuple[Column, Column]:
    """Rank and worker of a row number: dealt to ranks in turn, and within a rank to workers in turn."""
    c = F.col(number) if isinstance(number, str) else number
    return F.pmod(c, F.lit(world)), F.pmod(F.floor(c / world), F.lit(workers))


def slot(number: Column | str, slots: int) -> Column:
    c = F.col(number) if isinstance(number, str) else number
    return F.pmod(c, F.lit(slots))


def shuffled(rows: DataFrame, path: str, index: str, seed: int, epoch: int, cycle: int = 0) -> DataFrame:
    """``place``: a permutation of each path's rows that seed, epoch and cycle fix."""
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(epoch)), F.lit(str(cycle)), F.crc32(F.col(path).cast("binary")).cast("string"), F.col(index).cast("string")))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(path).orderBy(draw, index)) - 1)


def steps_per_epoch(clips: int, batch: int) -> tuple[int, int]:
    """Whole steps, and clips left over."""
    return clips // batch, clips % batch


def steps_per_epoch_of(clips: Column | str, batch: int) -> tuple[Column, Column]:
    """The same for a column."""
    c = F.col(clips) if isinstance(clips, str) else clips
    return F.floor(c / batch), F.pmod(c, F.lit(batch))


def lane_batch_of(remaining: Column | str, lanes: int, most: int = 100) -> Column:
    """:func:`lane_batch` for a column."""
    c = F.col(remaining) if isinstance(remaining, str) else remaining
    return F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(c / lanes))).cast("long")


def lane_batch(remaining: int, lanes: int, most: int = 100) -> int:
    return min(most, max(1, math.ceil(remaining / lanes)))


def seed_plan(rows: DataFrame, done: DataFrame, on: str, desired: int, *order: str) -> DataFrame:
    """The next rows that aren't done, as many as are desired in all; an error if there are too few."""
    have = done.select(on).distinct().count()
    need = max(0, desired - have)
    found = rows.join(done, on, "left_anti").orderBy(*order).limit(need)
    if found.count() < need:
        raise ValueError(f"fewer than {need} rows are left")
    return found
