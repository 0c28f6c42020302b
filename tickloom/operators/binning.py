"""Action-preserving binning: anchors every third tick, and the ordered actions between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import arrays, bits
from tickloom.operators import islands
from tickloom.operators.ticks import RATIO


def with_anchors(ticks: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``anchor`` marks every ``ratio``-th tick of a session and its last one."""
    last = F.max("idx").over(Window.partitionBy("session"))
    return ticks.withColumn("anchor", (F.col("idx") % ratio == 0) | (F.col("idx") == last))


def anchors(ticks: DataFrame, ratio: int = RATIO) -> DataFrame:
    return with_anchors(ticks, ratio).filter("anchor").drop("anchor")


def transition(idx: Column | str = "idx", ratio: int = RATIO) -> Column:
    """The transition that owns a tick's action: the first action of a session belongs to none."""
    c = F.col(idx) if isinstance(idx, str) else idx
    return F.floor((c - 1) / F.lit(float(ratio))).cast("long")


def transitions(ticks: DataFrame, action: str = "mask", ratio: int = RATIO, rate: float = 60.0) -> DataFrame:
    """A row per transition: ordered actions, how many, whether it is cut short, how long it lasts, and the
    actions and their mask at full width."""
    own = ticks.filter("idx >= 1").withColumn("transition", transition(ratio=ratio))
    listed = own.groupBy("session", "transition").agg(F.array_sort(F.collect_list(F.struct("idx", action))).alias("_a"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))
    out = listed.withColumn("actions", F.transform("_a", lambda s: s[action])).drop("_a")
    return out.select(
        "session",
        "transition",
        "first_idx",
        "last_idx",
        "actions",
        F.size("actions").cast("long").alias("steps"),
        (F.size("actions") < ratio).alias("partial"),
        (F.size("actions") / F.lit(rate)).alias("seconds"),
        arrays.padded("actions", ratio).alias("padded"),
        arrays.padding_mask("actions", ratio).alias("valid"),
    )


def flattened(binned: DataFrame) -> DataFrame:
    """The actions of transitions as ticks again; padding stays out."""
    flat = binned.select("session", "first_idx", F.posexplode("actions").alias("at", "action"))
    return flat.select("session", (F.col("first_idx") + F.col("at")).alias("idx"), "action")


def round_trip(ticks: DataFrame, action: str = "mask") -> DataFrame:
    """Per session, whether flattening its transitions gives its actions back, in order."""
    digest = lambda rows, name: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", rows))), lambda s: F.concat_ws(":", s["idx"].cast("string"), s[rows].cast("string"))), ","), 256).alias(name)
    source = ticks.filter("idx >= 1").groupBy("session").agg(digest(action, "source"))
    back = flattened(transitions(ticks, action)).groupBy("session").agg(digest("action", "back"))
    return source.join(back, "session", "full").select("session", F.col("source").eqNullSafe(F.col("back")).alias("round_trip"))


def manifest(ticks: DataFrame, action: str = "mask", ratio: int = RATIO) -> DataFrame:
    """Per session: ticks, anchors, transitions, partial ones, actions in and out."""
    marked = with_anchors(ticks, ratio).groupBy("session").agg(F.count("*").alias("ticks"), F.count_if("anchor").alias("anchors"))
    bins = transitions(ticks, action, ratio).groupBy("session").agg(F.count("*").alias("transitions"), F.count_if("partial").alias("partial"), F.sum("steps").alias("actions"))
    zero = ["transitions", "partial", "actions"]
    return marked.join(bins, "session", "left").fillna(0, zero)


def edges(ticks: DataFrame, mask: str = "mask", keys: tuple[str, ...] = ("session",)) -> DataFrame:
    """Bits pressed and released since the tick before; before the first tick, and after a tick at which the
    actor has no row, no bit is held."""
    order = Window.partitionBy(*keys).orderBy("idx")
    before = F.when(F.lag("idx").over(order) == F.col("idx") - 1, F.lag(mask).over(order))
    before = F.coalesce(before, F.lit(0))
    return ticks.withColumn("pressed", bits.pressed(before, mask)).withColumn("released", bits.released(before, mask))


def rising_counts(ticks: DataFrame, mask: str = "mask", ratio: int = RATIO) -> DataFrame:
    """Per session: bits that rise after its first tick, those that rise on anchors, and those lost."""
    marked = edges(with_anchors(ticks, ratio), mask).filter("idx >= 1")
    n = bits.popcount("pressed")
    counted = marked.groupBy("session").agg(F.sum(n).alias("rising"), F.sum(F.when(F.col("anchor"), n).otherwise(0)).alias("retained"))
    return counted.select("session", "rising", "retained", (F.col("rising") - F.col("retained")).alias("lost"))


def hidden_pulses(ticks: DataFrame, mask: str = "mask", bit_count: int = 32, ratio: int = RATIO) -> DataFrame:
    """Per session: presses that begin after the first tick and end before any anchor sees them."""
    marked = with_anchors(ticks, ratio)
    flat = marked.select("session", "idx", "anchor", F.posexplode(bits.unpacked(mask, bit_count)).alias("bit", "set"))
    runs = islands.runs(flat, ("session", "bit"), "idx", F.col("set") == 1, more=[F.bool_or("anchor").alias("seen")])
    hidden = runs.groupBy("session").agg(F.count_if((F.col("start") >= 1) & ~F.col("seen")).alias("hidden"))
    return ticks.select("session").distinct().join(hidden, "session", "left").fillna(0, ["hidden"])


def sampling_report(ticks: DataFrame, mask: str = "mask", bit_count: int = 32) -> DataFrame:
    """What plain sampling at the anchors would lose."""
    return rising_counts(ticks, mask).join(hidden_pulses(ticks, mask, bit_count), "session", "left").fillna(0, ["hidden"])


def interventions(binned: DataFrame, partner: str | None = None) -> DataFrame:
    """Changed actions for evaluation: those of the transition before (the last for the first), in reversed
    order, and, where a partner column is named, the partner's."""
    order = Window.partitionBy("session").orderBy("transition")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rolled = F.coalesce(F.lag("padded").over(order), F.last("padded").over(whole))
    out = binned.withColumn("rolled", rolled).withColumn("reversed", F.reverse("padded"))
    return out.withColumn("swapped", F.col(partner)) if partner else out


def shifted(rows: DataFrame, value: str, start, order: str = "transition", session: str = "session") -> DataFrame:
    """The value one step earlier; the first step has ``start``."""
    return rows.withColumn("past", F.lag(value, 1, start).over(Window.partitionBy(session).orderBy(order)))
