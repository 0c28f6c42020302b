"""Coverage: how often keys occur, and how many sessions and actors support them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import bins


def counts(rows: DataFrame, *keys: str, amount: Column | None = None) -> DataFrame:
    """Rows, or the sum of ``amount``, per key; most first, then by key."""
    n = F.count("*") if amount is None else F.sum(amount)
    return rows.groupBy(*keys).agg(n.alias("n")).orderBy(F.desc("n"), *keys)


def support(rows: DataFrame, key: str = "key", session: str = "session", actor: str | None = "actor", approximate: bool = False) -> DataFrame:
    """Per key: rows, distinct sessions, distinct (session, actor); the last is null for keys without actors."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    named = F.when(F.col(actor).isNotNull(), F.struct(session, actor)) if actor else F.lit(None)
    agg = [F.count("*").alias("rows"), distinct(session).alias("sessions")]
    agg.append(F.nullif(distinct(named), F.lit(0)).alias("actors") if actor else F.lit(None).cast("long").alias("actors"))
    return rows.groupBy(key).agg(*agg).orderBy(F.desc("rows"), key)


def key_families(rows: DataFrame, families: dict[str, Column], keep: tuple[str, ...] = ("session", "actor")) -> DataFrame:
    """Each row once per family, under the key ``family=value``; a null value has no key."""
    keys = F.array(*[F.when(c.isNotNull(), F.concat(F.lit(f"{name}="), c.cast("string"))) for name, c in families.items()])
    return rows.select(*keep, F.explode(F.array_compact(keys)).alias("key"))


def grouped_support(rows: DataFrame, dims: list[str], sets: list[list[str]], session: str, day: Column) -> DataFrame:
    """The same for several sets of columns at once."""
    return rows.withColumn("_day", day).groupingSets(sets, *dims).agg(F.count("*").alias("rows"), F.count_distinct(session).alias("sessions"), F.count_distinct("_day").alias("days"))


def support_class(c: Column | str) -> Column:
    return bins.binned(c, bins.SUPPORT)


def rarest_first(items: DataFrame, item: str, key: str, most: int) -> list:
    """Greedy choice of items: each time the one that holds the key chosen least so far and rarest overall.
    It plans on the driver, over a table of items and keys that planning bounds."""
    rows = items.select(item, key).distinct().collect()
    total: dict = {}
    holds: dict = {}
    for r in rows:
        total[r[key]] = total.get(r[key], 0) + 1
        holds.setdefault(r[item], set()).add(r[key])
    chosen, covered = [], dict.fromkeys(total, 0)
    while holds and len(chosen) < most:
        best = min(holds, key=lambda i: (min((covered[k], total[k]) for k in holds[i]), str(i)))
        for k in holds.pop(best):
            covered[k] += 1
        chosen.append(best)
    return chosen


def examples(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], most: int = 5) -> DataFrame:
    """The first rows of each key."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= most)


def flags(rows: DataFrame, flags: dict[str, Column], *by: str) -> DataFrame:
    """How many rows each flag holds for."""
    grouped = rows.groupBy(*by) if by else rows
    return grouped.agg(*[F.count_if(c).alias(name) for name, c in flags.items()])


def offscreen_audit(rows: DataFrame, x: str, y: str, dead: str, *by: str) -> DataFrame:
    """Ticks, ticks alive, ticks off the screen, and the share of those alive that are off it."""
    off = bins.offscreen(x, y, dead)
    alive = F.count_if(~F.col(dead))
    return rows.groupBy(*by).agg(F.count("*").alias("ticks"), alive.alias("alive"), F.count_if(off).alias("offscreen"), (F.count_if(off) / F.greatest(F.lit(1), alive)).alias("share"))


def session_summary(rows: DataFrame, flag: str = "flag", session: str = "session") -> DataFrame:
    """Per session: rows, and a map of flags to counts, in order of the flag."""
    per = rows.groupBy(session, flag).agg(F.count("*").alias("_n"))
    return per.groupBy(session).agg(F.sum("_n").alias("rows"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(flag).isNotNull(), F.struct(flag, "_n"))))).alias("flags"))


def combos(episodes: DataFrame, hit_edges: list[tuple], damage_edges: list[tuple], zero: float = 0.0) -> DataFrame:
    """Totals over episodes: ``hits`` is an array of (name, hit_count, damage); ``start_percent, killed``,
    ``start, last_hit, end`` are its fields. Histograms come as maps from bucket to count."""
    n_hits = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["hit_count"])
    damage = F.aggregate("hits", F.lit(0.0), lambda a, h: a + h["damage"])
    each = episodes.withColumn("n_hits", n_hits).withColumn("damage", damage)
    return each.agg(
        F.count("*").alias("total"),
        F.count_if("killed").alias("kills"),
        F.count_if(F.col("killed") & (F.col("start_percent") <= zero)).alias("zero_to_deaths"),
        F.sum("damage").alias("damage"),
        F.sum("n_hits").alias("hits"),
        F.sum(F.col("last_hit") - F.col("start") + 1).alias("tight_frames"),
        F.sum(F.col("end") - F.col("start") + 1).alias("frames"),
        *[F.count_if(bins.binned("n_hits", hit_edges) == e[2]).alias(f"hits_{e[2]}") for e in hit_edges],
        *[F.count_if(bins.binned("damage", damage_edges) == e[2]).alias(f"damage_{e[2]}") for e in damage_edges],
    )


def landed(episodes: DataFrame, once: bool = False) -> DataFrame:
    """Moves by the hits they landed, or by the episodes that hold them at least once."""
    if once:
        return episodes.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["name"]))).alias("name")).groupBy("name").agg(F.count("*").alias("episodes"))
    return episodes.select(F.explode("hits").alias("h")).groupBy(F.col("h.name").alias("name")).agg(F.sum("h.hit_count").alias("landed"))


def deep_sum(documents: DataFrame, column: str = "doc", skip: tuple[str, ...] = ()) -> DataFrame:
    """Sums of all numbers in nested JSON documents, by path; arrays and the skipped keys are left out."""
    maps = "map<string,string>"
    level = documents.select(F.lit("").alias("path"), F.from_json(column, maps).alias("m"))
    found = None
    for _ in range(8):  # as deep as documents go
        flat = level.select("path", F.explode("m").alias("k", "v")).filter(~F.col("k").isin(*skip) if skip else F.lit(True))
        flat = flat.select(F.concat_ws(".", F.nullif("path", F.lit("")), "k").alias("path"), "v")
        leaf = flat.select("path", F.col("v").try_cast("double").alias("n")).filter("n IS NOT NULL")
        found = leaf if found is None else found.unionAll(leaf)
        level = flat.filter(F.col("v").startswith("{")).select("path", F.from_json("v", maps).alias("m"))
    return found.groupBy("path").agg(F.sum("n").alias("total"))
