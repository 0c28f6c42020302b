"""Summaries: percentiles, roll-ups, latest rows, rankings, winners and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.numbers import is_finite


def nearest_rank(column: str, share: float) -> Column:
    """The value at rank ``ceil(n * share)``, the least one for shares of 0 and below; null for no values."""
    return F.min(column) if share <= 0 else F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY `{column}`)")


def spread_summary(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Least, median, 95th percentile and greatest value by nearest rank, and how many there are."""
    grouped = rows.groupBy(*keys)
    return grouped.agg(F.count(value).alias("n"), F.min(value).alias("low"), nearest_rank(value, 0.5).alias("median"), nearest_rank(value, 0.95).alias("p95"), F.max(value).alias("high"))


def over(rows: DataFrame, value: str, limit: float, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count_if(F.col(value) > limit).alias("over"))


def rolled_up(rows: DataFrame, folder: str, **sums: Column) -> DataFrame:
    """Sums per folder and, under a null folder, for all."""
    return rows.rollup(folder).agg(*[c.alias(n) for n, c in sums.items()])


def histogram(rows: DataFrame, status: str) -> DataFrame:
    return rows.groupBy(status).agg(F.count("*").alias("n"))


def having_all(rows: DataFrame, key: str, **flags: Column) -> DataFrame:
    """Keys for which every flag holds on some row."""
    found = rows.groupBy(key).agg(*[F.bool_or(c).alias(n) for n, c in flags.items()])
    for n in flags:
        found = found.filter(F.col(n))
    return found.select(key)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def dominant(rows: DataFrame, key: str, category: str, amount: Column | None = None) -> DataFrame:
    """The category with most rows (or the greatest amount) per key; the first by name on a tie."""
    n = F.count("*") if amount is None else F.sum(amount)
    per = rows.groupBy(key, category).agg(n.alias("n"))
    return latest(per, [key], [F.desc("n"), F.asc(category)])


def first_present(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The first value per key that isn't null."""
    return rows.filter(F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, order).alias(value))


def ranked(players: DataFrame, session: str = "session", player: str = "player", stocks: str = "stocks", percent: str = "percent") -> DataFrame:
    """Players by stocks, most first (null is -1), then by percent, least first (null is last), with ``place``
    and ``winner``: the first one's player, or null if the second is its equal."""
    s, p = F.coalesce(F.col(stocks), F.lit(-1)), F.coalesce(F.col(percent).cast("double"), F.lit(float("inf")))
    order = Window.partitionBy(session).orderBy(s.desc(), p.asc(), F.col(player))
    tied = (F.lead(s).over(order) == s) & (F.lead(p).over(order) == p)
    first = F.row_number().over(order)
    out = players.withColumn("place", first).withColumn("_w", F.when((F.col("place") == 1) & ~F.coalesce(tied, F.lit(False)), F.col(player)))
    return out.withColumn("winner", F.max("_w").over(Window.partitionBy(session))).drop("_w")


def team_winner(players: DataFrame, session: str = "session", team: str = "team", stocks: str = "stocks", percent: str | None = None) -> DataFrame:
    """The team with most stocks per session, then with least percent (null is 0), if there is such a column; null
    on a tie or where any member's team or stocks are unknown."""
    hurt = F.sum(F.coalesce(F.col(percent).cast("double"), F.lit(0.0))) if percent else F.lit(0.0)
    unknown = F.bool_or(F.col(team).isNull() | F.col(stocks).isNull())
    teams = players.groupBy(session, team).agg(F.sum(stocks).alias("_s"), hurt.alias("_p"), unknown.alias("_u"))
    order = Window.partitionBy(session).orderBy(F.desc_nulls_last("_s"), F.col("_p"), F.col(team))
    tied = (F.lead("_s").over(order) == F.col("_s")) & (F.lead("_p").over(order) == F.col("_p"))
    top = teams.withColumn("_tied", tied).withColumn("_rn", F.row_number().over(order)).withColumn("_any", F.bool_or("_u").over(Window.partitionBy(session)))
    sure = ~F.col("_any") & ~F.coalesce("_tied", F.lit(False))
    return top.filter("_rn = 1").select(session, F.when(sure, F.col(team)).alias("winner"))


def placed_winner(placements: DataFrame, session: str = "session", player: str = "player", place: str = "placement", ending: str = "ending", void: tuple[str, ...] = ("no-contest", "unresolved")) -> DataFrame:
    """The player placed first; none where the game had no proper end."""
    valid = placements.filter((F.col(place) >= 0) & ~F.col(ending).isin(*void))
    won = valid.groupBy(session).agg(F.min_by(player, F.struct(place, player)).alias("winner"))
    return placements.select(session).distinct().join(won, session, "left")


def tree(files: DataFrame, path: str = "path", size: str = "length", **globs) -> DataFrame:
    """Number and bytes of the files that globs leave."""
    from tickloom.functions.text import included

    return files.filter(included(path, **globs)).agg(F.count("*").alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def archive_rollup(manifest: DataFrame, frames: int, stride: int, archive: str = "archive", status: str = "status", n: str = "frames", sample: str = "sample") -> DataFrame:
    """Archives whose rows are all complete: their samples, clips, and last sample."""
    from tickloom.functions.numbers import clip_count

    per = manifest.groupBy(archive).agg(
        F.bool_and(F.col(status) == "complete").alias("_ok"),
        F.count_if(~F.col("artifact").eqNullSafe(F.lit("skipped"))).alias("samples"),
        F.count("*").alias("rows"),
        F.sum(F.when(~F.col("artifact").eqNullSafe(F.lit("skipped")), clip_count(n, frames, stride)).otherwise(0)).alias("clips"),
        F.max(sample).alias("last_sample"),
    )
    return per.filter("_ok AND samples > 0").drop("_ok")


def content_hash(rows: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """One hash per key over the hashes of its contents, in order."""
    each = F.struct(order, F.sha2(F.col(content).cast("binary"), 256).alias("h"))
    joined = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(each)), lambda s: s["h"]))
    return rows.groupBy(key).agg(F.sha2(joined, 256).alias("hash"))


def batch_key(rows: DataFrame, key: str, reference: str, digits: int = 20) -> DataFrame:
    """The first digits of the hash of a key's references, sorted and joined by line breaks."""
    joined = F.concat_ws("\n", F.array_sort(F.collect_list(F.col(reference).cast("string"))))
    return rows.groupBy(key).agg(F.substring(F.sha2(joined, 256), 1, digits).alias("batch_key"))


def checksum(rows: DataFrame, expression: Column, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum(expression).alias("checksum"))


def violations(rows: DataFrame, rules: dict[str, Column], ordered: bool = False) -> DataFrame:
    """``errors``: the names of the rules that a row breaks, by name or, if ``ordered``, in the rules' own order; a
    rule that is null isn't broken."""
    broken = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in (rules.items() if ordered else sorted(rules.items()))]))
    return rows.withColumn("errors", broken)


def file_rules(max_seconds: float) -> dict[str, Column]:
    """What a batch report's file entry must satisfy; each rule says what breaks it."""
    c = F.col
    return {
        "no-timing": ~is_finite("seconds"),
        "too-slow": is_finite("seconds") & (c("seconds") > max_seconds),
        "no-rows": c("row_count") <= 0,
        "no-frames": c("frame_entries") <= 0,
        "size-mismatch": c("binary_bytes") != c("row_count") * c("record_bytes"),
        "skipped-rows": c("skipped_rows") != 0,
        "row-stats-mismatch": c("complete_rows") != c("row_count"),
        "last-frame-mismatch": c("metadata_last_frame").isNotNull() & (c("last_frame") != c("metadata_last_frame")),
    }


def report_rules(least_runs: int, max_seconds: float, record_bytes: int) -> dict[str, Column]:
    """What a batch report as a whole must satisfy: ``failures``, ``runs``, ``slowest`` and ``record_bytes``."""
    c = F.col
    return {
        "failures": c("failures") != 0,
        "run-count": c("runs") < least_runs,
        "runs-over-limit": c("slowest") > max_seconds,
        "unknown-record-size": c("record_bytes").isNull() | (c("record_bytes") != record_bytes),
    }


def equal_counts(**tables: DataFrame) -> DataFrame:
    """The row counts of several tables and whether they agree."""
    found = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).withColumn("table", F.lit(name))
        found = one if found is None else found.unionAll(one)
    return found.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("table", "n")))).alias("counts"), (F.min("n") == F.max("n")).alias("agree"))


def manifest_totals(rows: DataFrame, key: str, order: str, frame: str, size: str, done: Column) -> DataFrame:
    """Entries, first and last frame in log order, whether the end was seen, and bytes."""
    return rows.groupBy(key).agg(
        F.count("*").alias("entries"),
        F.min_by(frame, order).alias("first_frame"),
        F.max_by(frame, order).alias("last_frame"),
        F.coalesce(F.bool_or(done), F.lit(False)).alias("completed"),
        F.coalesce(F.sum(size), F.lit(0)).alias("bytes"),
    )
