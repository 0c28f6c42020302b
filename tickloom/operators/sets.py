"""Set operations, predicates on sets, and total orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.scratch import cut

#: Rows of one range partition, about.
RANGE_ROWS = 1_000_000


def all_references(*sources: DataFrame, reference: str = "reference") -> DataFrame:
    """The references of all sources in one order."""
    out = sources[0].select(reference)
    for s in sources[1:]:
        out = out.unionByName(s.select(reference))
    return out.orderBy(reference)


def running(rows: DataFrame, order: list[str], name: str = "before", value: str | None = None) -> DataFrame:
    """The sum of ``value`` (or the number of rows) before each row, in a total order, as the column ``name``.

    Rows are range-partitioned by the order, each partition sums its own, and the partitions' totals give the
    starts, so that no task sees all rows. The totals, a row for each partition, are joined by broadcast.
    """
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    # Stored, as range bounds are sampled anew whenever the shuffle is planned again.
    ranged = cut(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    amount = F.lit(1).cast("long") if value is None else F.col(value)
    totals = [(r["_part"], r["n"]) for r in ranged.groupBy("_part").agg(F.coalesce(F.sum(amount), F.lit(0)).cast("long").alias("n")).orderBy("_part").collect()]
    starts, total = [], 0
    for part, n in totals:
        starts.append((part, total))
        total += n
    inner = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    first = F.broadcast(spark.createDataFrame(starts, "_part int, _first long").coalesce(1))
    summed = ranged.withColumn(name, F.coalesce(F.sum(amount).over(inner), F.lit(0)).cast("long")).join(first, "_part")
    return summed.withColumn(name, F.col(name) + F.col("_first")).drop("_part", "_first")


def numbered(rows: DataFrame, *order: str, name: str = "sample") -> DataFrame:
    """Numbers from 0 in a total order."""
    return running(rows, list(order), name)


def first_of(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Distinct keys, each with its first row."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def unique(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows themselves; a repeated key raises when it is read."""
    n = F.count("*").over(Window.partitionBy(*keys))
    ok = F.when(n == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("repeated key: "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))))
    return rows.withColumn("_ok", ok).filter("_ok").drop("_ok")


def same_set(c: Column | str, values: list) -> Column:
    """Whether an array holds exactly the given values, in any order and number."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.array_sort(F.array_distinct(c)) == F.array(*[F.lit(v) for v in sorted(values)]), F.lit(False))


def matchup(stage: Column | str, characters: Column | str, want_stage: int, want: list[int], players: int = 2) -> Column:
    """Exactly the wanted stage, number of players and unordered characters."""
    s = F.col(stage) if isinstance(stage, str) else stage
    c = F.col(characters) if isinstance(characters, str) else characters
    return (s == want_stage) & (F.size(c) == players) & (F.array_sort(c) == F.array(*[F.lit(v) for v in sorted(want)]))


def limited(rows: DataFrame, most: int, order: list[Column], *keys: str) -> DataFrame:
    """The first rows, of all or of each key."""
    if not keys:
        return rows.orderBy(*order).limit(most)
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= most).drop("_rn")


def bounded_subset(rows: DataFrame, most: int, *order: str) -> DataFrame:
    """Exactly ``most`` rows in order; an error if there are fewer."""
    found = rows.orderBy(*order).limit(most)
    if found.count() < most:
        raise ValueError(f"fewer than {most} rows")
    return found
