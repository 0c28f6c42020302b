"""Connected components of an edge table by alternating large and small stars.

Each round is two aggregations and joins on the edge table alone. A hub's minimum is combined map-side; where its
edges are joined with that minimum, a single row, adaptive execution splits them over tasks as a skewed partition,
and no neighbourhood is gathered into one row or on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import cut, drop


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v")))


def _stamp(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    row = edges.agg(F.count("*").alias("n"), F.sum(F.shiftright(h, 20)).alias("s"), F.bit_xor(h).alias("x")).first()
    return row["n"], row["s"], row["x"]


def component_labels(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (u long, v long) to ``(node, root)``, root the smallest node of the component.

    Loops and repeated edges are allowed; an empty table gives an empty table. Nodes without an edge
    to another node get no row.
    """
    now = cut(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    stamp = _stamp(now)
    for _ in range(max_rounds):
        starred = _large_star(now).filter("u <> v").distinct()
        before, now = now, cut(_small_star(starred).filter("u <> v").distinct(), "stars")
        drop(before)
        if (after := _stamp(now)) == stamp:
            break
        stamp = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
