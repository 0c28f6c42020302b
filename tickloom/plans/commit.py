"""Commits: data first, its commit row last; only what has both counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.sources.files import exists


def committed(data: DataFrame, commits: DataFrame, batch: str = "batch") -> DataFrame:
    """Rows of batches that have a commit row."""
    return data.join(commits.select(batch).distinct(), batch, "left_semi")


def commit(spark: SparkSession, data: DataFrame, path: str, batch: str, expected: int | None = None) -> int:
    """Write one batch and then its commit row. A batch that was committed before is left as it is; a count
    other than the expected one is an error, and leaves no commit row."""
    commits = f"{path}/_commits"
    if exists(spark, commits) and spark.read.json(commits).filter(F.col("batch") == batch).limit(1).count():
        return 0
    target = f"{path}/batch={batch}"
    data.write.mode("overwrite").parquet(target)
    n = spark.read.parquet(target).count()
    if expected is not None and n != expected:
        raise ValueError(f"batch {batch} has {n} rows, not {expected}")
    spark.createDataFrame([(batch, n)], "batch string, n long").coalesce(1).write.mode("append").json(commits)
    return n


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    return committed(spark.read.parquet(path), spark.read.json(f"{path}/_commits"))


def reconciled(staged: DataFrame, jobs: DataFrame, done: DataFrame, on: str = "id", agree: tuple[str, ...] = ("reference", "size")) -> DataFrame:
    """Staged rows with ``verdict``: committed ones go, ones that disagree with their job are invalid, and the
    others are kept."""
    job = jobs.select(on, *[F.col(c).alias(f"_{c}") for c in agree]).withColumn("_job", F.lit(True))
    out = staged.join(job, on, "left").join(done.select(on).distinct().withColumn("_done", F.lit(True)), on, "left")
    same = F.coalesce("_job", F.lit(False))
    for c in agree:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    verdict = F.when(F.col("_done"), "committed").when(~same, "invalid").otherwise("kept")
    return out.withColumn("verdict", verdict).drop("_job", "_done", *[f"_{c}" for c in agree])


def resumed(jobs: DataFrame, events: DataFrame, on: str, at: str, settled: tuple[str, ...]) -> DataFrame:
    """Jobs with the last status that the event log has of them, and ``seeded``: whether that settles them, so that
    a run that goes on leaves them out."""
    last = events.groupBy(on).agg(F.max_by("status", at).alias("status"))
    return jobs.join(last, on, "left").withColumn("seeded", F.coalesce(F.col("status").isin(*settled), F.lit(False)))


def flush_due(pending: DataFrame, batch: int, lanes: int, terminal: bool, age_seconds: float = 300, at: str = "ready_at", now=None) -> bool:
    """Whether to flush: a batch is full, all lanes can have a row, the input has ended, or a row is old."""
    now = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    row = pending.agg(F.count("*").alias("n"), F.max(F.unix_timestamp(now) - F.unix_timestamp(at)).alias("age")).first()
    return row["n"] > 0 and (row["n"] >= batch or row["n"] >= lanes or terminal or (row["age"] or 0) >= age_seconds)


def verified(left: DataFrame, right: DataFrame, name: str = "name", size: str = "size", digest: str = "sha256") -> DataFrame:
    """Names of which size or digest differ between what was written and what is there."""
    from tickloom.operators.joins import compared

    pair = lambda df: df.select(name, F.concat_ws(":", F.col(size).cast("string"), digest).alias("_v"))
    return compared(pair(left), pair(right), name, "_v")
