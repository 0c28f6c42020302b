"""File scans and writers: listings, JSON lines, documents, logs and images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def listing(spark: SparkSession, *paths: str, suffix: str = "", recursive: bool = True, most: int | None = None, missing_ok: bool = False) -> DataFrame:
    """``path, length`` of the files with a suffix, in any case, each once and in order; only the listing is
    read, not the contents. A missing path raises, or is empty if ``missing_ok``."""
    found = None
    for path in paths:
        if not exists(spark, path):
            if not missing_ok:
                raise FileNotFoundError(path)
            continue
        one = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length")
        found = one if found is None else found.unionAll(one)
    if found is None:
        return spark.createDataFrame([], "path string, length long")
    out = found.filter(F.lower("path").endswith(suffix.lower())).distinct().orderBy("path")
    return out if most is None else out.limit(most)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target))


def json_lines(spark: SparkSession, path: str | list[str], schema: StructType, strict: bool = True) -> DataFrame:
    """Rows of a known schema; a row that doesn't parse raises, or is left out if not strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def json_documents(spark: SparkSession, path: str | list[str], schema: StructType | None = None, strict: bool = True) -> DataFrame:
    """One document a file, with its path."""
    reader = spark.read.option("multiLine", "true").option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(path).withColumn("path", F.col("_metadata.file_path"))


def log_frames(spark: SparkSession, path: str, pattern: str = r"frame[ =:]+(-?\d+)") -> DataFrame:
    """``position, frame``: signed numbers in the lines that match, in order of the lines of each file."""
    lines = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("position", "line"))
    found = F.regexp_extract("line", pattern, 1)
    return lines.select("path", "position", F.nullif(found, F.lit("")).cast("long").alias("frame")).filter("frame IS NOT NULL")


def numbered_images(files: DataFrame, path: str = "path") -> DataFrame:
    """Files with ``number``, the number that ends their stem; those without one are left out."""
    from tickloom.functions.text import suffix_number

    return files.withColumn("number", suffix_number(path)).filter("number IS NOT NULL")


def image_sizes(files: DataFrame) -> DataFrame:
    """``width, height`` of PNG files by their header; null where the signature is another."""
    number = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("long")
    ok = F.hex(F.substring("content", 1, 8)) == "89504E470D0A1A0A"
    return files.select("path", F.when(ok, number(17)).alias("width"), F.when(ok, number(21)).alias("height"))


def frame_count(stream_frames: str, container_frames: str, seconds: str, rate: str):
    """Frames of a video by its stream, its container, or its time and rate, whichever is known first."""
    known = lambda c: F.when(F.col(c) > 0, F.col(c).cast("long"))
    return F.coalesce(known(stream_frames), known(container_frames), F.round(F.col(seconds) * F.col(rate)).cast("long"))


def jobs(entries: DataFrame, defaults: dict[str, str], aliases: dict[str, list[str]]) -> DataFrame:
    """Manifest rows with aliases and defaults applied, a slug for an id, and a checked address. A repeated id
    or an address that isn't http(s) raises."""
    from tickloom.functions.text import slug
    from tickloom.operators.sets import unique

    out = entries
    for name, others in aliases.items():
        there = [F.col(c) for c in (name, *others) if c in entries.columns]
        out = out.withColumn(name, F.coalesce(*there, F.lit(defaults.get(name))))
    for name, value in defaults.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in out.columns else F.lit(value))
    out = out.withColumn("id", slug("id"))
    valid = F.col("url").rlike(r"^https?://[^\s/]+")
    checked = F.when(F.coalesce(valid, F.lit(False)), F.col("url")).otherwise(F.raise_error(F.concat(F.lit("not an address: "), F.coalesce("url", F.lit("null")))))
    return unique(out.withColumn("url", checked), "id")


def write_json(df: DataFrame, path: str, one: bool = False) -> None:
    (df.coalesce(1) if one else df).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """A CSV with a header and a fixed order of columns; null is empty."""
    df.select(*(columns or df.columns)).write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def write_sharded(df: DataFrame, path: str, rows: int, by: list[str] | None = None) -> None:
    """Files of at most ``rows`` rows, in folders by key."""
    writer = df.write.mode("overwrite").option("maxRecordsPerFile", rows)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_batches(df: DataFrame, path: str, batch: str, order: str) -> None:
    """One folder per batch, its rows in order."""
    df.repartition(batch).sortWithinPartitions(batch, order).write.mode("overwrite").partitionBy(batch).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def latest_log(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of an append-only log for each key."""
    return log.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("_rn = 1").drop("_rn")
