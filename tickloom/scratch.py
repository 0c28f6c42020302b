"""Scratch tables, which cut lineage.

They are parquet folders under ``spark.checkpoint.dir``, which every executor and the driver can reach, so a
lost executor costs a re-read and never a recomputation that might come out otherwise.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster. Where none is named, a master on this machine alone takes a
    temporary folder, and any other raises: its executors could not read a folder of the driver's machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/tickloom-scratch"
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh shared scratch folder and return it as a scan of that folder."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(schema).parquet(path)
    out._scratch = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that :func:`cut` returned and that nothing will read again."""
    for t in tables:
        path = getattr(t, "_scratch", None)
        if path in _written:
            _delete(_written.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clear_scratch() -> None:
    """Delete the scratch folders of this process. Results that still read them must be stored before."""
    while _written:
        path, spark = _written.popitem()
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended before
            return


atexit.register(clear_scratch)
