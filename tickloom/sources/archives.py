"""Members of tar, zip and gzip archives, read in stream and never unpacked to disk.

As a Python data source, ``spark.read.format("archive_members")`` gives one partition per archive; a filter on
the members' names goes down to it as an option, and contents are read only for the members it takes.
"""

from __future__ import annotations

import fnmatch
import gzip
import io
import posixpath
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tickloom.workers import ship

#: The bytes that begin each kind of file.
MAGIC = {b"\x28\xb5\x2f\xfd": "zstd", b"\x1f\x8b": "gzip", b"PK\x03\x04": "zip", b"7z\xbc\xaf\x27\x1c": "7z"}
SCHEMA = "archive string, position int, member string, size long, content binary"


def kind(head: bytes) -> str:
    return next((k for m, k in MAGIC.items() if head.startswith(m)), "tar")


def members(name: str, content, pattern: str = "*", contents: bool = True) -> Iterator[tuple[str, int, str, int, bytes | None]]:
    """Members whose last part a glob takes, in the archive's order. A gzip member's content is unpacked."""
    head = content.read(8)
    content.seek(0)
    form = kind(head)
    if form == "7z":
        raise ValueError(f"{name}: 7z archives need a reader that isn't there")
    if form == "zip":
        with zipfile.ZipFile(content) as z:
            for k, info in enumerate(z.infolist()):
                if not info.is_dir() and fnmatch.fnmatch(posixpath.basename(info.filename), pattern):
                    yield name, k, info.filename, info.file_size, _plain(z.read(info)) if contents else None
        return
    stream = zstandard.ZstdDecompressor().stream_reader(content) if form == "zstd" else gzip.GzipFile(fileobj=content) if form == "gzip" else content
    with tarfile.open(fileobj=stream, mode="r|") as tar:
        for k, info in enumerate(tar):
            if info.isfile() and fnmatch.fnmatch(posixpath.basename(info.name), pattern):
                yield name, k, info.name, info.size, _plain(tar.extractfile(info).read()) if contents else None


def _plain(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def from_files(files: DataFrame, pattern: str = "*", contents: bool = True) -> DataFrame:
    """Members of the archives in a ``binaryFile`` table: ``archive, position, member, size, content``."""
    ship(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path, data in zip(pdf["path"], pdf["content"]):
                for row in members(path, io.BytesIO(data), pattern, contents):
                    yield pd.DataFrame([row], columns=["archive", "position", "member", "size", "content"])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def bundles(found: DataFrame) -> DataFrame:
    """Members of one parent folder as one sample: a map from suffix to content."""
    parent, suffix = F.regexp_extract("member", r"^(.*)/[^/]*$", 1), F.regexp_extract("member", r"\.([^./]+)$", 1)
    own = found.withColumn("sample", parent).withColumn("suffix", suffix)
    files = F.map_from_entries(F.array_sort(F.collect_list(F.struct("suffix", "content"))))
    return own.groupBy("archive", "sample").agg(F.min("position").alias("position"), files.alias("files"))


def complete_bundles(found: DataFrame, suffixes: list[str]) -> DataFrame:
    """Samples that have a member of every suffix."""
    test = F.lit(True)
    for s in suffixes:
        test = test & F.map_contains_key("files", s)
    return bundles(found).filter(test)


class _Archive(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p for p in options["paths"].split(",") if p]
        self.pattern, self.contents = options.get("pattern", "*"), options.get("contents", "true") == "true"

    def partitions(self) -> list[InputPartition]:
        return [_Archive(p) for p in self.paths]

    def read(self, partition: _Archive) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            yield from members(partition.path, f, self.pattern, self.contents)


class ArchiveMembers(DataSource):
    """For archives on a mounted file system; others are read by :func:`from_files`."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(ArchiveMembers)


def indexed_members(archives: DataFrame, index: DataFrame, pattern: str = "*") -> tuple[DataFrame, DataFrame]:
    """Member names from a cached index, and the rows to add to it: those of archives it lacks."""
    added = from_files(archives.join(index, archives["path"] == index["archive"], "left_anti"), pattern, contents=False).drop("content")
    return index.unionByName(added.select(*index.columns)), added
