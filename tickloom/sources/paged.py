"""Paged listings: each chain of pages is one partition, read page by page along its links."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tickloom.workers import ship

RETRIES = 5
PASSING = (408, 425, 429, 500, 502, 503, 504)


def fetch(url: str, open_url: Callable = urllib.request.urlopen, wait: Callable[[float], None] = time.sleep) -> tuple[list, str | None]:
    """The entries of a page and the link to the next. A passing failure is tried again after doubling waits,
    or after the time that the server names."""
    for attempt in range(RETRIES):
        try:
            with open_url(url) as page:
                return json.loads(page.read()), next_link(page.headers.get("Link"))
        except urllib.error.HTTPError as e:
            if e.code not in PASSING or attempt == RETRIES - 1:
                raise
            named = e.headers.get("Retry-After") if e.headers else None
            wait(float(named) if named and named.isdigit() else min(60.0, 2.0**attempt))
    raise RuntimeError("unreachable")


def next_link(header: str | None) -> str | None:
    """The address marked ``rel="next"`` in a Link header."""
    for part in (header or "").split(","):
        address, _, rest = part.partition(";")
        if 'rel="next"' in rest.replace(" ", ""):
            return address.strip()[1:-1]
    return None


def pages(url: str, **how) -> Iterator:
    """All entries of a chain of pages; a chain that returns to a page it had is an error."""
    seen: set[str] = set()
    at: str | None = url
    while at:
        if at in seen:
            raise ValueError(f"pages repeat at {at}")
        seen.add(at)
        entries, at = fetch(at, **how)
        yield from entries


class _Chain(InputPartition):
    def __init__(self, url: str) -> None:
        self.url = url


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.urls, self.suffix = options["urls"].split(), options.get("suffix", "").lower()

    def partitions(self) -> list[InputPartition]:
        return [_Chain(u) for u in self.urls]

    def read(self, partition: _Chain) -> Iterator[tuple]:
        for entry in pages(partition.url):
            if str(entry.get("path", "")).lower().endswith(self.suffix):
                yield entry.get("path"), entry.get("size"), entry.get("oid")


class PagedListing(DataSource):
    """``spark.read.format("paged_listing").option("urls", "...").option("suffix", ".bin")``."""

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return "path string, size long, oid string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(PagedListing)
