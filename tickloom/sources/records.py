"""Fixed-width records of 132 bytes."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tickloom.schemas import RECORD
from tickloom.workers import ship

FORMAT = "<" + "".join(code for _, code in RECORD)
SIZE = struct.calcsize(FORMAT)
NAMES = [n for n, _ in RECORD]
FIELDS = ", ".join(f"{n} {'double' if c[-1] == 'f' else 'long'}" for n, c in RECORD)


def packed_row(row: dict) -> bytes:
    """One record; a value that is missing or not finite is written as 0."""
    values = []
    for name, code in RECORD:
        v = row.get(name)
        v = 0 if v is None or isinstance(v, float) and not math.isfinite(v) else v
        values.append(float(v) if code[-1] == "f" else int(v))
    return struct.pack(FORMAT, *values)


def packed(rows: DataFrame, session: str = "session") -> DataFrame:
    """``session, part, content``: each batch's rows of a session in order, end to end."""
    ship(rows.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, pdf in enumerate(frames):
            for key, own in pdf.groupby(session, sort=False):
                yield pd.DataFrame({"session": [str(key)], "part": [part], "content": [b"".join(packed_row(r) for r in own.to_dict("records"))]})

    return rows.sortWithinPartitions(session, "frame", "slot").mapInPandas(run, "session string, part int, content binary")


def unpacked(files: DataFrame, name: str = "session", content: str = "content") -> DataFrame:
    """Rows of the records; a content that is no whole number of them raises."""
    ship(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for key, data in zip(pdf[name], pdf[content]):
                if len(data) % SIZE:
                    raise ValueError(f"{key}: {len(data)} bytes aren't whole records of {SIZE}")
                out = pd.DataFrame(list(struct.iter_unpack(FORMAT, data)), columns=NAMES)
                out.insert(0, "session", key)
                yield out

    return files.select(name, content).mapInPandas(run, f"session string, {FIELDS}")
