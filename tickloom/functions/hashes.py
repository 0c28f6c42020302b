"""Content hashes and canonical text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canonical_json(fields: dict[str, Column]) -> Column:
    """A JSON object in order of its keys, from typed columns. Doubles are written with six digits; a value
    that isn't finite raises; null is written as null."""
    parts = []
    for name in sorted(fields):
        c = fields[name]
        parts.append(F.concat(F.lit(f'"{name}":'), F.coalesce(c, F.lit("null"))))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def json_number(c: Column | str, digits: int | None = None) -> Column:
    c = _col(c)
    if digits is None:
        return c.cast("long").cast("string")
    bad = F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf")))
    return F.when(bad, F.raise_error(F.lit("value isn't finite"))).when(c.isNotNull(), F.format_string(f"%.{digits}f", c.cast("double")))


def json_text(c: Column | str) -> Column:
    c = _col(c)
    quoted = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), quoted, F.lit('"'))


def sha256(c: Column | str) -> Column:
    return F.sha2(_col(c).cast("binary"), 256)


def seed_mix(c: Column | str, *more: int) -> Column:
    """A seed from the checksum of a name and some numbers."""
    out = F.crc32(_col(c).cast("binary"))
    for k in more:
        out = out.bitwiseXOR(F.lit(k).cast("long"))
    return out


@F.pandas_udf(StringType())
def blake2b(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """BLAKE2b, 32 bytes, as hex; Spark has no such function."""
    for values in parts:
        yield values.map(lambda v: None if v is None else hashlib.blake2b(bytes(v), digest_size=32).hexdigest())
