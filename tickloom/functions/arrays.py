"""Array functions: padding, vectors, microsteps and documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _doubles(c: Column | str) -> Column:
    return _col(c).cast("array<double>")


def padded(c: Column | str, width: int) -> Column:
    """The array at a fixed width, its last element repeated."""
    c = _col(c)
    return F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.element_at(c, F.least(i, F.size(c))))


def padding_mask(c: Column | str, width: int) -> Column:
    c = _col(c)
    return F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: i <= F.size(c))


def zip_strict(a: Column | str, b: Column | str) -> Column:
    """Pairs of two arrays; an error if their sizes differ."""
    a, b = _col(a), _col(b)
    return F.when(F.size(a) == F.size(b), F.arrays_zip(a, b)).otherwise(F.raise_error(F.lit("sizes differ")))


def total(c: Column | str) -> Column:
    return F.aggregate(_doubles(c), F.lit(0.0), lambda a, x: a + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(c: Column | str) -> Column:
    return F.sqrt(dot(c, c))


def normalised(c: Column | str, least: float = 1e-12) -> Column:
    size = F.greatest(norm(c), F.lit(least))
    return F.transform(_doubles(c), lambda x: x / size)


def cosine(a: Column | str, b: Column | str, least: float = 1e-8) -> Column:
    """Cosine similarity; each length is ``least`` at least."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(least)) * F.greatest(norm(b), F.lit(least)))


def mean_squared_error(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(_col(a))


def mean_absolute_error(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(_col(a))


def interpolated(noise: Column | str, data: Column | str, t: Column | str) -> tuple[Column, Column]:
    """The point at ``t`` between noise and data, and the velocity from noise to data."""
    t = _col(t)
    return F.zip_with(_doubles(noise), _doubles(data), lambda n, d: (1 - t) * n + t * d), F.zip_with(_doubles(noise), _doubles(data), lambda n, d: d - n)


def layer_mean_plus_last(layers: list[Column | str]) -> Column:
    """Element means over layers, plus the last layer."""
    out = _doubles(layers[0])
    for layer in layers[1:]:
        out = F.zip_with(out, _doubles(layer), lambda a, b: a + b)
    return F.zip_with(out, _doubles(layers[-1]), lambda s, x: s / len(layers) + x)


def standardised(c: Column | str, mean: float, std: float) -> Column:
    return F.transform(_doubles(c), lambda x: (x - mean) / std)


def rescaled(c: Column | str, low: Column | str, high: Column | str, scale: float = 1.0) -> Column:
    """A value moved from ``low..high`` to ``0..scale`` and held there."""
    low, high = _col(low), _col(high)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (_col(c) - low) / F.greatest(high - low, F.lit(1e-12)))) * scale


MICROSTEPS = ("ordered", "last_repeated", "mean_repeated", "mean_first_last", "zeros")


def microsteps(c: Column | str, kind: str) -> Column:
    """Representations of a transition's steps that keep its width."""
    c = _doubles(c)
    mean, n = total(c) / F.size(c), F.size(c)
    if kind == "ordered":
        return c
    if kind == "last_repeated":
        return F.transform(c, lambda x: F.element_at(c, -1))
    if kind == "mean_repeated":
        return F.transform(c, lambda x: mean)
    if kind == "mean_first_last":
        return F.array(mean, F.element_at(c, 1), F.element_at(c, -1))
    if kind == "zeros":
        return F.transform(c, lambda x: F.lit(0.0))
    raise ValueError(f"unknown representation {kind}; one of {', '.join(MICROSTEPS)}")


def first_middle_last(n: Column | str) -> Column:
    """Places 0, the middle and the last, without repeats, for ``n`` of 1 at least."""
    n = _col(n)
    return F.array_sort(F.array_distinct(F.array(F.lit(0), F.floor(n / 2).cast("int"), (n - 1).cast("int"))))


def every_third_and_last(n: Column | str, step: int = 3) -> Column:
    """Places of the grid of ``n`` rows, and the last one where it is off the grid; no places for no rows."""
    n = _col(n).cast("long")
    grid = F.sequence(F.lit(0).cast("long"), n - 1, F.lit(step).cast("long"))
    return F.when(n > 0, F.array_union(grid, F.array(n - 1))).otherwise(F.array().cast("array<bigint>"))


def spread(n: Column | str, k: int) -> Column:
    """``k`` places of ``n``, evenly spaced, both ends included; all places where there are fewer."""
    n = _col(n)
    even = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.round(i * (n - 1) / F.lit(float(max(1, k - 1)))).cast("int"))
    return F.when(n <= k, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array_distinct(even))
