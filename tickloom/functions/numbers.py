"""Arithmetic rules: finite values, ratios, counts of windows, schedules and delays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: Column | str) -> Column:
    c = _col(c).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def finite_or_null(c: Column | str, digits: int | None = 6) -> Column:
    """The value rounded, or null where it isn't a finite number."""
    value = F.when(is_finite(c), _col(c).cast("double"))
    return value if digits is None else F.round(value, digits)


def finite_or(c: Column | str, fallback: float) -> Column:
    return F.coalesce(F.when(is_finite(c), _col(c).cast("double")), F.lit(float(fallback)))


def finite_or_raise(c: Column | str, message: str = "value isn't finite") -> Column:
    return F.when(_col(c).isNull() | is_finite(c), _col(c)).otherwise(F.raise_error(F.lit(message)))


def ratio(part: Column | str, whole: Column | str) -> Column:
    """A quotient whose denominator is 1 at least."""
    return _col(part).cast("double") / F.greatest(F.lit(1.0), _col(whole).cast("double"))


def mib(c: Column | str) -> Column:
    return _col(c) / F.lit(1048576.0)


def rate(amount: Column | str, seconds: Column | str) -> Column:
    """Amount per second; null where no time passed."""
    return _col(amount) / F.nullif(_col(seconds).cast("double"), F.lit(0.0))


def clip_count(n: Column | str, frames: int, stride: int, strict: bool = False) -> Column:
    """How many windows of ``frames`` fit at steps of ``stride``: 0 where none fits, or an error if strict."""
    n = _col(n)
    count = F.greatest(F.lit(0), 1 + F.floor((n - frames) / F.lit(float(stride)))).cast("long")
    return F.when(n < frames, F.raise_error(F.lit("shorter than one clip"))).otherwise(count) if strict else count


def grid_last(first: Column | str, last: Column | str, step: int = 3) -> Column:
    """The last place of a grid from ``first`` that isn't beyond ``last``."""
    return _col(first) + F.floor((_col(last) - _col(first)) / F.lit(float(step))).cast("int") * step


def warmup(step: Column | str, steps: int) -> Column:
    """A factor that rises evenly to 1."""
    return F.least(F.lit(1.0), _col(step) / F.lit(float(max(1, steps))))


def warmup_cosine(step: Column | str, steps: int, total: int, low: float = 0.0) -> Column:
    """Even rise to 1, then half a cosine down to ``low``."""
    s = _col(step)
    done = F.least(F.lit(1.0), (s - steps) / F.lit(float(max(1, total - steps))))
    return F.when(s < steps, (s + 1) / F.lit(float(max(1, steps)))).otherwise(low + (1 - low) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * done)))


def backoff(attempt: Column | str, base: float = 1.0, most: float = 60.0, retry_after: Column | str | None = None) -> Column:
    """Doubling delays up to ``most``; a delay that the other side asks for comes first."""
    delay = F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), _col(attempt)))
    return F.coalesce(_col(retry_after).cast("double"), delay) if retry_after is not None else delay


def recovered(first: Column | str, last: Column | str, reached: Column | str, least: int = 600, share: float = 0.75) -> Column:
    """Whether a prefix that stalled at ``reached`` is long enough: by ``least`` frames and by share."""
    first = _col(first)
    by_share = first + F.ceil((_col(last) - first) * F.lit(share))
    return _col(reached) >= F.greatest(first + least, by_share)


def timeline_ok(pts: Column | str, frame: Column | str, first: Column | str, last: Column | str, fps: float = 20.0, step: int = 3) -> Column:
    """Whether a decoded frame's time stands at its place of the grid and its frame is within the range."""
    place = F.round(_col(pts) * F.lit(fps)).cast("long")
    return (_col(frame) == _col(first) + place * step) & (_col(frame) <= _col(last))
