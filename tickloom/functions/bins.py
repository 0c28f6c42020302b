"""Categories of ticks. The edges are fixed values; which side an edge belongs to differs from bin to bin."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.numbers import finite_or

#: Fixed values: (upper edge, whether the edge is inside, name); the last name has no edge.
PERCENT = [(0, True, "0"), (40, False, "1-39"), (80, False, "40-79"), (120, False, "80-119"), (160, False, "120-159"), (200, False, "160-199"), (None, False, "200+")]
X = [(-100, False, "far-left"), (-35, False, "left"), (35, True, "center"), (100, True, "right"), (None, False, "far-right")]
Y = [(-25, False, "deep-below"), (0, False, "below"), (25, False, "low"), (60, False, "mid"), (None, False, "high")]
DISTANCE = [(15, False, "close"), (40, False, "medium"), (80, False, "far"), (None, False, "extreme")]
EPISODE = [(30, False, "under-0.5s"), (60, False, "0.5-1s"), (120, False, "1-2s"), (300, False, "2-5s"), (None, False, "5s+")]
SUPPORT = [(1, False, "0"), (5, False, "1-4"), (20, False, "5-19"), (None, False, "20+")]
EDGE_X = 68.4
LEDGE_STATES = (252, 263)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def binned(c: Column | str, edges: list[tuple]) -> Column:
    """The name of the first bin whose upper edge takes the value."""
    c = _col(c)
    out = F.lit(edges[-1][2])
    for edge, inside, name in reversed(edges[:-1]):
        out = F.when(c <= edge if inside else c < edge, F.lit(name)).otherwise(out)
    return out


def binned_sql(expression: str, edges: list[tuple]) -> str:
    """The same as a SQL expression."""
    cases = " ".join(f"WHEN {expression} {'<=' if inside else '<'} {edge} THEN '{name}'" for edge, inside, name in edges[:-1])
    return f"CASE {cases} ELSE '{edges[-1][2]}' END"


def state_class(state: Column | str, ranges: list[tuple[int, int | None, str]], fallback: str = "other") -> Column:
    """Ordered rules over a state number: the first range that holds it names it. The ranges are a dimension
    that the caller supplies; an open end is None."""
    state = _col(state)
    out = F.lit(fallback)
    for low, high, name in reversed(ranges):
        out = F.when((state >= low) if high is None else state.between(low, high), F.lit(name)).otherwise(out)
    return out


def zone(x: Column | str, y: Column | str, airborne: Column | str, dead: Column | str, state: Column | str) -> Column:
    """Where an actor stands: ledge, below or beside the stage, on a platform or the floor, or above it."""
    x, y, air, dead, state = finite_or(x, 0), finite_or(y, 0), _col(airborne), _col(dead), F.coalesce(_col(state), F.lit(-1))
    side = lambda left, right: F.when(x < 0, left).otherwise(right)
    floor = F.when(x < -35, "main-floor-left").when(x > 35, "main-floor-right").otherwise("main-floor-center")
    ground = F.when(y > 35, "top-platform").when(y > 8, side("left-platform", "right-platform")).otherwise(floor)
    above = F.when(y >= 60, "above-stage-high").when(y >= 25, "above-stage-mid").otherwise("above-stage-low")
    below = F.when(F.abs(x) < 55, "under-stage").otherwise(side("below-left-offstage", "below-right-offstage"))
    return (
        F.when(dead, "dead-or-respawn")
        .when(state.between(*LEDGE_STATES), side("left-ledge", "right-ledge"))
        .when(y < 0, below)
        .when(F.abs(x) > EDGE_X, side("side-left-offstage", "side-right-offstage"))
        .when(~F.coalesce(air, F.lit(False)), ground)
        .otherwise(above)
    )


def offstage(x: Column | str, y: Column | str, dead: Column | str) -> Column:
    return ~_col(dead) & ((finite_or(y, 0) < 0) | (F.abs(finite_or(x, 0)) > EDGE_X))


def offscreen(x: Column | str, y: Column | str, dead: Column | str) -> Column:
    """Beyond the usual view: by coordinates alone."""
    y = finite_or(y, 0)
    return ~_col(dead) & ((F.abs(finite_or(x, 0)) > 110) | (y > 80) | (y < -25))


def distance_bin(ax, ay, bx, by) -> Column:
    return binned(F.hypot(finite_or(ax, 0) - finite_or(bx, 0), finite_or(ay, 0) - finite_or(by, 0)), DISTANCE)


def facing(ax, a_dir, bx, b_dir) -> Column:
    """Whether two actors face each other, by the signs of offset times direction."""
    gap = finite_or(bx, 0) - finite_or(ax, 0)
    a, b = gap * finite_or(a_dir, 1) >= 0, -gap * finite_or(b_dir, 1) >= 0
    return F.when(a & b, "both-facing-toward").when(~a & ~b, "both-facing-away").otherwise("one-facing-toward")


def stock_relation(a: Column | str, b: Column | str) -> Column:
    gap = F.abs(finite_or(a, 0) - finite_or(b, 0))
    return F.when(gap == 0, "stocks-tied").when(gap >= 2, "stock-lead-2+").otherwise("stock-lead-1")


def pair_configuration(a: Column, b: Column, word: str, none: str) -> Column:
    """Both, one or none of two flags."""
    return F.when(a & b, f"both-{word}").when(a, f"first-only-{word}").when(b, f"second-only-{word}").otherwise(none)


def looked_up(c: Column | str, table: dict, unknown: str = "unknown") -> Column:
    """A dictionary as a map; values it lacks are ``unknown(value)``."""
    c = _col(c)
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    known = F.try_element_at(F.create_map(*pairs), c) if pairs else F.lit(None).cast("string")
    return F.coalesce(known, F.concat(F.lit(f"{unknown}("), F.coalesce(c.cast("string"), F.lit("null")), F.lit(")")))
