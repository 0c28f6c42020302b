"""Projections of player rows: nested, flat, compact, and by actor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numbers import finite_or_null
from tickloom.functions.text import stage_code

#: Numeric fields of the state before and after a tick's update, and of the input.
PRE = ("position_x", "position_y", "facing", "stick_x", "stick_y", "cstick_x", "cstick_y", "trigger", "percent")
POST = ("position_x", "position_y", "facing", "percent", "shield", "state_counter", "hitlag")
WHOLE = ("state", "stocks", "jumps", "combo_count", "last_hit_by", "last_attack", "character")


def compact(source: str, numbers: tuple[str, ...], whole: tuple[str, ...] = (), have: list[str] | None = None) -> Column:
    """A struct of finite numbers with six digits and of whole numbers; a field the source lacks is null."""
    there = lambda c: have is None or c in have
    fields = [(finite_or_null(F.col(f"{source}.{c}")) if there(c) else F.lit(None).cast("double")).alias(c) for c in numbers]
    fields += [(F.col(f"{source}.{c}").cast("long") if there(c) else F.lit(None).cast("long")).alias(c) for c in whole]
    return F.struct(*fields)


def nested(rows: DataFrame, keys: tuple[str, ...] = ("session", "frame", "player")) -> DataFrame:
    """Rows with compact ``pre`` and ``post`` structs."""
    names = lambda c: [f.name for f in rows.schema[c].dataType.fields]
    return rows.select(*keys, compact("pre", PRE, ("buttons", "physical_buttons"), names("pre")).alias("pre"), compact("post", POST, WHOLE, names("post")).alias("post"))


def flat(rows: DataFrame, opponents: str | None = "opponents", keep: tuple[str, ...] = ("session", "frame", "player")) -> DataFrame:
    """Struct fields as columns named by their struct, and the same for the first opponent."""
    out = [F.col(c) for c in keep]
    for side in ("pre", "post"):
        out += [F.col(f"{side}.{f.name}").alias(f"{side}_{f.name}") for f in rows.schema[side].dataType.fields]
    if opponents:
        first = F.try_element_at(F.col(opponents), F.lit(1))
        out += [first[f.name].alias(f"opponent_{f.name}") for f in rows.schema[opponents].dataType.elementType.fields]
    return rows.select(*out)


def actions(ticks: DataFrame, actors: str = "actors") -> DataFrame:
    """Each actor's masks as unsigned 32-bit values; a mask that is missing or no such value raises."""
    def mask(a: Column, name: str) -> Column:
        ok = a[name].isNotNull() & (a[name] >= 0) & (a[name] <= 0xFFFFFFFF)
        return F.when(ok, a[name].cast("long")).otherwise(F.raise_error(F.concat(F.lit(f"{name} isn't a mask, player "), a["player_index"].cast("string"))))

    one = lambda a: F.struct(a["player_index"].alias("player_index"), a["is_follower"].alias("is_follower"), mask(a, "buttons").alias("buttons"), mask(a, "physical_buttons").alias("physical_buttons"))
    return ticks.withColumn(actors, F.transform(actors, one))


def complete_actors(ticks: DataFrame, actors: str = "actors") -> DataFrame:
    """The ticks themselves; an actor without a state before or after its update raises."""
    bad = F.exists(actors, lambda a: a["pre"].isNull() | a["post"].isNull())
    ok = F.when(bad, F.raise_error(F.concat(F.lit("incomplete actor at frame "), F.col("frame").cast("string")))).otherwise(F.lit(True))
    return ticks.withColumn("_ok", ok).filter("_ok").drop("_ok")


def first_frame_sample(rows: DataFrame, frame: int = 0) -> DataFrame:
    """Players that are complete at one frame, with their position, state and stick."""
    there = rows.filter((F.col("frame") == frame) & F.col("pre").isNotNull() & F.col("post").isNotNull())
    return there.select("session", "player", "post.position_x", "post.position_y", "post.state", "pre.stick_x", "pre.stick_y").orderBy("session", "player")


def metadata_rows(paths: DataFrame, path: str = "path", target: str = "target", keep: tuple[str, ...] = ()) -> DataFrame:
    """What a path tells of a file: its folder, name, stem, suffix and stage code, and where it goes."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    return paths.select(
        *keep,
        F.col(path).alias("source_path"),
        F.col(target).alias("target_path"),
        F.nullif(F.regexp_extract(path, r"^([^/]+)/", 1), F.lit("")).alias("folder"),
        name.alias("name"),
        F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"),
        F.lower(F.nullif(F.regexp_extract(name, r"(\.[^.]*)$", 1), F.lit(""))).alias("suffix"),
        stage_code(path).alias("stage"),
    )


def in_corpus(stage: Column | str, characters: Column | str, want_stage: str, want: list[str]) -> Column:
    """The corpus filter: the wanted stage, and any of the wanted characters among those of the file."""
    s = F.col(stage) if isinstance(stage, str) else stage
    c = F.col(characters) if isinstance(characters, str) else characters
    return F.coalesce((s == want_stage) & F.arrays_overlap(c, F.array(*map(F.lit, want))), F.lit(False))


def checked_contract(rows: DataFrame, **expected) -> DataFrame:
    """The rows themselves; one whose columns differ from the expected values raises."""
    test = F.lit(True)
    for c, v in expected.items():
        test = test & F.col(c).eqNullSafe(F.lit(v))
    names = ", ".join(f"{c}={v}" for c, v in expected.items())
    return rows.withColumn("_ok", F.when(test, F.lit(True)).otherwise(F.raise_error(F.lit(f"expected {names}")))).filter("_ok").drop("_ok")


def game_timer(frame: Column | str, start_seconds: Column | str, counting_down: bool = True, rate: float = 60.0) -> Column:
    """The game's clock at a frame, in seconds: it runs from frame 0 and stops at 0 when it counts down."""
    c = F.col(frame) if isinstance(frame, str) else frame
    run = F.greatest(F.lit(0), c) / F.lit(rate)
    s = F.col(start_seconds) if isinstance(start_seconds, str) else start_seconds
    return F.greatest(F.lit(0.0), s - run) if counting_down else s + run
