"""Input schemas and dimensions."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _I, _S, _D, _B = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


MANIFEST = _struct(schemaVersion=_I, status=_S, sample=_I, sourceReference=_S, sourceSha256=_S, archive=_S, artifact=_S, skipReason=_S)
ARCHIVE_INDEX = _struct(schemaVersion=_I, status=_S, archiveBytes=_L, videoFrames=T.ArrayType(_I))
JOB = _struct(id=_L, run=_S, path=_S, start=_L, end=_L)
RESULT = _struct(job=JOB, status=_S, elapsed=_D, steps=T.ArrayType(_S))
EVENT = _struct(event=_S, timestamp=T.TimestampType(), fields=T.MapType(_S, _S))
REPORT_FILE = _struct(
    path=_S, seconds=_D, row_count=_L, frame_entries=_L, binary_bytes=_L, record_bytes=_L, skipped_rows=_L, complete_rows=_L, last_frame=_L, metadata_last_frame=_L
)
ACTION = _struct(player_index=_I, is_follower=_B, buttons=_L, physical_buttons=_L)
TICK = _struct(session=_L, source_index=_I, source_frame=_I, video_index=_I, state=T.MapType(_S, _S), actions=T.ArrayType(ACTION))
COMMIT = _struct(batch=_S, item=_L, reference=_S, size=_L, committed_at=T.TimestampType())
#: What the event-stream parser yields: one row for each (frame, player).
CONTROL = _struct(
    session=_S, frame=_I, player=_I, main_x=_D, main_y=_D, c_x=_D, c_y=_D, trigger=_D, left=_D, right=_D, raw_x=_D, buttons=_L, physical=_L
)
#: The record of 132 bytes, little-endian; (name, struct code with padding before it), in order of offset.
RECORD = (
    ("frame", "i"), ("slot", "B"), ("is_follower", "B"), ("airborne", "B"), ("character", "B"), ("seed", "I"),
    ("pre_state", "H"), ("state", "H"), ("pre_x", "f"), ("pre_y", "f"), ("pre_facing", "f"), ("stick_x", "f"), ("stick_y", "f"),
    ("cstick_x", "f"), ("cstick_y", "f"), ("trigger", "f"), ("buttons", "I"), ("physical_buttons", "I"), ("left_trigger", "f"),
    ("right_trigger", "f"), ("raw_stick_x", "f"), ("pre_percent", "f"), ("x", "f"), ("y", "f"), ("facing", "f"), ("percent", "f"),
    ("shield", "f"), ("last_attack", "B"), ("combo_count", "B"), ("last_hit_by", "B"), ("stocks", "B"), ("state_counter", "f"),
    ("misc_state", "f"), ("last_ground", "H"), ("jumps", "B"), ("l_cancel", "B"), ("hurtbox", "B"), ("reserved", "B"),
    ("instance_hit_by", "H"), ("instance", "H"), ("hitlag", "2xf"), ("animation", "I"), ("speed_x", "f"), ("speed_y", "f"),
)
