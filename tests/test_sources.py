import gzip
import io
import json
import math
import struct
import tarfile
import zipfile

import pytest
import zstandard
from pyspark.sql import functions as F

from tickloom import schemas
from tickloom.sources import archives, files, records, sessions


def control(frame, player, follower=0, x=0.5, raw=64, buttons=3, physical=1):
    body = bytearray(0x3B + 1)
    body[0] = sessions.CONTROLS
    struct.pack_into(">iBB", body, 1, frame, player, follower)
    for k in sessions.FLOATS:
        struct.pack_into(">f", body, k, x)
    struct.pack_into(">b", body, sessions.RAW_X, raw)
    struct.pack_into(">I", body, sessions.BUTTONS, buttons)
    struct.pack_into(">H", body, sessions.PHYSICAL, physical)
    return bytes(body)


TABLE = b"\x35" + bytes([1 + 3 * 4]) + b"".join(struct.pack(">BH", c, n) for c, n in ((0x36, 4), (0x37, 0x3B), (0x38, 8), (0x39, 1)))
START, END = b"\x36" + bytes(4), b"\x39\x00"


def state(frame):
    return b"\x38" + struct.pack(">i", frame) + bytes(4)


def game(frames, end=True, **kw):
    return START + b"".join(control(f, p, **kw) + state(f) for f in frames for p in (0, 1)) + (END if end else b"")


def test_one_game():
    rows = sessions.controls(TABLE + game([-39, -38]), "a")
    assert [r[:2] for r in rows] == [(-39, 0), (-39, 1), (-38, 0), (-38, 1)]
    assert rows[0][2:] == (*[0.5] * 7, 0.5, 3, 1)
    assert sessions.frame_range(TABLE + game([-39, -38]), "a") | {"start": 0, "stop": 0} == {"first": -39, "last": -38, "complete": True, "start": 0, "stop": 0}


def test_first_complete_game_of_several():
    data = TABLE + game([1, 2], end=False) + game([5, 6]) + game([9])
    assert {r[0] for r in sessions.controls(data, "a")} == {5, 6}
    assert sessions.frame_range(data, "a")["first"] == 5
    with pytest.raises(ValueError, match="none complete"):
        sessions.controls(TABLE + game([1], end=False) + game([2], end=False), "a")


def test_cut_short_duplicates_followers_and_containers():
    data = TABLE + game([1, 2], end=False)
    assert {r[0] for r in sessions.controls(data[:-20], "a")} == {1, 2}
    again = TABLE + START + control(1, 0, x=0.25) + control(1, 0, x=0.75) + control(1, 1, follower=1) + END
    assert [(r[0], r[1], r[2]) for r in sessions.controls(again, "a")] == [(1, 0, 0.75)]
    boxed = b"{U\x03raw[$U#l" + struct.pack(">I", len(data)) + data
    assert sessions.controls(boxed + b"trailing", "a") == sessions.controls(data, "a")


def test_errors():
    with pytest.raises(ValueError, match="isn't finite"):
        sessions.controls(TABLE + game([1], x=math.inf), "a")
    with pytest.raises(ValueError, match="empty"):
        sessions.frame_range(b"", "a")
    with pytest.raises(ValueError, match="no state"):
        sessions.frame_range(TABLE + START + END, "a")


def test_parsed_and_windows(spark):
    df = spark.createDataFrame([("a", TABLE + game(range(0, 10)))], "path string, content binary")
    rows = sessions.parsed(df)
    assert rows.schema == schemas.CONTROL and rows.count() == 20
    w = sessions.control_windows(rows, 0, 1, 3)
    assert w.count() == 12 and {(r.transition, r.microstep) for r in w.collect()} == {(t, m) for t in (0, 1) for m in (0, 1, 2)}
    assert sorted(r.frame for r in w.filter("player = 0").collect()) == [4, 5, 6, 7, 8, 9]
    with pytest.raises(Exception, match="controls are missing"):
        sessions.control_windows(rows.filter("NOT (frame = 5 AND player = 1)"), 0, 1, 3).collect()
    assert sessions.ranges(df).first().last == 9


def test_records_round_trip(spark):
    assert records.SIZE == 132
    rows = [{n: (0.5 * i if c[-1] == "f" else i) for n, c in schemas.RECORD} | {"frame": -39 + i} for i in range(3)]
    rows[1]["x"] = math.nan
    df = spark.createDataFrame([("s", b"".join(map(records.packed_row, rows)))], "session string, content binary")
    back = [r.asDict() for r in records.unpacked(df).orderBy("frame").collect()]
    assert [b["frame"] for b in back] == [-39, -38, -37] and back[1]["x"] == 0.0 and back[2]["percent"] == 1.0
    again = records.packed(records.unpacked(df))
    assert again.agg(F.sum(F.octet_length("content"))).first()[0] == 3 * 132
    with pytest.raises(Exception, match="whole records"):
        records.unpacked(spark.createDataFrame([("s", b"123")], "session string, content binary")).collect()


def tar(members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_archives(spark, tmp_path):
    members = [("s1/a.bin", b"1"), ("s1/a.json", b"{}"), ("s2/b.bin", b"22")]
    (tmp_path / "x.tar.zst").write_bytes(zstandard.ZstdCompressor().compress(tar(members)))
    with zipfile.ZipFile(tmp_path / "y.zip", "w") as z:
        z.writestr("s3/c.bin", gzip.compress(b"333"))
    found = archives.from_files(spark.read.format("binaryFile").load(str(tmp_path)), "*.bin")
    assert sorted((r.member, bytes(r.content)) for r in found.collect()) == [("s1/a.bin", b"1"), ("s2/b.bin", b"22"), ("s3/c.bin", b"333")]
    every = archives.from_files(spark.read.format("binaryFile").load(str(tmp_path)))
    assert [r["sample"] for r in archives.complete_bundles(every, ["bin", "json"]).collect()] == ["s1"]
    archives.register(spark)
    source = spark.read.format("archive_members").option("paths", f"{tmp_path}/x.tar.zst,{tmp_path}/y.zip").option("pattern", "*.bin").option("contents", "false").load()
    assert sorted((r.member, r.size, r.content) for r in source.collect())[0] == ("s1/a.bin", 1, None)
    index = every.drop("content").filter(F.col("archive").endswith("zip"))
    names, added = archives.indexed_members(spark.read.format("binaryFile").load(str(tmp_path)), index)
    assert added.count() == 3 and names.count() == 4
    with pytest.raises(ValueError, match="7z"):
        list(archives.members("z", io.BytesIO(b"7z\xbc\xaf\x27\x1c" + bytes(8))))


def test_listing(spark, tmp_path):
    for name in ("b.bin", "sub/A.BIN", "c.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    assert [r.path.rsplit("/", 1)[1] for r in files.listing(spark, str(tmp_path), str(tmp_path), suffix=".bin").collect()] == ["b.bin", "A.BIN"]
    assert files.listing(spark, str(tmp_path), suffix=".bin", recursive=False).count() == 1
    assert files.listing(spark, str(tmp_path / "no"), missing_ok=True).count() == 0
    with pytest.raises(FileNotFoundError):
        files.listing(spark, str(tmp_path / "no"))


def test_json(spark, tmp_path):
    rows = [{"schemaVersion": 1, "status": "complete", "sample": 3, "archive": "a"}]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "bad.jsonl").write_text(json.dumps(rows[0]) + "\n{broken\n")
    assert files.json_lines(spark, str(tmp_path / "m.jsonl"), schemas.MANIFEST).first().sample == 3
    assert len(files.json_lines(spark, str(tmp_path / "bad.jsonl"), schemas.MANIFEST, strict=False).collect()) == 1
    with pytest.raises(Exception):
        files.json_lines(spark, str(tmp_path / "bad.jsonl"), schemas.MANIFEST).collect()
    (tmp_path / "d").mkdir()
    (tmp_path / "d/i.json").write_text(json.dumps({"schemaVersion": 1, "status": "ok", "archiveBytes": 5, "videoFrames": [39, 80]}, indent=1))
    assert files.json_documents(spark, str(tmp_path / "d"), schemas.ARCHIVE_INDEX).first().videoFrames == [39, 80]


def test_logs_and_images(spark, tmp_path):
    (tmp_path / "r.log").write_text("start\nframe: -123\nnoise\nframe: 5\n")
    assert [r.frame for r in files.log_frames(spark, str(tmp_path / "r.log")).orderBy("position").collect()] == [-123, 5]
    png = b"\x89PNG\r\n\x1a\n" + bytes(8) + struct.pack(">II", 224, 184)
    df = spark.createDataFrame([("f_10.png", png), ("f_9.png", b"no"), ("x.png", b"")], "path string, content binary")
    assert [(r.width, r.height) for r in files.image_sizes(df).collect()] == [(224, 184), (None, None), (None, None)]
    assert [r.number for r in files.numbered_images(df).orderBy("number").collect()] == [9, 10]
    v = spark.createDataFrame([(0, 0, 2.0, 20.0), (7, 0, 2.0, 20.0)], "a long, b long, s double, r double")
    assert [r[0] for r in v.select(files.frame_count("a", "b", "s", "r")).collect()] == [40, 7]


def test_jobs(spark):
    entries = spark.createDataFrame([("My run!", "http://x.org/a", None), ("b", None, "https://y.org/b")], "id string, url string, link string")
    got = files.jobs(entries, {"kind": "raw"}, {"url": ["link"]}).orderBy("id").collect()
    assert [(r.id, r.url, r.kind) for r in got] == [("My-run", "http://x.org/a", "raw"), ("b", "https://y.org/b", "raw")]
    with pytest.raises(Exception, match="not an address"):
        files.jobs(entries.withColumn("link", F.lit("ftp://z")), {}, {"url": ["link"]}).collect()


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(i, f'n"{i}', i % 2) for i in range(10)], "id int, name string, b int")
    files.write_csv(df, str(tmp_path / "csv"), ["name", "id"])
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).filter("id = 3").first().name == 'n"3'
    files.write_sharded(df.coalesce(1), str(tmp_path / "s"), 4)
    assert len(list((tmp_path / "s").glob("*.parquet"))) == 3
    files.write_batches(df, str(tmp_path / "b"), "b", "id")
    assert spark.read.parquet(str(tmp_path / "b")).count() == 10
    files.append_log(df.limit(2), str(tmp_path / "l"))
    files.append_log(df.limit(2).withColumn("name", F.lit("new")), str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 4
    files.write_json(df, str(tmp_path / "j"), one=True)
    assert len(list((tmp_path / "j").glob("*.json"))) == 1
    log = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "id int, at int, v string")
    assert files.latest_log(log, "id", "at").first().v == "b"
