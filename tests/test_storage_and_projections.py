import io
import json
import urllib.error
from email.message import Message

import pytest
from pyspark.sql import functions as F

from tickloom.operators import projections
from tickloom.sources import paged, storage


def test_storage(spark, tmp_path):
    s = storage.HadoopStorage(spark, f"file://{tmp_path}")
    assert s.files("none") == []
    s.prepare("a")
    digest = s.publish("a/x.bin", b"\x00\xffabc")
    assert s.files("a") == ["x.bin"] and s.read("a/x.bin") == b"\x00\xffabc"
    s.wait_for("a/x.bin", 5, digest)
    assert s.copied("a/x.bin", "b/y.bin") == digest
    with pytest.raises(TimeoutError):
        s.wait_for("a/x.bin", 6, digest, timeout=0)
    with pytest.raises(ValueError, match="leaves its root"):
        s.read("../x")
    assert s.cleanup("a", ".bin") == ["a/x.bin"] and s.files("a") == ["x.bin"]
    s.cleanup("a", ".bin", dry_run=False)
    assert s.files("a") == []


class Page(io.BytesIO):
    def __init__(self, entries, link=None):
        super().__init__(json.dumps(entries).encode())
        self.headers = {"Link": link}


def test_pages():
    chain = {"u1": ([{"path": "a.bin"}], '<u2>; rel="next", <u1>; rel="first"'), "u2": ([{"path": "b"}], None)}
    fails = [True]
    waits = []

    def opener(url):
        if fails and fails.pop():
            headers = Message()
            headers["Retry-After"] = "7"
            raise urllib.error.HTTPError(url, 503, "busy", headers, None)
        return Page(*chain[url])

    assert [e["path"] for e in paged.pages("u1", open_url=opener, wait=waits.append)] == ["a.bin", "b"] and waits == [7.0]
    with pytest.raises(ValueError, match="repeat"):
        list(paged.pages("u1", open_url=lambda u: Page([], '<u1>; rel="next"')))

    def missing(url):
        raise urllib.error.HTTPError(url, 404, "no", Message(), None)

    with pytest.raises(urllib.error.HTTPError):
        paged.fetch("u1", open_url=missing)


SIDE = "struct<position_x:double,position_y:double,stick_x:double,stick_y:double,state:int>"


def player_rows(spark):
    nan = float("nan")
    rows = [("s", 0, 0, (1.23456789, 0.0, 0.5, nan, 14), (2.0, nan, None, None, 15), [{"player": 1, "position_x": 9.0}]), ("s", 0, 1, None, (1.0, 1.0, 0.0, 0.0, 1), [])]
    return spark.createDataFrame(rows, f"session string, frame int, player int, pre {SIDE}, post {SIDE}, opponents array<struct<player:int,position_x:double>>")


def test_nested_and_flat(spark):
    rows = player_rows(spark)
    first = projections.nested(rows).filter("player = 0").first()
    assert (first.pre.position_x, first.pre.stick_y, first.post.position_y, first.post.state, first.post.stocks) == (1.234568, None, None, 15, None)
    flat = projections.flat(rows).orderBy("player").collect()
    assert [r.opponent_position_x for r in flat] == [9.0, None] and flat[0].pre_state == 14
    assert [r.player for r in projections.first_frame_sample(rows).collect()] == [0]


def test_actions_and_contracts(spark):
    schema = "frame int, actors array<struct<player_index:int,is_follower:boolean,buttons:long,physical_buttons:long,pre:int,post:int>>"
    good = spark.createDataFrame([(1, [(0, False, 2**32 - 1, 0, 1, 1)])], schema)
    assert projections.actions(good).first().actors[0].buttons == 2**32 - 1 and projections.complete_actors(good).count() == 1
    for bad in ((0, False, 2**32, 0, 1, 1), (0, False, None, 0, 1, 1)):
        with pytest.raises(Exception, match="isn't a mask"):
            projections.actions(spark.createDataFrame([(1, [bad])], schema)).collect()
    with pytest.raises(Exception, match="incomplete actor"):
        projections.complete_actors(spark.createDataFrame([(1, [(0, False, 1, 0, None, 1)])], schema)).collect()
    meta = spark.createDataFrame([(60, 20, 3)], "source int, target int, ratio int")
    assert projections.checked_contract(meta, source=60, target=20, ratio=3).count() == 1
    with pytest.raises(Exception, match="expected source=50"):
        projections.checked_contract(meta, source=50).collect()


def test_paths_and_timer(spark):
    df = spark.createDataFrame([("RED/a b (X).BIN", "t/0.bin"), ("x", "y")], "path string, target string")
    got = projections.metadata_rows(df).collect()
    assert [(r.folder, r.name, r.stem, r.suffix) for r in got] == [("RED", "a b (X).BIN", "a b (X)", ".bin"), (None, "x", "x", None)]
    t = spark.createDataFrame([(-10,), (60,), (99999,)], "f int").select(projections.game_timer("f", F.lit(480.0)), projections.game_timer("f", F.lit(0.0), False))
    assert [tuple(r) for r in t.collect()] == [(480.0, 0.0), (479.0, 1.0), (0.0, 1666.65)]
