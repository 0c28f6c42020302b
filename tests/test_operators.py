import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.operators import binning, coverage, islands, joins, metrics, sets, summary, ticks, vectors, windows


def make_ticks(spark, masks, session=1):
    return spark.createDataFrame([(session, i, m) for i, m in enumerate(masks)], "session long, idx long, mask long")


def test_divisible(spark):
    t = make_ticks(spark, [0, 1, 2, 4, 8, 16, 32])
    assert [r.idx for r in binning.anchors(t).orderBy("idx").collect()] == [0, 3, 6]
    got = binning.transitions(t).orderBy("transition").collect()
    assert [(r.actions, r.partial, r.steps) for r in got] == [([1, 2, 4], False, 3), ([8, 16, 32], False, 3)]


def test_partial_tail(spark):
    t = make_ticks(spark, [0, 1, 2, 4, 8, 16])
    assert [r.idx for r in binning.anchors(t).orderBy("idx").collect()] == [0, 3, 5]
    tail = binning.transitions(t).orderBy("transition").collect()[-1]
    assert (tail.actions, tail.padded, tail.valid, tail.partial, tail.steps) == ([8, 16], [8, 16, 16], [True, True, False], True, 2)


@pytest.mark.parametrize("slot", [0, 1, 2])
def test_pulse_survives_in_each_slot(spark, slot):
    masks = [0, 0, 0, 0]
    masks[slot + 1] = 0x100
    got = binning.transitions(make_ticks(spark, masks)).collect()[0]
    assert got.actions[slot] == 0x100 and all(got.valid)
    report = binning.sampling_report(make_ticks(spark, masks)).collect()[0]
    assert (report.rising, report.hidden) == (1, 0 if slot == 2 else 1)


def test_order_matters(spark):
    a, b = (binning.transitions(make_ticks(spark, [0, *m])).collect()[0].actions for m in ([1, 2], [2, 1]))
    assert a != b and a[0] | a[1] == b[0] | b[1]


def test_ratio_and_gap_errors(spark):
    assert ticks.integer_ratio(60, 20) == 3
    for pair in ((50, 20), (60, 30), (0, 20)):
        with pytest.raises(ValueError):
            ticks.integer_ratio(*pair)
    gap = spark.createDataFrame([(1, 0), (1, 2)], "session long, idx long")
    with pytest.raises(Exception, match="gap before 2"):
        ticks.contiguous(gap).collect()
    assert ticks.contiguity(gap).collect()[0].gaps == 1


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=40))
def test_round_trip(spark, masks):
    t = make_ticks(spark, masks)
    back = [r.action for r in binning.flattened(binning.transitions(t)).orderBy("idx").collect()]
    assert back == masks[1:]


def test_hidden_pulses_against_loop(spark):
    rng = random.Random(4)
    masks = [rng.choice([0, 0, 1, 2, 3]) for _ in range(50)]
    hidden = 0
    for bit in range(2):
        held = [m >> bit & 1 for m in masks]
        i = 0
        while i < len(held):
            if held[i] and (i == 0 or not held[i - 1]):
                j = i
                while j + 1 < len(held) and held[j + 1]:
                    j += 1
                hidden += i >= 1 and not any(k % 3 == 0 or k == len(held) - 1 for k in range(i, j + 1))
                i = j
            i += 1
    assert binning.hidden_pulses(make_ticks(spark, masks), bit_count=2).collect()[0].hidden == hidden


@pytest.mark.parametrize(("length", "found"), [(14, 0), (15, 1), (16, 1)])
def test_least_length(spark, length, found):
    rows = spark.createDataFrame([(1, i, i < length) for i in range(20)], "session long, idx long, flag boolean")
    assert islands.runs(rows, ("session",), "idx", F.col("flag"), least=15).count() == found


def test_gap_policies(spark):
    rows = spark.createDataFrame([(1, i, True) for i in (0, 1, 5, 6)], "session long, idx long, flag boolean")
    extend = islands.runs(rows, ("session",), "idx", F.col("flag"), gap_policy="extend").collect()
    assert [(r.start, r.end, r.length) for r in extend] == [(0, 6, 7)]
    broken = islands.runs(rows, ("session",), "idx", F.col("flag"), gap_policy="break").orderBy("start").collect()
    assert [(r.start, r.end) for r in broken] == [(0, 1), (5, 6)]
    with pytest.raises(ValueError):
        islands.runs(rows, ("session",), "idx", F.col("flag"), gap_policy="other")


def test_still_and_joint(spark):
    row = lambda f, p, x: (1, p, f, 14, False, 0, 0.0, 0.0, 0.0, 0.0, x, 0.0)
    schema = "session int, player int, frame int, state int, airborne boolean, buttons long, stick_x double, stick_y double, cstick_x double, cstick_y double, x double, y double"
    rows = [row(f, p, 0.0 if p == 0 or f < 3 else float(f)) for f in range(5) for p in (0, 1)]
    still = islands.still(spark.createDataFrame(rows, schema))
    got = {(r.player, r.frame): r.still for r in still.collect()}
    assert [got[0, f] for f in range(5)] == [False, True, True, True, True]
    assert [got[1, f] for f in range(5)] == [False, True, True, False, False]
    joint = {r.frame: r.all_hold for r in islands.joint(still, ("session",), "frame", F.col("still"), 2).collect()}
    assert joint == {0: False, 1: True, 2: True, 3: False, 4: False}


def test_objects(spark):
    rows = [(1, 7, 0, -1, 5), (1, 7, 1, None, 5), (1, 7, 2, 2, 5), (1, 7, 3, 3, 5), (1, 8, 0, 1, 6)]
    got = islands.object_spans(spark.createDataFrame(rows, "session int, spawn int, frame int, owner int, kind int")).orderBy("spawn").collect()
    assert [(r.first, r.last, r.owners, r.pickups) for r in got] == [(0, 3, [-1, 2, 3], 1), (0, 0, [1], 0)]


def test_changed_spans_and_tiles(spark):
    rows = [(0, 0, c, int(c in (1, 2, 6)), 0) for c in range(8)]
    px = spark.createDataFrame(rows, "frame int, row int, col int, value int, before int")
    assert [(r.start, r.end) for r in islands.changed_spans(px).orderBy("start").collect()] == [(1, 2), (6, 6)]
    assert [r.tile_x for r in islands.changed_tiles(px, 4).orderBy("tile_x").collect()] == [0, 1]


def test_intervals_last_wins(spark):
    t = spark.createDataFrame([(1, i) for i in range(200)], "session long, idx long")
    spans = [(1, 10, 150, 1, "attacker"), (1, 100, 120, 2, "victim"), (1, 5, 2, 3, "never")]
    roles = spark.createDataFrame(spans, "session long, a long, b long, ordinal long, role string")
    got = {r.idx: r.role for r in joins.in_intervals(t, roles, "session", "idx", "a", "b", "ordinal").collect()}
    assert got == {i: "victim" if 100 <= i <= 120 else "attacker" for i in range(10, 151)}


def test_positional_join(spark):
    log = spark.createDataFrame([(i,) for i in range(5)], "frame int")
    images = spark.createDataFrame([(f"i{i}",) for i in range(7)], "image string")
    assert joins.by_place(log, images, ("frame",), ("image",)).count() == 5
    with pytest.raises(Exception, match="fewer rows"):
        joins.by_place(log, images.limit(4), ("frame",), ("image",)).collect()


def test_clip_actions(spark):
    clips = spark.createDataFrame([(1, 1, 3)], "session int, first_source int, last_source int")
    rows = [(1, f, p, f * 10 + p) for f in range(5) for p in (0, 1)]
    actions = spark.createDataFrame(rows, "session int, frame int, player int, mask int")
    assert [r.frame for r in joins.clip_actions(clips, actions).orderBy("frame").collect()] == [1, 2, 3]
    with pytest.raises(Exception, match="missing at frame 2"):
        joins.clip_actions(clips, actions.filter("NOT (frame = 2 AND player = 1)")).collect()


def test_opponents_and_pairs(spark):
    t = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "tick int, slot int, name string")
    got = {(r.tick, r.slot): [o["name"] for o in r.opponents] for r in joins.opponents(t, ["tick"], "slot", ["name"]).collect()}
    assert got == {(1, 0): ["b"], (1, 1): ["a"], (2, 0): []}
    assert [(r.name_0, r.name_1) for r in joins.ordered_pairs(t, ["tick"], "slot", ["name"]).collect()] == [("a", "b")]


def test_matching_and_status(spark):
    jobs = spark.createDataFrame([(1, "a", 5), (2, "b", None), (3, "c", 7)], "id int, reference string, size int")
    markers = spark.createDataFrame([(1, "a", 5), (2, "b", None), (3, "c", 8)], "id int, reference string, size int")
    assert sorted(r.id for r in joins.matching(jobs, markers, ["id", "reference", "size"]).collect()) == [1, 2]
    got = joins.done_or_skipped(jobs, markers, "id", F.col("size") > 5).orderBy("id").collect()
    assert [r.status for r in got] == ["skipped", "skipped", "done"]


def test_support_and_deep_sum(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (2, 0, "b"), (2, None, "b")], "session int, actor int, key string")
    assert [tuple(r) for r in coverage.support(rows).collect()] == [("a", 2, 1, 2), ("b", 2, 1, 1)]
    docs = spark.createDataFrame([('{"a":1,"b":{"c":2,"player":9}}',), ('{"a":3,"b":{"c":0.5},"l":[1]}',)], "doc string")
    assert {r.path: r.total for r in coverage.deep_sum(docs, skip=("player",)).collect()} == {"a": 4.0, "b.c": 2.5}
    items = spark.createDataFrame([("x", "k1"), ("y", "k1"), ("y", "k2"), ("z", "k3")], "item string, key string")
    assert set(coverage.rarest_first(items, "item", "key", 2)) == {"y", "z"}


def test_combos(spark):
    rows = [([("tap", 2, 5.0), ("swing", 1, 20.0)], 0.0, True, 0, 30, 40), ([("tap", 1, 4.0)], 50.0, False, 10, 12, 15)]
    eps = spark.createDataFrame(rows, "hits array<struct<name:string,hit_count:int,damage:double>>, start_percent double, killed boolean, start int, last_hit int, end int")
    r = coverage.combos(eps, [(2, False, "one"), (None, False, "more")], [(10, False, "low"), (None, False, "high")]).collect()[0]
    assert (r.total, r.kills, r.zero_to_deaths, r.damage, r.hits, r.tight_frames, r.frames) == (2, 1, 1, 29.0, 4, 34, 47)
    assert (r.hits_one, r.hits_more, r.damage_low, r.damage_high) == (1, 1, 1, 1)
    assert {x.name: x.landed for x in coverage.landed(eps).collect()} == {"tap": 3, "swing": 1}
    assert {x.name: x.episodes for x in coverage.landed(eps, once=True).collect()} == {"tap": 2, "swing": 1}


def test_nearest_rank(spark):
    data = sorted(random.Random(2).choices(range(100), k=37))
    df = spark.createDataFrame([(float(v),) for v in data], "v double")
    for p in (0, 0.5, 0.95, 1.0):
        got = df.agg(summary.nearest_rank("v", p)).first()[0]
        assert got == data[max(0, -(-len(data) * p // 1).__int__() - 1) if p else 0] or got == data[int(np.ceil(len(data) * p)) - 1]
    assert df.limit(0).agg(summary.nearest_rank("v", 0.5)).first()[0] is None


def test_winners(spark):
    schema = "session int, player int, stocks int, percent double"
    rows = [(1, 0, 2, 50.0), (1, 1, 1, 0.0), (2, 0, 1, 10.0), (2, 1, 1, 10.0), (3, 0, None, 1.0), (3, 1, 0, None)]
    got = {r.session: r.winner for r in summary.ranked(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: 0, 2: None, 3: 1}
    placed = spark.createDataFrame([(1, 0, 1, "game"), (1, 1, 0, "game"), (2, 0, 0, "no-contest")], "session int, player int, placement int, ending string")
    assert {r.session: r.winner for r in summary.placed_winner(placed).collect()} == {1: 1, 2: None}


@pytest.mark.parametrize(
    ("change", "rule"),
    [({}, []), ({"seconds": None}, ["no-timing"]), ({"seconds": 9.0}, ["too-slow"]), ({"row_count": 0, "binary_bytes": 0, "complete_rows": 0}, ["no-rows"]), ({"frame_entries": 0}, ["no-frames"]),
     ({"binary_bytes": 1}, ["size-mismatch"]), ({"skipped_rows": 1}, ["skipped-rows"]), ({"complete_rows": 1}, ["row-stats-mismatch"]), ({"last_frame": 1}, ["last-frame-mismatch"])],
)
def test_file_rules(spark, change, rule):
    from tickloom.schemas import REPORT_FILE

    good = {"path": "a", "seconds": 0.5, "row_count": 2, "frame_entries": 2, "binary_bytes": 264, "record_bytes": 132, "skipped_rows": 0, "complete_rows": 2, "last_frame": 9, "metadata_last_frame": 9}
    df = spark.createDataFrame([good | change], REPORT_FILE)
    assert summary.violations(df, summary.file_rules(1.0)).first().errors == rule


def test_archive_rollup(spark):
    rows = [("a", "complete", None, 80, 0), ("a", "complete", "skipped", 90, 1), ("b", "complete", None, 80, 2), ("b", "failed", None, 80, 3)]
    got = summary.archive_rollup(spark.createDataFrame(rows, "archive string, status string, artifact string, frames int, sample int"), 40, 40).collect()
    assert [(r.archive, r.samples, r.rows, r.clips, r.last_sample) for r in got] == [("a", 1, 2, 2, 1)]


def test_tau_bins_differ_at_edges(spark):
    rows = spark.createDataFrame([(t / 5, float(t)) for t in range(6)], "t double, v double")
    half = {r.bin: r.n for r in metrics.half_open_bins(rows, "t", "v").collect()}
    closed = {r.bin: r.n for r in metrics.right_closed_bins(rows, "t", "v").collect()}
    assert half == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1} and closed == {0: 2, 1: 1, 2: 1, 3: 1, 4: 1}


def test_change_shares(spark):
    rows = [(1, 0, 0, 0, 1, 1), (1, 0, 1, 0, 1, 1), (1, 1, 0, 0, 2, 1), (1, 1, 1, 0, 2, 1)]
    got = metrics.change_shares(spark.createDataFrame(rows, "session int, transition int, microstep int, player int, a int, b int"), ["a", "b"]).first()
    assert (got.features, got.steps, got.actors, got.transitions) == (0.125, 0.25, 0.5, 0.5)


def test_monotone_rows_and_last_update(spark):
    df = spark.createDataFrame([(1, i, f) for i, f in enumerate([1, 2, 2, 1, 4])], "session int, position int, frame int")
    assert [(r.frame, r.advance) for r in ticks.monotone(df).orderBy("position").collect()] == [(1, 1), (2, 1), (4, 2)]
    assert [r.position for r in ticks.without_repeats(df).orderBy("position").collect()] == [0, 1, 3, 4]
    dup = spark.createDataFrame([(1, 5, 0, 1, "x"), (1, 5, 0, 2, "y")], "session int, frame int, player int, position int, v string")
    assert ticks.last_update(dup).first().v == "y"


def test_actor_rows_and_completeness(spark):
    df = spark.createDataFrame([(1, ("a",), None), (2, ("b",), ("c",))], "tick int, leader struct<n:string>, follower struct<n:string>")
    assert sorted((r.tick, r.is_follower, r.actor.n) for r in ticks.actor_rows(df).collect()) == [(1, False, "a"), (2, False, "b"), (2, True, "c")]


def test_sets(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3)], "reference string, v int")
    assert [(r.reference, r.sample) for r in sets.numbered(df, "reference").orderBy("sample").collect()] == [("a", 0), ("b", 1), ("c", 2)]
    assert sets.unique(df, "reference").count() == 3
    with pytest.raises(Exception, match="repeated key: a"):
        sets.unique(df.union(df.filter("v = 2")), "reference").collect()
    with pytest.raises(ValueError):
        sets.bounded_subset(df, 4, "v")
    flags = spark.createDataFrame([(31, [2, 20]), (31, [20, 2]), (31, [2, 2]), (30, [2, 20])], "stage int, chars array<int>").select(sets.matchup("stage", "chars", 31, [20, 2])).collect()
    assert [r[0] for r in flags] == [True, True, False, False]


def test_every_third_and_last():
    assert windows.every_third_and_last(7) == [0, 3, 6]
    assert windows.every_third_and_last(8) == [0, 3, 6, 7]
    assert windows.every_third_and_last(0) == []


def test_vectors(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(60, 4)) * [5, 3, 1, 0.1]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(data)], "id int, v array<double>")
    mean, axes = vectors.principal_axes(df, "v", 2)
    assert np.allclose(mean, data.mean(0))
    expect = np.linalg.eigh(np.cov(data.T, bias=True))[1][:, ::-1][:, :2].T
    assert np.allclose(vectors.aligned_axes(axes, expect), expect)
    assert len(vectors.on_axes(df, "v", mean, axes).first().components) == 2
    code = vectors.projected(df, "v", 2).first()
    assert len(code.code) == 2 and max(map(abs, code.code)) == 127
    img = rng.integers(0, 255, (32, 32))
    assert vectors.best_shift(img, np.roll(img, (-2, -3), (0, 1)), 4, 1)[:2] == (3, 2)


def test_team_winner_by_percent_and_null_team(spark):
    rows = [(1, "a", 2, 50.0), (1, "b", 1, 10.0), (1, "b", 1, 20.0), (2, "a", 2, 5.0), (2, "b", 2, 5.0), (3, "a", 3, 0.0), (3, None, 1, 0.0), (4, "a", 2, None), (4, "b", 2, 1.0), (5, "a", 2, 9.0), (5, "b", None, 0.0)]
    df = spark.createDataFrame(rows, "session long, team string, stocks long, percent double")
    won = lambda **k: {r.session: r.winner for r in summary.team_winner(df, **k).collect()}
    assert won(percent="percent") == {1: "b", 2: None, 3: None, 4: "a", 5: None}
    assert won() == {1: None, 2: None, 3: None, 4: None, 5: None}
