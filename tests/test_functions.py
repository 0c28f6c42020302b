import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F

from tickloom.functions import arrays, bins, bits, hashes, numbers, text


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_text(spark):
    names = [("Red & Blue-2",), ("  a..b ",), ("",), (None,)]
    assert values(spark, names, "s string", text.key("s")) == [("RED AND BLUE 2",), ("A B",), ("",), (None,)]
    assert values(spark, names, "s string", text.slug("s")) == [("Red-Blue-2",), ("a..b",), ("item",), ("item",)]
    assert values(spark, [("/raw/x/",)], "s string", text.join_path("s", F.lit("foo"), F.lit("bar.bin"))) == [("raw/x/foo/bar.bin",)]
    assert values(spark, [("o/n/p/q",), ("o/n",)], "s string", *text.location("s")) == [("o/n", "p/q"), ("o/n", "")]
    assert values(spark, [("a.tar::m/x.bin",), ("a.tar",)], "s string", *text.reference("s")) == [("a.tar", "m/x.bin"), ("a.tar", None)]
    assert values(spark, [("../x",), ("a/b",), ("/a",), (None,)], "s string", text.safe_member("s")) == [(False,), (True,), (False,), (False,)]
    assert values(spark, [("Gold-Silver-x.bin",), ("x.bin",)], "s string", *text.ranks("s")) == [("gold", "silver"), (None, None)]
    assert values(spark, [("f_0012.png",), ("f.png",)], "s string", text.suffix_number("s")) == [(12,), (None,)]
    assert values(spark, [(61.5,), (0.0,)], "d double", text.clock("d")) == [("1:01.500",), ("0:00.000",)]
    assert values(spark, [(-7,), (12,)], "n long", text.numbered("n", 4)) == [("-0007",), ("0012",)]
    assert values(spark, [('a"b',), ("a,b",), ("ab",), (None,)], "s string", text.csv_field("s")) == [('"a""b"',), ('"a,b"',), ("ab",), ("",)]
    assert values(spark, [("1.10",), ("1.9.0",), (None,), ("2",)], "s string", text.version_at_least("s", "1.10.0")) == [(True,), (False,), (False,), (True,)]
    assert values(spark, [("HTTP 503",), ("not found",), (None,)], "s string", text.transient("s")) == [(True,), (False,), (False,)]
    assert values(spark, [("a/raw/x.bin",), ("a/b.bin",), ("a/b.txt",)], "s string", text.included("s", ["*.bin"], ["*/raw/*"])) == [(False,), (True,), (False,)]
    with pytest.raises(Exception, match="leaves its root"):
        values(spark, [("a/../b",)], "s string", text.safe_path("s"))
    assert text.scrubbed({"env": {"A": "1"}, "apiKey": "x", "n": [{"token": 3, "ok": 1}]}) == {"env": {"A": "***"}, "apiKey": "***", "n": [{"token": "***", "ok": 1}]}


def test_names_found_prefers_alias_then_longest(spark):
    column = text.names_found("s", {"OAK": "oak", "RED OAK": "red", "ELM": "elm"}, {"SHADE TREE": "elm"})
    got = values(spark, [("Red. Oak [tag] + Shade Tree",), ("Oak+nobody",)], "s string", column)
    assert got == [(["elm", "red"],), (["oak"],)]


def test_numbers(spark):
    assert values(spark, [(math.nan,), (math.inf,), (1.23456789,), (None,)], "d double", numbers.finite_or_null("d")) == [(None,), (None,), (1.234568,), (None,)]
    assert values(spark, [(39,), (40,), (79,), (80,)], "n long", numbers.clip_count("n", 40, 40)) == [(0,), (1,), (1,), (2,)]
    assert values(spark, [(0, 3), (4, 0)], "a long, b long", numbers.ratio("a", "b")) == [(0.0,), (4.0,)]
    assert values(spark, [(-39, -30), (-39, -31)], "a int, b int", numbers.grid_last("a", "b")) == [(-30,), (-33,)]
    assert values(spark, [(0,), (5,), (9,)], "n long", numbers.backoff("n", 1, 60)) == [(1.0,), (32.0,), (60.0,)]
    assert values(spark, [(599,), (600,)], "n long", numbers.recovered(F.lit(0), F.lit(700), "n")) == [(False,), (True,)]
    with pytest.raises(Exception, match="shorter than one clip"):
        values(spark, [(39,)], "n long", numbers.clip_count("n", 40, 40, strict=True))
    with pytest.raises(Exception, match="finite"):
        values(spark, [(math.inf,)], "d double", numbers.finite_or_raise("d"))


def test_bits(spark):
    assert values(spark, [(1, 2), (3, 1)], "a long, b long", bits.pressed("a", "b"), bits.released("a", "b")) == [(2, 1), (0, 2)]
    assert values(spark, [(0xFFFFFFFF,), (5,)], "a long", bits.popcount("a")) == [(32,), (2,)]
    assert values(spark, [(5,)], "a long", bits.unpacked("a", 4)) == [([1, 0, 1, 0],)]
    numbers_ = [0, -1, 1, -64, 300, 2**40]
    assert [r[0] for r in values(spark, [(n,) for n in numbers_], "a long", bits.unzigzag(bits.zigzag("a")))] == numbers_
    big = [0, 1, 127, 128, 300, 2**40]
    assert [r[0] for r in values(spark, [(n,) for n in big], "a long", bits.unvarint(bits.varint("a")))] == big
    assert bytes(values(spark, [(300,)], "a long", bits.varint("a"))[0][0]) == b"\xac\x02"


@pytest.mark.parametrize(("value", "name"), [(0, "0"), (0.5, "1-39"), (39.9, "1-39"), (40, "40-79"), (200, "200+")])
def test_percent_edges(spark, value, name):
    assert values(spark, [(float(value),)], "d double", bins.binned("d", bins.PERCENT)) == [(name,)]


@pytest.mark.parametrize(("value", "name"), [(-100.1, "far-left"), (-100, "left"), (-35, "center"), (35, "center"), (35.1, "right"), (100, "right"), (100.1, "far-right")])
def test_x_edges(spark, value, name):
    assert values(spark, [(float(value),)], "d double", bins.binned("d", bins.X)) == [(name,)]


def test_lookup_and_classes(spark):
    assert values(spark, [(1,), (9,), (None,)], "n int", bins.looked_up("n", {1: "one"})) == [("one",), ("unknown(9)",), ("unknown(null)",)]
    ranges = [(0, 10, "dead"), (5, 20, "hurt"), (266, None, "special")]
    assert values(spark, [(7,), (15,), (300,), (50,)], "n int", bins.state_class("n", ranges)) == [("dead",), ("hurt",), ("special",), ("other",)]


def test_arrays(spark):
    a = [([1.0, 2.0, 2.0], [2.0, 0.0, 1.0])]
    got = values(spark, a, "a array<double>, b array<double>", arrays.norm("a"), arrays.dot("a", "b"), arrays.mean_squared_error("a", "b"), arrays.mean_absolute_error("a", "b"))
    assert got == [(3.0, 4.0, 2.0, 4 / 3)]
    assert values(spark, [([1, 2],)], "a array<int>", arrays.padded("a", 3), arrays.padding_mask("a", 3)) == [([1, 2, 2], [True, True, False])]
    assert values(spark, [(1,), (2,), (9,)], "n int", arrays.first_middle_last("n")) == [([0],), ([0, 1],), ([0, 4, 8],)]
    assert values(spark, [(3,), (9,)], "n int", arrays.spread("n", 5)) == [([0, 1, 2],), ([0, 2, 4, 6, 8],)]
    with pytest.raises(Exception, match="sizes differ"):
        values(spark, [([1], [1, 2])], "a array<int>, b array<int>", arrays.zip_strict("a", "b"))
    with pytest.raises(ValueError, match="unknown representation"):
        arrays.microsteps("a", "other")


def test_hashes(spark):
    doc = hashes.canonical_json({"b": hashes.json_text("s"), "a": hashes.json_number("d", 2)})
    assert values(spark, [('x"y', 1.5), ("z", None)], "s string, d double", doc) == [('{"a":1.50,"b":"x\\"y"}',), ('{"a":null,"b":"z"}',)]
    with pytest.raises(Exception, match="finite"):
        values(spark, [("z", math.nan)], "s string, d double", doc)
    assert values(spark, [(b"abc",), (None,)], "s binary", hashes.blake2b("s")) == [(hashlib.blake2b(b"abc", digest_size=32).hexdigest(),), (None,)]
    assert values(spark, [("abc",)], "s string", hashes.seed_mix("s", 5)) == [(zlib.crc32(b"abc") ^ 5,)]
