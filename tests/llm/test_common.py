"""Scratch tables and what workers hold."""

from pathlib import Path

from tickloom.llm import common


def test_cut_writes_below_the_named_folder(spark):
    root = common.scratch_root(spark)
    assert root.startswith(spark.conf.get("spark.checkpoint.dir"))
    out = common.cut(spark.range(5), "some")
    assert out.count() == 5 and out.inputFiles()[0].startswith(root)
    assert common.cut(spark.range(0), "none").dtypes == spark.range(0).dtypes
    folder = Path(root.removeprefix("file://"))
    assert any(p.name.startswith("some-") for p in folder.iterdir())


def test_one_thing_is_held():
    made = []
    make = lambda k: lambda: made.append(k) or k
    assert [common.held(k, make(k)) for k in ("a", "a", "b", "a")] == ["a", "a", "b", "a"]
    assert made == ["a", "b", "a"]


def test_renamed_leaves_other_columns_out(spark):
    df = spark.createDataFrame([(1, "x", 2)], "a long, `t.x` string, doc_id long")
    assert common.renamed(df, doc_id="a", text="t.x").columns == ["doc_id", "text"]


def test_nothing_else_imports_the_subpackage():
    root = Path(common.__file__).parent.parent
    others = [p for p in root.rglob("*.py") if root / "llm" not in p.parents]
    assert others and not [p for p in others if "llm" in p.read_text()]
