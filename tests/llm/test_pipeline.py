"""The pipeline's stages, each over what the one before kept."""

import re

import pytest

import corpus_pipeline
from tickloom.llm import packing, secrets, simhash
from tickloom.llm.common import cut, table

ROWS = [
    (1, "the house and the garden " * 30, "en", "a", 0),
    (2, "the house and the garden " * 30, "en", "b", 0),
    (3, "das haus und der garten " * 30, "de", "a", 0),
    (4, 'the token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" of the king', "en", "b", 0),
    (5, "1234 !!", None, None, 0),
    (6, None, "en", "a", 0),
    (None, "the old garden and the king", None, "a", None),
]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.createDataFrame([r[:2] + r[2:] for r in ROWS] + [(100 + i, f"the garden of king number {i} and der {i} garten " * (i % 7 + 1), "en", "c", 1) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(cut(stage(spark, out[-1], ""), name))
    return out


def test_stages(stages):
    docs, named, single, masked, mixed, packed = stages
    assert all(s.columns == docs.columns for s in stages[:-1])
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in named.collect()} == {5, 6}
    ids = {r.doc_id for r in single.collect()}
    assert 1 in ids and 2 not in ids and None in ids and {3, 4} <= ids
    assert masked.count() == single.count() and not any(re.search("[0-9a-f]{24}", r.text) for r in masked.collect())
    words = {r.doc_id: len(r.text.split()) for r in masked.collect()}
    taken = {}
    for r in mixed.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.split())
    assert set(taken) <= set(words) and all(n <= 3 * words[i] for i, n in taken.items())
    assert abs(sum(taken.values()) - sum(words.values())) <= 8
    enc = packing.encoder()
    assert packed.agg({"length": "sum"}).first()[0] == sum(len(x) // 4 + 1 for x in enc.encode([r.text for r in mixed.collect()]))


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "copy", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    rows = got.collect()
    assert len({(r["copy"], r.piece) for r in rows}) == len(rows) and all(len(r.ids) == 4 * r.length for r in rows)
    ids = {r.doc_id for r in got.select("doc_id").distinct().collect()}
    kept = {r.doc_id for r in simhash.deduplicated(table(spark, sf, "documents")).select("doc_id").collect()}
    assert ids <= kept and len(ids) > 0.4 * len(kept)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_secrets_are_gone(stages):
    assert secrets.base_spans(stages[3].filter("doc_id = 4").first().text) == []


def test_extra_columns_that_clash(spark):
    extra = ["size", "target", "taken", "source_size", "fp", "component_id", "rep", "root", "lang_pred", "score", "spans", "kept", "words", "block", "sid"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    rows = [(i, t, "en", s, None, *["x"] * len(extra)) for i, (t, s) in enumerate([("the garden of the king " * 9, "a"), (None, None), ("the old house and a token = abcdefgh12", None), ("w" * 150_000 + " the king", "b")])]
    docs = spark.createDataFrame([*rows, rows[0]], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert out.count() > 0
        docs = cut(out, name)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= 2
