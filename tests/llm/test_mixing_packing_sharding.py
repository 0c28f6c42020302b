"""Mixing, packing, sharding and vector search against plain versions."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickloom.llm import mixing, packing, queries, sharding, vectors
from tickloom.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, held = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in held)
        free = [s for s in names if s not in held]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in held else share[s] for s in names}
        held |= over


def check_mix(rows, docs, block):
    """Figures of every row, and each source within a few blocks of its target."""
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += len(WORD.findall(text or ""))
    targets = plain_targets(sizes)
    taken = defaultdict(int)
    assert len(rows) == len(docs)
    by_id = {i: (t, s) for i, t, s in docs}
    for r in rows:
        text, source = by_id[r.doc_id]
        assert r.size == len(WORD.findall(text or "")) and r.source_size == sizes[source]
        assert r.target == pytest.approx(targets[source])
        assert 0 <= r.taken <= 3 * r.size and (r.first_slot is not None) == (r.taken > 0)
        taken[source] += r.taken
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 5 * block


def plain_mix(docs, block=None, step=mixing.STEP):
    """Slot by slot: the point names a source, whose stream is read on by a block."""
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += len(WORD.findall(text or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goals = [int(plain_targets(sizes)[s] + 1e-9) for s in names]
    whole = sum(goals)
    block = block or max(1, min(mixing.BLOCK_TOKENS, whole // mixing.SLOTS))
    order, taken, first = {}, defaultdict(int), {}
    for s in names:
        place = lambda d: hashlib.md5(f"{'' if d[0] is None else d[0]}|17|{hashlib.md5((d[1] or '').encode()).hexdigest()}".encode()).hexdigest()
        order[s] = [i for i, t, _ in sorted((d for d in docs if d[2] == s), key=place) for _ in WORD.findall(t or "")]
    at = dict.fromkeys(names, 0)
    ends = np.cumsum(goals) / whole
    for slot in range(-(-whole // block)):
        s = names[int(np.searchsorted(ends, (slot + 1) * step % 1.0, side="right"))]
        for k in range(at[s], min(at[s] + block, 3 * sizes[s])):
            i = order[s][k % sizes[s]]
            taken[i] += 1
            first.setdefault(i, slot)
        at[s] += block
    return {i: (taken[i], first.get(i)) for i, _, _ in docs}


def test_mix_query(spark, sf):
    docs = [(r.doc_id, r.text, r.source) for r in table(spark, sf, "documents").collect()]
    rows = queries.op3_mixing(spark, sf).collect()
    check_mix(rows, docs, 1 + sum(r.size for r in rows) // mixing.SLOTS)
    assert {r.doc_id: (r.taken, r.first_slot) for r in rows} == plain_mix(docs)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.sql(f"SELECT doc_id, size, source_size, target, taken, first_slot FROM ({queries.OP3_SQL})").fetchall()}
    assert {r.doc_id: (r.size, r.source_size, r.target, r.taken, r.first_slot) for r in rows} == want
    assert sorted(queries.op3_mixing(spark, sf).collect()) == sorted(rows)


@pytest.mark.parametrize("block", [1, 7, 64, 10_000])
def test_mix_any_block(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "GROUP_ROWS", 16)
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 2)
    rng = random.Random(block)
    docs = [(i, " ".join(["w"] * rng.randrange(0, 60)) if i % 9 else None, rng.choice(["a", "a", "a", "b", "é", None, "z"])) for i in range(150)]
    docs.append((1000, "x " * 4000, "a"))
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mix(df, block=block).collect()
    check_mix(rows, docs, block)
    assert {r.doc_id: (r.taken, r.first_slot) for r in rows} == plain_mix(docs, block)
    assert {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in mixing.mix(df.repartition(5), block=block).collect()}


def test_the_points_decide(spark, monkeypatch):
    docs = [(i, "w " * (i % 30), "abc"[i % 3]) for i in range(90)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert {r.doc_id: r.taken for r in mixing.mix(df).collect()} == {i: t for i, (t, _) in plain_mix(docs).items()}
    monkeypatch.setattr(mixing, "STEP", 0.0)
    assert {r.doc_id: r.taken for r in mixing.mix(df).collect()} == {i: t for i, (t, _) in plain_mix(docs, step=0.0).items()}
    assert {r.source for r in mixing.mixed(df).collect()} == {"a"}


def test_schedule_follows_the_shares(spark):
    targets = spark.createDataFrame([(1, 6000.0, 9000), (2, 3000.0, 1000), (3, 1.0, 50), (4, 0.0, 0)], "sid int, target double, source_size long")
    rows = mixing.schedule(targets, 10).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(901))
    counts = defaultdict(list)
    for r in rows:
        counts[r.sid].append(r["rank"])
    assert all(v == list(range(len(v))) for v in counts.values()) and 4 not in counts
    for n in (90, 300, 600, 901):
        assert abs(sum(r.sid == 1 for r in rows[:n]) - n * 6000 / 9001) < 4


def test_mixed_documents(spark, tmp_path):
    made = spark.createDataFrame([(i, f"  a{i} b\tc{i}\n d ", "x" if i else "y", 9, "k") for i in range(30)] + [(50, None, "y", 0, "k"), (51, "", None, 0, "k")], "doc_id long, text string, source string, n_chars long, size string")
    made.write.parquet(f"{tmp_path}/docs")
    for df in (made, spark.read.parquet(f"{tmp_path}/docs")):
        out = mixing.mixed(df)
        assert out.columns == df.columns
        words, slots = defaultdict(int), {r.doc_id: r.first_slot for r in mixing.mix(df).collect()}
        first = []
        for r in out.collect():
            if r.doc_id not in words:
                first.append(slots[r.doc_id])
            words[r.doc_id] += len(WORD.findall(r.text))
            assert df.filter(F.col("doc_id") == r.doc_id).first().text.startswith(r.text) and r.n_chars == len(r.text)
        assert dict(words) == {r.doc_id: r.taken for r in mixing.mix(df).collect() if r.taken}
        assert first == sorted(first)
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0
    assert mixing.mix(df.filter("doc_id >= 50")).agg(F.sum("taken")).first()[0] == 0


def test_mix_of_repeated_and_null_ids(spark):
    docs = [(None, f"w{i} a b c", "s") for i in range(40)] + [(7, "one two three", "t")] * 20 + [(8, "x y", None), (8, "z", None), (None, None, "s")]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, source string, row long, target string")
    rows = mixing.mix(df).collect()
    assert len(rows) == len(docs) and sorted(map(str, rows)) == sorted(map(str, mixing.mix(df.repartition(3)).collect()))
    taken = sum(r.taken for r in rows)
    assert abs(taken - sum(r.size for r in rows)) <= 4
    assert sum(len(r.text.split()) for r in mixing.mixed(df).collect()) == taken


def check_packing(rows, docs, limit=2048):
    tk = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    ids = {i: np.array([*tk.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in docs}
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == list(range(0, len(ids[i]), limit))
        for r in own:
            part = ids[i][r.start : r.start + limit]
            assert r.length == len(part) and r.ids_crc32 == zlib.crc32(part.tobytes())
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limit
    total = sum(len(x) for x in ids.values())
    return len(bins), -(-total // limit)


def test_packing_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    bins, least = check_packing(queries.op4_packing(spark, sf).collect(), docs)
    assert bins <= least + 1


def test_packing_odd_texts(spark):
    texts = [None, "", " ", "a\x1cb <|endoftext|>x", "É é ßẞ İSTANBUL ΣΑΣ", "don't we'LL 12ab3 (x)...!!", "字" * 3000, "word " * 9000, "x" * 50_000, "a\xa0b c​d", "'s's ''t"]
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, length long")
    check_packing(packing.packed_sequences(df).collect(), docs)
    twice = packing.packed_sequences(df.filter("doc_id = 3").unionAll(df.filter("doc_id = 3"))).collect()
    assert len(twice) == 2 and len({(r.sequence_id, r.offset) for r in twice}) == 2
    assert packing.packed_sequences(df.limit(0)).count() == 0
    kept = packing.packed_sequences(df.filter("doc_id = 5"), keep_ids=True).first()
    assert zlib.crc32(bytes(kept.ids)) == kept.ids_crc32


MARKS = "\u0307\u0301\u093c\u05bc\u0338\u200d\u0130\u0958\u095c\ufb1d\ufb2a\u1e9e\u03a3"


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(".,$!-_'s|<>=?0a" + MARKS)), max_size=8), max_size=6))
def test_ids_of_any_text(words):
    enc = packing.encoder()
    texts = [" ".join(words), *words, *(w + "." for w in words), *("$" + unicodedata.normalize("NFD", w) for w in words)]
    got = [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)]
    assert got == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("text", ["aİ.", "İ$", "क़.", "ड़,", "יִ.", "שׁ!", "a\u0338=", "=\u0338a."])
def test_ids_of_letters_that_end_in_marks(text):
    want = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER)).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.encoder().encode([text])[0], "<u4").tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=80))
def test_search_never_worsens(lengths):
    first = packing.best_fit(lengths, 100)
    done = packing.improve([list(b) for b in first], lengths, 100)
    for bins in (first, done):
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= 100 for b in bins)
    square = lambda bins: sum(sum(lengths[i] for i in b) ** 2 for b in bins)
    assert len(done) <= len(first) and square(done) >= square(first)


def test_search_empties_a_bin():
    lengths = [51, 27, 26, 23, 24, 49]
    bins = [[0, 3, 4], [1, 2], [5]]
    assert len(packing.improve(bins, lengths, 100)) == 2


def check_shards(rows, docs, shards=16):
    size = {i: len((t or "").encode()) + 1 for i, t in docs}
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in docs)
    by = defaultdict(list)
    for r in rows:
        assert r.size == size[r.doc_id] and r.text_crc32 == zlib.crc32((dict(docs)[r.doc_id] or "").encode())
        by[r.shard].append(r)
    order = []
    for k in sorted(by):
        own = sorted(by[k], key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own))) and 0 <= k < shards
        order += [r.doc_id for r in own]
    assert order == sorted(order)
    total, most = sum(size.values()), max(size.values())
    assert all(abs(sum(r.size for r in by[k]) - total / shards) <= most + 1 for k in range(shards) if by[k])


def test_shard_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    rows = queries.op5_sharding(spark, sf).collect()
    check_shards(rows, docs)
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}


def test_shards_of_odd_tables(spark):
    docs = [(i, None if i % 5 == 0 else "é" * (i % 40)) for i in range(200)] + [(999, "x" * 30_000)]
    df = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, shard int")
    check_shards(sharding.byte_shards(df).collect(), docs)
    assert sharding.byte_shards(df.limit(0)).count() == 0
    same = sharding.byte_shards(spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string"), 2).collect()
    assert len(same) == 3 and len({(r.shard, r.slot) for r in same}) == 3


def plain_neighbours(rows, k=20):
    rows = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and None not in v]
    rows = [(i, v) for i, v in rows if np.isfinite(v).all() and v.any()]
    out = {}
    for q, qv in rows:
        if q % 20 == 0:
            out[q] = sorted(((-float((v * qv).sum()), i) for i, v in rows if i != q))[:k]
    return out


def check_neighbours(rows, want, least=0.9):
    got = defaultdict(list)
    for r in rows:
        got[r.query_id].append(r)
    assert set(got) == {q for q, w in want.items() if w}
    hits = total = 0
    for q, own in got.items():
        own.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(want[q]) + 1))
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        hits += len({r.vec_id for r in own} & {i for _, i in want[q]})
        total += len(want[q])
    assert hits >= least * total


def test_vector_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    check_neighbours(queries.op6_vectors(spark, sf).collect(), plain_neighbours(rows))


def test_vectors_with_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 50)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 3)
    monkeypatch.setattr(vectors, "RUN_BLOCKS", 2)
    rng = np.random.default_rng(2)
    common = rng.normal(size=40).tolist()
    rows = [(i, common if i % 3 == 0 else (rng.normal(size=40) * rng.uniform(0.1, 5)).tolist()) for i in range(300)]
    rows += [(300, None), (320, [0.0] * 40), (340, [float("nan")] * 40), (360, [None] + [1.0] * 39), (380, [float("inf")] * 40), (None, common), (400, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    want = plain_neighbours([(i, None if v is None or len(v) != 40 else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    found = vectors.neighbours(df).collect()
    check_neighbours(found, want, 0.98)
    for q in (0, 60):  # of the equal vectors those of the smallest ids
        copies = [r.vec_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q and r.vec_id % 3 == 0]
        assert copies == [i for i in range(0, 300, 3) if i != q][: len(copies)]
    assert vectors.neighbours(df.limit(0)).count() == 0
    assert vectors.neighbours(df.filter("vec_id = 0")).count() == 0
    assert vectors.neighbours(df.filter("vec_id in (0, 1, 2)")).count() == 2


def test_bounds_hold():
    rng = np.random.default_rng(7)
    for dim in (3, 64, 100):
        v, q, turn = rng.normal(size=(500, dim)), rng.normal(size=(20, dim)), vectors.rotation(dim)
        assert np.allclose(turn @ turn.T, np.eye(dim))
        guess, bound = vectors.estimate(q, turn, *vectors.encode(v, turn))
        assert (np.abs(guess - q @ v.T) <= bound).mean() > 0.98


def test_packing_tasks_bounded_by_tokens(spark):
    docs = spark.createDataFrame([(i, "word " * (5 + i % 40)) for i in range(60)], "doc_id long, text string")
    cut_pieces = packing.pieces(docs, keep_ids=True)
    rows = packing.pack(cut_pieces, task_tokens=300).collect()
    assert len({r["sequence_id"] >> 32 for r in rows}) > 1
    assert sorted((r["doc_id"], bytes(r["ids"])) for r in rows) == sorted((r["doc_id"], bytes(r["ids"])) for r in cut_pieces.collect())
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= packing.SEQUENCE_TOKENS
