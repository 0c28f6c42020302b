"""SimHash near-duplicates, components and suffix dedup against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tickloom.llm import components, queries, simhash, suffixes
from tickloom.llm.common import table


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys(map(ord, "\t\n\x0b\f\r"), " ")).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius=2):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    groups = defaultdict(list)
    for i in range(len(ids)):
        groups[find(i)].append(ids[i])
    return {x: min(g) for g in groups.values() for x in g}


@pytest.mark.parametrize("text", [None, "", " \n", "one", "A b", "x y z", "É Ö ß é w", "a " * 5000, "w\x0bv\fu\rt s\xa0r"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_query_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op8_simhash(spark, sf).collect()}
    fps = [brute_fingerprint(r.text) for r in docs]
    assert len(got) == len(docs)
    assert all(got[r.doc_id].fingerprint == f"{f:016x}" for r, f in zip(docs, fps))
    assert {k: v.component_id for k, v in got.items()} == brute_components([r.doc_id for r in docs], fps)


def test_links_of_crafted_fingerprints(spark):
    rng = random.Random(3)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(8):
            fps.add(base)
            base ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(s,) for s in signed], "fp long")
    for tile_rows in (1, 8192):
        labels = {r.node: r.root for r in components.component_labels(simhash.links(nodes, 2, tile_rows)).collect()}
        want = brute_components(signed, fps)
        for s in signed:
            assert labels.get(s, s) == want[s]


def test_clique_gives_few_edges():
    rng = np.random.default_rng(0)
    fps = np.unique(np.array([1 << int(b) for b in rng.integers(0, 64, 400)], np.uint64))
    u, v = simhash.link_tile(fps, np.zeros(0, np.uint64), 2)
    assert len(u) == len(fps) - 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (5, 5), (200, 300), (300, 250)]
    got = {r.node: r.root for r in components.component_labels(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 200: 200, 300: 200, 250: 200}
    assert components.component_labels(spark.createDataFrame([], "u long, v long")).count() == 0


def test_odd_tables(spark):
    schema = "doc_id long, text string, fp int, rep string, tile long"
    rows = [(1, "a b c d", 1, "x", 2), (1, "a b c d", 1, "x", 2), (2, None, None, None, None), (3, "", 0, "", 0), (None, "a b c d", 1, "x", 2), (None, "other words here", 1, "x", 2)]
    df = spark.createDataFrame(rows, schema)
    got = sorted(str((r.doc_id, r.component_id)) for r in simhash.near_duplicates(df).collect())
    assert got == sorted(map(str, [(None, None), (None, 1), (1, 1), (1, 1), (2, 2), (3, 2)]))
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "None", "None"]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.deduplicated(df.limit(0)).count() == 0


def test_rows_of_one_id_with_different_texts(spark):
    rng = random.Random(4)
    a, b, c = (" ".join(rng.choices([f"w{i}" for i in range(500)], k=60)) for _ in range(3))
    rows = [(3, a, "x", 1), (5, b, "x", 2), (5, a, "x", 3), (5, c, "x", 4), (5, c, "x", 5), (5, c, None, 5), (9, c, "y", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key string, _kept_id int")
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns
    got = sorted((r[0], r[1]) for r in kept.collect())
    assert got == sorted([(3, a), (5, b), (5, c)])


def brute_repeats(docs, least=50):
    where = defaultdict(set)
    words = {i: (t or "").encode().lower().split() for i, t in docs}
    for i, w in words.items():
        for k in range(len(w) - least + 1):
            where[tuple(w[k : k + least])].add(i)
    out = {}
    for i, w in words.items():
        cover = set()
        for k in range(len(w) - least + 1):
            if len(where[tuple(w[k : k + least])]) > 1:
                cover.update(range(k, k + least))
        if cover:
            out[i] = cover
    return out


def covered(df):
    out = defaultdict(set)
    for r in df.collect():
        out[r.doc_id].update(range(r.start_word, r.end_word))
    return dict(out)


def test_repeats_of_planted_passages(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 60, 200)]
    docs = []
    for i in range(60):
        body = [word() for _ in range(rng.randrange(0, 120))]
        p = passages[i % 5]
        docs.append((i, " ".join(body + p + [word() for _ in range(rng.randrange(0, 90))])))
    docs += [(100, " ".join([word() for _ in range(40)])), (101, " ".join(["tick"] * 300)), (102, None), (103, "")]
    got = covered(suffixes.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")))
    want = brute_repeats(docs)
    assert set(got) == set(want) and 101 not in got
    for i, c in want.items():
        assert c <= got[i] and len(got[i] - c) <= 2


def test_repeats_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "TASK_SUFFIXES", 10)
    rng = random.Random(6)
    text = " ".join("".join(rng.choices("abcd", k=5)) for _ in range(80))
    docs = [(i, text) for i in range(50)] + [(60, " ".join("w%d" % k for k in range(99)))]
    got = covered(suffixes.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got == {i: set(range(80)) for i in range(50)}


def test_repeats_query_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    got, want = covered(queries.op1_suffixes(spark, sf)), brute_repeats(docs)
    assert got == want


def test_repeats_of_odd_tables(spark):
    text = " ".join(f"w{k}" for k in range(70))
    df = spark.createDataFrame([(1, text, 5), (1, text, 5), (None, text, 5), (2, None, None)], "doc_id long, text string, a long")
    assert suffixes.repeated_passages(df).count() == 0
    assert suffixes.repeated_passages(df.limit(0)).count() == 0
    assert covered(suffixes.repeated_passages(df.unionAll(spark.createDataFrame([(3, text, 1)], df.schema)))) == {1: set(range(70)), 3: set(range(70))}
    assert suffixes.repeated_passages(df.withColumn("start_word", F.lit(1))).columns == ["doc_id", "start_word", "end_word", "partner_id"]


def test_repeats_of_periodic_text(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    docs = []
    for i, n in enumerate((400, 90, 55, 30)):
        docs.append((i, " ".join([word() for _ in range(60)] + ["tick", "tock"] * (n // 2) + [word() for _ in range(70)] + ["tick", "tock"] * (n // 4) + [word()])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = suffixes._suffix_rows(np.array([0]), [np.array(suffixes.hashed_words(docs[0][1]), np.uint64)])
    assert kept.num_rows < 60  # not a row for each place of the periodic text
    got, want = covered(suffixes.repeated_passages(df)), brute_repeats(docs)
    assert set(got) == set(want) == {0, 1, 2}
    for i, c in want.items():
        assert c <= got[i]
    assert got[0] == want[0] and got[1] == want[1]


def repeats_of(spark, docs):
    return covered(suffixes.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")))


def test_repeats_behind_a_stem_that_all_share(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    docs = []
    for run in range(4):
        stem = [word() for _ in range(45)]
        for pair in range(50):
            more = [word() for _ in range(6)]
            for k in range(2):
                docs.append((len(docs), " ".join([word() for _ in range(20)] + stem + more + [word() for _ in range(20)])))
    got = repeats_of(spark, docs)
    assert got == brute_repeats(docs) and len(got) == len(docs)


def test_repeats_whose_head_stands_twice_in_both(spark):
    rng = random.Random(10)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    docs = []
    for pair in range(100):
        stem = [word() for _ in range(45)]
        more = [word() for _ in range(8)]
        for k in range(2):
            docs.append((len(docs), " ".join([word() for _ in range(20)] + stem + [word() for _ in range(20)] + stem + more + [word() for _ in range(20)])))
    got = repeats_of(spark, docs)
    assert got == brute_repeats(docs) and len(got) == len(docs)


def test_repeats_from_the_middle_of_a_repeated_line(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    docs = []
    for trial in range(150):
        line = [word() for _ in range(20)]
        start = rng.randrange(20, 50)
        for body in (line * 6, (line * 6)[start : start + 50]):
            docs.append((len(docs), " ".join([word() for _ in range(20)] + body + [word() for _ in range(20)])))
    got = repeats_of(spark, docs)
    assert got == brute_repeats(docs) and len(got) == len(docs)
