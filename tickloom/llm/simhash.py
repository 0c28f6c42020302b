"""SimHash near-duplicates: exact tiled comparison of 64-bit fingerprints.

Fingerprints are compared inside tiles. A tile holds the fingerprints whose four 16-bit words have the
same population counts; two tiles whose counts differ by more than the radius in sum hold no pair within
the radius, because each differing bit moves one of the counts by one. Tile pairs beyond it are never met.
Equal fingerprints are collapsed before, so a group of copies of any size is one row here.

Defined cases: a null or empty text, or one of white space, has fingerprint 0, which links like any other;
fewer than three words hash as one shingle; equal documents share a fingerprint; a null doc_id keeps its row
and never names a component unless the component has no other id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product
from operator import and_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import batches_of, cut, held, prepare, renamed
from tickloom.llm.components import component_labels

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
#: Fingerprints of a tile that one task compares with all others of the tile and its neighbours.
TILE_ROWS = 8192
QUARTERS = [0xFFFF, 0xFFFF << 16, 0xFFFF << 32, -(1 << 48)]


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit fingerprint: bit i is set if over half of the shingle hashes have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower touches A-Z only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE_WORDS:
        return digest(b" ".join(words), SEED)
    join = b" ".join
    hashes = np.array([digest(join(t), SEED) for t in zip(words, words[1:], words[2:])], "<u8")
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        votes += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text, the first column, gives way to its fingerprint; all others go through."""
    held("simhash", dict)  # what another operator left in this worker goes
    for b in batches_of(batches):
        prints = np.array([fingerprint(t) for t in b.column(0).to_pylist()], np.uint64).view(np.int64)
        yield pa.record_batch([pa.array(prints), *b.columns[1:]], names=["fp", *b.schema.names[1:]])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """``(fp, doc_id)`` with fp the fingerprint as a signed long, one row per row of ``docs``; if ``keyed``, with
    ``key``, a hash of the text that tells apart rows of one doc_id."""
    prepare(docs.sparkSession)
    kept = renamed(docs, doc_id=id_col, text=text_col)
    key = [_key("text").alias("key")] if keyed else []
    return kept.select("text", F.col("doc_id").cast("long"), *key).mapInArrow(_fingerprint_batches, "fp long, doc_id long" + ", key long" * keyed)


def _key(text: str | Column) -> Column:
    return F.xxhash64(text)


def _half_space(radius: int) -> list[tuple[int, ...]]:
    steps = (d for d in product(range(-radius, radius + 1), repeat=4) if 0 < sum(map(abs, d)) <= radius)
    return [d for d in steps if d > (0, 0, 0, 0)]


def _spread(found_i: np.ndarray, found_j: np.ndarray, label: np.ndarray) -> None:
    """Lower the labels of linked nodes to their common minimum, in place."""
    while True:
        low = np.minimum(label[found_i], label[found_j])
        before = label.copy()
        np.minimum.at(label, found_i, low)
        np.minimum.at(label, found_j, low)
        np.minimum(label, label[label], out=label)
        if (before == label).all():
            return


def link_tile(home: np.ndarray, guest: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between ``home`` and itself and ``guest``; never all pairs of a clique."""
    every = np.concatenate([home, guest])
    label = np.arange(len(every))
    rows = max(1, (1 << 20) // max(1, len(every)))
    for i in range(0, len(home), rows):
        block = home[i : i + rows]
        for j in range(i, len(every), 1 << 20):
            near = np.bitwise_count(block[:, None] ^ every[None, j : j + (1 << 20)]) <= radius
            a, b = np.nonzero(near)
            a, b = a + i, b + j
            real = a < b
            if real.any():
                _spread(a[real], b[real], label)
    child = np.nonzero(label != np.arange(len(every)))[0]
    return every[child].view(np.int64), every[label[child]].view(np.int64)


def _tile_runs(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by tile and part; each run of one (tile, part) is compared on its own."""
    key, fps, guests = None, [], []

    def close() -> Iterator[pa.RecordBatch]:
        if key is None:
            return
        fp, guest = np.concatenate(fps).view(np.uint64), np.concatenate(guests)
        u, v = link_tile(fp[~guest], fp[guest], radius)
        if len(u):
            yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])

    for b in batches:
        if not b.num_rows:
            continue
        run = b.column(0).to_numpy(zero_copy_only=False)
        fp, guest = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.nonzero(run[1:] != run[:-1])[0] + 1), len(run)]
        for s, e in zip(cuts, cuts[1:]):
            if run[s] != key:
                yield from close()
                key, fps, guests = run[s], [], []
            fps.append(fp[s:e])
            guests.append(guest[s:e])
    yield from close()


def links(nodes: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Distinct fingerprints ``(fp)`` to edges ``(u, v)`` that connect all within ``radius`` bits."""
    spark = nodes.sparkSession
    words = nodes.select("fp", *[F.bit_count(F.col("fp").bitwiseAND(F.lit(m))).cast("int").alias(f"q{i}") for i, m in enumerate(QUARTERS)])

    def tile(d=(0, 0, 0, 0)):
        return sum((F.col(f"q{i}") + F.lit(d[i])) * F.lit(17**i) for i in range(4))

    def inside(d):
        return [(F.col(f"q{i}") + F.lit(x)).between(0, 16) for i, x in enumerate(d) if x]

    moved = [F.when(reduce(and_, inside(d)), tile(d)) for d in _half_space(radius)]
    words = words.withColumn("tile", tile())
    # At most 17^4 tiles exist, whatever the input, so their sizes can be broadcast.
    parts = F.broadcast(words.groupBy("tile").agg(F.ceil(F.count("*") / F.lit(tile_rows)).cast("int").alias("parts")))
    own = words.join(parts, "tile").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    home = own.select("tile", "part", "fp", F.lit(False).alias("guest"))
    beside = own.filter("part + 1 < parts").select("tile", F.explode(F.sequence(F.col("part") + 1, F.col("parts") - 1)).alias("part"), "fp", F.lit(True).alias("guest"))
    across = (
        words.select("fp", F.explode(F.array_compact(F.array(*moved))).alias("tile"))
        .join(parts, "tile")
        .select("tile", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "fp", F.lit(True).alias("guest"))
    )
    rows = home.unionAll(beside).unionAll(across).select((F.col("tile").cast("long") * F.lit(1 << 24) + F.col("part")).alias("run"), "fp", "guest")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "run").sortWithinPartitions("run").mapInArrow(lambda it: _tile_runs(it, radius), "u long, v long")


def _labelled(docs: DataFrame, id_col: str, text_col: str, radius: int, keyed: bool) -> DataFrame:
    """The rows of ``fingerprints`` with the root of their component and its smallest doc_id."""
    prints = cut(fingerprints(docs, id_col, text_col, keyed), "simhash")
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    labels = component_labels(links(nodes.select("fp"), radius))
    rooted = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    return prints.join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fp, component_id)``: one row per document, component_id its component's smallest doc_id."""
    return _labelled(docs, id_col, text_col, radius, False).select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest doc_id; all columns stay.

    Rows that repeat a doc_id drop each other only inside one component: of its rows of the smallest doc_id one text
    stays, and of rows equal in both the first by content. Rows without a doc_id can't stand for others: of those that
    are equal in all columns one stays.
    """
    found = _labelled(docs, "doc_id", "text", radius, True).filter("doc_id = component_id")
    kept = found.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("_r")).select("_r.doc_id", "_r.key")
    kept = kept.select(F.col("doc_id").alias("_kept_id"), F.col("key").alias("_kept_key"))
    same = (docs["doc_id"].cast("long") == kept["_kept_id"]) & (_key(docs["text"]) == kept["_kept_key"])
    rows = docs.join(kept, same, "left_semi")
    # An aggregate, not a window: rows of one id and text are combined before the shuffle, however many they are.
    least = rows.groupBy("doc_id", _key("text").alias("_key")).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("_row"))
    named = least.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
    return named.unionByName(docs.filter("doc_id IS NULL").distinct())
