"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are scaled to unit length, turned by one fixed random rotation and kept as sign bits, with two
correction scalars: the length and the inner product of the turned vector with its own code. From these and a
turned query, the sums of its components at set and unset bits estimate each inner product, and the estimate has
an error bound that holds with high probability. A query reranks, on the original vectors in double precision, a
first few by estimate; their k-th best score is one that the result must reach, so then it reranks all candidates
whose upper bound reaches it. There is no cap.

Vectors are kept in blocks of bounded bytes; each block of queries meets each block of candidates once, and only the
k best of a block go on. A task takes one block and a bounded run of query blocks. Every vector is indexed.

Defined cases: a vector that is null, all zero, or holds a null or a non-finite component takes no part, nor
does one whose length differs from that of most; ties go to the smaller vec_id; rows of one vec_id are one
candidate each but never the query's own, and as a query the first of them by components counts; fewer candidates than k are all returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tickloom.llm.common import cut, prepare, renamed

NEIGHBOURS = 20
SEED = 5
#: Width of the error bound in standard deviations.
WIDTH = 3.0
#: Candidates reranked first, for each neighbour asked for.
FIRST = 8
#: Vectors in one block of candidates, queries in one block, and the bytes that bound either.
BLOCK_ROWS, QUERY_ROWS, BLOCK_BYTES = 8192, 1024, 32 << 20
#: Query blocks that one task takes to a block of candidates.
RUN_BLOCKS = 16


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """An orthonormal matrix, the same for a seed on every machine."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits (rows of 64-bit words), lengths, and inner products with the own code."""
    size = np.linalg.norm(vectors, axis=1)
    turned = (vectors / size[:, None]) @ turn.T
    bits = turned > 0
    own = np.abs(turned).sum(1) / np.sqrt(turned.shape[1])
    words = -(-bits.shape[1] // 64)
    packed = np.zeros((len(bits), words * 8), np.uint8)
    by = np.packbits(bits, axis=1, bitorder="little")
    packed[:, : by.shape[1]] = by
    return packed.view("<u8"), size, own


def signs(codes: np.ndarray, dim: int) -> np.ndarray:
    """The packed bits as columns of 1 and -1, in single precision."""
    bits = np.unpackbits(np.ascontiguousarray(codes).view(np.uint8), axis=1, count=dim, bitorder="little")
    return np.where(bits.T, np.float32(1), np.float32(-1))


def estimate(queries: np.ndarray, turn: np.ndarray, codes: np.ndarray, size: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of every query with every coded vector, and the bounds of their errors."""
    dim = turn.shape[0]
    qsize = np.linalg.norm(queries, axis=1)[:, None]
    turned = ((queries / qsize) @ turn.T / np.sqrt(dim)).astype(np.float32)
    product = turned @ signs(codes, dim)  # of the query with the code's unit vector
    miss = np.sqrt(np.maximum(0, 1 - own**2) / max(1, dim - 1)) * WIDTH
    rounding = (dim + 2) * np.finfo(np.float32).eps
    return product * (size / own) * qsize, (miss + rounding) * (size / own) * qsize


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision; each row's own sum, so equal vectors score alike."""
    return (vectors.astype(np.float64) * query.astype(np.float64)).sum(1)


def search_block(qids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, index: tuple, turn: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the k best of the block: (query id, ids, scores)."""
    rows = max(1, (1 << 20) // max(1, len(ids)))
    few = min(len(ids), FIRST * k)
    for s in range(0, len(qids), rows):
        guess, bound = estimate(queries[s : s + rows].astype(np.float64), turn, *index)
        own = qids[s : s + rows, None] == ids[None]
        guess[own] = -np.inf
        first = np.argpartition(guess, len(ids) - few, axis=1)[:, len(ids) - few :]
        high = guess + bound
        for j in range(len(guess)):
            begun = first[j][~own[j, first[j]]]
            score = exact(queries[s + j], vectors[begun])
            least = np.partition(score, len(score) - k)[len(score) - k] if len(score) >= k else -np.inf
            chosen = (high[j] >= least) & ~own[j]
            chosen[begun] = False
            at = np.nonzero(chosen)[0]
            at, score = np.concatenate([begun, at]), np.concatenate([score, exact(queries[s + j], vectors[at])])
            best = np.lexsort((ids[at], -score))[:k]
            yield int(qids[s + j]), ids[at][best], score[best]


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    kept = renamed(vectors, vec_id=id_col, v=vector_col).select(F.col("vec_id").cast("long"), "v").filter("vec_id IS NOT NULL AND v IS NOT NULL")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return kept.filter(~bad & F.exists("v", lambda x: x != 0))


def _blocks(batches: Iterator[pa.RecordBatch], rows: int, dim: int, kind: str, coded: bool) -> Iterator[pa.RecordBatch]:
    """The partition's vectors as blocks: ids, components and, for candidates, codes and scalars as bytes."""

    def block(t: pa.Table) -> pa.RecordBatch:
        ids = t.column(0).to_numpy().astype("<i8")
        flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t.column(1).chunks]).astype(kind)
        parts = [ids, flat, *(encode(flat.reshape(-1, dim).astype(np.float64), rotation(dim)) if coded else ())]
        names = ["ids", "vectors", "codes", "size", "own"][: len(parts)]
        return pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in parts], names=names)

    held, n = [], 0
    for b in batches:
        while b.num_rows:
            part, b = b.slice(0, rows - n), b.slice(rows - n)
            held, n = [*held, part], n + part.num_rows
            if n == rows:
                yield block(pa.Table.from_batches(held))
                held, n = [], 0
    if n:
        yield block(pa.Table.from_batches(held))


def neighbours(vectors: DataFrame, k: int = NEIGHBOURS, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows whose id is divisible by ``every``."""
    prepare(vectors.sparkSession)
    usable = _usable(vectors, id_col, vector_col)
    sizes = usable.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = sizes["dim"] if sizes else 1
    usable = usable.filter(F.size("v") == dim)
    turn = rotation(dim)
    n = sizes["n"] if sizes else 0
    kind = "<f4" if isinstance(usable.schema["v"].dataType.elementType, FloatType) else "<f8"
    rows, query_rows = (max(1, min(most, BLOCK_BYTES // (8 * dim))) for most in (BLOCK_ROWS, QUERY_ROWS))
    blocks = max(1, -(-n // rows))
    groups = max(1, -(-n // (every * query_rows)))
    # Even blocks: vectors are dealt round-robin, and a partition is one block, or two where it got more than its share.
    fields = "ids binary, vectors binary, codes binary, size binary, own binary"
    indexed = usable.repartition(blocks).mapInArrow(lambda it: _blocks(it, 2 * rows, dim, kind, True), fields)
    held = cut(indexed.withColumn("block", F.spark_partition_id()), "vector-blocks")
    asked = usable.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v")).repartition(groups)
    asked = asked.mapInArrow(lambda it: _blocks(it, query_rows, dim, kind, False), "ids binary, vectors binary")
    asked = cut(asked.withColumn("run", F.floor(F.spark_partition_id() / RUN_BLOCKS).cast("int")), "query-blocks")
    # Few blocks of many bytes: the key's hash would put several in one task, so tasks outnumber the keys. The
    # counts come from the tables, as the partitions that a repartition makes may be more than asked for.
    blocks, runs = (t.agg(F.max(c)).first()[0] for t, c in ((held, "block"), (asked, "run")))
    blocks, runs = (0 if x is None else x for x in (blocks, runs))
    keys = (blocks + 1) * (runs + 1)
    tasks = keys if keys > 1000 else 4 * keys
    asked = asked.select("run", F.col("ids").alias("qids"), F.col("vectors").alias("queries"), F.explode(F.sequence(F.lit(0), F.lit(blocks))).alias("block"))
    held = held.select("*", F.explode(F.sequence(F.lit(0), F.lit(runs))).alias("run"))
    met = asked.repartition(tasks, "block", "run").join(held.repartition(tasks, "block", "run"), ["block", "run"])
    met = met.select("qids", "queries", "ids", "vectors", "codes", "size", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                qids, queries, ids, own, codes, size, inner = (b.column(j)[i].as_buffer() for j in range(7))
                index = (np.frombuffer(codes, "<u8").reshape(len(ids) // 8, -1), np.frombuffer(size, "<f8"), np.frombuffer(inner, "<f8"))
                shaped = [np.frombuffer(x, kind).reshape(-1, dim) for x in (queries, own)]
                found = list(search_block(np.frombuffer(qids, "<i8"), shaped[0], np.frombuffer(ids, "<i8"), shaped[1], index, turn, k))
                query = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
                arrays = [pa.array(query, pa.int64()), pa.array(np.concatenate([f[1] for f in found]), pa.int64()), pa.array(np.concatenate([f[2] for f in found]), pa.float64())]
                yield pa.record_batch(arrays, names=["query_id", "vec_id", "score"])

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.mapInArrow(run, "query_id long, vec_id long, score double").withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
