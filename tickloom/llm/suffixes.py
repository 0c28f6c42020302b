"""Sparse suffix array dedup: repeated passages of ``LEAST_WORDS`` words or more across documents.

Suffixes are kept only at minimisers: of every ``WINDOW`` successive k-word hashes the least, the first on a tie,
so that which ones are kept depends on content alone and two documents that share a passage keep the same places
in it. Each window of 50 words belongs to the place kept in its first 16, so two equal windows belong to suffixes
that agree on 35 words at least. The work has two rounds, each a sort over the whole corpus:

1. The kept suffixes by a hash of their first 35 words, a row per document and head. Heads that one document
   alone holds go; they are most.
2. The windows that belong to a head that is left, by a hash of all their 50 words. Those that two documents hold
   are the result, overlapping and touching ones joined. No window is left out that another document holds, so what
   is found is whole, whatever else shares its first words, however often a document repeats them.

The sorts are split by range over (hash, document, place), so a passage that a third of all documents hold spreads
over many tasks, and each row meets the least documents of its group alone, never the whole group.

Words are of the text in lower case (A-Z), split at white space. Defined cases: a null or empty text, or one
of fewer than 50 words, has no suffixes; rows with a null doc_id take no part; rows of one doc_id are one
document and don't match each other, nor does a document match itself; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import batches_of, cut, partitions_for, prepare, renamed

LEAST_WORDS = 50
GRAM_WORDS = 8
WINDOW = 16  # a power of two
HEAD_WORDS = LEAST_WORDS - WINDOW + 1
#: Suffixes that one sorting task holds, about.
TASK_SUFFIXES = 500_000
#: Words that are looked at together, about.
STEP_WORDS = 150_000
#: Sorted rows that are looked at together, about.
STEP_ROWS = 50_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def hashed_words(text: str | None) -> list[int]:
    digest = xxhash.xxh64_intdigest
    return [digest(w) for w in (text or "").encode("utf-8", "surrogatepass").lower().split()]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def windows(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(document, start, window, of, document of place, head)``: for each window of 50 words its document, first
    word, hash and the number of its kept place; for each kept place its document and the hash of its 35 words."""
    sizes = np.array([len(d) for d in docs], np.int64)
    words = np.concatenate([np.zeros(0, np.uint64), *docs])
    total = len(words)
    none = np.zeros(0, np.int64)
    if total < LEAST_WORDS:
        return none, none, none.view(np.uint64), none, none, none.view(np.uint64)
    ends = np.cumsum(sizes)
    doc_of = np.repeat(np.arange(len(docs)), sizes)
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(total - 1, _BASE)]))
    back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(total - 1, _INVERSE)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words * power, dtype=np.uint64)])

    def range_hash(at: np.ndarray, n) -> np.ndarray:
        return _mixed((sums[at + n] - sums[at]) * back[at])

    starts = np.arange(total - GRAM_WORDS + 1)
    low = np.uint64((1 << 24) - 1)
    packed = (range_hash(starts, GRAM_WORDS) & ~low) | starts.astype(np.uint64)
    width = 1
    while width < WINDOW:
        packed = np.minimum(packed[:-width], packed[width:])
        width *= 2
    first = np.arange(total - LEAST_WORDS + 1)
    first = first[first + LEAST_WORDS <= ends[doc_of[first]]]
    places, of = np.unique((packed[first] & low).astype(np.int64), return_inverse=True)
    doc = doc_of[first]
    return doc, first - (ends[doc] - sizes[doc]), range_hash(first, LEAST_WORDS), of, doc_of[places], range_hash(places, HEAD_WORDS)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches, whose second column is the text, with the hashed words of each."""
    for b in batches:
        start, n, hashed = 0, 0, []
        for k, text in enumerate(b.column(1).to_pylist()):
            hashed.append(np.array(hashed_words(text), np.uint64))
            n += len(hashed[-1])
            if n >= STEP_WORDS or k + 1 == b.num_rows:
                yield b.slice(start, len(hashed)), hashed
                start, n, hashed = k + 1, 0, []


def _suffix_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, hashed in _steps(batches):
        yield _suffix_rows(part.column(0).to_numpy(zero_copy_only=False), hashed)


def _suffix_rows(ids: np.ndarray, hashed: list[np.ndarray]) -> pa.RecordBatch:
    """One row per document and head, however often the document repeats it."""
    doc, head = windows(hashed)[4:]
    order = np.lexsort((head, doc))
    doc, head = doc[order], head[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (head[1:] != head[:-1])
    return pa.record_batch([pa.array(head[new].view(np.int64)), pa.array(ids[doc[new]], pa.int64())], names=["key", "doc"])


def _window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows whose head is among the asked ones. A head that is asked for one document is asked for
    every document that has it, so those of a step can be looked up together."""
    for part, hashed in _steps(batches):
        doc, start, window, of, _, head = windows(hashed)
        asked = part.column(2).flatten().to_numpy(zero_copy_only=False)
        kept = np.isin(head.view(np.int64), asked)[of]
        ids = part.column(0).to_numpy(zero_copy_only=False)[doc[kept]]
        yield pa.record_batch([pa.array(window[kept].view(np.int64)), pa.array(ids, pa.int64()), pa.array(start[kept].astype(np.int32))], names=["key", "doc", "start"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= STEP_ROWS:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _shared_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and document, those whose key another document holds, with the least such one as
    ``other``. All rows of the partition's first and last key go along with no ``other``: their groups may reach
    into other partitions."""
    first, rest = None, None
    for t in _gathered(batches):
        t = (t if rest is None else pa.concat_tables([rest, t])).combine_chunks()
        key, doc = (t.column(k).to_numpy() for k in (0, 1))
        first = key[0] if first is None else first
        n = int(np.searchsorted(key, key[-1]))
        rest = t.slice(n)
        if not n:
            continue
        key, doc = key[:n], doc[:n]
        at = np.nonzero(np.append(True, key[1:] != key[:-1]))[0]
        size = np.diff(np.append(at, n))
        group = np.repeat(np.arange(len(at)), size)
        least = doc[at]
        own = doc == least[group]
        lead = np.add.reduceat(own, at, dtype=np.int64)
        second = doc[np.minimum(at + lead, n - 1)]
        edge = key == first
        kept = edge | (lead < size)[group]
        other = pa.array(np.where(own, second[group], least[group]), mask=edge)
        out = t.slice(0, n).append_column("other", other).filter(pa.array(kept))
        yield from out.to_batches()
    if rest is not None:
        yield from rest.append_column("other", pa.nulls(rest.num_rows, pa.int64())).to_batches()


def _least_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The two least documents of each key of a task; only the partitions' first and last keys come here."""
    found: dict[int, list[int]] = {}
    for b in batches:
        key, doc = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        for k in np.unique(key).tolist():
            found[k] = np.unique(np.concatenate([doc[key == k], np.array(found.get(k, []), np.int64)]))[:2].tolist()
    rows = [(k, d) for k, docs in found.items() for d in docs]
    cols = list(zip(*rows)) if rows else [(), ()]
    yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["key", "doc"])


def _closed_batches(batches: Iterator[pa.RecordBatch], pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """All rows, those without an ``other`` only if their key is among ``pairs`` (key, its two least documents),
    and then with the least other document."""
    for b in batches_of(batches):
        key, doc, other = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(b.num_columns - 1)
        edge = other.is_null().to_numpy(zero_copy_only=False)
        if edge.any():
            near = pairs if len(pairs) else np.full((1, 3), -1, np.int64)
            at = np.minimum(np.searchsorted(near[:, 0], key), len(near) - 1)
            known = (near[at, 0] == key) & (len(pairs) > 0)
            filled = np.where(edge, np.where(doc == near[at, 1], near[at, 2], near[at, 1]), other.fill_null(0).to_numpy())
            b = pa.record_batch([*b.columns[:-1], pa.array(filled)], names=b.schema.names).filter(pa.array(~edge | known))
        yield b


def shared(rows: DataFrame, n: int, name: str) -> DataFrame:
    """``rows`` (``key``, ``doc``, others) whose key another document holds, with the least such document as ``other``."""
    by = rows.columns
    ranged = rows.repartitionByRange(n, *by).sortWithinPartitions(*by)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    found = cut(ranged.mapInArrow(_shared_batches, f"{fields}, other long"), name)
    edges = found.filter("other IS NULL")
    least: dict[int, set[int]] = {}
    for r in edges.select("key", "doc").mapInArrow(_least_batches, "key long, doc long").collect():  # a few per partition
        least[r["key"]] = set(sorted(least.get(r["key"], set()) | {r["doc"]})[:2])
    pairs = np.array([(k, *sorted(d)) for k, d in sorted(least.items()) if len(d) == 2], np.int64).reshape(-1, 3)
    return found.mapInArrow(lambda it: _closed_batches(it, pairs), found.schema)


def shared_windows(docs: DataFrame) -> DataFrame:
    """``docs`` has ``doc_id, text``; ``(doc, start, other)``: the windows that other documents hold too."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stored = cut(docs.mapInArrow(_suffix_batches, "key long, doc long"), "suffixes")
    heads = shared(stored, max(least, partitions_for(stored.count(), TASK_SUFFIXES)), "heads").select("key", "doc")
    n = heads.count() * WINDOW // 2  # a kept place has about so many windows
    asked = heads.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("key").alias("asked"))
    found = docs.join(asked, "doc_id").select("doc_id", "text", "asked").mapInArrow(_window_batches, "key long, doc long, start int")
    return shared(found, max(least, partitions_for(n, TASK_SUFFIXES)), "windows").select("doc", "start", "other")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start_word, end_word, partner_id``: the stretches of each document that other documents hold
    too, overlapping ones joined, with the smallest matched document."""
    prepare(docs.sparkSession)
    kept = renamed(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id IS NOT NULL")
    found = shared_windows(kept)
    by = Window.partitionBy("doc").orderBy("start")
    begins = F.coalesce(F.col("start") - F.lag("start").over(by) > LEAST_WORDS, F.lit(True)).cast("int")
    merged = found.withColumn("begins", begins).withColumn("run", F.sum("begins").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    ends = [F.min("start").cast("long").alias("start_word"), (F.max("start") + LEAST_WORDS).cast("long").alias("end_word"), F.min("other").alias("partner_id")]
    return merged.groupBy(F.col("doc").alias("doc_id"), "run").agg(*ends).drop("run")
