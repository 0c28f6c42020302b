"""Best-fit packing of token pieces into sequences, improved by swap-based local search.

A document is its token ids and one separator id. Only documents longer than a sequence are cut, into
full sequences and a last piece that may be shorter. Full pieces fill a sequence of their own; the others
are dealt evenly to packing tasks of a bounded number of pieces. Each task packs best-fit decreasing and
then exchanges one piece for one or two, or moves pieces, between underfull bins, always raising the sum
of squared fills, until bins run empty.

Defined cases: a null or empty text is the separator alone (one piece of length 1); repeated rows are
packed once each; a null doc_id stays null; long texts are cut; an empty table gives an empty result. Sequence numbers are unique, not consecutive.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import batches_of, cut, held, partitions_for, prepare, renamed

TOKENIZER = "word_bpe_49k.json"
SEPARATOR = 0
SEQUENCE_TOKENS = 2048
#: Pieces that one packing task holds at most, about; the loss is under one bin a task.
TASK_PIECES = 50_000
#: Tokens whose ids one packing task holds at most, about, where pieces carry their ids.
TASK_TOKENS = 8_000_000
#: Words whose ids a worker keeps; further words are encoded anew for each batch.
CACHED_WORDS = 250_000
CACHED_LENGTH = 40
#: Units that one call of the tokenizer takes.
UNITS = 4096
#: ASCII punctuation of which a run is one unit. The apostrophe isn't among it, as it joins letters.
PUNCTUATION = '!"#$%&()*+,-./:;=?@[]^_`{}~'
#: White space at which str.split() splits and which the tokenizer's own pattern may treat otherwise.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
#: Width of one step of the local search: items of one length that are looked at, and lengths that are tried for
#: an exchange of one for one and of two for one. A step that finds nothing so narrow isn't made; the search goes
#: on until no step is left. At sf0.001 a test asserts that one sequence more than the least possible is enough.
SEARCH_ITEMS, SEARCH_ONES, SEARCH_TWOS = 16, 4, 8



def _letters(word: str) -> bool:
    """Whether the tokenizer sees letters alone in a word."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


class WordEncoder:
    """Token ids of texts, by word. The tokenizer splits at white space before all else, so the ids of a
    text are those of its words in order. A text with white space of other kinds is encoded whole.

    A word of letters between ASCII punctuation is three units to the tokenizer, which end in tokens that
    say so; so new words are encoded many at a time, by their letters, and cut at those tokens. That holds for
    letters that are letters still after the tokenizer's own normalising (composition, then lower case); a mark
    that this leaves at an end would join the punctuation, so any other word is encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}

    def _encode_whole(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def _encode_units(self, units: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for s in range(0, len(units), UNITS):
            part = units[s : s + UNITS]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            cuts = np.nonzero(self.ends[ids])[0] + 1
            if len(cuts) == len(part):
                raw, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
                out += [raw[x:y] for x, y in zip(at, at[1:])]
            else:
                out += self._encode_whole(part)
        return out

    def _learn(self, new: list[str]) -> list[str]:
        """Put the ids of all words, and of their letters, into ``known``; return all that it put there."""
        known = self.known
        alone, split, odd, parts = [], [], [], set()
        for w in new:
            if _letters(w):
                alone.append(w)
                continue
            core = w.strip(PUNCTUATION)
            if _letters(core):
                at = w.index(core)
                x = (w[:at], core, w[at + len(core) :])
                split.append((w, x))
                parts.update(x)
            else:
                odd.append(w)
        parts.difference_update(alone)
        units = [*alone, *parts.difference(known)]
        known.update(zip(units, self._encode_units(units)))
        known.update(zip(odd, self._encode_whole(odd)))
        for w, (before, core, after) in split:
            known[w] = known[before] + known[core] + known[after]
        return [*units, *odd, *(w for w, _ in split)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [_words(t) for t in texts]
        known = self.known
        new = set().union(*split).difference(known)
        put = self._learn(list(new)) if new else []
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        room = len(known) - CACHED_WORDS
        if room > 0:
            for w in put[max(0, len(put) - room) :]:
                del known[w]
        for w in put:
            if len(w) > CACHED_LENGTH:
                known.pop(w, None)
        return out


#: Latin text in which lower case and composition are plain: the tokenizer lowers it like Python does.
_UNUSUAL = re.compile("[^\t\n\r -~\xa1-\u012f\u0131-\u024f]").search


def _words(text: str | None) -> list[str]:
    if not text:
        return []
    if text.isascii() and text.isprintable() or not _UNUSUAL(text):
        return text.lower().split()
    return [text] if ODD_SPACE(text) else text.split()


def encoder(name: str = TOKENIZER) -> WordEncoder:
    return held(f"encoder {name}", lambda: WordEncoder(public_tokenizers.path(name)))


#: Columns of a piece, by whether the copy's number and the ids are kept.
PIECE = {"doc_id": ("long", pa.int64()), "copy": ("long", pa.int64()), "piece": ("int", pa.int32()), "start": ("long", pa.int64()), "length": ("long", pa.int64()), "ids_crc32": ("long", pa.int64()), "ids": ("binary", pa.binary())}


def _piece_batches(batches: Iterator[pa.RecordBatch], tokenizer: str, limit: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    enc = encoder(tokenizer)
    end = np.array([SEPARATOR], "<u4").tobytes()
    for b in batches_of(batches):
        rows: list[tuple] = []
        for doc, copy, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), enc.encode(b.column(1).to_pylist())):
            ids += end
            for k, s in enumerate(range(0, len(ids), 4 * limit)):
                part = ids[s : s + 4 * limit]
                rows.append((doc, copy, k, s // 4, len(part) // 4, zlib.crc32(part), part))
        cols = dict(zip(PIECE, zip(*rows)))
        yield pa.record_batch([pa.array(cols[n], PIECE[n][1]) for n in names], names=names)


def pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, limit: int = SEQUENCE_TOKENS, keep_ids: bool = False, copies: bool = False
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32`` and, on request, the ids themselves and
    ``copy``, a number of the row that the piece is of, which parts rows of one doc_id."""
    prepare(docs.sparkSession)
    names = [n for n in PIECE if (n != "ids" or keep_ids) and (n != "copy" or copies)]
    kept = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.monotonically_increasing_id().alias("copy"))
    return kept.mapInArrow(lambda it: _piece_batches(it, tokenizer, limit, names), ", ".join(f"{n} {PIECE[n][0]}" for n in names))


def best_fit(lengths: list[int], limit: int) -> list[list[int]]:
    """Bins of item indexes: longest first, each to the fullest bin that takes it. No item exceeds ``limit``."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    bins: list[list[int]] = []
    open_at: list[list[int]] = [[] for _ in range(limit + 1)]  # bins by free tokens
    mask = 0  # bit f: a bin with f free tokens exists
    for i in order:
        need = lengths[i]
        fits = mask >> need
        if fits:
            free = need + (fits & -fits).bit_length() - 1
            k = open_at[free].pop()
            if not open_at[free]:
                mask &= ~(1 << free)
            bins[k].append(i)
        else:
            free, k = limit, len(bins)
            bins.append([i])
        free -= need
        if free:
            open_at[free].append(k)
            mask |= 1 << free
    return bins


class _Pool:
    """Items of underfull bins by length, to find the longest item of at most a length in another bin."""

    def __init__(self, limit: int) -> None:
        self.at: list[set[tuple[int, int]]] = [set() for _ in range(limit + 1)]
        self.mask = 0

    def add(self, length: int, k: int, i: int) -> None:
        self.at[length].add((k, i))
        self.mask |= 1 << length

    def remove(self, length: int, k: int, i: int) -> None:
        self.at[length].discard((k, i))
        if not self.at[length]:
            self.mask &= ~(1 << length)

    def longest(self, most: int, least: int) -> int:
        """The greatest length held within ``least..most``, or 0."""
        if most < least:
            return 0
        found = (self.mask & ((1 << (most + 1)) - 1)) >> least
        return least + found.bit_length() - 1 if found else 0


def improve(bins: list[list[int]], lengths: list[int], limit: int) -> list[list[int]]:
    """Local search over the underfull bins, until no step is left. A step takes a bin, fullest first, and fills its gap from less
    full bins: it moves an item in, or gives one item for a longer one, or one for two that are longer in
    sum. Each raises the sum of squared fills, as the bin that gains is the fuller one; emptied bins go."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    held = [set(b) for b in bins]
    pool = _Pool(limit)
    active = [k for k in range(len(bins)) if fill[k] < limit]
    for k in active:
        for i in held[k]:
            pool.add(lengths[i], k, i)

    def shift(i: int, a: int, b: int) -> None:
        n = lengths[i]
        pool.remove(n, a, i)
        held[a].discard(i)
        fill[a] -= n
        held[b].add(i)
        fill[b] += n
        pool.add(n, b, i)

    def retire(k: int) -> None:
        for i in held[k]:
            pool.remove(lengths[i], k, i)

    def pick(length: int, fuller: int, gain: int, but: tuple = ()) -> tuple[int, int] | None:
        """An item of that length in another bin that is less full than ``fuller`` will have been."""
        best = None
        for n, (k, i) in enumerate(pool.at[length]):
            if k != fuller and i not in but and 0 < fill[k] < fill[fuller] + gain and (best is None or fill[k] < fill[best[0]]):
                best = (k, i)
            if best and n >= SEARCH_ITEMS:
                break
        return best

    def step(a: int) -> bool:
        gap = limit - fill[a]
        length = pool.longest(gap, 1)
        while length:
            if got := pick(length, a, length):
                shift(got[1], got[0], a)
                return True
            length = pool.longest(length - 1, 1)
        for x in sorted(held[a], key=lambda i: -lengths[i]):
            n, tries = lengths[x], 0
            length = pool.longest(min(limit, n + gap), n + 1)
            while length and tries < SEARCH_ONES:
                if got := pick(length, a, length - n):
                    shift(got[1], got[0], a)
                    shift(x, a, got[0])
                    return True
                length, tries = pool.longest(length - 1, n + 1), tries + 1
            # Two of one other bin for one: their sum within (n, n + gap].
            tries, length = 0, pool.longest(min(limit, n + gap - 1), 1)
            while length and tries < SEARCH_TWOS:
                if got := pick(length, a, 1):
                    k, y = got
                    rest = sorted((lengths[z], z) for z in held[k] if z != y)
                    at = bisect_right(rest, (n + gap - length, len(lengths))) - 1
                    if at >= 0 and rest[at][0] + length > n and fill[k] < fill[a] + rest[at][0] + length - n:
                        shift(y, k, a)
                        shift(rest[at][1], k, a)
                        shift(x, a, k)
                        return True
                length, tries = pool.longest(length - 1, 1), tries + 1
        return False

    moved = 1
    while moved:
        order: list[tuple[int, int]] = []
        for k in active:
            if held[k] and fill[k] < limit:
                insort(order, (-fill[k], k))
        moved = 0
        for _, k in order:
            while held[k] and fill[k] < limit and step(k):
                moved += 1
            if fill[k] == limit:
                retire(k)
        active = [k for k in active if held[k] and fill[k] < limit]
        if len(active) < 2 or sum(limit - fill[k] for k in active) < limit:
            break
    return [sorted(b) for b in held if b]


def _pack_partition(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches([b for b in batches if b.num_rows])
    task = table.column("task")[0].as_py()
    lengths = table.column("length").to_pylist()
    single = [i for i, n in enumerate(lengths) if n == limit]
    others = [i for i, n in enumerate(lengths) if n < limit]
    own = [lengths[i] for i in others]
    packed = [[i] for i in single] + [[others[i] for i in b] for b in improve(best_fit(own, limit), own, limit)]
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, b in enumerate(packed):
        at = 0
        for i in b:
            sequence[i], offset[i] = (task << 32) + k, at
            at += lengths[i]
    table = table.drop_columns(["task"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
    yield from table.to_batches(max_chunksize=10_000)


def _pack_batches(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    first = next((b for b in batches if b.num_rows), None)
    if first is not None:
        yield from _pack_partition(iter([first, *batches]), limit)


def pack(cut_pieces: DataFrame, limit: int = SEQUENCE_TOKENS, task_pieces: int = TASK_PIECES, task_tokens: int = TASK_TOKENS) -> DataFrame:
    """Piece rows plus ``sequence_id, offset``. Rows are dealt round-robin, so that tasks are equal and
    bounded, in pieces and in the ids that they carry, whatever ids repeat."""
    stored = cut(cut_pieces, "pieces")
    size = stored.agg(F.count("*").alias("rows"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).first()
    tasks = partitions_for(size["rows"], task_pieces)
    if "ids" in stored.columns:
        tasks = max(tasks, partitions_for(size["tokens"], task_tokens))
    dealt = stored.repartition(tasks).withColumn("task", F.spark_partition_id().cast("long"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stored.schema)
    return dealt.mapInArrow(lambda it: _pack_batches(it, limit), f"{fields}, sequence_id long, offset long")


def packed_sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, limit: int = SEQUENCE_TOKENS, keep_ids: bool = False, copies: bool = False) -> DataFrame:
    """All documents, cut and packed: one row per piece with its place."""
    return pack(pieces(docs, id_col, text_col, tokenizer, limit, keep_ids, copies), limit)
