"""Language ID by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has probabilities over the pieces of the vocabulary. The probability of a word is the sum over
all its segmentations into pieces, found by the forward algorithm; that of a text is the product over its
words. Piece probabilities come from expectation-maximisation (forward-backward counts) on the words of a
sample of labelled documents.

The sample: of each language about ``SAMPLE_DOCS`` documents, drawn by a hash of the id; it is the only bound
and all else covers all data. Words are of the lower-cased text, split at white space, without ASCII signs and
digits at their ends, and marked at their start as the vocabulary does. All pieces that are text are in use;
those that no language's sample holds are left out of the model, as they tell no language from another.
Characters that the vocabulary lacks count as one unknown piece each. Words of any length teach and are scored.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is any text if no language
was learned; ties go to the language that sorts first; repeated rows are judged alike.
"""

from __future__ import annotations

import math
import uuid
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import batches_of, held, prepare, renamed

VOCABULARY = "piece_bpe_32k.model"
SAMPLE_DOCS = 300
SAMPLE_SEED = 7
EM_ROUNDS = 3
SMOOTHING = 0.1
UNKNOWN = math.exp(-18)
MARK = "▁"
#: Words whose scores a worker keeps; others are scored anew.
CACHED_WORDS = 200_000
#: Words of up to so many characters, mark included, go through the forward algorithm many at once; longer ones
#: one by one in logarithms, to the same end.
CACHED_LENGTH = 40
NEW_WORDS = 4096
#: Signs that are taken off the ends of words.
SIGNS = "!\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~"
UNDEFINED = "und"
#: Posterior probability below which a text counts as of no one language.
LEAST_SCORE = 0.5

#: Factor for each character of a path, so that words of up to ``CACHED_LENGTH`` characters neither vanish nor
#: overflow in double precision, whatever their pieces; it is the same for all ways to cut a word.
LIFT = 9.0

_vocabularies: dict[str, frozenset[str]] = {}


def vocabulary(name: str = VOCABULARY) -> frozenset[str]:
    """All pieces of the vocabulary that are text: those of any length and case."""
    if name not in _vocabularies:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        _vocabularies[name] = frozenset(sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return _vocabularies[name]


def prefix_rows(pieces: Iterable[str]) -> dict[str, int]:
    """A number for each piece, and -1 for what only begins pieces."""
    rows = {p: k for k, p in enumerate(pieces)}
    for p in list(rows):
        for n in range(1, len(p)):
            rows.setdefault(p[:n], -1)
    return rows


def arcs(word: str, rows: dict[str, int], unknown: int) -> Iterator[tuple[int, int, int]]:
    """``(start, end, row)`` of the pieces of a word, by start; a character that is no piece is one of its own."""
    size = len(word)
    for s in range(size):
        known = False
        for e in range(s + 1, size + 1):
            r = rows.get(word[s:e])
            if r is None:
                break
            if r >= 0:
                known = known or e == s + 1
                yield s, e, r
        if not known:
            yield s, s + 1, unknown


class Lattice:
    """All ways to cut many words into pieces. A node is a place in a word, an arc a piece between two places;
    a character that is no piece is an arc of its own. Arcs that end at one place of their words are one
    step, for all words at once."""

    def __init__(self, words: list[str], rows: dict[str, int], unknown: int) -> None:
        level, start, row = array("q"), array("q"), array("q")
        sizes = [len(w) for w in words]
        base = 0
        for w, size in zip(words, sizes):
            for s, e, r in arcs(w, rows, unknown):
                level.append(e)
                start.append(base + s)
                row.append(r)
            base += size + 1
        self.nodes = base
        self.sizes = np.array(sizes, np.int64)
        self.last = np.cumsum(self.sizes + 1) - 1
        self.first = self.last - sizes
        levels, starts = np.frombuffer(level, np.int64), np.frombuffer(start, np.int64)
        self.word_of = np.repeat(np.arange(len(words)), self.sizes + 1)
        ends = self.first[self.word_of[starts]] + levels
        order = np.lexsort((ends, levels))
        self.starts, self.ends, self.rows = starts[order], ends[order], np.frombuffer(row, np.int64)[order]
        cuts = np.searchsorted(levels[order], np.arange(1, (int(levels.max()) if len(levels) else 0) + 2))
        self.steps = [(x, y) for x, y in zip(cuts.tolist(), cuts[1:].tolist()) if y > x]

    def forward(self, lifted: np.ndarray) -> np.ndarray:
        """The sums over all ways to reach each node; ``lifted`` has a row for each piece, times the factor of
        its characters."""
        alpha = np.zeros((self.nodes, lifted.shape[1]))
        alpha[self.first] = 1.0
        for x, y in self.steps:
            value = alpha[self.starts[x:y]] * lifted[self.rows[x:y]]
            new = np.nonzero(np.diff(self.ends[x:y], prepend=-1))[0]
            alpha[self.ends[x:y][new]] = np.add.reduceat(value, new, axis=0)
        return alpha

    def expected(self, lifted: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all ways to cut the words, ``weight`` times each."""
        alpha = self.forward(lifted[:, None])[:, 0]
        beta = np.zeros(self.nodes)
        beta[self.last] = 1.0
        for x, y in reversed(self.steps):
            np.add.at(beta, self.starts[x:y], lifted[self.rows[x:y]] * beta[self.ends[x:y]])
        scale = weight / alpha[self.last]
        uses = alpha[self.starts] * lifted[self.rows] * beta[self.ends] * scale[self.word_of[self.starts]]
        return np.bincount(self.rows, uses, len(lifted))


def long_forward(word: str, rows: dict[str, int], logs: np.ndarray) -> np.ndarray:
    """Log sums over all ways to reach each place of one word of any length; the last row of ``logs`` is that of
    unknown characters."""
    out = np.full((len(word) + 1, logs.shape[1]), -np.inf)
    out[0] = 0.0
    for s, e, r in arcs(word, rows, len(logs) - 1):
        np.logaddexp(out[e], out[s] + logs[r], out=out[e])
    return out


def long_expected(word: str, rows: dict[str, int], logs: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in one word of any length; ``logs`` has one column."""
    alpha = long_forward(word, rows, logs)[:, 0]
    beta = np.full(len(word) + 1, -np.inf)
    beta[-1] = 0.0
    found = list(arcs(word, rows, len(logs) - 1))
    uses = np.zeros(len(logs))
    for s, e, r in reversed(found):
        way = logs[r, 0] + beta[e]
        beta[s] = np.logaddexp(beta[s], way)
        uses[r] += math.exp(alpha[s] + way - alpha[-1])
    return uses


def lifts(names: Iterable[str]) -> np.ndarray:
    """The factor of each piece, and of an unknown character."""
    return np.exp(LIFT * np.array([*map(len, names), 1.0]))


def train_language(words: Counter, pieces: Iterable[str], rounds: int = EM_ROUNDS) -> dict[str, float]:
    """Piece probabilities of one language, smoothed over the vocabulary, from words of any length."""
    names = sorted(pieces)
    rows, lift = prefix_rows(names), lifts(names)
    short = {w: n for w, n in sorted(words.items()) if len(w) <= CACHED_LENGTH}
    long = {w: n for w, n in sorted(words.items()) if len(w) > CACHED_LENGTH}
    known = list(short.items())
    parts = [known[k : k + NEW_WORDS] for k in range(0, len(known), NEW_WORDS)]
    lattices = [(Lattice([w for w, _ in part], rows, len(names)), np.array([n for _, n in part], np.float64)) for part in parts]
    prob = np.full(len(names) + 1, 1 / max(1, len(names)))
    prob[-1] = UNKNOWN
    for _ in range(rounds):
        counts = np.zeros(len(prob))
        for lattice, weight in lattices:
            counts += lattice.expected(prob * lift, weight)
        logs = np.log(prob)[:, None]
        for w, n in long.items():
            counts += n * long_expected(w, rows, logs)
        new = counts[:-1] + SMOOTHING
        prob[:-1] = new / new.sum()
    return dict(zip(names, prob.tolist()))


def units(text: str | None) -> list[str]:
    """The words of a text in lower case, as they stand between white space."""
    return (text or "").lower().split()


def core(word: str) -> str:
    """A word without the ASCII signs and digits at its ends, which tell nothing of its language."""
    return word.strip(SIGNS)


class Scorer:
    """Log probabilities of words in every language, kept for the words met first.

    All new words of a batch go through the forward algorithm together: the pieces that end at one place of
    their words are one step, for all words and languages at once.
    """

    def __init__(self, langs: list[str], model: dict[str, np.ndarray]) -> None:
        self.langs = langs
        self.rows = prefix_rows(model)
        probs = np.array([*model.values(), np.full(len(langs), UNKNOWN)]) if model else np.full((1, len(langs)), UNKNOWN)
        self.logs, self.lifted, self.unknown = np.log(probs), probs * lifts(model)[:, None], len(model)
        self.index: dict[str, int] = {"": 0}
        self.scores, self.used = np.zeros((1024, len(langs))), 1

    def words(self, words: list[str]) -> np.ndarray:
        """A row of log probabilities for each word, each over all its segmentations."""
        short = [k for k, w in enumerate(words) if len(w) < CACHED_LENGTH]
        out = np.zeros((len(words), len(self.langs)))
        if short:
            lattice = Lattice([MARK + words[k] for k in short], self.rows, self.unknown)
            out[short] = np.log(lattice.forward(self.lifted)[lattice.last]) - LIFT * lattice.sizes[:, None]
        for k, w in enumerate(words):
            if len(w) >= CACHED_LENGTH:
                out[k] = long_forward(MARK + w, self.rows, self.logs)[-1]
        return out

    def _learn(self, new: list[str]) -> None:
        """Rows for new words; words that differ in the signs at their ends alone share one."""
        index, cores = self.index, {w: core(w) for w in new}
        fresh = [c for c in set(cores.values()) if c not in index]
        if fresh:
            at = self.used
            rows = np.concatenate([self.words(fresh[k : k + NEW_WORDS]) for k in range(0, len(fresh), NEW_WORDS)])
            while at + len(rows) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.scores[at : at + len(rows)] = rows
            index.update(zip(fresh, range(at, at + len(rows))))
            self.used = at + len(rows)
        for w, c in cores.items():
            index[w] = index[c]

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        split = [units(t) for t in texts]
        index = self.index
        new = set().union(*split).difference(index)
        if new:
            self._learn(list(new))
        flat = np.fromiter(map(index.__getitem__, chain.from_iterable(split)), np.int64)
        sizes = np.array([len(w) for w in split])
        ends = np.cumsum(sizes)
        out: list[tuple[str, float]] = []
        for text, s, e in zip(texts, ends - sizes, ends):
            if not self.langs or not text or not any(map(str.isalpha, text)):
                out.append((UNDEFINED, 0.0))
                continue
            total = self.scores[flat[s:e]].sum(0)
            best = int(total.argmax())
            out.append((self.langs[best], float(1 / np.exp(np.maximum(total - total[best], -700)).sum())))
        for w in [w for w in new if len(w) > CACHED_LENGTH]:
            del index[w]
        if len(index) > CACHED_WORDS or self.used > 2 * CACHED_WORDS:  # the common words came first: their rows are the first
            self.index = dict(islice(index.items(), CACHED_WORDS // 2))
            self.used = 1 + max(self.index.values())
        return out


def learns(doc_id: Column) -> Column:
    """True for documents that may be learned from: crc32 of the id as text, mod 4, is not 2."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 != 2


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}
    for b in batches_of(batches):
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            counts.setdefault(lang, Counter()).update(map(core, units(text)))
    for lang, words in counts.items():
        yield pa.record_batch([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["lang", "word", "n"])


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, rounds: int = EM_ROUNDS, vocabulary_name: str = VOCABULARY) -> tuple[list[str], dict[str, np.ndarray]]:
    """``docs`` has ``doc_id, text, lang``. The model is bounded by the vocabulary and the languages."""
    prepare(docs.sparkSession)
    usable = docs.filter(learns(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    if not sizes:
        return [], {}
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample_docs / n))).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(SAMPLE_SEED)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = usable.filter(draw < share).select("lang", "text")
    counted = sample.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pieces = vocabulary(vocabulary_name)
        prob = train_language(Counter({MARK + w: n for w, n in zip(pdf["word"], pdf["n"]) if w}), pieces, rounds)
        floor = min(prob.values())
        kept = {p: v for p, v in prob.items() if v > 1.01 * floor}
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "piece": ["", *kept], "prob": [floor, *kept.values()]})

    rows = counted.groupBy("lang").applyInPandas(one, "lang string, piece string, prob double").collect()
    langs = sorted({r["lang"] for r in rows})
    floors = np.array([next(r["prob"] for r in rows if r["lang"] == x and r["piece"] == "") for x in langs])
    model: dict[str, np.ndarray] = {}  # pieces that no language uses are as good as absent
    at = {x: k for k, x in enumerate(langs)}
    for r in rows:
        if r["piece"]:
            model.setdefault(r["piece"], floors.copy())[at[r["lang"]]] = r["prob"]
    return langs, model


def predict(docs: DataFrame, langs: list[str], model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, lang_pred, score`` and the columns named in ``keep``, a row per document."""
    spark = docs.sparkSession
    prepare(spark)
    sent, name = spark.sparkContext.broadcast((langs, model)), uuid.uuid4().hex
    kept = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), *keep)
    fields = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in kept.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(name, lambda: Scorer(*sent.value))
        for b in batches_of(batches):
            got = scorer.texts(b.column(1).to_pylist())
            arrays = [b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), *b.columns[2:]]
            yield pa.record_batch(arrays, names=["doc_id", "lang_pred", "score", *keep])

    return kept.mapInArrow(run, f"doc_id long, lang_pred string, score double{fields}")


def identified(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Train on the labelled documents that may be learned from, then predict for all."""
    langs, model = train(renamed(docs, doc_id="doc_id", text="text", lang="lang"))
    return predict(docs, langs, model, keep=keep)


def accepted(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose text has a language with a posterior probability of ``least`` or more; all
    columns stay as they are. Texts without a letter go, and those between languages."""
    spark = docs.sparkSession
    langs, model = train(renamed(docs, doc_id="doc_id", text="text", lang="lang"))
    sent, name = spark.sparkContext.broadcast((langs, model)), uuid.uuid4().hex
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(name, lambda: Scorer(*sent.value))
        for b in batches_of(batches):
            yield b.filter(pa.array([lang != UNDEFINED and score >= least for lang, score in scorer.texts(b.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
