"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds what they miss.

The field tags the words of a text (runs without white space) as B, I or O: begin of a secret, inside one,
outside. A word's score for a tag sums weights of its own shape, of the shapes of the words beside it, and of
features of the whole file; tag pairs have weights too, and Viterbi decodes the best path. Most words are
certain to be outside: where O beats both other tags by more than any two transitions can win back, every
best path passes through O, so only the stretches between such words are decoded, with the same result.

The weights are learned here, from words labelled by the fixed patterns in a sample of about ``SAMPLE_DOCS``
documents drawn by a hash of the id, and in generated lines that hold secrets of other forms. Of a sampled text
the windows that hold a match teach, and ``WINDOWS`` more that lie evenly over the whole text, ``MOST_WINDOWS`` in
all at most. That sample is the only bound; every whole text is scanned.

Defined cases: a null text is empty and has no spans; a null doc_id stays null; repeated rows are scanned alike;
very long texts are scanned whole; other columns, clashing or not, aren't looked at; an empty table gives an empty
result. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
import uuid
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import batches_of, held, prepare, renamed

KINDS = ("assign", "access", "hex", "crf")
#: The patterns of the base.
ASSIGN = re.compile(
    r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs of 24 and over of [0-9a-f]+: a run is matched whole
KEYWORDS = ("passw", "secret", "token", "api_key", "apikey")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

SAMPLE_DOCS = 600
#: The sample is drawn from a pool of about so many times its size.
POOL = 10
SAMPLE_SEED = 11
#: Words of a training window, windows that each sampled text gives besides those with a match, and in all.
WINDOW_WORDS, WINDOWS, MOST_WINDOWS = 60, 2, 20
GENERATED = 400
EPOCHS = 6
RATE = 0.2
DECAY = 1e-4
TAGS = 3  # O, B, I
CACHED_WORDS = 150_000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed patterns' matches, in order."""
    low = text.lower()
    spans = []
    if any(k in low for k in KEYWORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


#: Characters that what a base span leaves of a word must have to be a span.
LEAST_REST = 4
_TRIM = " \t\"'`,;()[]{}<>#*$%&|!?."
_CORE = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
_NAME = re.compile(r"pass|pwd|secret|token|key|auth|cred|bearer|login|private", re.ASCII | re.IGNORECASE)


def shape(word: str) -> tuple[str, ...]:
    """The features of a word itself."""
    bare = word.strip(_TRIM)
    if bare.isalpha() and len(bare) < 24:
        case = "lower" if bare.islower() else "upper" if bare.isupper() else "title" if bare[1:].islower() else "mixed"
        named = bare.isascii() and bool(_NAME.search(bare))
        return (f"alpha={case}", f"letters={min(len(bare) // 6, 3)}{case == 'mixed'}", f"alpha_named={named}")
    core = max(_CORE.findall(word), key=len, default="")
    if not core:
        named = bool(_NAME.search(word)) and word.isascii()
        return ("short", f"named={named}", f"ends={word[-1] if word and word[-1] in '=:' else ''}")
    n = len(core)
    digits = sum(map(str.isdigit, core))
    lower, upper = sum(map(str.islower, core)), sum(map(str.isupper, core))
    kinds = (digits > 0) + (lower > 0) + (upper > 0)
    turns = sum((a.isdigit(), a.isupper()) != (b.isdigit(), b.isupper()) for a, b in zip(core, core[1:]))
    distinct = len(set(core)) / n
    return (
        f"len={min(n // 4, 10)}",
        f"kinds={kinds}",
        f"digits={int(4 * digits / n)}{'' if digits else '-'}",
        f"turns={min(int(8 * turns / n), 4)}{'' if turns else '-'}",
        f"distinct={int(4 * distinct)}",
        f"hex={all(c in '0123456789abcdefABCDEF' for c in core)}",
        f"mix={kinds >= 2 and digits > 1}/{min(n // 8, 4)}",
        f"assign={any(c in word for c in '=:')}/{bool(_NAME.search(word)) and word.isascii()}",
        f"address={'@' in word or '://' in word}",
        f"pure={digits == n or lower == n or upper == n}/{min(n // 8, 4)}",
    )


def beside(word: str) -> tuple[str, ...]:
    """What a word tells about its neighbours."""
    named = bool(_NAME.search(word)) and word.isascii()
    return (f"named={named}/{word[-1:] if word[-1:] in '=:' else ''}", f"sign={word if word in ('=', ':', ':=', '=>', '->') else ''}")


def file_bucket(text: str) -> int:
    """Features of the whole file: whether it looks like settings or code, and how often it has signs."""
    signs = text.count("=") + text.count(":") + text.count("{")
    return min(3, int(math.log2(1 + 400 * signs / (len(text) + 1))))


class Tagger:
    """Weights by feature name, and the score rows of the words met so far. Words with the same features share
    a row, so there are few rows, however many words."""

    def __init__(self, weights: dict[str, np.ndarray], pairs: np.ndarray) -> None:
        self.weights, self.pairs = weights, pairs
        self.rows = np.zeros((64, 4, TAGS), np.float32)
        self.by_features: dict[tuple, int] = {}
        self.index: dict[str, int] = {}
        self.files = [self._sum([f"file={k}"]) for k in range(4)]
        # The most that two transitions can gain over those through O.
        ways = [pairs[p, a] + pairs[a, q] - pairs[p, 0] - pairs[0, q] for p in range(TAGS) for q in range(TAGS) for a in (1, 2)]
        self.margin = max(0.0, *ways) + 1e-3

    def _sum(self, names) -> np.ndarray:
        out = np.zeros(TAGS)
        for n in names:
            w = self.weights.get(n)
            if w is not None:
                out += w
        return out

    def _row(self, word: str) -> int:
        key = own, side = shape(word), beside(word)
        at = self.by_features.get(key)
        if at is None:
            at = self.by_features[key] = len(self.by_features)
            if at >= len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[at] = [self._sum(own), self._sum("next:" + x for x in side), self._sum("prev:" + x for x in side), self._sum("prev2:" + x for x in side)]
        return at

    def _ids(self, words: list[str]) -> np.ndarray:
        index = self.index
        try:
            return np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        except KeyError:
            for w in set(words).difference(index):
                index[w] = self._row(w)
        return np.fromiter(map(index.__getitem__, words), np.int64, len(words))

    def trim(self) -> None:
        """Forget the words met last once there are too many of them; the common ones came first."""
        if len(self.index) > CACHED_WORDS:
            self.index = dict(islice(self.index.items(), CACHED_WORDS // 2))

    def emissions(self, words: list[str], bucket: int) -> np.ndarray:
        ids = self._ids(words)
        n, rows = len(ids), self.rows
        e = rows[ids, 0] + self.files[bucket].astype(np.float32)
        if n > 1:
            e[:-1] += rows[ids[1:], 1]
            e[1:] += rows[ids[:-1], 2]
        if n > 2:
            e[2:] += rows[ids[:-2], 3]
        return e

    def tags(self, e: np.ndarray) -> np.ndarray:
        """Viterbi over the stretches that aren't certain to be outside."""
        out = np.zeros(len(e), np.int8)
        sure = e[:, 0] - np.maximum(e[:, 1], e[:, 2]) > self.margin
        open_at = np.nonzero(~sure)[0]
        if not len(open_at):
            return out
        breaks = np.nonzero(np.diff(open_at) > 1)[0] + 1
        for part in np.split(open_at, breaks):
            s, t = part[0], part[-1] + 1
            out[s:t] = viterbi(e[s:t], self.pairs, s > 0, t < len(e))
        return out


def viterbi(e: np.ndarray, pairs: np.ndarray, before: bool, after: bool) -> np.ndarray:
    """The best path; ``before`` and ``after`` say whether a word that is outside stands there."""
    score = e[0] + pairs[0] if before else e[0]
    back = np.zeros((len(e), TAGS), np.int8)
    for t in range(1, len(e)):
        ways = score[:, None] + pairs
        back[t] = ways.argmax(0)
        score = ways.max(0) + e[t]
    if after:
        score = score + pairs[:, 0]
    path = np.zeros(len(e), np.int8)
    path[-1] = score.argmax()
    for t in range(len(e) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def _names(words: list[str], t: int, bucket: int) -> list[str]:
    names = [*shape(words[t]), f"file={bucket}"]
    if t + 1 < len(words):
        names += ["next:" + x for x in beside(words[t + 1])]
    if t:
        names += ["prev:" + x for x in beside(words[t - 1])]
    if t > 1:
        names += ["prev2:" + x for x in beside(words[t - 2])]
    return names


def labels(text: str) -> tuple[list[str], list[int]]:
    """Words and tags as the fixed patterns see them: the words that hold a match's value."""
    words, tags = [], []
    values = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    values += [(s, e) for s, k, e in base_spans(text) if k]
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        words.append(m[0])
        tags.append(1 if any(s < m.end() and m.start() < e for s, e in values) else 0)
    return words, tags


def generated(n: int, seed: int = SAMPLE_SEED) -> list[tuple[list[str], list[int]]]:
    """Lines with secrets of forms that the patterns miss, and lines with harmless values in like places."""
    rng = random.Random(seed)
    alphabet = string.ascii_letters + string.digits
    plain = ["the", "value", "of", "is", "set", "to", "see", "https://example.com/a/b", "2024-01-05", "10.0.0.12", "version", "count", "name@example.com", "+1", "555-0100", "4111111111111111", "1234567890123456", "Name:", "coo.79@mail2.example.com", "lya.b@mail.example.org,", "size", "=", "42", "true", "internationalization", "AND", "PLEASE"]
    out = []

    def key_lines() -> list[str]:
        return ["".join(rng.choices(alphabet + "+/", k=rng.choice([48, 64]))) for _ in range(rng.randrange(2, 5))]

    def secret() -> str:
        kind = rng.randrange(4)
        if kind == 0:
            return "".join(rng.choices(alphabet, k=rng.randrange(20, 48)))
        if kind == 1:
            return "sk-" + "".join(rng.choices(alphabet, k=rng.randrange(24, 40)))
        if kind == 2:
            return "".join(rng.choices("0123456789ABCDEF", k=rng.choice([32, 40, 64])))
        return "ghp_" + "".join(rng.choices(alphabet, k=36))

    for _ in range(n):
        words = rng.choices(plain, k=rng.randrange(2, 9))
        tags = [0] * len(words)
        if rng.random() < 0.6:
            name = rng.choice(["pwd", "auth", "credential", "private_key", "access_token", "bearer", "Authorization:", "client_secret"])
            sign = rng.choice([["="], [":"], [], ["=>"]])
            words += [name, *sign, rng.choice(['"%s"', "'%s'", "%s", "%s;"]) % secret()]
            tags += [0] * (1 + len(sign)) + [1]
        elif rng.random() < 0.3:  # a key in lines: the first begins the secret, the others are inside
            lines = key_lines()
            words += ["-----BEGIN", "PRIVATE", "KEY-----", *lines, "-----END", "PRIVATE", "KEY-----"]
            tags += [0, 0, 0, 1, *[2] * (len(lines) - 1), 0, 0, 0]
        more = rng.choices(plain, k=rng.randrange(1, 6))
        out.append((words + more, tags + [0] * len(more)))
    return out


def train(samples: list[tuple[list[str], list[int], int]], epochs: int = EPOCHS) -> Tagger:
    """Stochastic gradient of the conditional log-likelihood; gradients from forward-backward marginals."""
    weights: dict[str, np.ndarray] = {}
    pairs = np.zeros((TAGS, TAGS))
    rng = random.Random(SAMPLE_SEED)
    prepared = [([_names(w, t, b) for t in range(len(w))], y) for w, y, b in samples if w]
    order = list(range(len(prepared)))
    for epoch in range(epochs):
        rng.shuffle(order)
        rate = RATE / (1 + epoch)
        for k in order:
            names, y = prepared[k]
            e = np.array([sum((weights[n] for n in x if n in weights), np.zeros(TAGS)) for x in names])
            node, edge = marginals(e, pairs)
            for t, x in enumerate(names):
                g = -node[t]
                g[y[t]] += 1
                if np.abs(g).max() < 1e-3:
                    continue
                for n in x:
                    w = weights.setdefault(n, np.zeros(TAGS))
                    w += rate * (g - DECAY * w)
            for t in range(1, len(y)):
                edge[y[t - 1], y[t]] += 1
            pairs += rate * (np.clip(edge, -3, 3) / 3 - DECAY * pairs)
    return Tagger(weights, pairs)


def marginals(e: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tag probabilities of each word, and minus the expected number of each tag pair."""
    n = len(e)
    a, b = np.zeros((n, TAGS)), np.zeros((n, TAGS))
    move = np.exp(pairs)
    local = np.exp(e - e.max(1, keepdims=True))
    a[0] = local[0]
    a[0] /= a[0].sum()
    for t in range(1, n):
        a[t] = (a[t - 1] @ move) * local[t]
        a[t] /= a[t].sum()
    b[-1] = 1
    for t in range(n - 2, -1, -1):
        b[t] = move @ (local[t + 1] * b[t + 1])
        b[t] /= b[t].sum()
    node = a * b
    node /= node.sum(1, keepdims=True)
    edge = np.zeros((TAGS, TAGS))
    if n > 1:
        joint = a[:-1, :, None] * move[None] * (local[1:] * b[1:])[:, None, :]
        edge = -(joint / joint.sum((1, 2), keepdims=True)).sum(0)
    return node, edge


def training_windows(text: str) -> list[tuple[list[str], list[int], int]]:
    """Windows of a text to learn from, with its file bucket: all that hold a match, and some evenly spread."""
    words, y = labels(text)
    starts = list(range(0, len(words), WINDOW_WORDS))
    found = [s for s in starts if any(y[s : s + WINDOW_WORDS])]
    found = found[:: -(-len(found) // (MOST_WINDOWS - WINDOWS))] if found else found
    spread = {starts[(2 * k + 1) * len(starts) // (2 * WINDOWS)] for k in range(WINDOWS)} if starts else set()
    bucket = file_bucket(text)
    return [(words[s : s + WINDOW_WORDS], y[s : s + WINDOW_WORDS], bucket) for s in sorted({*found, *spread})]


def _window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches_of(batches):
        rows = [w for text in b.column(0).to_pylist() for w in training_windows(text)]
        cols = list(zip(*rows)) if rows else [(), (), ()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.list_(pa.string()), pa.list_(pa.int32()), pa.int32()))], names=["words", "tags", "bucket"])


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Tagger:
    """``docs`` has ``doc_id, text``. About half the sample are texts that name or hold a secret."""
    texts = docs.filter(F.col("text").isNotNull())
    order = F.xxhash64("doc_id", F.lit(SAMPLE_SEED))
    share = min(1.0, POOL * sample_docs / max(1, texts.count()))
    pool = texts.filter(F.pmod(order, F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    low = F.lower("text")
    hint = low.contains("akia")
    for k in KEYWORDS:
        hint = hint | low.contains(k)
    some = pool.filter(hint).orderBy(order, "doc_id", "text").limit(sample_docs // 2).select("text")
    rest = pool.filter(~hint).orderBy(order, "doc_id", "text").limit(sample_docs - sample_docs // 2).select("text")
    windows = some.unionAll(rest).mapInArrow(_window_batches, "words array<string>, tags array<int>, bucket int")
    # At most sample_docs * MOST_WINDOWS windows, whatever the texts.
    samples = sorted((r["words"], r["tags"], r["bucket"]) for r in windows.collect())
    samples += [(w, y, k % 4) for k, (w, y) in enumerate(generated(GENERATED))]
    return train(samples)


def _without(s: int, e: int, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """What the base's spans leave of a stretch."""
    for bs, _, be in base:
        if bs < e and s < be:
            if s < bs:
                yield s, bs
            s = max(s, be)
    if s < e:
        yield s, e


def added_spans(text: str, tagger: Tagger, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Secrets that the field tags, without what the spans of the base hold of them already, and without signs at
    their ends. What is left of a word beside a base span counts from ``LEAST_REST`` characters on."""
    words = text.split()
    if not words:
        return []
    tags = tagger.tags(tagger.emissions(words, file_bucket(text)))
    hits = np.nonzero(tags)[0]
    out: list[tuple[int, int, int]] = []
    if not len(hits):
        return out
    at, t = 0, 0
    run: list[tuple[int, int, int]] = []
    for h in hits.tolist():
        while t <= h:
            at = text.index(words[t], at)
            start, at, t = at, at + len(words[t]), t + 1
        if run and tags[h] == 2 and run[-1][2] == h - 1:
            run[-1] = (run[-1][0], at, h)
        else:
            run.append((start, at, h))
    for first, last, _ in run:
        for s, e in _without(first, last, base):
            body = text[s:e]
            if (s, e) != (first, last) and len(body.strip(_TRIM)) < LEAST_REST:
                continue
            s, e = s + len(body) - len(body.lstrip(_TRIM)), e - (len(body) - len(body.rstrip(_TRIM)))
            if s < e:
                out.append((s, 3, e))
    return out


def scan(text: str | None, tagger: Tagger) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base's spans and all spans of a whole text."""
    text = text or ""
    base = base_spans(text)
    return base, sorted(base + added_spans(text, tagger, base))


def _tagger(name: str, sent) -> Tagger:
    tagger = held(name, lambda: Tagger(*sent.value))
    tagger.trim()
    return tagger


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added``, a row per document."""
    spark = docs.sparkSession
    prepare(spark)
    kept = renamed(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    tagger = fit(kept)
    sent, name = spark.sparkContext.broadcast((tagger.weights, tagger.pairs)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            own, rows = _tagger(name, sent), []
            for text in b.column(1).to_pylist():
                base, spans = scan(text, own)
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(written(base).encode()).hexdigest(), written(spans), len(spans) - len(base)))
            cols = list(zip(*rows)) if rows else [()] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.record_batch([b.column(0), *[pa.array(c, t) for c, t in zip(cols, types)]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"])

    return kept.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")


def redacted(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mask`` and ``n_chars`` counted anew; all rows and columns stay."""
    spark = docs.sparkSession
    prepare(spark)
    tagger = fit(renamed(docs, doc_id="doc_id", text="text"))
    sent, name = spark.sparkContext.broadcast((tagger.weights, tagger.pairs)), uuid.uuid4().hex
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            own, out = _tagger(name, sent), []
            for text in b.column(at).to_pylist():
                if text:
                    parts, last = [], 0
                    for s, _, e in scan(text, own)[1]:
                        if s >= last:
                            parts += [text[last:s], mask]
                        last = max(last, e)
                    text = "".join([*parts, text[last:]])
                out.append(text)
            yield pa.record_batch([*b.columns[:at], pa.array(out, pa.string()), *b.columns[at + 1 :]], names=b.schema.names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    done = docs.mapInArrow(run, fields)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done
