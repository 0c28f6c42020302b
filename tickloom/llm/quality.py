"""Quality rules with weak supervision, in DataFrame functions only.

Each rule votes for (1) or against (-1) a document or abstains (0). Vote patterns are counted over all
documents; expectation-maximisation over the pattern counts estimates how often each rule's votes are right,
and a document is kept if the posterior probability that it is good reaches one half. There are at most
3^rules patterns, whatever the input, and one row of sums reaches the driver per round.

Defined cases: a null or empty text has no words and fails; repeated rows count each; an empty table gives an
empty result. Word windows are compared by 64-bit hash within one text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import WORD, cut, renamed

WINDOW = 3
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
SYMBOLS = "#*$%&|<>"
ROUNDS = 25
KEEP = 0.5
#: Where the search starts: how often a rule's vote is right, and how many documents are good.
FIRST_ACCURACY, FIRST_GOOD = 0.8, 0.7
ACCURACY_BOUNDS, GOOD_BOUNDS = (0.6, 0.99), (0.2, 0.9)


def _repeat_words() -> Column:
    """Words inside three-word windows that the text holds twice or more, the first included. ``marks`` has
    the (hash, place) of the windows in order; equal hashes stand side by side there."""
    def near(i: Column) -> Column:
        at, n = F.get("marks", i), F.size("marks")
        before = (i > 0) & (F.get("marks", i - 1)["h"] == at["h"])
        return before | ((i + 1 < n) & (F.get("marks", i + 1)["h"] == at["h"]))

    return F.transform(F.filter(F.sequence(F.lit(0), F.size("marks") - 1), near), lambda i: F.get("marks", i)["p"])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` with the counts that the rules look at, a row per document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = renamed(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), text.alias("text"))
    worded = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    packed = F.translate("text", " \t\n\x0b\f\r", "")
    counted = base.select(
        "doc_id",
        F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)).alias("words"),
        worded.alias("lines"),
        F.length("text").cast("long").alias("n_chars"),
        F.length(packed).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.translate("text", "0123456789", "")).alias("undigited"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("text", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
    )
    n = F.size("words")
    window = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)]))
    hashed = counted.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        (F.col("n_chars") - F.col("undigited")).cast("long").alias("n_digits"),
        "n_upper",
        "n_letters",
        F.when(n >= WINDOW, window).otherwise(F.array().cast("array<bigint>")).alias("hashes"),
    )
    # Most texts repeat few windows; only those that repeat any are sorted.
    repeated = F.size("hashes") > F.size(F.array_distinct("hashes"))
    pairs = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    marked = hashed.withColumn("marks", F.when(repeated, pairs)).drop("hashes")
    placed = marked.withColumn("places", F.when(F.col("marks").isNotNull(), F.sort_array(_repeat_words()))).drop("marks")
    step = F.aggregate(
        "places",
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-WINDOW).alias("end")),
        lambda a, p: F.struct((a["sum"] + F.least(F.lit(WINDOW), p + WINDOW - a["end"])).cast("long").alias("sum"), (p + WINDOW).alias("end")),
        lambda a: a["sum"],
    )
    return placed.withColumn("n_repeat_words", F.coalesce(F.when(F.col("places").isNotNull(), step), F.lit(0)).cast("long")).drop("places")


def rules() -> dict[str, Column]:
    """Votes by name: 1 for good, -1 for bad, 0 to abstain. Most rules know signs of bad documents only."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    symbols, repeats = F.col("n_symbols") / words, F.col("n_repeat_words") / words
    lines, mean = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), F.col("word_chars") / words
    digits, upper, letters = F.col("n_digits") / chars, F.col("n_upper") / chars, F.col("n_letters") / chars
    bad = lambda found: F.when(found, -1).otherwise(0)
    return {
        "length": bad(F.col("n_words") < LEAST_WORDS),
        "symbols": bad(symbols > 0.1),
        "repeats": bad(repeats > 0.5),
        "lines": bad(lines > 0.3),
        "word_length": bad((mean < 2.5) | (mean > 15)),
        "digits": bad(digits > 0.2),
        "upper": bad(upper > 0.4),
        "letters": F.when(letters < 0.85, -1).when(letters >= 0.92, 1).otherwise(0),
    }


def _log_odds(accuracy: dict[str, float], good: float) -> Column:
    """Log odds of good for a row of votes: each vote counts by how often its rule is right."""
    odds = F.lit(math.log(good / (1 - good)))
    for name, a in accuracy.items():
        odds = odds + F.col(f"v_{name}") * F.lit(math.log(a / (1 - a)))
    return odds


def fit(patterns: DataFrame, names: list[str], rounds: int = ROUNDS) -> tuple[dict[str, float], float]:
    """EM over ``v_<name>`` columns and the count ``n``: each rule's accuracy among its votes, and the share of
    good documents. Both stay within bounds that keep a rule better than chance and no side empty."""
    accuracy, good = dict.fromkeys(names, FIRST_ACCURACY), FIRST_GOOD
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-_log_odds(accuracy, good)))
        sums = [F.sum(F.col("n") * p).alias("good"), F.sum("n").alias("all")]
        for k in names:
            v = F.col(f"v_{k}")
            sums += [F.sum(F.col("n") * F.when(v == 1, p).when(v == -1, 1 - p).otherwise(0.0)).alias(f"right_{k}"), F.sum(F.when(v != 0, F.col("n")).otherwise(0)).alias(f"votes_{k}")]
        r = patterns.agg(*sums).first()
        if not r["all"]:
            break
        bound = lambda x, low, high: min(high, max(low, x))
        new = {k: bound((r[f"right_{k}"] + FIRST_ACCURACY) / (r[f"votes_{k}"] + 1), *ACCURACY_BOUNDS) for k in names}
        now = bound(r["good"] / r["all"], *GOOD_BOUNDS)
        settled = abs(now - good) < 1e-6 and all(abs(new[k] - accuracy[k]) < 1e-6 for k in names)
        accuracy, good = new, now
        if settled:
            break
    return accuracy, good


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Counts, ``base_failed``, ``good`` (posterior probability) and ``kept``, a row per document."""
    votes = rules()
    measured = cut(features(docs, id_col, text_col), "quality")
    voted = measured.select("*", *[v.cast("int").alias(f"v_{k}") for k, v in votes.items()])
    patterns = cut(voted.groupBy(*[f"v_{k}" for k in votes]).agg(F.count("*").alias("n")).coalesce(1), "patterns")
    accuracy, good = fit(patterns, list(votes), rounds)
    posterior = 1 / (1 + F.exp(-_log_odds(accuracy, good)))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return voted.select(*measured.columns, failed.alias("base_failed"), posterior.alias("good")).withColumn("kept", ~F.col("base_failed") & (F.col("good") >= KEEP))
