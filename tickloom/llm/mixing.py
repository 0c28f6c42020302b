"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Slots are numbered; slot i has the point frac((i + 1) / golden ratio), and it belongs to the source whose interval
of the cumulative target shares holds the point. So the points alone decide how many slots a source gets, and in
which order; golden-ratio points keep both within a few slots of the shares at every place of the schedule. A
source's slots are ranked, and the slot of rank r takes block r of the source's stream: its documents in shuffled
order, end to end, read again from the start as often as it has slots for, and cut into blocks of equal tokens. No
stream is read more than ``MOST_REPEATS`` times; slots beyond that stay empty. All of it is DataFrame functions, and
no task sees all of a source: orders and sums go by ranges.

There are about ``SLOTS`` slots, or as many as blocks of ``BLOCK_TOKENS`` need if that is more, so a source comes
within a few parts in ``SLOTS`` of the whole of its target.

Weights 1, 2, 3 repeat over the sources in code point order, null last. Defined cases: a null text has size 0;
a source without words has target 0; repeated rows are documents of their own, and rows that agree in id and text
may change places, which changes no result; a null doc_id is an id like any other; long texts go through many
blocks; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import WORD, cut, renamed, word_count
from tickloom.operators.sets import numbered, running

MOST_REPEATS = 3
BLOCK_TOKENS = 1024
#: Slots of a schedule, at least about.
SLOTS = 1 << 16
#: 1 / golden ratio.
STEP = 0.6180339887498949
#: Slots of one ranking group, about.
GROUP_ROWS = 1 << 12
SEED = 17
#: Equal cells of the unit interval for each source and at least, by which a point finds the sources near it.
CELLS, LEAST_CELLS = 4, 4096
#: Sources whose targets are broadcast; more are joined by shuffle.
MOST_BROADCAST = 10_000
#: Rounds of resharing the excess; each but the last finds a source that its bound holds.
ROUNDS = 200


def source_targets(sizes: DataFrame, most: int = MOST_REPEATS) -> DataFrame:
    """``(source, size)`` rows to ``(source, sid, source_size, target)``; one row per source.

    The excess over a bound is reshared until no source is above: each round is one sum over the sources, and the
    share of a weight only rises.
    """
    totals = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_null", F.col("source").isNull()), "mix-totals")
    ranked = numbered(totals, "_null", "source", name="sid").drop("_null").withColumn("sid", F.col("sid") + 1)
    ranked = cut(ranked.withColumn("weight", (F.pmod(F.col("sid") - 1, F.lit(3)) + 1).cast("double")).withColumn("bound", F.col("source_size") * F.lit(float(most))), "mix-sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = -1.0
    for _ in range(ROUNDS):
        held = F.col("bound") <= F.col("weight") * F.lit(level)
        r = ranked.agg(F.coalesce(F.sum(F.when(held, F.col("bound"))), F.lit(0.0)).alias("full"), F.sum(F.when(~held, F.col("weight"))).alias("free")).first()
        now = (total - r["full"]) / r["free"] if r["free"] else level
        if now == level:
            break
        level = now
    else:
        raise RuntimeError("targets did not settle")
    target = F.least(F.col("bound"), F.col("weight") * F.lit(level))
    return ranked.select("source", "sid", "source_size", F.when(F.col("source_size") > 0, target).otherwise(F.lit(0.0)).alias("target"))


def block_size(whole: int, block: int = BLOCK_TOKENS) -> int:
    """Tokens of a block for so many tokens in all."""
    return max(1, min(block, whole // SLOTS))


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """``(slot, sid, rank)``: the slots in order, the source that each point falls to, and the slot's rank among the
    source's slots. ``targets`` has ``sid, target``."""
    goals = targets.select("sid", F.floor("target").cast("long").alias("goal")).filter("goal > 0")
    n, whole = goals.agg(F.count("*"), F.coalesce(F.sum("goal"), F.lit(0))).first()
    count, cells = -(-whole // block), max(LEAST_CELLS, CELLS * n)
    ends = running(goals, ["sid"], "before", "goal")
    shares = ends.select("sid", (F.col("before") / F.lit(whole)).alias("since"), ((F.col("before") + F.col("goal")) / F.lit(whole)).alias("upto"))
    cell = F.explode(F.sequence(F.floor(F.col("since") * cells), F.least(F.floor(F.col("upto") * cells), F.lit(cells - 1)))).alias("cell")
    slots = goals.sparkSession.range(count).select(F.col("id").alias("slot"), (((F.col("id") + 1) * F.lit(STEP)) % F.lit(1.0)).alias("point"))
    slots = slots.withColumn("cell", F.floor(F.col("point") * cells))
    placed = slots.join(shares.select("sid", "since", "upto", cell), "cell").filter("point >= since AND point < upto")
    placed = placed.select("slot", "sid", F.floor(F.col("slot") / F.lit(GROUP_ROWS)).alias("span"))
    sums = placed.groupBy("sid", "span").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("sid").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("sid", "span", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("span_begin"))
    inner = placed.withColumn("inner", F.row_number().over(Window.partitionBy("sid", "span").orderBy("slot")) - 1)
    return inner.join(starts, ["sid", "span"]).select("slot", "sid", (F.col("span_begin") + F.col("inner")).alias("rank"))


def streams(sized: DataFrame) -> DataFrame:
    """Rows with ``row, doc_id, size, sid, key`` plus ``begin``: a document's first token in its source's stream.
    The shuffled order is that of a hash of id and text; ``row`` parts rows that agree in both."""
    place = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"|{SEED}|"), F.col("key")))
    summed = cut(running(sized.withColumn("place", place), ["sid", "place", "row"], "before", "size"), "mix-order")
    first = summed.groupBy("sid").agg(F.min("before").alias("first"))
    return summed.join(F.broadcast(first) if first.count() <= MOST_BROADCAST else first, "sid").select(*sized.columns, (F.col("before") - F.col("first")).alias("begin"))


def reads(placed: DataFrame, targets: DataFrame, block: int) -> DataFrame:
    """``(row, round, slot, got)``: for each reading of a document the slot that begins it and the words it takes.

    A document of a stream stands at ``begin`` in its first round and a whole stream later in each further one; the
    blocks that it crosses there are joined with the slots of their ranks.
    """
    each = placed.filter("size > 0").select("row", "sid", "size", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(MOST_REPEATS - 1)), lambda k: F.col("begin") + k * F.col("source_size"))).alias("round", "since"))
    upto = F.col("since") + F.col("size")
    crossed = F.explode(F.sequence(F.floor(F.col("since") / F.lit(block)), F.floor((upto - 1) / F.lit(block)))).alias("rank")
    parts = each.select("row", "round", "sid", "since", upto.alias("upto"), crossed).join(schedule(targets, block), ["sid", "rank"])
    start = F.col("rank") * F.lit(block)
    words = F.least("upto", start + F.lit(block)) - F.greatest("since", start)
    return parts.groupBy("row", "round").agg(F.min("slot").alias("slot"), F.sum(words).cast("long").alias("got"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, row: Column) -> DataFrame:
    kept = docs.select(row.alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return kept.select("row", "doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("key"))


def _mix(sized: DataFrame, block: int | None) -> tuple[DataFrame, DataFrame]:
    """Documents with their source's figures, and their readings; ``sized`` is stored."""
    targets = cut(source_targets(sized), "mix-targets")
    if block is None:
        block = block_size(targets.agg(F.coalesce(F.sum(F.floor("target")), F.lit(0))).first()[0])
    known = F.broadcast(targets) if targets.count() <= MOST_BROADCAST else targets
    own = sized.join(known, sized["source"].eqNullSafe(targets["source"])).select("row", "doc_id", "size", "key", "sid", "source_size", "target")
    placed = streams(own)
    return placed, reads(placed, targets, block)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int | None = None) -> DataFrame:
    """``doc_id, size, source_size, target, taken, first_slot``, a row per document; no document exceeds 3 times its
    size, and ``first_slot`` is null for one that the schedule doesn't reach."""
    sized = cut(_sized(docs, id_col, text_col, source_col, F.monotonically_increasing_id()), "mix-sizes")
    placed, found = _mix(sized, block)
    sums = found.groupBy("row").agg(F.sum("got").alias("taken"), F.min("slot").alias("first_slot"))
    return placed.join(sums, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def _with_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``, which names a row and stays the same from scan to scan: file and place in it for a
    plain scan of Parquet files; other tables are stored first."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        try:
            return docs.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias("_row"))
        except AnalysisException:  # files of a form without row numbers
            pass
    return cut(docs.withColumn("_row", F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))), "mix-docs")


def mixed(docs: DataFrame, block: int | None = None) -> DataFrame:
    """The documents that the mix takes, in order of the schedule and as often as it takes them: a copy for each
    whole reading and, where a reading is cut, one of the words before the cut. All columns stay; ``n_chars`` is
    counted anew. Rows that repeat an id, or have none, are documents of their own."""
    own = _with_rows(docs)
    sized = cut(_sized(own, "doc_id", "text", "source", F.col("_row")), "mix-sizes")
    found = _mix(sized, block)[1].withColumnRenamed("row", "_row")
    size = word_count(F.col("text"))
    units = F.regexp_extract_all("text", F.lit(f"([\\x20\\x09-\\x0D]*{WORD})"), F.lit(1))
    each = own.join(found.select("_row", F.col("slot").alias("_slot"), F.col("got").alias("_got")), "_row")
    short = F.array_join(F.slice(units, F.lit(1), F.col("_got").cast("int")), "")
    out = each.withColumn("text", F.when(F.col("_got") < size, short).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    ordered = out.repartitionByRange("_slot", "_row").sortWithinPartitions("_slot", "_row")
    return ordered.select(*[f"`{c}`" for c in docs.columns])
