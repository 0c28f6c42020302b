"""The query catalogue: each operator on the driver's tables, with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions import arrays, bins, bits, hashes, numbers, text
from tickloom.operators import binning, coverage, islands, joins, metrics, sets, summary, ticks, vectors, windows
from tickloom.plans import shards, splits
from tickloom.sources.tables import table
from tickloom.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

T = """t AS (SELECT user_id AS session, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS idx, event_id, ts,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS mask, value AS x, event_type AS state FROM events)"""
BITS = 7


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _ticks(spark: SparkSession, d: str) -> DataFrame:
    return ticks.from_events(table(spark, d, "events"))


# Binning


@query(f"WITH {T} SELECT session, idx, state, x FROM (SELECT *, max(idx) OVER (PARTITION BY session) AS last FROM t) WHERE idx % 3 = 0 OR idx = last")
def anchor_observations(spark, d):
    return binning.anchors(_ticks(spark, d)).select("session", "idx", "state", "x")


@query(
    f"""WITH {T} SELECT session, (idx - 1) // 3 AS transition, string_agg(CAST(mask AS VARCHAR), ',' ORDER BY idx) AS actions, count(*) AS steps,
    count(*) < 3 AS partial, round(count(*) / 60.0::DOUBLE, 6) AS seconds FROM t WHERE idx >= 1 GROUP BY ALL"""
)
def bin_transitions(spark, d):
    out = binning.transitions(_ticks(spark, d))
    return out.select("session", "transition", F.array_join(F.col("actions").cast("array<string>"), ",").alias("actions"), "steps", "partial", F.round("seconds", 6).alias("seconds"))


@query(
    f"""WITH {T}, g AS (SELECT session, (idx - 1) // 3 AS transition, list(mask ORDER BY idx) AS a FROM t WHERE idx >= 1 GROUP BY ALL)
    SELECT session, transition, a[1] || ',' || a[least(2, len(a))] || ',' || a[least(3, len(a))] AS padded, CAST(len(a) AS BIGINT) AS valid FROM g"""
)
def transition_padding(spark, d):
    out = binning.transitions(_ticks(spark, d))
    return out.select("session", "transition", F.array_join(F.col("padded").cast("array<string>"), ",").alias("padded"), F.size(F.filter("valid", lambda x: x)).cast("long").alias("valid"))


@query(
    f"""WITH {T}, m AS (SELECT *, max(idx) OVER (PARTITION BY session) AS last FROM t)
    SELECT session, count(*) AS ticks, count(*) FILTER (idx % 3 = 0 OR idx = last) AS anchors, CAST(ceil((count(*) - 1) / 3.0) AS BIGINT) AS transitions,
    CAST((count(*) - 1) % 3 > 0 AS BIGINT) AS partial, count(*) - 1 AS actions, true AS round_trip FROM m GROUP BY session"""
)
def binning_manifest(spark, d):
    t = _ticks(spark, d)
    return binning.manifest(t).join(binning.round_trip(t), "session", "left")


@query(
    """WITH g AS (SELECT user_id AS session, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events)
    SELECT session, count(*) AS n, count(*) FILTER (step <> 1) AS gaps FROM g GROUP BY session"""
)
def contiguity_audit(spark, d):
    own = table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("idx"))
    return ticks.contiguity(own)


@query(
    f"""WITH {T}, p AS (SELECT *, coalesce(lag(mask) OVER (PARTITION BY session ORDER BY idx), 0) AS before FROM t)
    SELECT session, idx, mask & ~before AS pressed, before & ~mask AS released FROM p"""
)
def mask_edges(spark, d):
    return binning.edges(_ticks(spark, d)).select("session", "idx", "pressed", "released")


_RISING = f"""WITH {T}, p AS (SELECT *, coalesce(lag(mask) OVER (PARTITION BY session ORDER BY idx), 0) AS before, max(idx) OVER (PARTITION BY session) AS last FROM t),
  c AS (SELECT session, idx, last, CAST(bit_count(mask & ~before) AS BIGINT) AS n FROM p WHERE idx >= 1)"""


@query(_RISING + "SELECT session, CAST(sum(n) AS BIGINT) AS rising FROM c GROUP BY session")
def rising_edge_counts(spark, d):
    return binning.rising_counts(_ticks(spark, d)).select("session", "rising")


@query(
    _RISING
    + """SELECT session, CAST(sum(n) AS BIGINT) AS rising, CAST(sum(CASE WHEN idx % 3 = 0 OR idx = last THEN n ELSE 0 END) AS BIGINT) AS retained,
    CAST(sum(CASE WHEN idx % 3 = 0 OR idx = last THEN 0 ELSE n END) AS BIGINT) AS lost FROM c GROUP BY session"""
)
def sampled_edge_loss(spark, d):
    return binning.rising_counts(_ticks(spark, d))


_HIDDEN = f"""WITH {T}, m AS (SELECT *, max(idx) OVER (PARTITION BY session) AS last FROM t),
  b AS (SELECT session, idx, (idx % 3 = 0 OR idx = last) AS seen, bit, (mask >> bit) & 1 AS held FROM m, (SELECT unnest(generate_series(0, {BITS - 1})) AS bit)),
  s AS (SELECT *, CASE WHEN held = 1 AND coalesce(lag(held) OVER (PARTITION BY session, bit ORDER BY idx), 0) = 0 THEN 1 ELSE 0 END AS start FROM b),
  r AS (SELECT *, sum(start) OVER (PARTITION BY session, bit ORDER BY idx) AS run FROM s),
  g AS (SELECT session, bit, run, min(idx) AS first, bool_or(seen) AS seen FROM r WHERE held = 1 GROUP BY ALL),
  h AS (SELECT session, count(*) FILTER (first >= 1 AND NOT seen) AS hidden FROM g GROUP BY session)"""


@query(_HIDDEN + "SELECT session, coalesce(hidden, 0) AS hidden FROM (SELECT DISTINCT session FROM t) LEFT JOIN h USING (session)")
def hidden_pulses(spark, d):
    return binning.hidden_pulses(_ticks(spark, d), bit_count=BITS)


@query(
    _HIDDEN
    + """, p AS (SELECT *, coalesce(lag(mask) OVER (PARTITION BY session ORDER BY idx), 0) AS before FROM m),
    c AS (SELECT session, CAST(sum(bit_count(mask & ~before)) AS BIGINT) AS rising, CAST(sum(CASE WHEN idx % 3 = 0 OR idx = last THEN bit_count(mask & ~before) ELSE 0 END) AS BIGINT) AS retained
      FROM p WHERE idx >= 1 GROUP BY session)
    SELECT session, rising, retained, rising - retained AS lost, coalesce(hidden, 0) AS hidden FROM c LEFT JOIN h USING (session)"""
)
def naive_sampling_report(spark, d):
    return binning.sampling_report(_ticks(spark, d), bit_count=BITS)


@query(
    f"""WITH {T}, g AS (SELECT session, (idx - 1) // 3 AS transition, list(mask ORDER BY idx) AS a FROM t WHERE idx >= 1 GROUP BY ALL),
    p AS (SELECT session, transition, [a[1], a[least(2, len(a))], a[least(3, len(a))]] AS a FROM g),
    w AS (SELECT *, coalesce(lag(a) OVER (PARTITION BY session ORDER BY transition), last(a) OVER (PARTITION BY session ORDER BY transition ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS r FROM p)
    SELECT session, transition, r[1] || ',' || r[2] || ',' || r[3] AS rolled, a[3] || ',' || a[2] || ',' || a[1] AS reversed FROM w"""
)
def action_interventions(spark, d):
    out = binning.interventions(binning.transitions(_ticks(spark, d)))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return out.select("session", "transition", joined("rolled"), joined("reversed"))


# Runs


_RUNS = f"""WITH {T}, s AS (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER (PARTITION BY session ORDER BY idx) OR idx = 0 THEN 1 ELSE 0 END AS start FROM t),
  r AS (SELECT *, sum(start) OVER (PARTITION BY session ORDER BY idx) AS run FROM s),
  g AS (SELECT session, run, any_value(state) AS value, min(idx) AS "start", max(idx) AS "end", count(*) AS length FROM r GROUP BY session, run)"""


@query(_RUNS + 'SELECT session, value, "start", "end", length FROM g WHERE length >= 2')
def state_runs(spark, d):
    return islands.value_runs(_ticks(spark, d), ("session",), "idx", "state", least=2)


@query(_RUNS + 'SELECT session, value, "start", "end", length FROM g ORDER BY length DESC, session, "start" LIMIT 20')
def long_runs_topk(spark, d):
    found = islands.value_runs(_ticks(spark, d), ("session",), "idx", "state")
    return sets.limited(found, 20, [F.desc("length"), F.col("session"), F.col("start")])


@query(
    f"""WITH {T}, f AS (SELECT *, state IN ('click', 'view') AS flag FROM t),
    s AS (SELECT *, CASE WHEN flag AND NOT coalesce(lag(flag) OVER (PARTITION BY session ORDER BY idx), false) THEN 1 ELSE 0 END AS start FROM f),
    r AS (SELECT *, sum(start) OVER (PARTITION BY session ORDER BY idx) AS run FROM s)
    SELECT session, min(idx) AS run_start, max(idx) AS run_end, count(*) AS run_len, 'click|view' AS run_value FROM r WHERE flag GROUP BY session, run HAVING count(*) >= 2"""
)
def flag_runs(spark, d):
    found = islands.runs(_ticks(spark, d), ("session",), "idx", F.col("state").isin("click", "view"), least=2)
    return found.select("session", F.col("start").alias("run_start"), F.col("end").alias("run_end"), F.col("length").alias("run_len"), F.lit("click|view").alias("run_value"))


@query(
    f"""WITH {T}, j AS (SELECT date_diff('hour', TIMESTAMP '2000-01-01', ts) AS hour, bool_and(x > 10) AS all_hold FROM t GROUP BY 1),
    s AS (SELECT *, CASE WHEN all_hold AND NOT coalesce(lag(all_hold) OVER (ORDER BY hour) AND hour - lag(hour) OVER (ORDER BY hour) = 1, false) THEN 1 ELSE 0 END AS start FROM j),
    r AS (SELECT *, sum(start) OVER (ORDER BY hour) AS run FROM s)
    SELECT CAST(min(hour) AS BIGINT) AS "start", CAST(max(hour) AS BIGINT) AS "end", count(*) AS length FROM r WHERE all_hold GROUP BY run"""
)
def joint_runs(spark, d):
    t = _ticks(spark, d).withColumn("hour", F.timestamp_diff("HOUR", F.to_timestamp_ntz(F.lit("2000-01-01 00:00:00")), F.col("ts")).cast("long"))
    held = islands.joint(t, (), "hour", F.col("x") > 10)
    return islands.ranged_runs(held, "hour", F.col("all_hold"), 24).select("start", "end", "length")


@query(f"WITH {T}, p AS (SELECT *, lag(x) OVER (PARTITION BY session ORDER BY idx) AS before FROM t) SELECT session, idx, before, x FROM p WHERE x > before AND mask % 2 = 1")
def value_jump_events(spark, d):
    return islands.jumps(_ticks(spark, d), "x", attributed=F.col("mask") % 2 == 1).select("session", "idx", "before", "x")


@query(
    """WITH p AS (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders)
    SELECT o_custkey, o_orderkey, before, o_orderstatus FROM p WHERE before IS NOT NULL AND before <> o_orderstatus"""
)
def owner_transitions(spark, d):
    out = islands.transitions(table(spark, d, "orders"), ("o_custkey",), ("o_orderdate", "o_orderkey"), "o_orderstatus")
    return out.select("o_custkey", "o_orderkey", "before", "o_orderstatus")


# Windows


@query(
    f"""WITH {T}, n AS (SELECT session, count(*) AS n FROM t GROUP BY session)
    SELECT session, n, clip, clip * 6 AS "first", clip * 6 + 11 AS "last" FROM n, unnest(generate_series(0, (n - 12) // 6)) AS u(clip) WHERE n >= 12"""
)
def clip_windows(spark, d):
    return windows.clips(_ticks(spark, d).groupBy("session").agg(F.count("*").alias("n")), 12, 6)


@query(f"WITH {T} SELECT session, count(*) AS n, CAST(greatest(0, 1 + floor((count(*) - 12) / 6.0)) AS BIGINT) AS clips FROM t GROUP BY session")
def clip_counts(spark, d):
    sizes = _ticks(spark, d).groupBy("session").agg(F.count("*").alias("n"))
    return sizes.withColumn("clips", numbers.clip_count("n", 12, 6))


@query(
    f"""WITH {T}, r AS (SELECT session, min(idx) AS "first", max(idx) AS "last" FROM t GROUP BY session)
    SELECT session, c AS chunk_first, least("last", c + 11) AS chunk_last, "first" + ("last" - "first") // 3 * 3 AS grid_last FROM r, unnest(generate_series("first", "last", 12)) AS u(c)"""
)
def chunk_ranges(spark, d):
    spans = _ticks(spark, d).groupBy("session").agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
    return windows.chunks(spans, 12).select("session", "chunk_first", "chunk_last", numbers.grid_last("first", "last").alias("grid_last"))


@query(
    f"""WITH {T}, w AS (SELECT session, idx, count(*) OVER f AS n, avg(x) OVER f AS m, min(x) OVER f AS low, max(x) OVER f AS high FROM t
    WINDOW f AS (PARTITION BY session ORDER BY idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) SELECT session, idx, round(m, 6) AS mean, low, high FROM w WHERE n = 3"""
)
def moving_window_stats(spark, d):
    return windows.moving(_ticks(spark, d), "x", 3).select("session", "idx", F.round("mean", 6).alias("mean"), "low", "high")


@query(f"WITH {T} SELECT session, (idx - 1) // 3 AS transition, round(avg(x), 6) AS mean, arg_min(x, idx) AS first, arg_max(x, idx) AS last FROM t WHERE idx >= 1 GROUP BY ALL")
def microstep_summary(spark, d):
    return windows.microsteps(_ticks(spark, d), "x").select("session", "transition", F.round("mean", 6).alias("mean"), "first", "last")


@query(
    f"""WITH {T}, g AS (SELECT session, (idx - 1) // 3 AS transition, list(x ORDER BY idx) AS a FROM t WHERE idx >= 1 GROUP BY ALL)
    SELECT session, transition, round(list_sum(a) / len(a), 6) AS mean_part, round(a[-1] * len(a), 6) AS last_sum, round(list_sum(a) / len(a) + a[1] + a[-1], 6) AS mixed_sum FROM g"""
)
def microstep_forms(spark, d):
    own = binning.transitions(_ticks(spark, d), "x")
    form = lambda kind: arrays.microsteps("actions", kind)
    return own.select(
        "session",
        "transition",
        F.round(F.element_at(form("mean_repeated"), 1), 6).alias("mean_part"),
        F.round(F.element_at(form("last_repeated"), 1) * F.size(form("last_repeated")), 6).alias("last_sum"),
        F.round(arrays.total(form("mean_first_last")), 6).alias("mixed_sum"),
    )


@query(f"WITH {T} SELECT session, idx, coalesce(lag(state) OVER (PARTITION BY session ORDER BY idx), 'start') AS past FROM t")
def next_state_roll(spark, d):
    return binning.shifted(_ticks(spark, d), "state", "start", order="idx").select("session", "idx", "past")


@query(
    f"""WITH {T}, p AS (SELECT *, coalesce(lag(mask) OVER (PARTITION BY session ORDER BY idx), 0) AS before FROM t)
    SELECT session, idx, xor(mask, before) AS "xor", ((mask - before) % 256 + 256) % 256 AS difference FROM p"""
)
def delta_encode(spark, d):
    return windows.deltas(_ticks(spark, d), "mask").select("session", "idx", "xor", "difference")


@query(
    f"""WITH {T}, s AS (SELECT session, idx, max(x) OVER (PARTITION BY session ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen, x FROM t)
    SELECT session, idx, x FROM s WHERE seen IS NULL OR x > seen"""
)
def monotone_rows(spark, d):
    return ticks.monotone(_ticks(spark, d), "x", "idx").select("session", "idx", "x")


@query(f"WITH {T}, p AS (SELECT *, lag(state) OVER (PARTITION BY session ORDER BY idx) AS before FROM t) SELECT session, idx, state FROM p WHERE idx = 0 OR state IS DISTINCT FROM before")
def consecutive_dedup(spark, d):
    return ticks.without_repeats(_ticks(spark, d), "state", "idx").select("session", "idx", "state")


@query(
    f"""WITH {T}, n AS (SELECT session, count(*) AS n FROM t GROUP BY session), p AS (SELECT DISTINCT session, u.p FROM n, unnest([0, n // 2, n - 1]) AS u(p))
    SELECT t.session, t.idx, t.state FROM t JOIN p ON t.session = p.session AND t.idx = p.p"""
)
def sample_positions(spark, d):
    t = _ticks(spark, d)
    spots = t.groupBy("session").agg(F.count("*").alias("n")).select("session", F.explode(arrays.first_middle_last("n").cast("array<bigint>")).alias("idx"))
    return t.join(spots, ["session", "idx"]).select("session", "idx", "state")


@query(
    """WITH n AS (SELECT count(*) AS n FROM documents), r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)
    SELECT doc_id FROM r, n WHERE i IN (SELECT CAST(round(k * (n - 1) / 8.0::DOUBLE) AS BIGINT) FROM generate_series(0, 8) AS g(k), n)"""
)
def stratified_positions(spark, d):
    return windows.stratified(table(spark, d, "documents").select("doc_id"), 9, ("doc_id",))


# Coverage


@query(f"WITH {T} SELECT state, count(*) AS n FROM t GROUP BY state")
def state_distribution(spark, d):
    return coverage.counts(_ticks(spark, d), "state")


@query(
    f"""WITH {T}, h AS (SELECT date_trunc('hour', ts) AS hour, CAST(session % 2 AS INTEGER) AS slot, max(state) AS state FROM t GROUP BY ALL),
    p AS (SELECT hour, max(CASE WHEN slot = 0 THEN state END) AS state_0, max(CASE WHEN slot = 1 THEN state END) AS state_1 FROM h GROUP BY hour)
    SELECT state_0, state_1, count(*) AS n FROM p WHERE state_0 IS NOT NULL AND state_1 IS NOT NULL GROUP BY ALL"""
)
def joint_state_pairs(spark, d):
    own = _ticks(spark, d).withColumn("hour", F.date_trunc("hour", "ts")).withColumn("slot", F.col("session") % 2).groupBy("hour", "slot").agg(F.max("state").alias("state"))
    return coverage.counts(joins.ordered_pairs(own, ["hour"], "slot", ["state"]), "state_0", "state_1")


_XBIN = bins.binned_sql("x", bins.PERCENT)


@query(
    f"""WITH {T}, b AS (SELECT *, {_XBIN} AS xbin, CAST(ts AS DATE) AS day FROM t)
    SELECT state, xbin, count(*) AS rows, count(DISTINCT session) AS sessions, count(DISTINCT day) AS days FROM b GROUP BY GROUPING SETS ((state), (xbin), (state, xbin))"""
)
def coverage_support(spark, d):
    own = _ticks(spark, d).withColumn("xbin", bins.binned("x", bins.PERCENT))
    return coverage.grouped_support(own, ["state", "xbin"], [["state"], ["xbin"], ["state", "xbin"]], "session", F.to_date("ts"))


@query(
    f"""WITH {T}, b AS (SELECT session, CAST(ts AS DATE) AS day, u.key FROM t, unnest(['state=' || state, 'bin=' || ({_XBIN}), 'state-bin=' || state || ':' || ({_XBIN})]) AS u(key))
    SELECT key, count(*) AS rows, count(DISTINCT session) AS sessions, count(DISTINCT (session, day)) AS actors FROM b GROUP BY key"""
)
def key_family_support(spark, d):
    own = _ticks(spark, d).withColumn("actor", F.to_date("ts"))
    xbin = bins.binned("x", bins.PERCENT)
    keys = coverage.key_families(own, {"state": F.col("state"), "bin": xbin, "state-bin": F.concat_ws(":", "state", xbin)})
    return coverage.support(keys)


@query(
    f"""WITH {T}, c AS (SELECT session, state, count(*) AS n FROM t GROUP BY ALL)
    SELECT session, state, n, {bins.binned_sql("n", bins.SUPPORT)} AS support FROM c"""
)
def support_classes(spark, d):
    own = _ticks(spark, d).groupBy("session", "state").agg(F.count("*").alias("n"))
    return own.withColumn("support", coverage.support_class("n"))


@query(f"WITH {T}, r AS (SELECT state, event_id, row_number() OVER (PARTITION BY state ORDER BY event_id) AS place FROM t) SELECT state, event_id, place FROM r WHERE place <= 5")
def bounded_examples(spark, d):
    return coverage.examples(_ticks(spark, d), ("state",), ("event_id",)).select("state", "event_id", F.col("place").cast("long").alias("place"))


@query(
    f"""WITH {T} SELECT session, idx, {_XBIN} AS percent, {bins.binned_sql("x - 60", bins.X)} AS xb, {bins.binned_sql("x - 40", bins.Y)} AS yb,
    {bins.binned_sql("mask", bins.EPISODE)} AS episode FROM t"""
)
def value_bins(spark, d):
    return _ticks(spark, d).select(
        "session", "idx", bins.binned("x", bins.PERCENT).alias("percent"), bins.binned(F.col("x") - 60, bins.X).alias("xb"), bins.binned(F.col("x") - 40, bins.Y).alias("yb"), bins.binned("mask", bins.EPISODE).alias("episode")
    )


_GEO = f"""WITH {T}, g AS (SELECT session, idx, x - 60 AS px, mask - 30.0::DOUBLE AS py, mask % 2 = 1 AS air, mask % 17 = 0 AS dead, mask + 200 AS st FROM t)"""


@query(
    _GEO
    + """ SELECT session, idx, CASE WHEN dead THEN 'dead-or-respawn' WHEN st BETWEEN 252 AND 263 THEN CASE WHEN px < 0 THEN 'left-ledge' ELSE 'right-ledge' END
    WHEN py < 0 THEN CASE WHEN abs(px) < 55 THEN 'under-stage' WHEN px < 0 THEN 'below-left-offstage' ELSE 'below-right-offstage' END
    WHEN abs(px) > 68.4 THEN CASE WHEN px < 0 THEN 'side-left-offstage' ELSE 'side-right-offstage' END
    WHEN NOT air THEN CASE WHEN py > 35 THEN 'top-platform' WHEN py > 8 THEN CASE WHEN px < 0 THEN 'left-platform' ELSE 'right-platform' END
      WHEN px < -35 THEN 'main-floor-left' WHEN px > 35 THEN 'main-floor-right' ELSE 'main-floor-center' END
    WHEN py >= 60 THEN 'above-stage-high' WHEN py >= 25 THEN 'above-stage-mid' ELSE 'above-stage-low' END AS zone,
    NOT dead AND (py < 0 OR abs(px) > 68.4) AS offstage, NOT dead AND (abs(px) > 110 OR py > 80 OR py < -25) AS offscreen FROM g"""
)
def zones(spark, d):
    g = _ticks(spark, d).select("session", "idx", (F.col("x") - 60).alias("px"), (F.col("mask") - 30.0).alias("py"), (F.col("mask") % 2 == 1).alias("air"), (F.col("mask") % 17 == 0).alias("dead"), (F.col("mask") + 200).alias("st"))
    return g.select("session", "idx", bins.zone("px", "py", "air", "dead", "st").alias("zone"), bins.offstage("px", "py", "dead").alias("offstage"), bins.offscreen("px", "py", "dead").alias("offscreen"))


@query(
    f"""WITH {T}, p AS (SELECT session, idx, x, mask, lag(x) OVER w AS bx, lag(mask) OVER w AS bm FROM t WINDOW w AS (PARTITION BY session ORDER BY idx)),
    q AS (SELECT *, sqrt((x - bx) * (x - bx) + CAST(mask - bm AS DOUBLE) * (mask - bm)) AS dist, (bx - x) * (mask % 3 - 1) >= 0 AS a, (x - bx) * (bm % 3 - 1) >= 0 AS b FROM p WHERE bx IS NOT NULL)
    SELECT {bins.binned_sql("dist", bins.DISTANCE)} AS distance, CASE WHEN a AND b THEN 'both-facing-toward' WHEN NOT a AND NOT b THEN 'both-facing-away' ELSE 'one-facing-toward' END AS facing,
    CASE WHEN mask % 4 = bm % 4 THEN 'stocks-tied' WHEN abs(mask % 4 - bm % 4) >= 2 THEN 'stock-lead-2+' ELSE 'stock-lead-1' END AS stocks, count(*) AS n FROM q GROUP BY ALL"""
)
def pair_relations(spark, d):
    w = Window.partitionBy("session").orderBy("idx")
    p = _ticks(spark, d).withColumn("bx", F.lag("x").over(w)).withColumn("bm", F.lag("mask").over(w)).filter("bx IS NOT NULL")
    named = p.select(
        bins.distance_bin("x", "mask", "bx", "bm").alias("distance"),
        bins.facing("x", F.col("mask") % 3 - 1, "bx", F.col("bm") % 3 - 1).alias("facing"),
        bins.stock_relation(F.col("mask") % 4, F.col("bm") % 4).alias("stocks"),
    )
    return coverage.counts(named, "distance", "facing", "stocks")


@query(
    f"""WITH {T} SELECT session, count(*) AS n, count(*) FILTER (state = 'click') AS clicks, count(*) FILTER (x > 50) AS large,
    round(count(*) FILTER (state = 'click') / greatest(1, count(*))::DOUBLE, 6) AS clicks_share, round(count(*) FILTER (x > 50) / greatest(1, count(*))::DOUBLE, 6) AS large_share FROM t GROUP BY session"""
)
def ratio_summary(spark, d):
    out = metrics.ratio_summary(_ticks(spark, d), "session", clicks=F.col("state") == "click", large=F.col("x") > 50)
    return out.withColumn("clicks_share", F.round("clicks_share", 6)).withColumn("large_share", F.round("large_share", 6))


@query(f"WITH {T}, c AS (SELECT session, state, count(*) AS n FROM t GROUP BY ALL) SELECT session, CAST(sum(n) AS BIGINT) AS rows, string_agg(state || ':' || n, ',' ORDER BY state) AS flags FROM c GROUP BY session")
def session_flags(spark, d):
    out = coverage.session_summary(_ticks(spark, d), "state")
    flags = F.array_join(F.transform(F.map_entries("flags"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return out.select("session", "rows", flags.alias("flags"))


# Summaries


@query(
    """SELECT l_returnflag, count(l_quantity) AS n, min(l_quantity) AS low, quantile_disc(l_quantity, 0.5) AS median, quantile_disc(l_quantity, 0.95) AS p95, max(l_quantity) AS high
    FROM lineitem GROUP BY l_returnflag"""
)
def nearest_rank_summary(spark, d):
    return summary.spread_summary(table(spark, d, "lineitem"), "l_quantity", "l_returnflag")


@query("SELECT l_returnflag, count(*) FILTER (l_extendedprice > 50000) AS over FROM lineitem GROUP BY l_returnflag")
def over_threshold(spark, d):
    return summary.over(table(spark, d, "lineitem"), "l_extendedprice", 50000.0, "l_returnflag")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def status_histogram(spark, d):
    return summary.histogram(table(spark, d, "orders"), "o_orderstatus")


@query("SELECT source, count(*) AS scanned, count(*) FILTER (lang = 'en') AS matched, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (source)")
def folder_rollup(spark, d):
    return summary.rolled_up(table(spark, d, "documents"), "source", scanned=F.count("*"), matched=F.count_if(F.col("lang") == "en"), chars=F.sum("n_chars"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def latest_per_key(spark, d):
    return summary.latest(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    f"""WITH {T}, c AS (SELECT session, state, count(*) AS n FROM t GROUP BY ALL)
    SELECT session, state, n FROM c QUALIFY row_number() OVER (PARTITION BY session ORDER BY n DESC, state) = 1"""
)
def dominant_category(spark, d):
    return summary.dominant(_ticks(spark, d), "session", "state").select("session", "state", "n")


@query(
    """WITH o AS (SELECT o_custkey, count(*) AS stocks FROM orders GROUP BY 1), p AS (SELECT c_nationkey AS session, c_custkey AS player, stocks, c_acctbal AS percent FROM customer LEFT JOIN o ON c_custkey = o_custkey),
    r AS (SELECT *, row_number() OVER w AS place, lead(coalesce(stocks, -1)) OVER w AS ns, lead(coalesce(percent, 'inf'::DOUBLE)) OVER w AS np FROM p WINDOW w AS (PARTITION BY session ORDER BY coalesce(stocks, -1) DESC, coalesce(percent, 'inf'::DOUBLE), player))
    SELECT session, player, place, max(CASE WHEN place = 1 AND NOT coalesce(ns = coalesce(stocks, -1) AND np = coalesce(percent, 'inf'::DOUBLE), false) THEN player END) OVER (PARTITION BY session) AS winner FROM r"""
)
def player_ranking(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("player")).agg(F.count("*").alias("stocks"))
    people = table(spark, d, "customer").select(F.col("c_nationkey").alias("session"), F.col("c_custkey").alias("player"), F.col("c_acctbal").alias("percent")).join(n, "player", "left")
    return summary.ranked(people).select("session", "player", F.col("place").cast("long").alias("place"), "winner")


@query(
    """WITH o AS (SELECT o_custkey, count(*) AS stocks FROM orders GROUP BY 1), p AS (SELECT c_nationkey AS session, c_mktsegment AS team, stocks FROM customer LEFT JOIN o ON c_custkey = o_custkey),
    g AS (SELECT session, team, sum(stocks) AS s, bool_or(stocks IS NULL) AS u FROM p GROUP BY ALL),
    r AS (SELECT *, row_number() OVER w AS rn, lead(s) OVER w AS nxt, bool_or(u) OVER (PARTITION BY session) AS unsure FROM g WINDOW w AS (PARTITION BY session ORDER BY s DESC NULLS LAST, team))
    SELECT session, CASE WHEN NOT unsure AND NOT coalesce(nxt = s, false) THEN team END AS winner FROM r WHERE rn = 1"""
)
def team_winners(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("stocks"))
    people = table(spark, d, "customer").join(n, "c_custkey", "left")
    return summary.team_winner(people.select(F.col("c_nationkey").alias("session"), F.col("c_mktsegment").alias("team"), "stocks"))


@query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_returnflag = 'A') AND bool_or(l_returnflag = 'N') AND bool_or(l_returnflag = 'R')")
def complete_groups(spark, d):
    flag = F.col("l_returnflag")
    return summary.having_all(table(spark, d, "lineitem"), "l_orderkey", a=flag == "A", n=flag == "N", r=flag == "R")


@query("SELECT o_orderpriority || '/' || o_orderstatus AS batch, substr(sha256(string_agg(CAST(o_orderkey AS VARCHAR), chr(10) ORDER BY CAST(o_orderkey AS VARCHAR))), 1, 20) AS batch_key FROM orders GROUP BY 1")
def batch_key(spark, d):
    own = table(spark, d, "orders").withColumn("batch", F.concat_ws("/", "o_orderpriority", "o_orderstatus"))
    return summary.batch_key(own, "batch", "o_orderkey")


@query(
    """SELECT source, sha256(string_agg(sha256(text), chr(10) ORDER BY doc_id)) AS hash FROM documents GROUP BY source"""
)
def content_hashes(spark, d):
    return summary.content_hash(table(spark, d, "documents"), "source", "doc_id", "text")


@query("SELECT l_returnflag, CAST(sum(l_partkey * 7 + l_linenumber) AS BIGINT) AS checksum FROM lineitem GROUP BY l_returnflag")
def row_checksum(spark, d):
    return summary.checksum(table(spark, d, "lineitem"), F.col("l_partkey") * 7 + F.col("l_linenumber"), "l_returnflag")


@query(
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate, concat_ws(',', CASE WHEN l_discount > 0.05 THEN 'discount' END, CASE WHEN l_quantity > 40 THEN 'quantity' END, CASE WHEN l_tax < 0.02 THEN 'tax' END) AS errors FROM lineitem"""
)
def rule_report(spark, d):
    rules = {"tax": F.col("l_tax") < F.lit(0.02), "quantity": F.col("l_quantity") > 40, "discount": F.col("l_discount") > F.lit(0.05)}
    out = summary.violations(table(spark, d, "lineitem"), rules)
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate", F.array_join("errors", ",").alias("errors"))


# Joins and sets


@query("SELECT doc_id, n_chars, filled FROM (SELECT doc_id, n_chars, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS filled, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE filled <= 20000 OR rn = 1")
def batch_fill(spark, d):
    out = windows.prefix_fill(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "n_chars", 20000, ("doc_id",), ("source",))
    return out.select("doc_id", "n_chars", "filled")


@query(
    """WITH m AS (SELECT doc_id, quality, CASE WHEN toxic = 1 THEN 'skipped' END AS artifact FROM labels)
    SELECT source, count(*) AS rows, count(*) FILTER (artifact IS DISTINCT FROM 'skipped') AS kept, bool_and(quality = 1) AS complete FROM documents JOIN m USING (doc_id) GROUP BY source"""
)
def commit_pairs(spark, d):
    own = table(spark, d, "labels").withColumn("artifact", F.when(F.col("toxic") == 1, "skipped"))
    met = table(spark, d, "documents").join(own, "doc_id")
    return met.groupBy("source").agg(F.count("*").alias("rows"), F.count_if(~F.col("artifact").eqNullSafe(F.lit("skipped"))).alias("kept"), F.bool_and(F.col("quality") == 1).alias("complete"))


@query("SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def pending_anti(spark, d):
    return joins.pending(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), ["doc_id"])


@query("(SELECT 'both' AS side, doc_id FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE quality = 1)) UNION ALL (SELECT 'missing', doc_id FROM (SELECT doc_id FROM documents WHERE lang = 'en' EXCEPT SELECT doc_id FROM labels))")
def uploaded_intersect(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    both = docs.select("doc_id").intersect(labels.filter("quality = 1").select("doc_id")).select(F.lit("both").alias("side"), "doc_id")
    return both.unionAll(docs.filter("lang = 'en'").select("doc_id").subtract(labels.select("doc_id")).select(F.lit("missing"), "doc_id"))


@query(
    f"""WITH {T}, i AS (SELECT o_custkey AS session, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS image FROM orders GROUP BY 1)
    SELECT t.session, t.idx, i.image FROM t JOIN i USING (session)"""
)
def frame_image_join(spark, d):
    images = table(spark, d, "orders").select(F.col("o_custkey").alias("session"), F.struct("o_orderdate", "o_orderkey").alias("position"), F.col("o_orderkey").alias("image"))
    return joins.latest_image_join(_ticks(spark, d), images, "session").select("session", "idx", "image")


@query(
    """WITH a AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS place FROM benchmark), b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place FROM documents)
    SELECT place, item_id, doc_id FROM a JOIN b USING (place)"""
)
def positional_join(spark, d):
    out = joins.by_place(table(spark, d, "benchmark").select("item_id"), table(spark, d, "documents").select("doc_id"), ("item_id",), ("doc_id",))
    return out.select(F.col("place").cast("long").alias("place"), "item_id", "doc_id")


@query(
    """SELECT a.n_nationkey, string_agg(b.n_name, ',' ORDER BY b.n_nationkey) AS opponents FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey GROUP BY a.n_nationkey"""
)
def opponents_in_tick(spark, d):
    out = joins.opponents(table(spark, d, "nation"), ["n_regionkey"], "n_nationkey", ["n_name"])
    return out.select("n_nationkey", F.array_join(F.transform("opponents", lambda o: o["n_name"]), ",").alias("opponents"))


@query(
    f"""WITH {T}, f AS (SELECT *, x > 40 AS flag FROM t), s AS (SELECT *, CASE WHEN flag AND NOT coalesce(lag(flag) OVER (PARTITION BY session ORDER BY idx), false) THEN 1 ELSE 0 END AS start FROM f),
    r AS (SELECT *, sum(start) OVER (PARTITION BY session ORDER BY idx) AS run FROM s),
    g AS (SELECT session, min(idx) AS a, max(idx) + 2 AS b, row_number() OVER (PARTITION BY session ORDER BY min(idx)) AS ordinal FROM r WHERE flag GROUP BY session, run)
    SELECT t.session, t.idx, max(g.ordinal) AS ordinal FROM t JOIN g ON t.session = g.session AND t.idx BETWEEN g.a AND g.b GROUP BY ALL"""
)
def interval_roles(spark, d):
    t = _ticks(spark, d)
    runs = islands.runs(t, ("session",), "idx", F.col("x") > 40)
    spans = runs.select("session", F.col("start").alias("a"), (F.col("end") + 2).alias("b"), F.row_number().over(Window.partitionBy("session").orderBy("start")).cast("long").alias("ordinal"))
    return joins.in_intervals(t.select("session", "idx"), spans, "session", "idx", "a", "b", "ordinal")


@query(
    """WITH a AS (SELECT doc_id, CAST(n_chars % 2 AS INTEGER) AS v FROM documents), b AS (SELECT doc_id, quality AS v FROM labels)
    SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN a.doc_id IS NULL THEN 'unexpected' ELSE 'different' END AS verdict
    FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.v IS DISTINCT FROM b.v"""
)
def checksum_compare(spark, d):
    left = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("v"))
    return joins.compared(left, table(spark, d, "labels").select("doc_id", F.col("quality").alias("v")), "doc_id", "v").select("doc_id", "verdict")


@query("SELECT md5(text) AS content_key, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def content_dedup(spark, d):
    return splits.content_unique(table(spark, d, "documents"), "text", "doc_id").select("content_key", "doc_id")


@query("SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source")
def first_occurrence(spark, d):
    return sets.first_of(table(spark, d, "documents").select("source", "doc_id"), ["source"], "doc_id")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return sets.duplicates(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT url, row_number() OVER (ORDER BY url, page_id) - 1 AS sample FROM pages")
def numbered_references(spark, d):
    return sets.numbered(table(spark, d, "pages").select("url", "page_id"), "url", "page_id").select("url", "sample")


# Plans


@query("SELECT doc_id, draw, row_number() OVER (ORDER BY draw, doc_id) - 1 AS target FROM (SELECT doc_id, md5('28|' || doc_id) AS draw FROM documents ORDER BY 2, 1 LIMIT 50)")
def seeded_sample(spark, d):
    return splits.seeded_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 28, 50).select("doc_id", "draw", F.col("target").cast("long").alias("target"))


@query(
    """WITH g AS (SELECT source, max(doc_id) AS m FROM documents GROUP BY source), h AS (SELECT source FROM g ORDER BY m DESC, source LIMIT 1)
    SELECT doc_id, source, CASE WHEN source = (SELECT source FROM h) THEN 'eval' ELSE 'train' END AS split FROM documents"""
)
def group_holdout(spark, d):
    return splits.group_holdout(table(spark, d, "documents").select("doc_id", "source"), "source", order="doc_id")


@query("(SELECT doc_id, 'train' AS split FROM documents ORDER BY doc_id LIMIT 100) UNION ALL (SELECT doc_id, 'eval' FROM documents ORDER BY doc_id DESC LIMIT 20)")
def head_tail_split(spark, d):
    return splits.head_tail(table(spark, d, "documents").select("doc_id"), 100, 20, "doc_id")


@query("SELECT doc_id, CAST(doc_id % 4 AS BIGINT) AS rank, CAST((doc_id // 4) % 3 AS BIGINT) AS worker, CAST(doc_id % 7 AS BIGINT) AS slot FROM documents")
def stride_assignment(spark, d):
    rank, worker = splits.strided("doc_id", 4, 3)
    return table(spark, d, "documents").select("doc_id", rank.cast("long").alias("rank"), worker.cast("long").alias("worker"), splits.slot("doc_id", 7).cast("long").alias("slot"))


@query()
def shard_permutation(spark, d):
    return splits.shuffled(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", seed=3, epoch=1)


@query()
def shard_plan(spark, d):
    sizes = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return shards.planned(sizes, "source", "n", 4)


# Metrics


@query(
    f"""WITH {T} SELECT session, idx // 16 AS "interval", count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, min(x) AS low, max(x) AS high FROM t GROUP BY ALL"""
)
def interval_metrics(spark, d):
    out = metrics.intervals(_ticks(spark, d), "x", 16, "idx", ("session",))
    return out.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query(
    """WITH e AS (SELECT unnest(generate_series(0, 4)) AS bin), b AS (SELECT CAST(floor(l_discount * 10 * 5) AS BIGINT) AS bin, l_quantity FROM lineitem WHERE l_discount * 10 < 1)
    SELECT e.bin, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean FROM e LEFT JOIN b USING (bin) GROUP BY e.bin"""
)
def tau_bins_half_open(spark, d):
    own = table(spark, d, "lineitem").withColumn("t", F.col("l_discount") * 10)
    return metrics.half_open_bins(own, "t", "l_quantity").withColumn("mean", F.round("mean", 6))


@query(
    """WITH e AS (SELECT unnest(generate_series(0, 4)) AS bin), b AS (SELECT CASE WHEN t <= 0.2::DOUBLE THEN 0 WHEN t <= 0.4::DOUBLE THEN 1 WHEN t <= 0.6::DOUBLE THEN 2 WHEN t <= 0.8::DOUBLE THEN 3 ELSE 4 END AS bin, l_quantity
    FROM (SELECT l_discount * 10 AS t, l_quantity FROM lineitem)) SELECT e.bin, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean FROM e LEFT JOIN b USING (bin) GROUP BY e.bin"""
)
def tau_bins_right_closed(spark, d):
    own = table(spark, d, "lineitem").withColumn("t", F.col("l_discount") * 10)
    return metrics.right_closed_bins(own, "t", "l_quantity").withColumn("mean", F.round("mean", 6))


@query("SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean FROM lineitem GROUP BY l_returnflag")
def weighted_mean(spark, d):
    return metrics.weighted_mean(table(spark, d, "lineitem"), "l_discount", "l_quantity", "l_returnflag").withColumn("mean", F.round("mean", 6))


@query("SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY 1")
def rank_reduction(spark, d):
    own = table(spark, d, "orders").select("o_orderpriority", F.col("o_totalprice").alias("total"), F.col("o_orderkey").alias("first"), F.col("o_orderkey").alias("last"))
    return metrics.reduced(own, "o_orderpriority", {"total": "sum", "first": "min", "last": "max"}).withColumn("total", F.round("total", 2))


@query(
    f"""WITH {T}, g AS (SELECT session % 5 AS part, state, count(*) AS n, avg(x) AS m FROM t GROUP BY ALL)
    SELECT part, state, n, round(m, 6) AS mean, round(m - max(CASE WHEN state = 'view' THEN m END) OVER (PARTITION BY part), 6) AS delta FROM g"""
)
def effect_delta(spark, d):
    own = _ticks(spark, d).withColumn("part", F.col("session") % 5)
    out = metrics.effects(own, "x", "state", "view", "part")
    return out.withColumn("mean", F.round("mean", 6)).withColumn("delta", F.round("delta", 6))


@query(
    f"""WITH {T}, n AS (SELECT *, count(*) OVER (PARTITION BY session) AS n FROM t)
    SELECT session, round(sum(0.1::DOUBLE * pow(0.9::DOUBLE, n - 1 - idx) * x), 6) AS ema FROM n GROUP BY session"""
)
def scalar_ema(spark, d):
    return windows.ema(_ticks(spark, d), "x", 0.9).withColumn("ema", F.round("ema", 6))


@query(
    f"""WITH {T}, n AS (SELECT *, count(*) OVER (PARTITION BY session) AS n FROM t)
    SELECT session, round(sum(pow(0.9::DOUBLE, n - 1 - idx) * x) / sum(pow(0.9::DOUBLE, n - 1 - idx)), 6) AS ema FROM n GROUP BY session"""
)
def bias_corrected_ema(spark, d):
    return windows.unbiased_ema(_ticks(spark, d), "x", 0.9).withColumn("ema", F.round("ema", 6))


@query(
    f"""WITH {T}, f AS (SELECT session, min(idx) AS idx FROM (SELECT session % 13 AS session, idx FROM t) GROUP BY session), n AS (SELECT idx, count(*) AS new FROM f GROUP BY idx),
    s AS (SELECT DISTINCT idx FROM t) SELECT idx, coalesce(new, 0) AS new, CAST(sum(coalesce(new, 0)) OVER (ORDER BY idx) AS BIGINT) AS seen FROM s LEFT JOIN n USING (idx)"""
)
def seen_samples(spark, d):
    own = _ticks(spark, d).withColumn("session", F.col("session") % 13)
    return metrics.seen_samples(own, "session", "idx")


@query(f"WITH {T} SELECT session, idx, min(x) OVER (PARTITION BY session ORDER BY idx) AS best FROM t")
def best_so_far(spark, d):
    return metrics.best_so_far(_ticks(spark, d), "x", "idx", ("session",)).select("session", "idx", "best")


@query(
    f"""WITH {T}, r AS (SELECT idx // 20 AS "interval", mask AS clips, x AS seconds, x / 2 AS wait FROM t)
    SELECT "interval", round(sum(clips) / sum(seconds), 6) AS clips_per_second, max(wait) AS wait_max, round(sum(wait) / count(*), 6) AS wait_per_step, round(sum(wait) / sum(clips), 6) AS wait_per_clip FROM r GROUP BY 1"""
)
def throughput_intervals(spark, d):
    own = _ticks(spark, d).select("idx", F.col("mask").alias("clips"), F.col("x").alias("seconds"), (F.col("x") / 2).alias("wait"))
    out = metrics.throughput(own, 20, step="idx")
    for c in ("clips_per_second", "wait_per_step", "wait_per_clip"):
        out = out.withColumn(c, F.round(c, 6))
    return out


# Vectors


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS similarity FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q")
def cosine_to_query(spark, d):
    rows = table(spark, d, "embeddings")
    found = vectors.similarity_to(rows, "embedding", vectors.example_vector(rows, "vec_id", 0, "embedding"))
    return found.select("vec_id", F.round("similarity", 5).alias("similarity"))


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS similarity FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, vec_id LIMIT 10")
def nearest_vectors(spark, d):
    rows = table(spark, d, "embeddings")
    found = vectors.nearest(rows, "vec_id", "embedding", vectors.example_vector(rows, "vec_id", 0, "embedding"), 10)
    return found.select("vec_id", F.round("similarity", 5).alias("similarity"))


@query(
    """WITH p AS (SELECT a.vec_id, list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: z[1] - z[2]) AS e FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
    SELECT vec_id, round(list_sum(list_transform(e, lambda v: v * v)) / len(e), 6) AS mse, round(list_sum(list_transform(e, lambda v: abs(v))) / len(e), 6) AS mae FROM p"""
)
def vector_error(spark, d):
    rows = table(spark, d, "embeddings")
    pairs = rows.select("vec_id", F.col("embedding").alias("a")).join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return pairs.select("vec_id", F.round(arrays.mean_squared_error("a", "b"), 6).alias("mse"), F.round(arrays.mean_absolute_error("a", "b"), 6).alias("mae"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda v: v * v))), 5) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda v: v * v))), 5) AS first FROM embeddings")
def vector_norms(spark, d):
    rows = table(spark, d, "embeddings")
    return rows.select("vec_id", F.round(arrays.norm("embedding"), 5).alias("norm"), F.round(F.element_at(arrays.normalised("embedding"), 1), 5).alias("first"))


@query(
    """WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS n, b.embedding::DOUBLE[] AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
    SELECT vec_id, round(0.75 * n[1] + 0.25 * d[1], 5) AS point, round(d[1] - n[1], 5) AS velocity FROM p"""
)
def flow_points(spark, d):
    rows = table(spark, d, "embeddings")
    pairs = rows.select("vec_id", F.col("embedding").alias("n")).join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("d")), "vec_id")
    point, velocity = arrays.interpolated("n", "d", F.lit(0.25))
    return pairs.select("vec_id", F.round(F.element_at(point, 1), 5).alias("point"), F.round(F.element_at(velocity, 1), 5).alias("velocity"))


@query(
    f"""WITH {T}, q AS (SELECT quantile_cont(x, 0.02) AS lo, quantile_cont(x, 0.98) AS hi FROM t)
    SELECT session, idx, round(greatest(0, least(1, (x - lo) / greatest(hi - lo, 1e-12::DOUBLE))) * 255, 4) AS scaled FROM t, q"""
)
def quantile_rescale(spark, d):
    out = vectors.quantile_rescaled(_ticks(spark, d), "x", scale=255.0)
    return out.select("session", "idx", F.round("scaled", 4).alias("scaled"))


@query("WITH s AS (SELECT avg(x) AS m, stddev_samp(x) AS sd FROM (SELECT unnest(embedding::DOUBLE[]) AS x FROM embeddings)) SELECT vec_id, round((embedding[1]::DOUBLE - m) / sd, 4) AS first FROM embeddings, s")
def standardised_vectors(spark, d):
    rows = table(spark, d, "embeddings")
    stats = rows.select(F.explode(F.col("embedding").cast("array<double>")).alias("x")).agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("sd")).first()
    return rows.select("vec_id", F.round(F.element_at(arrays.standardised("embedding", stats["m"], stats["sd"]), 1), 4).alias("first"))


@query()
def projected_codes(spark, d):
    return vectors.projected(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", 8).select("vec_id", "code", "scale")


# Text


_KEY = "trim(regexp_replace(replace(upper({0}), '&', ' AND '), '[^A-Z0-9]+', ' ', 'g'))"


@query(f"SELECT p_partkey, {_KEY.format('p_name')} AS key FROM part")
def key_normalise(spark, d):
    return table(spark, d, "part").select("p_partkey", text.key("p_name").alias("key"))


@query("SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'item') AS slug FROM pages")
def slug_ids(spark, d):
    return table(spark, d, "pages").select("page_id", text.slug("url").alias("slug"))


@query(
    """WITH p AS (SELECT page_id, list_filter(string_split(url, '/'), lambda v: v <> '' AND v <> '.') AS a FROM pages)
    SELECT page_id, array_to_string(a[1:2], '/') AS owner, coalesce(array_to_string(a[3:], '/'), '') AS prefix FROM p"""
)
def path_components(spark, d):
    owner, prefix = text.location("url")
    return table(spark, d, "pages").select("page_id", owner.alias("owner"), prefix.alias("prefix"))


@query(
    """SELECT doc_id, split_part(source || '::' || lang, '::', 2) AS member, lang IN ('en', 'de') AND source <> 'src0' AS included FROM documents"""
)
def reference_parts(spark, d):
    ref = F.concat_ws("::", "source", "lang")
    path = F.concat_ws("/", "source", "lang")
    return table(spark, d, "documents").select("doc_id", text.reference(ref)[1].alias("member"), text.included(path, ["*/en", "*/de"], ["src0/*"]).alias("included"))


@query(
    """WITH s AS (SELECT doc_id, list_sort(list_distinct(list_concat(regexp_extract_all(lower(text), '[a-z]{6,}'), regexp_extract_all(lower(source || ' ' || coalesce(lang, '')), '[a-z]{2,}')))) AS a FROM documents)
    SELECT doc_id, array_to_string(a, ',') AS words FROM s"""
)
def char_union(spark, d):
    words = lambda c, n: F.regexp_extract_all(F.lower(c), F.lit(f"([a-z]{{{n},}})"), F.lit(1))
    both = F.array_sort(F.array_union(words(F.col("text"), 6), words(F.concat_ws(" ", "source", "lang"), 2)))
    return table(spark, d, "documents").select("doc_id", F.array_join(both, ",").alias("words"))


@query("SELECT c_custkey, printf('%d:%02d.%03d', CAST(floor(round(abs(c_acctbal) * 1000) / 60000) AS BIGINT), CAST(floor(round(abs(c_acctbal) * 1000) / 1000) AS BIGINT) % 60, CAST(round(abs(c_acctbal) * 1000) AS BIGINT) % 1000) AS clock, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS name FROM customer")
def formatted_names(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.clock(F.abs("c_acctbal")).alias("clock"), text.numbered("c_custkey", 8).alias("name"))


@query(f"WITH {T} SELECT session, idx, " + " || ".join(f"CAST((mask >> {k}) & 1 AS VARCHAR)" for k in range(BITS)) + f" AS bits, CAST(bit_count(mask) AS BIGINT) AS ones FROM t")
def unpack_bits(spark, d):
    return _ticks(spark, d).select("session", "idx", F.array_join(bits.unpacked("mask", BITS).cast("array<string>"), "").alias("bits"), bits.popcount("mask").alias("ones"))


@query(f"WITH {T} SELECT session, idx, array_to_string(list_filter([CASE WHEN mask & 1 > 0 THEN 'a' END, CASE WHEN mask & 2 > 0 THEN 'b' END, CASE WHEN mask & 32 > 0 THEN 'x' END], lambda v: v IS NOT NULL), ',') AS names FROM t")
def bit_names(spark, d):
    return _ticks(spark, d).select("session", "idx", F.array_join(bits.names("mask", {1: "a", 2: "b", 32: "x"}), ",").alias("names"))


@query(f"WITH {T} SELECT session, idx, CASE WHEN mask % 2 = 0 THEN mask * 2 ELSE mask * 2 - 1 END AS zigzag, CAST(ceil(greatest(1, length(ltrim(bin(mask), '0'))) / 7.0) AS BIGINT) AS varint_bytes FROM t")
def zigzag_varint(spark, d):
    signed = F.when(F.col("mask") % 2 == 0, F.col("mask")).otherwise(-F.col("mask"))
    return _ticks(spark, d).select("session", "idx", bits.zigzag(signed).alias("zigzag"), F.octet_length(bits.varint("mask")).cast("long").alias("varint_bytes"))


@query(f"""WITH {T} SELECT session, idx, sha256('{{"mask":' || mask || ',"state":"' || state || '"}}') AS hash FROM t""")
def canonical_hash(spark, d):
    doc = hashes.canonical_json({"state": hashes.json_text("state"), "mask": hashes.json_number("mask")})
    return _ticks(spark, d).select("session", "idx", hashes.sha256(doc).alias("hash"))


@query("SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def content_digests(spark, d):
    return table(spark, d, "documents").select("doc_id", hashes.sha256("text").alias("sha256"), F.md5(F.col("text").cast("binary")).alias("md5"))


@query(
    """SELECT o_orderkey, CASE WHEN o_totalprice / 1000 < 20 THEN false ELSE true END AS slow, round(least(60.0::DOUBLE, pow(2.0::DOUBLE, o_orderkey % 8)), 6) AS delay,
    round(least(1.0::DOUBLE, (o_orderkey % 500) / 200.0::DOUBLE), 6) AS warm, o_orderkey % 700 >= greatest(600, ceil((o_orderkey % 900) * 0.75::DOUBLE)) AS recovered FROM orders"""
)
def schedules(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        "o_orderkey",
        (F.col("o_totalprice") / 1000 >= 20).alias("slow"),
        F.round(numbers.backoff(k % 8), 6).alias("delay"),
        F.round(numbers.warmup(k % 500, 200), 6).alias("warm"),
        numbers.recovered(F.lit(0), k % 900, k % 700).alias("recovered"),
    )


@query("SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN lower(c_mktsegment) ELSE 'unknown(' || c_mktsegment || ')' END AS segment FROM customer")
def dictionary_lookup(spark, d):
    return table(spark, d, "customer").select("c_custkey", bins.looked_up("c_mktsegment", {"BUILDING": "building", "MACHINERY": "machinery"}).alias("segment"))


# Event time


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS start FROM events),
    r AS (SELECT *, sum(start) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM r GROUP BY user_id, run"""
)
def session_windows(spark, d):
    return streams.sessions(table(spark, d, "events"), "6 hours", "user_id")


@query("SELECT date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def tumbling_windows(spark, d):
    return streams.tumbling(table(spark, d, "events"), "1 hour").withColumn("total", F.round("total", 4))


@query(
    """SELECT date_trunc('hour', ts) - INTERVAL (k) HOUR AS start, event_type, count(*) AS n FROM events, (SELECT unnest(generate_series(0, 1)) AS k) GROUP BY ALL"""
)
def sliding_windows(spark, d):
    return streams.sliding(table(spark, d, "events"), "2 hours", "1 hour", None, "ts", "event_type")


@query(f"WITH {T} SELECT session, (idx * 2 // 3) AS step, count(DISTINCT idx * 2) AS ticks, 3 - count(DISTINCT idx * 2) AS missing, count(*) - count(DISTINCT idx * 2) AS repeated FROM t GROUP BY ALL")
def count_windows(spark, d):
    return streams.count_windows(_ticks(spark, d).withColumn("tick", F.col("idx") * 2))


# Further operators


@query(
    f"""WITH {T}, p AS (SELECT session, idx, x, state, mask, lag(x) OVER (PARTITION BY session ORDER BY idx) AS bx FROM t)
    SELECT session, idx, coalesce(mask % 5 = 0 AND mask % 2 = 0 AND abs(x - bx) < 20, false) AS still FROM p"""
)
def stillness(spark, d):
    zero = [F.lit(0.0).alias(c) for c in ("stick_x", "stick_y", "cstick_x", "cstick_y", "y")]
    own = _ticks(spark, d).select("session", F.lit(0).alias("player"), F.col("idx").alias("frame"), (F.col("mask") % 5).alias("state"), (F.col("mask") % 2 == 1).alias("airborne"), F.lit(0).cast("long").alias("buttons"), "x", *zero)
    return islands.still(own, waiting=0, move=20.0).select("session", F.col("frame").alias("idx"), "still")


@query(
    f"""WITH {T}, n AS (SELECT session, count(*) AS n FROM t GROUP BY session)
    SELECT session, clip, clip * 5 + 4 AS "first", clip * 5 + 13 AS "last" FROM n, unnest(generate_series(0, least(3, 1 + (n - 4 - 10) // 5) - 1)) AS u(clip) WHERE n >= 14"""
)
def offset_clips(spark, d):
    sizes = _ticks(spark, d).groupBy("session").agg(F.count("*").alias("n"))
    return windows.clips(sizes, 10, 5, offset=4, cap=3).select("session", "clip", "first", "last")


@query(
    """SELECT o_orderkey, round(CASE WHEN o_orderkey % 1000 < 100 THEN (o_orderkey % 1000 + 1) / 100.0::DOUBLE
    ELSE 0.1::DOUBLE + 0.9::DOUBLE * 0.5::DOUBLE * (1 + cos(pi() * least(1.0::DOUBLE, (o_orderkey % 1000 - 100) / 700.0::DOUBLE))) END, 6) AS factor FROM orders"""
)
def cosine_schedule(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(numbers.warmup_cosine(F.col("o_orderkey") % 1000, 100, 800, 0.1), 6).alias("factor"))


@query("SELECT 'k' AS path, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS DOUBLE) AS total FROM events")
def deep_totals(spark, d):
    return coverage.deep_sum(table(spark, d, "events"), "props")


@query(f"WITH {T} SELECT session, count(*) FILTER (x > 50) AS large, count(*) FILTER (state = 'click') AS clicks, count(*) FILTER (mask % 2 = 1) AS odd FROM t GROUP BY session")
def flag_counts(spark, d):
    return coverage.flags(_ticks(spark, d), {"large": F.col("x") > 50, "clicks": F.col("state") == "click", "odd": F.col("mask") % 2 == 1}, "session")


def _episodes(spark: SparkSession, d: str) -> DataFrame:
    """Orders as episodes: their lines are the hits."""
    hit = F.struct(F.col("l_returnflag").alias("name"), F.col("l_linenumber").alias("hit_count"), F.col("l_quantity").alias("damage"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.collect_list(hit).alias("hits"), F.min("l_linenumber").alias("start"), F.max("l_linenumber").alias("last_hit"), F.min("l_discount").alias("start_percent"))
    return lines.withColumn("end", F.col("last_hit") + 3).withColumn("killed", F.col("key") % 3 == 0)


@query(
    """WITH e AS (SELECT l_orderkey AS key, sum(l_linenumber) AS n, sum(l_quantity) AS damage, min(l_linenumber) AS a, max(l_linenumber) AS b, min(l_discount) AS p FROM lineitem GROUP BY 1)
    SELECT count(*) AS total, count(*) FILTER (key % 3 = 0) AS kills, count(*) FILTER (key % 3 = 0 AND p <= 0) AS zero_to_deaths, sum(damage) AS damage, CAST(sum(n) AS BIGINT) AS hits,
    CAST(sum(b - a + 1) AS BIGINT) AS tight_frames, CAST(sum(b - a + 4) AS BIGINT) AS frames, count(*) FILTER (n < 8) AS hits_few, count(*) FILTER (n >= 8) AS hits_many,
    count(*) FILTER (damage < 100) AS damage_low, count(*) FILTER (damage >= 100) AS damage_high FROM e"""
)
def episode_totals(spark, d):
    return coverage.combos(_episodes(spark, d), [(8, False, "few"), (None, False, "many")], [(100, False, "low"), (None, False, "high")])


@query("SELECT l_returnflag AS name, CAST(sum(l_linenumber) AS BIGINT) AS landed FROM lineitem GROUP BY 1")
def landed_moves(spark, d):
    return coverage.landed(_episodes(spark, d))


@query("SELECT l_returnflag AS name, count(DISTINCT l_orderkey) AS episodes FROM lineitem GROUP BY 1")
def moves_per_episode(spark, d):
    return coverage.landed(_episodes(spark, d), once=True)


@query(
    """WITH o AS (SELECT o_custkey AS session, o_orderkey AS frame, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 4 - 1 AS INTEGER) END AS owner, o_orderstatus AS kind FROM orders),
    p AS (SELECT *, lag(owner) OVER w AS before, row_number() OVER w AS rn FROM o WINDOW w AS (PARTITION BY session ORDER BY frame))
    SELECT session, arg_min(kind, frame) AS kind, min(frame) AS "first", max(frame) AS "last", count(DISTINCT owner) AS owners, count(*) FILTER (rn > 1 AND before IS NULL AND owner BETWEEN 0 AND 3) AS pickups FROM p GROUP BY session"""
)
def object_spans(spark, d):
    k = F.col("o_orderkey")
    own = table(spark, d, "orders").select(F.col("o_custkey").alias("session"), F.lit(0).alias("spawn"), k.alias("frame"), F.when(k % 4 != 0, (k % 4 - 1).cast("int")).alias("owner"), F.col("o_orderstatus").alias("kind"))
    return islands.object_spans(own).select("session", "kind", "first", "last", F.size("owners").cast("long").alias("owners"), "pickups")


@query(f"WITH {T} SELECT session, arg_min(x, idx) AS x FROM t WHERE x IS NOT NULL GROUP BY session")
def first_values(spark, d):
    return summary.first_present(_ticks(spark, d), "session", "x", "idx")


@query(
    f"""WITH {T}, p AS (SELECT session, (idx - 1) // 3 AS transition, idx, state, mask % 3 AS low, lag(state) OVER w AS bs, lag(mask % 3) OVER w AS bl, lag(idx) OVER w AS bi FROM t WHERE idx >= 1 WINDOW w AS (PARTITION BY session ORDER BY idx)),
    f AS (SELECT session, transition, bi IS NOT NULL AND state IS DISTINCT FROM bs AS a, bi IS NOT NULL AND low IS DISTINCT FROM bl AS b FROM p),
    g AS (SELECT session, transition, avg((a::INTEGER + b::INTEGER) / 2.0::DOUBLE) AS features, avg((a OR b)::INTEGER::DOUBLE) AS steps, bool_or(a OR b) AS hit FROM f GROUP BY ALL)
    SELECT round(avg(features), 6) AS features, round(avg(steps), 6) AS steps, round(avg(hit::INTEGER::DOUBLE), 6) AS actors, round(avg(hit::INTEGER::DOUBLE), 6) AS transitions FROM g"""
)
def change_shares(spark, d):
    own = _ticks(spark, d).filter("idx >= 1").select("session", F.floor((F.col("idx") - 1) / 3).alias("transition"), F.col("idx").alias("microstep"), F.lit(0).alias("player"), "state", (F.col("mask") % 3).alias("low"))
    out = metrics.change_shares(own, ["state", "low"])
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("SELECT (SELECT count(*) FROM documents) = (SELECT count(*) FROM labels) AS agree")
def cutover_counts(spark, d):
    return summary.equal_counts(documents=table(spark, d, "documents"), labels=table(spark, d, "labels")).select("agree")


@query("SELECT l_orderkey, count(*) AS entries, CAST(arg_min(l_suppkey, (l_shipdate, l_partkey, l_suppkey)) AS BIGINT) AS first_frame, CAST(arg_max(l_suppkey, (l_shipdate, l_partkey, l_suppkey)) AS BIGINT) AS last_frame, bool_or(l_linestatus = 'F') AS completed, sum(l_quantity) AS bytes FROM lineitem GROUP BY 1")
def manifest_totals(spark, d):
    own = table(spark, d, "lineitem").withColumn("at", F.struct("l_shipdate", "l_partkey", "l_suppkey"))
    return summary.manifest_totals(own, "l_orderkey", "at", "l_suppkey", "l_quantity", F.col("l_linestatus") == "F")


@query("SELECT doc_id, source, CAST(quality AS VARCHAR) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def enriched_documents(spark, d):
    return joins.enriched(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("quality")), ["doc_id"])


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'done' ELSE 'skipped' END AS status, CASE WHEN quality = 1 THEN NULL ELSE 'not available' END AS reason FROM documents LEFT JOIN labels USING (doc_id)")
def job_status(spark, d):
    return joins.done_or_skipped(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id", F.col("quality") == 1)


@query("SELECT p_partkey, n_nationkey FROM (SELECT *, 'a/' || p_partkey % 30 || '.bin' AS l FROM part) JOIN nation ON p_partkey % 30 = n_nationkey")
def stem_pairs(spark, d):
    left = table(spark, d, "part").withColumn("l", F.concat(F.lit("a/"), (F.col("p_partkey") % 30).cast("string"), F.lit(".bin")))
    right = table(spark, d, "nation").withColumn("r", F.concat(F.lit("b/c/"), F.col("n_nationkey").cast("string"), F.lit(".json")))
    return joins.stem_pairs(left, right, "l", "r").select("p_partkey", "n_nationkey")


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def dimension_lookup(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    own = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return own.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@query("SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE CAST(n_chars % 2 AS INTEGER) IS NOT DISTINCT FROM quality")
def matching_markers(spark, d):
    jobs = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("quality"))
    return joins.matching(jobs, table(spark, d, "labels").select("doc_id", "quality"), ["doc_id", "quality"]).select("doc_id")


@query(
    f"""WITH {T}, h AS (SELECT session // 2 AS pair, idx, count(*) AS n FROM t GROUP BY ALL)
    SELECT t.session, t.idx FROM t JOIN h ON t.session // 2 = h.pair AND t.idx = h.idx WHERE h.n = 2 AND t.idx >= 3"""
)
def complete_ticks(spark, d):
    own = _ticks(spark, d).withColumn("pair", F.floor(F.col("session") / 2))
    return ticks.complete(ticks.playable(own, "idx", 3), 2, ("pair", "idx")).select("session", "idx")


@query("SELECT p_partkey, (p_size // 10 > 2) OR (p_size // 10 = 2 AND p_size % 10 >= 5) AS new_enough FROM part")
def version_gate(spark, d):
    version = F.concat_ws(".", F.floor(F.col("p_size") / 10).cast("string"), (F.col("p_size") % 10).cast("string"))
    return table(spark, d, "part").select("p_partkey", text.version_at_least(version, "2.5").alias("new_enough"))


@query(
    """WITH b AS (SELECT user_id AS node, epoch(TIMESTAMP '2024-02-01') - epoch(max(ts)) AS age FROM events GROUP BY 1)
    SELECT node, CASE WHEN floor(age / 86400) < 1 THEN 'alive' WHEN floor(age / 86400) < 2 THEN 'unknown' ELSE 'dead' END AS state FROM b"""
)
def node_states(spark, d):
    from tickloom.streaming import health

    return health.node_states(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "2024-02-01 00:00:00", "user_id", stale=86400).select(F.col("user_id").alias("node"), "state")
